"""Closed, typed table queries: filter, inner join, group, aggregate, sort and series over keyed tables.

A plan is data.  ``check`` infers the result's schema without reading rows and
refuses what is not allowed, each refusal with a stable code and the place in
the plan; ``execute`` folds the same plan into lazy DataFrames.  Row order is
part of a table: it is carried as ordinal columns and restored only where a step
or the caller asks for it.
"""

from __future__ import annotations

import datetime
import decimal
import hashlib
import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.storage import Scratch

NUMBER, STRING, BOOLEAN, DATE = "number", "string", "boolean", "date"
#: Spark types of exact numbers; wide enough for sums of money at any scale.
DECIMAL = "decimal(38,6)"
_CASTS = {NUMBER: DECIMAL, STRING: "string", BOOLEAN: "boolean", DATE: "date"}
COMPARE = {"eq": "__eq__", "ne": "__ne__", "lt": "__lt__", "lte": "__le__", "gt": "__gt__", "gte": "__ge__"}
AGGREGATES = ("count", "sum", "mean", "min", "max")
#: Limits on a plan's shape; rows are not limited.
MOST_FIELDS, MOST_SOURCES, MOST_STEPS, MOST_PREDICATE_NODES = 128, 32, 128, 1024


class QueryError(ValueError):
    """A refused plan: a stable ``code`` and the ``path`` of what is at fault."""

    def __init__(self, code: str, path: str, message: str) -> None:
        super().__init__(f"{code} at {path}: {message}")
        self.code, self.path = code, path


@dataclass(frozen=True)
class Source:
    name: str
    fields: tuple[tuple[str, str], ...]
    key: tuple[str, ...]


@dataclass(frozen=True)
class Compare:
    op: str
    field: str
    value: object


@dataclass(frozen=True)
class Logic:
    op: str
    terms: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    input: str
    where: object


@dataclass(frozen=True)
class Join:
    """``on``: (left field, right field); ``select``: (side, field, new name); ``key``: of the result."""

    name: str
    left: str
    right: str
    on: tuple[tuple[str, str], ...]
    select: tuple[tuple[str, str, str], ...]
    key: tuple[str, ...]


@dataclass(frozen=True)
class Group:
    name: str
    input: str
    by: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Aggregate:
    """``values``: (function, field or None for count, new name)."""

    name: str
    input: str
    values: tuple[tuple[str, str | None, str], ...]


@dataclass(frozen=True)
class Sort:
    name: str
    input: str
    by: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Series:
    name: str
    input: str
    x: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Plan:
    sources: tuple[Source, ...]
    steps: tuple
    result: str


@dataclass
class _Shape:
    fields: dict[str, str]
    key: tuple[str, ...]
    kind: str = "table"
    group: tuple = field(default=())


def _need(ok: bool, code: str, path: str, message: str) -> None:
    if not ok:
        raise QueryError(code, path, message)


def _predicate_nodes(p) -> int:
    return 1 + sum(map(_predicate_nodes, p.terms)) if isinstance(p, Logic) else 1


def _check_predicate(p, shape: _Shape, path: str) -> None:
    if isinstance(p, Logic):
        _need(p.op in ("and", "or", "not"), "PREDICATE_OP", path, f"unknown {p.op}")
        _need(len(p.terms) == 1 if p.op == "not" else len(p.terms) >= 1, "PREDICATE_ARITY", path, "wrong number of terms")
        for i, t in enumerate(p.terms):
            _check_predicate(t, shape, f"{path}.terms[{i}]")
        return
    _need(p.op in COMPARE, "PREDICATE_OP", path, f"unknown {p.op}")
    _need(p.field in shape.fields, "UNKNOWN_FIELD", path, p.field)
    _need(shape.fields[p.field] != BOOLEAN or p.op in ("eq", "ne"), "PREDICATE_TYPE", path, "booleans have no order")
    _need(p.value is not None, "PREDICATE_VALUE", path, "a literal is needed")
    _need(_literal_fits(p.value, shape.fields[p.field]), "PREDICATE_TYPE", path, f"{p.value!r} is no {shape.fields[p.field]}")


def _literal_fits(value, kind: str) -> bool:
    if kind == NUMBER:
        return isinstance(value, (int, float, decimal.Decimal)) and not isinstance(value, bool)
    if kind == DATE and isinstance(value, str):
        try:
            return datetime.date.fromisoformat(value).isoformat() == value
        except ValueError:
            return False
    return isinstance(value, {STRING: str, BOOLEAN: bool, DATE: datetime.date}[kind]) and not isinstance(value, datetime.datetime)


def check(plan: Plan) -> _Shape:
    """The result's shape; raises QueryError for the first fault in authored order."""
    _need(0 < len(plan.sources) <= MOST_SOURCES, "SOURCE_COUNT", "sources", "too many or no sources")
    _need(len(plan.steps) <= MOST_STEPS, "STEP_COUNT", "steps", "too many steps")
    seen: dict[str, _Shape] = {}
    for i, s in enumerate(plan.sources):
        path, fields = f"sources[{i}]", dict(s.fields)
        _need(s.name not in seen, "DUPLICATE_NAME", path, s.name)
        _need(0 < len(s.fields) <= MOST_FIELDS and len(fields) == len(s.fields), "FIELDS", path, "fields must be named once, 1 to 128")
        _need(all(t in _CASTS for t in fields.values()), "FIELD_TYPE", path, "unknown type")
        _need(bool(s.key) and set(s.key) <= set(fields), "KEY", path, "the key must be of the fields")
        seen[s.name] = _Shape(fields, s.key)
    nodes = sum(_predicate_nodes(s.where) for s in plan.steps if isinstance(s, Filter))
    _need(nodes <= MOST_PREDICATE_NODES, "PREDICATE_SIZE", "steps", "too many predicate nodes")
    for i, s in enumerate(plan.steps):
        path = f"steps[{i}]"
        _need(s.name not in seen, "DUPLICATE_NAME", path, s.name)
        for name in (s.left, s.right) if isinstance(s, Join) else (s.input,):
            _need(name in seen, "UNKNOWN_INPUT", path, name)
            want = "group" if isinstance(s, Aggregate) else "table"
            _need(seen[name].kind == want, "INPUT_KIND", path, f"{name} is a {seen[name].kind}")
        if isinstance(s, Join):
            left, right = seen[s.left], seen[s.right]
            _need(bool(s.on), "JOIN_KEYS", path, "at least one key pair")
            for a, b in s.on:
                _need(a in left.fields and b in right.fields, "UNKNOWN_FIELD", path, f"{a} = {b}")
                _need(left.fields[a] == right.fields[b], "JOIN_TYPE", path, f"{a} and {b} differ in type")
            out = {}
            for side, f, new in s.select:
                _need(side in ("left", "right") and f in seen[getattr(s, side)].fields, "UNKNOWN_FIELD", path, f"{side}.{f}")
                _need(new not in out, "DUPLICATE_FIELD", path, new)
                out[new] = seen[getattr(s, side)].fields[f]
            _need(bool(s.key) and set(s.key) <= set(out), "KEY", path, "the key must be of the selected fields")
            seen[s.name] = _Shape(out, s.key)
            continue
        shape = seen[s.input]
        if isinstance(s, Filter):
            _check_predicate(s.where, shape, f"{path}.where")
            seen[s.name] = shape
        elif isinstance(s, Group):
            _need(bool(s.by) and all(f in shape.fields for f, _ in s.by), "GROUP_KEYS", path, "at least one known field")
            _need(len({new for _, new in s.by}) == len(s.by), "DUPLICATE_FIELD", path, "aliases repeat")
            _need(len({f for f, _ in s.by}) == len(s.by), "DUPLICATE_FIELD", path, "an input field repeats")
            seen[s.name] = _Shape(shape.fields, tuple(new for _, new in s.by), "group", s.by)
        elif isinstance(s, Aggregate):
            out = {new: shape.fields[f] for f, new in shape.group}
            for fn, f, new in s.values:
                _need(fn in AGGREGATES, "AGGREGATE", path, fn)
                _need((f is None) == (fn == "count") and (f is None or f in shape.fields), "UNKNOWN_FIELD", path, str(f))
                _need(fn not in ("sum", "mean") or shape.fields[f] == NUMBER, "AGGREGATE_TYPE", path, f"{fn} needs numbers")
                _need(fn not in ("min", "max") or shape.fields[f] != BOOLEAN, "AGGREGATE_TYPE", path, "booleans have no order")
                _need(new not in out, "DUPLICATE_FIELD", path, new)
                out[new] = NUMBER if fn in ("count", "sum", "mean") else shape.fields[f]
            seen[s.name] = _Shape(out, shape.key)
        elif isinstance(s, Sort):
            _need(bool(s.by) and all(f in shape.fields and d in ("asc", "desc") for f, d in s.by), "SORT_KEYS", path, "known fields, asc or desc")
            seen[s.name] = shape
        elif isinstance(s, Series):
            _need(s.x in shape.fields and shape.fields[s.x] != BOOLEAN, "SERIES_X", path, s.x)
            _need(bool(s.values) and all(shape.fields.get(v) == NUMBER for v in s.values), "SERIES_VALUES", path, "numbers are needed")
            seen[s.name] = _Shape(dict.fromkeys((*shape.key, s.x, *s.values)) and {c: shape.fields[c] for c in (*shape.key, s.x, *s.values)}, shape.key, "series")
        else:
            raise QueryError("STEP_KIND", path, type(s).__name__)
    _need(plan.result in seen, "UNKNOWN_RESULT", "result", plan.result)
    _need(seen[plan.result].kind != "group", "RESULT_KIND", "result", "a group must be aggregated")
    return seen[plan.result]


def plan_id(plan: Plan) -> str:
    """A digest that changes with every change of meaning, but not with the order in which sources are listed."""
    body = asdict(plan) | {"sources": sorted((asdict(s) for s in plan.sources), key=lambda s: s["name"]), "kinds": [type(s).__name__ for s in plan.steps]}
    return hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest()


def _column(p) -> Column:
    if isinstance(p, Logic):
        terms = [_column(t) for t in p.terms]
        return ~terms[0] if p.op == "not" else reduce((lambda a, b: a & b) if p.op == "and" else (lambda a, b: a | b), terms)
    return getattr(F.col(p.field), COMPARE[p.op])(F.lit(p.value))


def conformed(df: DataFrame, source: Source, ordinal: list[Column]) -> DataFrame:
    """A DataFrame as a source table: declared fields in declared types, and ``_ord``, a struct that orders the rows."""
    return df.select(*[F.col(f).cast(_CASTS[t]).alias(f) for f, t in source.fields], F.struct(*[c.alias(f"o{i}") for i, c in enumerate(ordinal)]).alias("_ord"))


def _assert_key(df: DataFrame, key: tuple[str, ...], code: str, path: str) -> None:
    """Refuses rows whose declared key is null or repeats, naming one of them."""
    lost = df.filter(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])).select(*key)
    again = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*key)
    if found := lost.unionByName(again).first():
        raise QueryError(code, path, f"the key {key} has {tuple(found)} as null or more than once")


def _ascending(c: Column, kind: str, direction: str) -> Column:
    """A value that orders upward as ``c`` does in ``direction``, with nulls where Spark has them."""
    if direction == "asc":
        return F.struct(c.isNotNull(), c)
    if kind == STRING:  # bytes inverted; an end mark behind them puts longer texts first
        turned = F.concat(F.translate(F.hex(F.encode(c, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    else:
        turned = {NUMBER: lambda: -c, BOOLEAN: lambda: ~c, DATE: lambda: -F.datediff(c, F.lit("1970-01-01").cast("date"))}[kind]()
    return F.struct(c.isNull(), turned)


def execute(plan: Plan, tables: dict[str, DataFrame], *, verify: bool = True) -> tuple[DataFrame, list[str]]:
    """The result with its order; ``tables`` are conformed sources by name.  ``ordered`` sorts it.

    A sort only notes by what to order.  Where a later join or group needs the
    sorted places, the sort's values go in front of the rows' ordinals, each
    turned so that it orders upward: nothing is ranked or gathered.

    With ``verify``, the declared keys of sources and join results are checked
    on the data, one aggregate each, before the result is returned.
    """
    check(plan)
    shapes = {s.name: check(Plan(plan.sources, plan.steps, s.name)) for s in (*plan.sources, *plan.steps) if not isinstance(s, Group)}
    seen, groups, sorts = dict(tables), {}, {}
    if verify:
        for i, source in enumerate(plan.sources):
            _assert_key(tables[source.name], source.key, "SOURCE_KEY", f"sources[{i}]")

    def placed(name: str) -> DataFrame:
        if name not in sorts:
            return seen[name]
        turned = [_ascending(F.col(c), kind, d).alias(f"s{i}") for i, (c, d, kind) in enumerate(sorts[name])]
        return seen[name].withColumn("_ord", F.struct(*turned, F.col("_ord").alias("rest")))

    for at, s in enumerate(plan.steps):
        if isinstance(s, (Filter, Series)) and s.input in sorts:
            sorts[s.name] = sorts[s.input]
        if isinstance(s, Filter):
            seen[s.name] = seen[s.input].filter(_column(s.where))
        elif isinstance(s, Join):
            left, right = placed(s.left), placed(s.right)
            left, right = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]), right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
            both = left.join(right, reduce(lambda a, b: a & b, [F.col(f"l_{a}") == F.col(f"r_{b}") for a, b in s.on]))
            seen[s.name] = both.select(*[F.col(f"{side[0]}_{f}").alias(new) for side, f, new in s.select], F.struct(F.col("l__ord").alias("l"), F.col("r__ord").alias("r")).alias("_ord"))
            if verify:
                _assert_key(seen[s.name], s.key, "JOIN_RESULT_KEY", f"steps[{at}]")
        elif isinstance(s, Group):
            groups[s.name] = (s.input, s.by)
        elif isinstance(s, Aggregate):
            source, by = groups[s.input]
            make = {"count": lambda f: F.count(F.lit(1)).cast(DECIMAL), "sum": F.sum, "min": F.min, "max": F.max, "mean": lambda f: (F.sum(f) / F.count(f)).cast(DECIMAL)}
            seen[s.name] = placed(source).groupBy(*[F.col(f).alias(new) for f, new in by]).agg(*[make[fn](f).alias(new) if fn in ("count", "min", "max") else make[fn](f).cast(DECIMAL).alias(new) for fn, f, new in s.values], F.min("_ord").alias("_first")).withColumnRenamed("_first", "_ord")
        elif isinstance(s, Sort):
            kept = {f"_sort{len(seen)}_{i}": F.col(f) for i, (f, _) in enumerate(s.by)}
            seen[s.name] = seen[s.input].withColumns(kept)
            sorts[s.name] = [*((c, d, shapes[s.name].fields[f]) for c, (f, d) in zip(kept, s.by)), *sorts.get(s.input, [])]
        elif isinstance(s, Series):
            shape = [c for c in dict.fromkeys((*_key_of(plan, s.input), s.x, *s.values))]
            seen[s.name] = seen[s.input].select(*shape, *[c for c, _, _ in sorts.get(s.input, [])], "_ord")
    out = seen[plan.result]
    return out.select(*[c for c in out.columns if not c.startswith("_")], F.struct(*[F.col(c) for c, _, _ in sorts.get(plan.result, [])], "_ord").alias("_ord")), [d for _, d, _ in sorts.get(plan.result, [])]


def _directed(sort: list[tuple[str, str]]) -> list[Column]:
    return [F.asc(c) if d == "asc" else F.desc(c) for c, d in sort]


def _key_of(plan: Plan, name: str) -> tuple[str, ...]:
    return check(Plan(plan.sources, plan.steps, name)).key


def ordered(result: tuple[DataFrame, list[str]]) -> DataFrame:
    """The rows in their order, ties in the order of the input, without the ordinal."""
    df, directions = result
    names = df.schema["_ord"].dataType.names
    return df.orderBy(*_directed([(f"_ord.{n}", d) for n, d in zip(names, [*directions, "asc"])])).drop("_ord")


def placed(result: tuple[DataFrame, list[str]]) -> DataFrame:
    """The rows with their places, from 1: sorted over all tasks and written, then counted on from the partitions before."""
    df, directions = result
    names, columns = df.schema["_ord"].dataType.names, [c for c in df.columns if c != "_ord"]
    rows = df.orderBy(*_directed([(f"_ord.{n}", d) for n, d in zip(names, [*directions, "asc"])])).drop("_ord")
    rows = Scratch(df.sparkSession, "placed").put(rows.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    # a row for each partition of the sort
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(sizes), "_part").select((F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias("place"), *columns)


def long_form(df: DataFrame, key: list[str], x: str, values: list[str]) -> DataFrame:
    """One row for each point and value column."""
    return df.unpivot([*key, x], values, "series", "value")
