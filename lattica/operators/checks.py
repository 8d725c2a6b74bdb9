"""Rule checks with a status each, and diffs of nested rows and of several entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.operators import graphs, signals
from lattica.sources import read

#: Tolerances of a timeline in milliseconds: of source ranges, of joints, the shortest shot and of the whole duration.
BOUNDS, JOINTS, SHORTEST, BUDGET = 1, 2, 350, 250


def assert_conditions(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(condition, status, n_false, n_unknown): fail where a row breaks it, deferred where some can't tell, else pass."""
    each = [F.struct(F.lit(name).alias("condition"), F.count_if(~c).alias("n_false"), F.count_if(c.isNull()).alias("n_unknown")).alias(f"_{i}") for i, (name, c) in enumerate(conditions.items())]
    rows = df.agg(*each).select(F.explode(F.array(*[F.col(f"_{i}") for i in range(len(each))])).alias("c")).select("c.*")
    return rows.withColumn("status", F.when(F.col("n_false") > 0, "fail").when(F.col("n_unknown") > 0, "deferred").otherwise("pass"))


def verify_timelines(clips: DataFrame, catalog: DataFrame, declared: DataFrame, durations: DataFrame) -> DataFrame:
    """(timeline, rule, status, n_faults) by five rules.

    Clips (timeline, nth, moment, source, start, end, from, to) must lie in their
    moment's range of the catalog (moment, lo, hi), come from a declared source
    (source), follow each other in the timeline, not be too short, and end near
    the timeline's duration (timeline, duration); the last two only warn.
    """
    order = Window.partitionBy("timeline").orderBy("nth")
    rows = clips.withColumn("_before", F.lag("to").over(order)).join(catalog, "moment", "left").join(declared.distinct().withColumn("_declared", F.lit(True)), "source", "left")
    bad = {
        "source_bounds": F.col("lo").isNull() | (F.col("start") < F.col("lo") - BOUNDS) | (F.col("end") > F.col("hi") + BOUNDS) | (F.col("end") <= F.col("start")),
        "declared_sources": F.col("_declared").isNull(),
        "contiguous_timeline": F.abs(F.col("from") - F.col("_before")) > JOINTS,
        "minimum_shot_length": F.col("to") - F.col("from") < SHORTEST,
    }
    sums = rows.groupBy("timeline").agg(*[F.count_if(c).alias(name) for name, c in bad.items()], F.max_by("to", "nth").alias("_last"))
    sums = durations.join(sums, "timeline", "left").withColumn("duration_budget", (F.abs(F.coalesce("_last", F.lit(0)) - F.col("duration")) > BUDGET).cast("long"))
    rules = [*bad, "duration_budget"]
    out = sums.select("timeline", *[F.coalesce(r, F.lit(0)).cast("long").alias(r) for r in rules]).unpivot(["timeline"], rules, "rule", "n_faults")
    worst = F.when(F.col("rule").isin("minimum_shot_length", "duration_budget"), "warn").otherwise("fail")
    return out.select("timeline", "rule", F.when(F.col("n_faults") > 0, worst).otherwise("pass").alias("status"), "n_faults")


def leaves(kind: T.StructType, of: str = "") -> list[tuple[str, str]]:
    """(column, path) of all leaves of nested structs; arrays and maps are leaves as a whole."""
    out = []
    for f in kind:
        name = f"{of}.`{f.name}`" if of else f"`{f.name}`"
        out += leaves(f.dataType, name) if isinstance(f.dataType, T.StructType) else [(name, "/" + name.replace("`.`", "/").strip("`"))]
    return out


def leaf_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, path, old, new) of every leaf that differs between rows of one key, as texts; rows of one side alone are no leaves."""
    kind = T.StructType([f for f in before.schema if f.name != key])
    text = lambda side, c, t: F.to_json(F.col(f"{side}.{c}")) if isinstance(t, (T.ArrayType, T.MapType)) else F.col(f"{side}.{c}").cast("string")
    both = before.alias("a").join(after.alias("b"), key)
    each = []
    for name, path in leaves(kind):
        t = before.select(name).schema[0].dataType
        each.append(F.struct(F.lit(path).alias("path"), text("a", name, t).alias("old"), text("b", name, t).alias("new")))
    return both.select(key, F.explode(F.filter(F.array(*each), lambda d: ~d["old"].eqNullSafe(d["new"]))).alias("d")).select(key, "d.*")


def entity_summary(diffs: dict[str, DataFrame]) -> DataFrame:
    """(entity, op, n_rows) over the diffs (with ``op``) of several entities."""
    parts = [d.groupBy("op").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("entity"), "op", "n_rows") for name, d in diffs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- queries


def assertion_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("rank", F.expr("try_cast(substring(o_orderpriority, 1, 1) as int)"))
    return assert_conditions(o, {"priced": F.col("o_totalprice") > 0, "ranked": F.when(F.col("rank") != 3, F.col("rank") > 0), "urgent": F.col("rank") <= 4})


def timeline_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as clips of parts, with slips by rule."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    c = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("timeline"), F.row_number().over(order).cast("long").alias("nth"), F.col("l_partkey").alias("moment"), (F.col("l_suppkey") % 40).alias("source"), (F.col("l_partkey") * 13 % 3000).alias("start"), (F.col("l_quantity").cast("long") * 60 + 60).alias("dur"))
    to = F.sum("dur").over(Window.partitionBy("timeline").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("to", to).withColumns({"from": F.col("to") - F.col("dur") + F.when(F.col("moment") % 50 == 0, 5).otherwise(0), "end": F.col("start") + F.col("dur")})
    catalog = read(spark, sf_dir, "part").filter("p_partkey % 31 <> 0").select(F.col("p_partkey").alias("moment"), F.lit(0).alias("lo"), (F.col("p_size") * 100 + 1500).alias("hi"))
    declared = spark.range(1, 40).select(F.col("id").alias("source"))
    durations = c.groupBy("timeline").agg((F.max("to") + F.col("timeline") % 9 * 40).alias("duration"))
    return verify_timelines(c, catalog, declared, durations)


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.struct("o_orderstatus", F.struct((F.col("o_custkey") % 100).alias("c"), F.col("o_orderpriority").alias("p")).alias("deep")).alias("row"), F.array(F.col("o_orderkey") % 3, F.lit(1)).alias("list"))


def nested_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _nested(spark, sf_dir)
    k = F.col("id")
    after = before.filter("id % 17 <> 0").select("id", F.struct(F.when(k % 5 == 0, "changed").otherwise(F.col("row.o_orderstatus")).alias("o_orderstatus"), F.struct((F.col("row.deep.c") + F.when(k % 7 == 0, 1).otherwise(0)).alias("c"), F.when(k % 11 == 0, None).otherwise(F.col("row.deep.p")).alias("p")).alias("deep")).alias("row"), F.when(k % 13 == 0, F.array(k)).otherwise(F.col("list")).alias("list"))
    return leaf_diff(before, after, "id")


def diff_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    changed = c.filter("id % 6 <> 0").withColumn("c_name", F.when(F.col("id") % 4 == 0, F.upper("c_name")).otherwise(F.col("c_name")))
    return entity_summary({"orders": graphs.semantic_diff(spark, sf_dir), "customers": graphs.keyed_diff(c, changed, "id", ("c_name",))})


def activity_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active samples and active windows of each user, in parts per million."""
    w = signals.hop_windows(spark, sf_dir)
    share = lambda c: F.floor(c * 1_000_000).cast("long")
    return w.groupBy("user_id").agg(share(F.sum("n_active") / F.sum("n_samples")).alias("samples_ppm"), share(F.count_if(F.col("n_active") * 2 >= F.col("n_samples")) / F.count(F.lit(1))).alias("windows_ppm"))


QUERIES = {f.__name__: f for f in (assertion_statuses, timeline_rules, nested_diff, diff_by_entity, activity_share)}

ORACLES = {
    "assertion_statuses": """WITH o AS (SELECT o_totalprice > 0 AS a, CASE WHEN left(o_orderpriority, 1) <> '3' THEN CAST(left(o_orderpriority, 1) AS INTEGER) > 0 END AS b, CAST(left(o_orderpriority, 1) AS INTEGER) <= 4 AS c FROM orders),
n AS (SELECT 'priced' AS condition, count(*) FILTER (NOT a) AS n_false, count(*) FILTER (a IS NULL) AS n_unknown FROM o UNION ALL SELECT 'ranked', count(*) FILTER (NOT b), count(*) FILTER (b IS NULL) FROM o UNION ALL SELECT 'urgent', count(*) FILTER (NOT c), count(*) FILTER (c IS NULL) FROM o)
SELECT *, CASE WHEN n_false > 0 THEN 'fail' WHEN n_unknown > 0 THEN 'deferred' ELSE 'pass' END AS status FROM n""",
    "timeline_rules": """WITH c AS (SELECT l_orderkey AS timeline, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth, l_partkey AS moment, l_suppkey % 40 AS source, l_partkey * 13 % 3000 AS s, CAST(l_quantity AS BIGINT) * 60 + 60 AS dur FROM lineitem),
d AS (SELECT *, sum(dur) OVER (PARTITION BY timeline ORDER BY nth) AS t FROM c), e AS (SELECT *, t - dur + CASE WHEN moment % 50 = 0 THEN 5 ELSE 0 END AS f FROM d), g AS (SELECT e.*, lag(t) OVER (PARTITION BY timeline ORDER BY nth) AS b, p_size * 100 + 1500 AS hi FROM e LEFT JOIN part ON p_partkey = moment AND p_partkey % 31 <> 0),
a AS (SELECT timeline, count(*) FILTER (hi IS NULL OR s + dur > hi + 1) AS r1, count(*) FILTER (source = 0) AS r2, count(*) FILTER (abs(f - b) > 2) AS r3, count(*) FILTER (t - f < 350) AS r4, CAST(timeline % 9 * 40 > 250 AS BIGINT) AS r5 FROM g GROUP BY 1),
u AS (SELECT timeline, unnest([{r: 'source_bounds', n: r1, w: 'fail'}, {r: 'declared_sources', n: r2, w: 'fail'}, {r: 'contiguous_timeline', n: r3, w: 'fail'}, {r: 'minimum_shot_length', n: r4, w: 'warn'}, {r: 'duration_budget', n: r5, w: 'warn'}]) AS x FROM a)
SELECT timeline, x.r AS rule, CASE WHEN x.n > 0 THEN x.w ELSE 'pass' END AS status, x.n AS n_faults FROM u""",
    "nested_diff": """WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_custkey % 100 AS c, o_orderpriority AS p, concat('[', o_orderkey % 3, ',1]') AS l FROM orders WHERE o_orderkey % 17 <> 0)
SELECT id, '/row/o_orderstatus' AS path, s AS old, 'changed' AS new FROM o WHERE id % 5 = 0 UNION ALL SELECT id, '/row/deep/c', CAST(c AS VARCHAR), CAST(c + 1 AS VARCHAR) FROM o WHERE id % 7 = 0
UNION ALL SELECT id, '/row/deep/p', p, NULL FROM o WHERE id % 11 = 0 UNION ALL SELECT id, '/list', l, concat('[', id, ']') FROM o WHERE id % 13 = 0""",
    "diff_by_entity": graphs.ORACLES["diff_summary"].replace("SELECT op, count(*) AS n_rows FROM d GROUP BY 1", "SELECT 'orders' AS entity, op, count(*) AS n_rows FROM d GROUP BY 2") + " UNION ALL SELECT 'customers', CASE WHEN c_custkey % 6 = 0 THEN 'remove' ELSE 'modify' END, count(*) FROM customer WHERE c_custkey % 6 = 0 OR (c_custkey % 4 = 0 AND upper(c_name) <> c_name) GROUP BY 2",
    "activity_share": f"WITH h AS ({signals.ORACLES['hop_windows']}) SELECT user_id, CAST(floor(sum(n_active) / CAST(sum(n_samples) AS DOUBLE) * 1000000) AS BIGINT) AS samples_ppm, CAST(floor(count(*) FILTER (n_active * 2 >= n_samples) / CAST(count(*) AS DOUBLE) * 1000000) AS BIGINT) AS windows_ppm FROM h GROUP BY 1",
}
