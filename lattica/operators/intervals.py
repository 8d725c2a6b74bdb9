"""Half-open intervals: joins by relation, subtraction, sweeps, and edits of contiguous tracks.

Joins deal both sides to buckets of time, so they are equi-joins with a residual
condition; a pair is reported in the bucket where its overlap begins.  Edits act
on tracks: each row has a track, a start and a duration, and what follows is
placed by running sums within the track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import ceil_to, clamp, floor_to
from lattica.sources import dealt, read


def bucketed_overlap(a: DataFrame, b: DataFrame, width: int, *, touching: bool = False, on: list[str] | None = None, salt: int = 1) -> DataFrame:
    """Pairs of rows (a_start, a_end) and (b_start, b_end) that overlap, or at least touch, and have the columns ``on`` alike.

    A row is copied once for each bucket of ``width`` that it meets; choose a
    width near the usual length.  Where few buckets hold most rows, ``salt`` deals
    each bucket's left rows to that many parts, each with all its right rows.
    """
    more = 0 if touching else 1
    spread = lambda df, s, e: df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - more) / width))))
    left, right, keys = spread(a, "a_start", "a_end"), spread(b, "b_start", "b_end"), [*(on or []), "_bucket"]
    if salt > 1:
        left = left.withColumn("_salt", F.pmod(F.xxhash64(*a.columns), F.lit(salt)).cast("int"))
        right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        keys.append("_salt")
    pairs = left.join(right, keys)
    meet = (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end")) if touching else (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end"))
    return pairs.filter(meet & (F.col("_bucket") == F.floor(F.greatest("a_start", "b_start") / width))).drop("_bucket", "_salt")


#: Parts of a bucket in the joins of all orders, whose days fill a few hundred buckets.
SALT = 4
DAY = "datediff(cast({} as date), date'1992-01-01')"


def _all_spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as intervals of 3 to 12 days, and all of them as intervals of 5 days; both with a day's number."""
    a, b = _spans(spark, sf_dir)
    return a.drop("custkey"), b.drop("custkey")


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of ``_all_spans`` with the order's customer."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.expr(DAY.format("o_orderdate")).cast("long").alias("d"), F.col("o_custkey").alias("custkey"))
    a = o.select("custkey", F.col("k").alias("a_id"), F.col("d").alias("a_start"), (F.col("d") + 3 + F.col("k") % 10).alias("a_end"))
    return a, o.select("custkey", F.col("k").alias("b_id"), F.col("d").alias("b_start"), (F.col("d") + 5).alias("b_end"))


def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping intervals of a customer's orders; so too the joins below."""
    return bucketed_overlap(*_spans(spark, sf_dir), 8, on=["custkey"]).select("a_id", "b_id")


def interval_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucketed_overlap(*_spans(spark, sf_dir), 8, on=["custkey"]).filter("b_start <= a_start and a_end <= b_end").select("a_id", "b_id")


def interval_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucketed_overlap(*_spans(spark, sf_dir), 8, touching=True, on=["custkey"]).filter("a_start = b_end or b_start = a_end").select("a_id", "b_id")


def weighted_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a value over an interval, weighted by overlap, whole and half up."""
    pairs = bucketed_overlap(*_spans(spark, sf_dir), 8, on=["custkey"])
    over = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    sums = pairs.groupBy("b_id", (F.col("b_end") - F.col("b_start")).alias("length")).agg(F.sum(over * (F.col("a_id") % 100)).alias("s"))
    return sums.select("b_id", F.floor((F.col("s") * 2 + F.col("length")) / (F.col("length") * 2)).cast("long").alias("mean"))


def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _spans(spark, sf_dir)
    points = a.select("custkey", "a_id", "a_start", (F.col("a_start") + 1).alias("a_end"))
    return bucketed_overlap(points, b, 8, on=["custkey"]).select("a_id", "b_id")


#: Ids that a row of a block holds, at most, and pairs that a task spells out, about.
BLOCK, TASK_PAIRS = 256, 100_000_000


def _blocks(rows: DataFrame, side: str) -> DataFrame:
    """Rows of one interval (side_start, side_end) as blocks of at most ``BLOCK`` ids in order, numbered within it."""
    span, id_ = [f"{side}_start", f"{side}_end"], f"{side}_id"
    place = F.row_number().over(Window.partitionBy(*span).orderBy(id_)) - 1
    ids = F.transform(F.sort_array(F.collect_list(F.struct(id_))), lambda x: x[id_])  # structs, as null ids count
    return rows.withColumn(f"{side}_block", F.floor(place / BLOCK)).groupBy(*span, f"{side}_block").agg(ids.alias(f"{side}_ids"))


def _n_pairs(a: DataFrame, b: DataFrame, where: str, *, touching: bool) -> int:
    """How many pairs of rows meet, by the counts of equal intervals."""
    n = lambda df, side: df.groupBy(f"{side}_start", f"{side}_end").agg(F.count(F.lit(1)).alias(f"{side}_n"))
    met = bucketed_overlap(n(a, "a"), n(b, "b"), 8, touching=touching).filter(where)
    return int(met.agg(F.sum(F.col("a_n").cast("decimal(38,0)") * F.col("b_n"))).first()[0] or 0)


def _all_pairs(a: DataFrame, b: DataFrame, where: str, *, touching: bool = False) -> DataFrame:
    """Ids of all rows whose intervals meet.

    Blocks of ids of equal intervals are joined, dealt evenly to tasks, and only
    there spelt out one by one: so each pair made is a pair reported, no task has
    more than its share of them, and none is sorted, kept or shuffled.  A task has
    neighbouring blocks, in order, so that its ids are few and come round in short
    cycles: columns of Parquet then hold many pairs in a byte.
    """
    met = bucketed_overlap(_blocks(a, "a"), _blocks(b, "b"), 8, touching=touching, salt=SALT).filter(where)
    parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-_n_pairs(a, b, where, touching=touching) // TASK_PAIRS))
    place = ["b_start", "b_end", "b_block", "a_start", "a_end", "a_block"]
    met = met.repartitionByRange(parts, *place).sortWithinPartitions(*place)
    return met.select(F.explode("a_ids").alias("a_id"), "b_ids").select("a_id", F.explode("b_ids").alias("b_id"))


def interval_overlap_join_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of overlapping intervals, of all orders on both sides."""
    return _all_pairs(*_all_spans(spark, sf_dir), "true")


def interval_contained_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_pairs(*_all_spans(spark, sf_dir), "b_start <= a_start and a_end <= b_end")


def interval_touches_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_pairs(*_all_spans(spark, sf_dir), "a_start = b_end or b_start = a_end", touching=True)


def weighted_overlap_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``weighted_overlap`` for all intervals: values are summed by equal spans first, so that no pair of rows is made."""
    a, b = _all_spans(spark, sf_dir)
    values = a.groupBy("a_start", "a_end").agg(F.sum(F.col("a_id") % 100).alias("value"))
    over = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    sums = bucketed_overlap(values, b.select("b_start", "b_end").distinct(), 8).groupBy("b_start", "b_end").agg(F.sum(over * F.col("value")).alias("s"))
    length = F.col("b_end") - F.col("b_start")
    return b.join(sums, ["b_start", "b_end"]).select("b_id", F.floor((F.col("s") * 2 + length) / (length * 2)).cast("long").alias("mean"))


def point_in_interval_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _all_spans(spark, sf_dir)
    points = a.select("a_id", "a_start", (F.col("a_start") + 1).alias("a_end"))
    return _all_pairs(points, b, "true")


def _by_track():
    return Window.partitionBy("track").orderBy("ord")



def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as one contiguous track: track, ord (from 1), start, dur (whole), end and total."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = dealt(read(spark, sf_dir, "lineitem"), "l_orderkey").select(F.col("l_orderkey").cast("long").alias("track"), F.row_number().over(order).cast("long").alias("ord"), F.col("l_quantity").cast("long").alias("dur"))
    rows = rows.withColumn("start", F.coalesce(F.sum("dur").over(_by_track().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.withColumns({"end": F.col("start") + F.col("dur"), "total": F.sum("dur").over(Window.partitionBy("track"))})


def split_at(rows: DataFrame, *at: Column) -> DataFrame:
    """Rows cut at whatever boundaries lie strictly inside them; ``src`` is how far into its row a part begins."""
    cuts = F.array_sort(F.array_distinct(F.array("start", "end", *[clamp(c, F.col("start"), F.col("end")) for c in at])))
    pairs = F.transform(F.slice(cuts, F.lit(1), F.size(cuts) - 1), lambda c, i: F.struct(c.alias("s"), F.get(cuts, i + 1).alias("e")))
    parts = rows.withColumn("_p", F.explode(pairs))
    return parts.select("track", "ord", "total", F.col("_p.s").alias("start"), F.col("_p.e").alias("end"), (F.col("_p.s") - F.col("start")).alias("src"))


#: The range of the edits.
FROM, TO = 10, 40


def _lo() -> Column:
    return F.lit(FROM)


def _hi() -> Column:
    return F.lit(TO)


_OUT = ("track", "ord", "start", "end", "src")


def edit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_at(track(spark, sf_dir), _lo()).select(*_OUT)


def _inside() -> Column:
    return (F.col("start") >= _lo()) & (F.col("end") <= _hi())


def _gaps(parts: DataFrame, gap: Column) -> DataFrame:
    """Rows with ``ord`` 0 where they are gaps, gaps in a row made one."""
    order = Window.partitionBy("track").orderBy("start")
    rows = parts.withColumn("gap", gap)
    fresh = F.when(F.col("gap") & F.coalesce(F.lag("gap").over(order), F.lit(False)), 0).otherwise(1)
    rows = rows.withColumn("run", fresh).withColumn("run", F.sum("run").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("track", "run").agg(F.min(F.when(F.col("gap"), 0).otherwise(F.col("ord"))).alias("ord"), F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.when(F.col("gap"), 0).otherwise(F.col("src"))).alias("src")).select(*_OUT)


def edit_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range stays, all else becomes gaps."""
    return _gaps(split_at(track(spark, sf_dir), _lo(), _hi()), ~_inside())


def edit_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range becomes a gap in its place."""
    return _gaps(split_at(track(spark, sf_dir), _lo(), _hi()), _inside())


def _with_item(rows: DataFrame, *more: Column) -> DataFrame:
    """The rows of ``_OUT`` and, from the part that begins each track, further ones: structs of ``_OUT`` less the track, or null."""
    own = F.struct(*[F.col(c) for c in _OUT[1:]])
    new = F.array_compact(F.array(*more))
    parts = F.when(F.col("first"), F.concat(F.when(F.col("stays"), F.array(own)).otherwise(F.array().cast(_ITEMS)), new.cast(_ITEMS))).when(F.col("stays"), F.array(own))
    return rows.select("track", F.explode(parts).alias("p")).select("track", "p.*")


_ITEMS = "array<struct<ord:bigint,start:bigint,end:bigint,src:bigint>>"


def _item(ord_: int, start: Column, end: Column) -> Column:
    return F.struct(F.lit(ord_).cast("long").alias("ord"), start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(0).cast("long").alias("src"))


def edit_ripple_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range goes, what follows moves left, and a gap of the same length ends the track."""
    rows = split_at(track(spark, sf_dir), _lo(), _hi())
    cut = F.greatest(F.least(_hi(), F.col("total")) - _lo(), F.lit(0))
    move = F.when(F.col("start") >= _hi(), cut).otherwise(0)
    moved = rows.select("track", "ord", (F.col("start") - move).alias("start"), (F.col("end") - move).alias("end"), "src", "total", (~_inside()).alias("stays"), (F.col("start") == 0).alias("first"), cut.alias("cut"))
    return _with_item(moved, F.when(F.col("cut") > 0, _item(0, F.col("total") - F.col("cut"), F.col("total"))))


def edit_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item of 7 enters at 10 and what follows moves right."""
    rows = split_at(track(spark, sf_dir).filter("total > 10"), _lo())
    move = F.when(F.col("start") >= _lo(), 7).otherwise(0)
    moved = rows.select("track", "ord", (F.col("start") + move).alias("start"), (F.col("end") + move).alias("end"), "src", F.lit(True).alias("stays"), (F.col("start") == 0).alias("first"))
    return _with_item(moved, _item(-1, _lo(), F.lit(17)))


def edit_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item takes the place of what lies in the range; tracks must reach it."""
    rows = split_at(track(spark, sf_dir).filter("total >= 40"), _lo(), _hi())
    return _with_item(rows.withColumns({"stays": ~_inside(), "first": F.col("start") == 0}), _item(-1, _lo(), _hi()))


def edit_slip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second items show what lies 3 later in their sources, where handles of a tenth of the duration allow it."""
    second = F.col("ord") == 2
    allowed = F.floor(F.col("dur") / 10) >= 3
    return track(spark, sf_dir).select("track", "ord", "start", "end", F.when(second & allowed, 3).otherwise(0).cast("long").alias("src"))


def edit_slide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second items move right by 2; the neighbours grow and shrink."""
    rows = track(spark, sf_dir)
    can = F.max(F.when((F.col("ord") == 3) & (F.col("dur") > 2), 1).otherwise(0)).over(Window.partitionBy("track")) == 1
    by = F.when(can, 2).otherwise(0)
    start = F.when(F.col("ord").isin(2, 3), F.col("start") + by).otherwise(F.col("start"))
    end = F.when(F.col("ord").isin(1, 2), F.col("end") + by).otherwise(F.col("end"))
    return rows.select("track", "ord", start.alias("start"), end.alias("end"), F.when(F.col("ord") == 3, by).otherwise(0).cast("long").alias("src"))


def edit_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut between the first two items moves to the middle of both."""
    rows = track(spark, sf_dir)
    second_end = F.max(F.when(F.col("ord") == 2, F.col("end"))).over(Window.partitionBy("track"))
    middle = F.floor(second_end / 2)
    start = F.when((F.col("ord") == 2), middle).otherwise(F.col("start"))
    end = F.when((F.col("ord") == 1) & second_end.isNotNull(), middle).otherwise(F.col("end"))
    return rows.select("track", "ord", start.cast("long").alias("start"), end.cast("long").alias("end"))


def no_gap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as intervals of 400 days: first starts after a gap."""
    o = read(spark, sf_dir, "orders").select("o_custkey", F.expr(DAY.format("o_orderdate")).cast("long").alias("start"))
    order = Window.partitionBy("o_custkey").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    rows = o.withColumn("reach", F.max(F.col("start") + 400).over(order)).filter(F.col("start") > F.col("reach"))
    return rows.groupBy("o_custkey").agg(F.min("start").alias("first_after_gap"), F.count(F.lit(1)).alias("n_gaps"))


def no_overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_custkey", F.expr(DAY.format("o_orderdate")).cast("long").alias("start"))
    order = Window.partitionBy("o_custkey").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    rows = o.withColumn("reach", F.max(F.col("start") + 30).over(order)).filter(F.col("start") < F.col("reach"))
    return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_overlaps"))


def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of overlapping or touching intervals, by customer."""
    o = read(spark, sf_dir, "orders").select("o_custkey", F.expr(DAY.format("o_orderdate")).cast("long").alias("start"))
    order = Window.partitionBy("o_custkey").orderBy("start")
    reach = F.max(F.col("start") + 60).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = o.withColumn("fresh", F.when(F.col("start") <= reach, 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("fresh").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("o_custkey", "run").agg(F.min("start").alias("start"), (F.max("start") + 60).alias("end"))


def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the runs of ``coverage_check`` leave of each customer's span of days."""
    runs = coverage_check(spark, sf_dir)
    order = Window.partitionBy("o_custkey").orderBy("run")
    return runs.select("o_custkey", F.col("end").alias("start"), F.lead("start").over(order).alias("end")).filter("`end` is not null")


def sweep_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elementary segments between all boundaries of a customer's intervals, with how many are active: running sums of +1 and -1."""
    o = read(spark, sf_dir, "orders").select("o_custkey", F.expr(DAY.format("o_orderdate")).cast("long").alias("start"))
    steps = o.select("o_custkey", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct((F.col("start") + 90).alias("at"), F.lit(-1).alias("d")))).alias("s"))
    points = steps.groupBy("o_custkey", F.col("s.at").alias("at")).agg(F.sum("s.d").alias("d"))
    order = Window.partitionBy("o_custkey").orderBy("at")
    rows = points.select("o_custkey", F.col("at").alias("start"), F.lead("at").over(order).alias("end"), F.sum("d").over(order).alias("n_active"))
    return rows.filter("`end` is not null and n_active > 0")


def chunk_plan(spark: SparkSession, sf_dir: str, size: int = 20, overlap: int = 5, grid: int = 4) -> DataFrame:
    """Chunks of ``size`` every size - overlap over each track, snapped outward to a grid, the last one clamped."""
    t = track(spark, sf_dir).filter("ord = 1").select("track", "total")
    hop = size - overlap
    n = F.greatest(F.ceil((F.col("total") - overlap) / hop), F.lit(1))
    rows = t.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return rows.select("track", "chunk", floor_to(F.col("chunk") * hop, grid).alias("start"), F.least(ceil_to(F.col("chunk") * hop + size, grid), F.col("total")).alias("end"))


def sample_points(spark: SparkSession, sf_dir: str, slot: int = 10, grid: int = 4) -> DataFrame:
    """One point on the grid near the middle of each slot."""
    t = track(spark, sf_dir).filter("ord = 1").select("track", "total")
    rows = t.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("total") / slot) - 1)))
    middle = F.floor((F.col("slot") * slot + F.least((F.col("slot") + 1) * slot, F.col("total"))) / 2)
    return rows.select("track", "slot", floor_to(middle, grid).alias("at"))


def handle_clamp(spark: SparkSession, sf_dir: str, handle: int = 6, grid: int = 4) -> DataFrame:
    """Items widened by a handle, snapped inward to the grid and kept within their track."""
    return track(spark, sf_dir).select("track", "ord", ceil_to(F.greatest(F.col("start") - handle, F.lit(0)), grid).alias("start"), floor_to(F.least(F.col("end") + handle, F.col("total")), grid).alias("end"))


QUERIES = {f.__name__: f for f in (interval_overlap_join, interval_contained, interval_touches, weighted_overlap, point_in_interval, interval_overlap_join_all, interval_contained_all, interval_touches_all, weighted_overlap_all, point_in_interval_all, edit_split, edit_trim, edit_lift, edit_ripple_delete, edit_insert, edit_overwrite, edit_slip, edit_slide, edit_boundary, no_gap_check, no_overlap_check, coverage_check, interval_subtract, sweep_segments, chunk_plan, sample_points, handle_clamp)}

_I = """o AS (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS d, o_custkey FROM orders),
a AS (SELECT o_custkey AS c, k AS a_id, d AS a_start, d + 3 + k % 10 AS a_end FROM o), b AS (SELECT o_custkey AS c, k AS b_id, d AS b_start, d + 5 AS b_end FROM o)"""
_T = """t0 AS (SELECT CAST(l_orderkey AS BIGINT) AS track, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS ord, CAST(l_quantity AS BIGINT) AS dur FROM lineitem),
t AS (SELECT *, CAST(coalesce(sum(dur) OVER (PARTITION BY track ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(sum(dur) OVER (PARTITION BY track ORDER BY ord) AS BIGINT) AS "end", CAST(sum(dur) OVER (PARTITION BY track) AS BIGINT) AS total FROM t0),
x AS (SELECT track, ord, total, g.s AS start, g.e AS "end", g.s - start AS src FROM (SELECT *, unnest([{s: start, e: least("end", 10)}, {s: greatest(start, 10), e: least("end", 40)}, {s: greatest(start, 40), e: "end"}]) AS g FROM t) WHERE g.s < g.e)"""
_G = """r AS (SELECT *, CASE WHEN gap AND coalesce(lag(gap) OVER (PARTITION BY track ORDER BY start), false) THEN 0 ELSE 1 END AS f FROM g), u AS (SELECT *, sum(f) OVER (PARTITION BY track ORDER BY start) AS run FROM r)
SELECT track, min(CASE WHEN gap THEN 0 ELSE ord END) AS ord, min(start) AS start, max("end") AS "end", min(CASE WHEN gap THEN 0 ELSE src END) AS src FROM u GROUP BY track, run"""
_J = "FROM a JOIN b ON a.c = b.c AND a_start < b_end AND b_start < a_end"

ORACLES = {
    "interval_overlap_join": f"WITH {_I} SELECT a_id, b_id {_J}",
    "interval_contained": f"WITH {_I} SELECT a_id, b_id {_J} WHERE b_start <= a_start AND a_end <= b_end",
    "interval_touches": f"WITH {_I} SELECT a_id, b_id FROM a JOIN b ON a.c = b.c AND (a_start = b_end OR b_start = a_end)",
    "weighted_overlap": f"WITH {_I}, s AS (SELECT b_id, b_end - b_start AS n, CAST(sum((least(a_end, b_end) - greatest(a_start, b_start)) * (a_id % 100)) AS BIGINT) AS s {_J} GROUP BY 1, 2) SELECT b_id, (s * 2 + n) // (n * 2) AS mean FROM s",
    "point_in_interval": f"WITH {_I} SELECT a_id, b_id FROM a JOIN b ON a.c = b.c AND b_start <= a_start AND a_start < b_end",
    "edit_split": f"""WITH {_T} SELECT track, ord, g.s AS start, g.e AS "end", g.s - start AS src FROM (SELECT *, unnest([{{s: start, e: least("end", 10)}}, {{s: greatest(start, 10), e: "end"}}]) AS g FROM t) WHERE g.s < g.e""",
    "edit_trim": f"""WITH {_T}, g AS (SELECT *, NOT (start >= 10 AND "end" <= 40) AS gap FROM x), {_G}""",
    "edit_lift": f"""WITH {_T}, g AS (SELECT *, (start >= 10 AND "end" <= 40) AS gap FROM x), {_G}""",
    "edit_ripple_delete": f"""WITH {_T}, k AS (SELECT *, greatest(least(40, total) - 10, 0) AS cut FROM x WHERE NOT (start >= 10 AND "end" <= 40))
SELECT track, ord, CASE WHEN start >= 40 THEN start - cut ELSE start END AS start, CASE WHEN start >= 40 THEN "end" - cut ELSE "end" END AS "end", src FROM k
UNION ALL SELECT track, 0, total - greatest(least(40, total) - 10, 0), total, 0 FROM t WHERE ord = 1 AND total > 10""",
    "edit_insert": f"""WITH {_T}, y AS (SELECT track, ord, g.s AS start, g.e AS "end", g.s - start AS src FROM (SELECT *, unnest([{{s: start, e: least("end", 10)}}, {{s: greatest(start, 10), e: "end"}}]) AS g FROM t WHERE total > 10) WHERE g.s < g.e)
SELECT track, ord, start + CASE WHEN start >= 10 THEN 7 ELSE 0 END AS start, "end" + CASE WHEN start >= 10 THEN 7 ELSE 0 END AS "end", src FROM y UNION ALL SELECT track, -1, 10, 17, 0 FROM t WHERE ord = 1 AND total > 10""",
    "edit_overwrite": f"""WITH {_T} SELECT track, ord, start, "end", src FROM x WHERE total >= 40 AND NOT (start >= 10 AND "end" <= 40) UNION ALL SELECT track, -1, 10, 40, 0 FROM t WHERE ord = 1 AND total >= 40""",
    "edit_slip": f"""WITH {_T} SELECT track, ord, start, "end", CAST(CASE WHEN ord = 2 AND dur >= 30 THEN 3 ELSE 0 END AS BIGINT) AS src FROM t""",
    "edit_slide": f"""WITH {_T}, c AS (SELECT *, CASE WHEN max(CASE WHEN ord = 3 AND dur > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY track) = 1 THEN 2 ELSE 0 END AS m FROM t)
SELECT track, ord, start + CASE WHEN ord IN (2, 3) THEN m ELSE 0 END AS start, "end" + CASE WHEN ord IN (1, 2) THEN m ELSE 0 END AS "end", CAST(CASE WHEN ord = 3 THEN m ELSE 0 END AS BIGINT) AS src FROM c""",
    "edit_boundary": f"""WITH {_T}, c AS (SELECT *, max(CASE WHEN ord = 2 THEN "end" END) OVER (PARTITION BY track) // 2 AS m FROM t)
SELECT track, ord, CASE WHEN ord = 2 THEN m ELSE start END AS start, CASE WHEN ord = 1 AND m IS NOT NULL THEN m ELSE "end" END AS "end" FROM c""",
    "no_gap_check": f"""WITH {_I}, r AS (SELECT *, max(d + 400) OVER (PARTITION BY o_custkey ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o) SELECT o_custkey, min(d) AS first_after_gap, count(*) AS n_gaps FROM r WHERE d > reach GROUP BY 1""",
    "no_overlap_check": f"""WITH {_I}, r AS (SELECT *, max(d + 30) OVER (PARTITION BY o_custkey ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o) SELECT o_custkey, count(*) AS n_overlaps FROM r WHERE d < reach GROUP BY 1""",
}
_C = f"""{_I}, r AS (SELECT *, CASE WHEN d <= max(d + 60) OVER (PARTITION BY o_custkey ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM o),
u AS (SELECT *, CAST(sum(f) OVER (PARTITION BY o_custkey ORDER BY d) AS BIGINT) AS run FROM r), c AS (SELECT o_custkey, run, min(d) AS start, max(d) + 60 AS "end" FROM u GROUP BY 1, 2)"""
ORACLES |= {
    "coverage_check": f"WITH {_C} SELECT * FROM c",
    "interval_subtract": f"""WITH {_C}, l AS (SELECT o_custkey, "end" AS start, lead(start) OVER (PARTITION BY o_custkey ORDER BY run) AS e FROM c) SELECT o_custkey, start, e AS "end" FROM l WHERE e IS NOT NULL""",
    "sweep_segments": f"""WITH {_I}, p AS (SELECT DISTINCT o_custkey, unnest([d, d + 90]) AS b FROM o), l AS (SELECT *, lead(b) OVER (PARTITION BY o_custkey ORDER BY b) AS e FROM p)
SELECT l.o_custkey, b AS start, e AS "end", count(*) AS n_active FROM l JOIN o ON l.o_custkey = o.o_custkey AND o.d <= b AND e <= o.d + 90 WHERE e IS NOT NULL GROUP BY 1, 2, 3""",
    "chunk_plan": f"""WITH {_T}, c AS (SELECT track, total, unnest(range(greatest((total - 5 + 14) // 15, 1))) AS chunk FROM t WHERE ord = 1)
SELECT track, chunk, chunk * 15 // 4 * 4 AS start, least((chunk * 15 + 20 + 3) // 4 * 4, total) AS "end" FROM c""",
    "sample_points": f"""WITH {_T}, c AS (SELECT track, total, unnest(range((total + 9) // 10)) AS slot FROM t WHERE ord = 1) SELECT track, slot, (slot * 10 + least((slot + 1) * 10, total)) // 2 // 4 * 4 AS "at" FROM c""",
    "handle_clamp": f"""WITH {_T} SELECT track, ord, (greatest(start - 6, 0) + 3) // 4 * 4 AS start, least("end" + 6, total) // 4 * 4 AS "end" FROM t""",
}
ORACLES |= {
    "interval_contained_all": f"WITH {_I} SELECT a_id, b_id FROM a JOIN b ON b_start <= a_start AND a_end <= b_end",
    "interval_touches_all": f"WITH {_I} SELECT a_id, b_id FROM a JOIN b ON a_start = b_end UNION ALL SELECT a_id, b_id FROM a JOIN b ON b_start = a_end",
    "point_in_interval_all": f"WITH {_I} SELECT a_id, b_id FROM a JOIN b ON b_start <= a_start AND a_start < b_end",
    "weighted_overlap_all": f"WITH {_I}, v AS (SELECT a_start, a_end, sum(a_id % 100) AS v FROM a GROUP BY 1, 2), s AS (SELECT b_id, b_end - b_start AS n, CAST(sum((least(a_end, b_end) - greatest(a_start, b_start)) * v) AS BIGINT) AS s FROM b JOIN v ON a_start < b_end AND b_start < a_end GROUP BY 1, 2) SELECT b_id, (s * 2 + n) // (n * 2) AS mean FROM s",
}
