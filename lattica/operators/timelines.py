"""Edits and checks of tracks with sources and handles, each a function of a table and parameters.

A track table has ``track``, ``item``, ``start``, ``end`` (half-open, contiguous),
``src`` (where the item begins in its source), ``head`` and ``tail`` (how much
source lies unused before and after it), ``gap`` and ``link``.  An edit applies to
every track by itself; where its law is broken the track stays as it is and
``refused`` says why: SELECTION, GAP, TIME, HANDLE or RESULT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.sources import dealt, parts_for, read

OUT = ("track", "item", "start", "end", "src", "head", "tail", "gap")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as a track; the last item of every other track is a gap, and some items are linked across tracks."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    whole = Window.partitionBy("l_orderkey")
    rows = dealt(read(spark, sf_dir, "lineitem"), "l_orderkey").select(F.col("l_orderkey").alias("track"), F.row_number().over(order).cast("long").alias("item"), F.count(F.lit(1)).over(whole).alias("n"), F.col("l_quantity").cast("long").alias("dur"), (F.col("l_partkey") % 7).alias("head"), (F.col("l_suppkey") % 7).alias("tail"), F.when(F.col("l_partkey") % 3 == 0, F.floor(F.col("l_orderkey") / 4)).alias("link"))
    end = F.sum("dur").over(Window.partitionBy("track").orderBy("item").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", end).select("track", "item", (F.col("end") - F.col("dur")).alias("start"), "end", F.lit(0).cast("long").alias("src"), "head", "tail", ((F.col("item") == F.col("n")) & (F.col("track") % 2 == 0)).alias("gap"), "link")


def _track():
    return Window.partitionBy("track")


def _in_order():
    return Window.partitionBy("track").orderBy("start")


def _edited(rows: DataFrame, refused: Column, **changes: Column) -> DataFrame:
    """The rows with changes added to their numbers where the track isn't refused."""
    rows = rows.withColumn("refused", refused)
    moved = {c: (F.col(c) + F.when(F.col("refused").isNull(), by).otherwise(0)).cast("long") for c, by in changes.items()}
    return rows.select(*[moved.get(c, F.col(c)).alias(c) for c in OUT], "refused")


def slip(rows: DataFrame, selected: Column, by: int) -> DataFrame:
    """The one selected item of a track shows what lies ``by`` later in its source, as far as its handles allow."""
    rows = rows.withColumn("_sel", F.coalesce(selected, F.lit(False)))
    why = F.when(F.col("gap"), "GAP").when((F.col("head") + by < 0) | (F.col("tail") - by < 0), "HANDLE")
    refused = F.when(F.count_if("_sel").over(_track()) != 1, "SELECTION").otherwise(F.max(F.when(F.col("_sel"), why)).over(_track()))
    move = F.when(F.col("_sel"), by).otherwise(0)
    return _edited(rows, refused, src=move, head=move, tail=-move)


def slide(rows: DataFrame, selected: Column, by: int) -> DataFrame:
    """The one selected item moves by ``by``; its neighbours, which must be media, grow and shrink out of their handles."""
    w, near = _in_order(), lambda f, c: f(c).over(_in_order())
    rows = rows.withColumns({"_sel": F.coalesce(selected, F.lit(False)), "_dur": F.col("end") - F.col("start")})
    rows = rows.withColumns({"_l": F.lag(F.struct("_dur", "gap", "tail")).over(w), "_r": F.lead(F.struct("_dur", "gap", "head")).over(w), "_is_l": F.coalesce(near(F.lead, "_sel"), F.lit(False)), "_is_r": F.coalesce(near(F.lag, "_sel"), F.lit(False))})
    why = F.when(F.col("_l").isNull() | F.col("_r").isNull(), "SELECTION").when((F.col("_l._dur") + by <= 0) | (F.col("_r._dur") - by <= 0), "TIME").when(F.col("_l.gap") | F.col("_r.gap"), "GAP").when((F.col("_l.tail") < by) | (F.col("_r.head") < -by), "HANDLE")
    refused = F.when(F.count_if("_sel").over(_track()) != 1, "SELECTION").otherwise(F.max(F.when(F.col("_sel"), why)).over(_track()))
    on = lambda c: F.when(c, by).otherwise(0)
    left, own, right = F.col("_is_l"), F.col("_sel"), F.col("_is_r")
    return _edited(rows, refused, start=on(own | right), end=on(left | own), src=on(right), head=on(right), tail=-on(left))


def adjust_boundary(rows: DataFrame, selected: Column, at: int) -> DataFrame:
    """The cut between the two selected media items, which must be adjacent, moves to ``at``."""
    rows = rows.withColumn("_sel", F.coalesce(selected & ~F.col("gap"), F.lit(False)))
    rows = rows.withColumns({"_left": F.col("_sel") & F.coalesce(F.lead("_sel").over(_in_order()), F.lit(False)), "_right": F.col("_sel") & F.coalesce(F.lag("_sel").over(_in_order()), F.lit(False))})
    of = lambda flag, c: F.max(F.when(F.col(flag), F.col(c))).over(_track())
    rows = rows.withColumns({"_n": F.count_if("_sel").over(_track()), "_lo": of("_left", "start"), "_cut": of("_left", "end"), "_hi": of("_right", "end"), "_tail": of("_left", "tail"), "_head": of("_right", "head")})
    move = F.lit(at) - F.col("_cut")
    refused = F.when((F.col("_n") != 2) | F.col("_cut").isNull(), "SELECTION").when((F.lit(at) <= F.col("_lo")) | (F.lit(at) >= F.col("_hi")), "TIME").when((F.col("_tail") < move) | (F.col("_head") < -move), "HANDLE")
    on = lambda flag: F.when(F.col(flag), move).otherwise(0)
    return _edited(rows, refused, end=on("_left"), tail=-on("_left"), start=on("_right"), src=on("_right"), head=on("_right"))


def insert(rows: DataFrame, at: int, length: int, item: int) -> DataFrame:
    """An item of ``length`` enters at ``at``; what follows moves right and a closing gap of that length is used up.

    A track keeps its duration, so all of its last ``length`` must be gap.  The
    new item is made from the track's first row: nothing is read twice.
    """
    total = F.max("end").over(_track())
    rows = rows.withColumns({"_from": total - length, "_media": F.max(F.when(~F.col("gap"), F.col("end"))).over(_track())})
    refused = F.when((F.lit(at) < 0) | (F.lit(at) > F.col("_from")), "TIME").when(F.coalesce(F.col("_media"), F.lit(0)) > F.col("_from"), "RESULT")
    rows = rows.withColumn("refused", refused)
    part = lambda s, e, move: F.struct(F.col("item").alias("item"), (s + move).cast("long").alias("start"), (e + move).cast("long").alias("end"), (F.col("src") + F.when(F.col("gap"), 0).otherwise(s - F.col("start"))).cast("long").alias("src"), F.col("gap").alias("gap"))
    new = F.struct(F.lit(item).cast("long").alias("item"), F.lit(at).cast("long").alias("start"), F.lit(at + length).cast("long").alias("end"), F.lit(0).cast("long").alias("src"), F.lit(False).alias("gap"))
    before = part(F.col("start"), F.least("end", F.lit(at)), 0)
    after = part(F.greatest("start", F.lit(at)), F.least("end", F.col("_from")), length)
    parts = F.filter(F.array(before, after), lambda p: p["start"] < p["end"])
    parts = F.when(F.col("refused").isNotNull(), F.array(part(F.col("start"), F.col("end"), 0))).otherwise(F.concat(parts, F.when(F.col("start") == 0, F.array(new)).otherwise(F.array().cast(parts_type()))))
    out = rows.select("track", "refused", F.explode(parts).alias("p")).select("track", "p.*", "refused")
    return _without_gap_seams(out)


def parts_type() -> str:
    return "array<struct<item:bigint,start:bigint,end:bigint,src:bigint,gap:boolean>>"


def _without_gap_seams(rows: DataFrame) -> DataFrame:
    """Gaps that touch made one, under the smallest of their items."""
    w = _in_order()
    fresh = F.when(F.col("gap") & F.coalesce(F.lag("gap").over(w), F.lit(False)), 0).otherwise(1)
    rows = rows.withColumn("_run", fresh).withColumn("_run", F.sum("_run").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("track", "_run").agg(F.min("item").alias("item"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("src").alias("src"), F.max("gap").alias("gap"), F.max("refused").alias("refused")).drop("_run")


def transitions(rows: DataFrame, selected: Column, duration: int) -> DataFrame:
    """Overlaps of ``duration`` (even) round the cut after each selected item: both sides' sources beyond the cut, or why not."""
    half, w = duration // 2, _in_order()
    nxt = F.lead(F.struct("item", "start", "src", "head", "gap")).over(w)
    pairs = rows.withColumn("_n", nxt).filter(selected)
    refused = F.when(F.col("_n").isNull(), "SELECTION").when(F.col("gap") | F.col("_n.gap"), "GAP").when((F.col("tail") < half) | (F.col("_n.head") < half), "HANDLE")
    ok = lambda c: F.when(F.col("refused").isNull(), c).cast("long")
    return pairs.withColumn("refused", refused).select("track", "item", F.col("_n.item").alias("next_item"), ok(F.col("end") - half).alias("start"), ok(F.col("end") + half).alias("end"), ok(F.col("src") + F.col("end") - F.col("start")).alias("out_src"), ok(F.col("_n.src") - half).alias("in_src"), "refused")


def open_links(rows: DataFrame, selected: Column) -> DataFrame:
    """(link, track) of the tracks that a selected item's link also owns items on, none of them selected."""
    own = rows.filter("link is not null").groupBy("link", "track").agg(F.max(F.coalesce(selected, F.lit(False))).alias("any"))
    return own.withColumn("used", F.max("any").over(Window.partitionBy("link"))).filter("used and not any").select("link", "track")


def selected_coverage(rows: DataFrame, selected: Column, lo: int, hi: int) -> DataFrame:
    """(track, refused): whether the selected items alone cover the range, and why not."""
    rows = rows.withColumns({"_over": F.greatest(F.least("end", F.lit(hi)) - F.greatest("start", F.lit(lo)), F.lit(0)), "_sel": F.coalesce(selected, F.lit(False))})
    sums = rows.groupBy("track").agg(F.sum("_over").alias("over"), F.sum(F.when(F.col("_sel"), F.col("_over")).otherwise(0)).alias("own"))
    return sums.select("track", F.when((F.col("over") == 0) | (F.col("own") < F.col("over")), "SELECTION").when(F.col("own") < hi - lo, "RESULT").alias("refused"))


# --- checks of intervals by group


def covered_ranges(ranges: DataFrame, spans: DataFrame, by: str) -> DataFrame:
    """``ranges`` (by, lo, hi) with ``covered``: whether one run of the group's overlapping or touching spans (by, start, end) holds it."""
    w = Window.partitionBy(by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.filter("start < end").withColumn("_fresh", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("_run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(by, "_run").agg(F.min("start").alias("_s"), F.max("end").alias("_e"))
    # the run that begins last at or before lo is the only one that can hold the range
    probe = ranges.select(by, F.col("lo").alias("_at"), F.lit(1).alias("_probe"), "lo", "hi", F.lit(None).cast("long").alias("_end"))
    known = runs.select(by, F.col("_s").alias("_at"), F.lit(0).alias("_probe"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"), F.col("_e").cast("long").alias("_end"))
    last = F.last("_end", ignorenulls=True).over(Window.partitionBy(by).orderBy("_at", "_probe").rowsBetween(Window.unboundedPreceding, 0))
    both = probe.unionByName(known).withColumn("_end", last).filter("_probe = 1")
    return both.select(by, "lo", "hi", F.coalesce(F.col("_end") >= F.col("hi"), F.lit(False)).alias("covered"))


def partition_coverage(spans: DataFrame, by: str, first: int) -> DataFrame:
    """Per group whether its spans (start, end; ``total`` of the group) follow each other from 0 without gap or overlap, where
    they first fail to, and whether they reach ``first`` (or the total, if less) and the total."""
    w = Window.partitionBy(by).orderBy("start", "end")
    rows = spans.withColumn("_bad", F.col("start") != F.coalesce(F.lag("end").over(w), F.lit(0)))
    sums = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_spans"), F.min(F.when(F.col("_bad"), F.col("start"))).alias("fails_at"), F.max("end").alias("reach"), F.max("total").alias("total"))
    exact = F.col("fails_at").isNull()
    return sums.select(by, "n_spans", "fails_at", (exact & (F.col("reach") >= F.least(F.col("total"), F.lit(first)))).alias("first_covered"), (exact & (F.col("reach") == F.col("total"))).alias("all_covered"))


def on_grid(n: Column, d: Column, rate: int) -> Column:
    """Whether the time n / d is a whole number of 1 / rate steps."""
    return F.pmod(n * rate, d) == 0


def subtracted(minuend: DataFrame, spans: DataFrame, by: str) -> DataFrame:
    """(by, id, start, end): what the group's spans (by, start, end) leave of each interval of ``minuend`` (by, id, start, end).

    An interval's spans are clipped to it and walked by their running end; the
    pairs of an interval with its own spans are all that is made.
    """
    met = minuend.select(by, "id", F.col("start").alias("_lo"), F.col("end").alias("_hi")).join(spans.select(by, F.col("start").alias("_s"), F.col("end").alias("_e")), by)
    met = met.filter((F.col("_s") < F.col("_hi")) & (F.col("_lo") < F.col("_e")) & (F.col("_s") < F.col("_e"))).select(by, "id", "_lo", "_hi", F.greatest("_s", "_lo").alias("_s"), F.least("_e", "_hi").alias("_e"))
    ends = minuend.filter(F.col("start") < F.col("end")).select(by, "id", F.col("start").alias("_lo"), F.col("end").alias("_hi"), F.col("end").alias("_s"), F.col("end").alias("_e"))
    before = Window.partitionBy(by, "id").orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1)
    rows = met.unionByName(ends).withColumn("_from", F.coalesce(F.max("_e").over(before), F.col("_lo")))
    return rows.filter(F.col("_from") < F.col("_s")).select(by, "id", F.col("_from").alias("start"), F.col("_s").alias("end"))


def swept(spans: DataFrame, by: str, gain: str) -> DataFrame:
    """Elementary segments between all boundaries of a group's spans (by, id, start, end, gain): the ids active in each, in
    order, and the least of their gains, 0 at most.

    Each span is carried to the segments it covers, so a row is made for each id in the result and no more.
    """
    points = spans.select(by, F.explode(F.array("start", "end")).alias("at")).distinct()
    w = Window.partitionBy(by).orderBy("at")
    segments = points.select(by, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), F.row_number().over(w).alias("k")).filter("`end` is not null")
    first = segments.select(by, "start", F.col("k").alias("k0"))
    last = segments.select(by, "end", F.col("k").alias("k1"))
    placed = spans.filter("start < end").join(first, [by, "start"]).join(last, [by, "end"])
    active = placed.select(by, "id", gain, F.explode(F.sequence("k0", "k1")).alias("k"))
    sums = active.groupBy(by, "k").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"), F.least(F.min(gain), F.lit(0)).alias("least"))
    return segments.join(sums, [by, "k"]).select(by, "start", "end", "ids", "least")


def clip_diff(before: DataFrame, after: DataFrame, same: list[str], at: str, least: int, parts: int | None = None) -> DataFrame:
    """Clips added, removed or moved: equal by the columns ``same``, moved if ``at`` differs by more than ``least``.

    ``parts`` says how many parts both sides are dealt to; without it the session's settings do.
    """
    old, new = before.select(*same, F.col(at).alias("was")), after.select(*same, F.col(at).alias("now"))
    if parts:
        old, new = old.repartition(parts, *same), new.repartition(parts, *same)
    both = old.join(new, same, "full_outer")
    op = F.when(F.col("was").isNull(), "add").when(F.col("now").isNull(), "remove").when(F.abs(F.col("now") - F.col("was")) > least, "move")
    return both.select(*same, op.alias("op"), "was", "now").filter("op is not null")


# --- queries


def track_slip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slip(tracks(spark, sf_dir), F.col("item") == 2, 3)


def track_slide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slide(tracks(spark, sf_dir), F.col("item") == 2, -2)


def track_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjust_boundary(tracks(spark, sf_dir), F.col("item").isin(1, 2), 25)


def track_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insert(tracks(spark, sf_dir), 10, 7, -1)


def track_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions(tracks(spark, sf_dir), F.col("item") % 2 == 1, 4)


def track_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_links(tracks(spark, sf_dir), F.col("item") == 1)


def track_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected_coverage(tracks(spark, sf_dir), F.col("item") <= 2, 5, 45)


def _customer_spans(spark: SparkSession, sf_dir: str, days: int) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    return read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), day.alias("start"), (day + days).alias("end"), (-(F.col("o_orderkey") % 9)).alias("gain"))


def range_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a customer's orders, as spans of 300 days, cover each year from the first order's day on."""
    spans = _customer_spans(spark, sf_dir, 300)
    ranges = spans.groupBy("o_custkey").agg(F.min("start").alias("s")).select("o_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("y"), "s").select("o_custkey", (F.col("s") + F.col("y") * 365).alias("lo"), (F.col("s") + F.col("y") * 365 + 365).alias("hi"))
    return covered_ranges(ranges, spans, "o_custkey")


def track_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks without their items of 13: partitions where there are none."""
    rows = tracks(spark, sf_dir).withColumn("total", F.max("end").over(_track())).filter(F.col("end") - F.col("start") != 13)
    return partition_coverage(rows.withColumnRenamed("track", "key"), "key", 60)


def grid_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts at a third of their number in seconds that don't lie on frames of 24 a second and of 25 a second."""
    t = tracks(spark, sf_dir)
    return t.select("track", "item", on_grid(F.col("start"), F.lit(3), 24).alias("at_24"), on_grid(F.col("start"), F.lit(3), 25).alias("at_25")).filter("not at_24 or not at_25")


def silence_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What orders as spans of 20 days leave of the 100 days after each tenth order of the customer."""
    minuend = _customer_spans(spark, sf_dir, 100).filter("id % 10 = 0").select("o_custkey", "id", "start", "end")
    return subtracted(minuend, _customer_spans(spark, sf_dir, 20).filter("id % 10 <> 0"), "o_custkey")


def sweep_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swept(_customer_spans(spark, sf_dir, 90), "o_custkey", "gain")


def clip_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items against those of a version in which some are gone, some new and some elsewhere."""
    t = tracks(spark, sf_dir).select("track", "item", "start")
    after = t.filter("item % 5 <> 4").withColumn("start", F.col("start") + F.when(F.col("track") % 3 == 0, F.col("item") % 4).otherwise(0))
    return clip_diff(t, after.unionByName(t.filter("item = 1").withColumn("item", F.lit(0).cast("long"))), ["track", "item"], "start", 1, parts_for(read(spark, sf_dir, "lineitem")))


QUERIES = {f.__name__: f for f in (track_slip, track_slide, track_boundary, track_insert, track_transitions, track_links, track_coverage, range_covered, track_partition, grid_alignment, silence_subtract, sweep_active, clip_changes)}

_T = """t0 AS (SELECT l_orderkey AS track, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS item, count(*) OVER (PARTITION BY l_orderkey) AS n, CAST(l_quantity AS BIGINT) AS dur, l_partkey % 7 AS head, l_suppkey % 7 AS tail, CASE WHEN l_partkey % 3 = 0 THEN l_orderkey // 4 END AS link FROM lineitem),
t1 AS (SELECT *, CAST(sum(dur) OVER (PARTITION BY track ORDER BY item) AS BIGINT) AS "end" FROM t0),
t AS (SELECT track, item, "end" - dur AS start, "end", CAST(0 AS BIGINT) AS src, head, tail, item = n AND track % 2 = 0 AS gap, link FROM t1)"""
_C = """o AS (SELECT o_custkey, o_orderkey AS id, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS start, -(o_orderkey % 9) AS gain FROM orders)"""
ORACLES = {
    "track_slip": f"""WITH {_T}, w AS (SELECT track, CASE WHEN count(*) FILTER (item = 2) <> 1 THEN 'SELECTION' WHEN bool_or(gap) FILTER (item = 2) THEN 'GAP' WHEN min(tail) FILTER (item = 2) < 3 THEN 'HANDLE' END AS refused FROM t GROUP BY 1)
SELECT t.track, item, start, "end", src + m AS src, head + m AS head, tail - m AS tail, gap, refused FROM (SELECT t.*, refused, CASE WHEN item = 2 AND refused IS NULL THEN 3 ELSE 0 END AS m FROM t JOIN w USING (track)) t""",
    "track_slide": f"""WITH {_T}, p AS (SELECT b.track, CASE WHEN a.track IS NULL OR c.track IS NULL THEN 'SELECTION' WHEN a."end" - a.start - 2 <= 0 THEN 'TIME' WHEN a.gap OR c.gap THEN 'GAP' WHEN c.head < 2 THEN 'HANDLE' END AS refused FROM t b LEFT JOIN t a ON a.track = b.track AND a.item = 1 LEFT JOIN t c ON c.track = b.track AND c.item = 3 WHERE b.item = 2),
j AS (SELECT t.*, CASE WHEN p.track IS NULL THEN 'SELECTION' ELSE refused END AS refused FROM t LEFT JOIN p USING (track)), m AS (SELECT *, CASE WHEN refused IS NULL THEN -2 ELSE 0 END AS m FROM j)
SELECT track, item, start + CASE WHEN item IN (2, 3) THEN m ELSE 0 END AS start, "end" + CASE WHEN item IN (1, 2) THEN m ELSE 0 END AS "end", src + CASE WHEN item = 3 THEN m ELSE 0 END AS src, head + CASE WHEN item = 3 THEN m ELSE 0 END AS head, tail - CASE WHEN item = 1 THEN m ELSE 0 END AS tail, gap, refused FROM m""",
    "track_boundary": f"""WITH {_T}, p AS (SELECT a.track, 25 - a."end" AS m, CASE WHEN a.gap OR coalesce(b.gap, true) THEN 'SELECTION' WHEN 25 <= a.start OR 25 >= b."end" THEN 'TIME' WHEN a.tail < 25 - a."end" OR b.head < a."end" - 25 THEN 'HANDLE' END AS refused FROM t a LEFT JOIN t b ON a.track = b.track AND b.item = 2 WHERE a.item = 1)
SELECT track, item, start + CASE WHEN item = 2 THEN k ELSE 0 END AS start, "end" + CASE WHEN item = 1 THEN k ELSE 0 END AS "end", src + CASE WHEN item = 2 THEN k ELSE 0 END AS src, head + CASE WHEN item = 2 THEN k ELSE 0 END AS head, tail - CASE WHEN item = 1 THEN k ELSE 0 END AS tail, gap, refused FROM (SELECT t.*, refused, CASE WHEN refused IS NULL THEN m ELSE 0 END AS k FROM t JOIN p USING (track))""",
    "track_insert": f"""WITH {_T}, s AS (SELECT track, max("end") - 7 AS f, CASE WHEN 10 > max("end") - 7 THEN 'TIME' WHEN coalesce(max("end") FILTER (NOT gap), 0) > max("end") - 7 THEN 'RESULT' END AS refused FROM t GROUP BY 1),
j AS (SELECT t.*, f, refused FROM t JOIN s USING (track)),
p AS (SELECT track, item, start, "end", src, gap, refused FROM j WHERE refused IS NOT NULL
UNION ALL SELECT track, item, start, least("end", 10), src, gap, refused FROM j WHERE refused IS NULL AND start < 10
UNION ALL SELECT track, item, greatest(start, 10) + 7, least("end", f) + 7, CASE WHEN gap THEN src ELSE src + greatest(start, 10) - start END, gap, refused FROM j WHERE refused IS NULL AND least("end", f) > greatest(start, 10)
UNION ALL SELECT track, -1, 10, 17, 0, false, refused FROM s WHERE refused IS NULL)
SELECT * FROM p""",
    "track_transitions": f"""WITH {_T}, n AS (SELECT t.*, b.item AS next_item, CASE WHEN b.track IS NULL THEN 'SELECTION' WHEN t.gap OR b.gap THEN 'GAP' WHEN t.tail < 2 OR b.head < 2 THEN 'HANDLE' END AS refused FROM t LEFT JOIN t b ON b.track = t.track AND b.item = t.item + 1 WHERE t.item % 2 = 1)
SELECT track, item, next_item, CASE WHEN refused IS NULL THEN "end" - 2 END AS start, CASE WHEN refused IS NULL THEN "end" + 2 END AS "end", CASE WHEN refused IS NULL THEN "end" - start END AS out_src, CASE WHEN refused IS NULL THEN -2 END AS in_src, refused FROM n""",
    "track_links": f"""WITH {_T}, l AS (SELECT link, track, bool_or(item = 1) AS a FROM t WHERE link IS NOT NULL GROUP BY 1, 2) SELECT l.link, l.track FROM l WHERE NOT a AND link IN (SELECT link FROM l WHERE a)""",
    "track_coverage": f"""WITH {_T}, c AS (SELECT track, sum(greatest(least("end", 45) - greatest(start, 5), 0)) AS o, sum(CASE WHEN item <= 2 THEN greatest(least("end", 45) - greatest(start, 5), 0) ELSE 0 END) AS s FROM t GROUP BY 1)
SELECT track, CASE WHEN o = 0 OR s < o THEN 'SELECTION' WHEN s < 40 THEN 'RESULT' END AS refused FROM c""",
    "range_covered": f"""WITH {_C}, r AS (SELECT o_custkey, s + y * 365 AS lo, s + y * 365 + 365 AS hi FROM (SELECT o_custkey, min(start) AS s FROM o GROUP BY 1), range(4) t(y)),
u AS (SELECT *, CASE WHEN start <= max(start + 300) OVER (PARTITION BY o_custkey ORDER BY start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM o),
v AS (SELECT *, sum(f) OVER (PARTITION BY o_custkey ORDER BY start, id ROWS UNBOUNDED PRECEDING) AS run FROM u), w AS (SELECT o_custkey, run, min(start) AS s, max(start) + 300 AS e FROM v GROUP BY 1, 2)
SELECT r.o_custkey, lo, hi, bool_or(coalesce(s <= lo AND hi <= e, false)) AS covered FROM r LEFT JOIN w ON r.o_custkey = w.o_custkey GROUP BY 1, 2, 3""",
    "track_partition": f"""WITH {_T}, a AS (SELECT *, max("end") OVER (PARTITION BY track) AS total FROM t), b AS (SELECT *, start <> coalesce(lag("end") OVER (PARTITION BY track ORDER BY start), 0) AS bad FROM a WHERE "end" - start <> 13),
g AS (SELECT track AS key, count(*) AS n_spans, min(start) FILTER (bad) AS fails_at, max("end") AS reach, max(total) AS total FROM b GROUP BY 1)
SELECT key, n_spans, fails_at, fails_at IS NULL AND reach >= least(total, 60) AS first_covered, fails_at IS NULL AND reach = total AS all_covered FROM g""",
    "grid_alignment": f"""WITH {_T} SELECT track, item, start * 24 % 3 = 0 AS at_24, start * 25 % 3 = 0 AS at_25 FROM t WHERE start * 24 % 3 <> 0 OR start * 25 % 3 <> 0""",
    "silence_subtract": f"""WITH {_C}, m AS (SELECT o_custkey, id, start AS lo, start + 100 AS hi FROM o WHERE id % 10 = 0), d AS (SELECT o_custkey, id, unnest(range(lo, hi)) AS d FROM m),
f AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.o_custkey = d.o_custkey AND o.id % 10 <> 0 AND o.start <= d.d AND d.d < o.start + 20)), g AS (SELECT *, d - row_number() OVER (PARTITION BY o_custkey, id ORDER BY d) AS g FROM f)
SELECT o_custkey, id, min(d) AS start, max(d) + 1 AS "end" FROM g GROUP BY o_custkey, id, g""",
    "sweep_active": f"""WITH {_C}, p AS (SELECT DISTINCT o_custkey, unnest([start, start + 90]) AS b FROM o), l AS (SELECT *, lead(b) OVER (PARTITION BY o_custkey ORDER BY b) AS e FROM p)
SELECT l.o_custkey, b AS start, e AS "end", string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, least(min(gain), 0) AS least FROM l JOIN o ON l.o_custkey = o.o_custkey AND o.start <= b AND e <= o.start + 90 WHERE e IS NOT NULL GROUP BY 1, 2, 3""",
    "clip_changes": f"""WITH {_T}, a AS (SELECT track, item, start FROM t), b AS (SELECT track, item, start + CASE WHEN track % 3 = 0 THEN item % 4 ELSE 0 END AS start FROM a WHERE item % 5 <> 4 UNION ALL SELECT track, 0, start FROM a WHERE item = 1)
SELECT coalesce(a.track, b.track) AS track, coalesce(a.item, b.item) AS item, CASE WHEN a.track IS NULL THEN 'add' WHEN b.track IS NULL THEN 'remove' ELSE 'move' END AS op, a.start AS was, b.start AS now FROM a FULL JOIN b ON a.track = b.track AND a.item = b.item WHERE a.track IS NULL OR b.track IS NULL OR abs(b.start - a.start) > 1""",
}
