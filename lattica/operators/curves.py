"""Signals over time as functions of tables: event tracks, keyframes with easing, observations, ramps and tempo maps; and the
parts of a chart that depend on all of its values: domains, decade ticks, label thinning and legend rows.

A signal belongs to a ``by``; probes (by, t) ask for its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica import functions as fn
from lattica.operators.charts import monthly
from lattica.sources import read

#: Labels of one axis, and items of one legend, at most: these are laid out as one array.
MOST_LABELS = 256


def _beside(points: DataFrame, probes: DataFrame, by: str, at: str, *, ahead: bool = False) -> DataFrame:
    """Probes (by, t) with ``a``, the last of the ``points`` at or before t, and ``b``, the first one after it, if asked for."""
    row = F.struct(*[c for c in points.columns if c != by]).alias("_p")
    both = points.select(by, F.col(at).alias("t"), F.lit(0).alias("_k"), row).unionByName(probes.select(by, "t", F.lit(1).alias("_k")), allowMissingColumns=True)
    order = Window.partitionBy(by).orderBy("t", "_k")
    found = both.withColumn("a", F.last("_p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if ahead:
        found = found.withColumn("b", F.first("_p", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    return found.filter("_k = 1").drop("_k", "_p")


def sample_tracks(events: DataFrame, probes: DataFrame, by: str, initial: float) -> DataFrame:
    """(by, t, v): the value of the last event (by, start, end, v0, v1, curve) begun at or before each probe.

    An event without an end sets its value v1; one with an end moves from v0 to
    v1 along its curve and stays there.  Before all events the value is ``initial``.
    """
    e = lambda c: F.col(f"a.{c}")
    share = fn.clamp((F.col("t") - e("start")) / F.nullif(e("end") - e("start"), F.lit(0)), F.lit(0.0), F.lit(1.0))
    moving = e("v0") + (e("v1") - e("v0")) * fn.eased(share, e("curve"))
    value = F.when(F.col("a").isNull(), F.lit(initial)).when(e("end").isNull() | (F.col("t") >= e("end")), e("v1")).when(F.col("t") <= e("start"), e("v0")).otherwise(moving)
    return _beside(events, probes, by, "start").select(by, "t", value.alias("v"))


def sample_keyframes(keys: DataFrame, probes: DataFrame, by: str) -> DataFrame:
    """(by, t, v) between keyframes (by, at, v, curve), along the right one's curve; held before the first and after the last."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    share = (F.col("t") - a("at")) / F.nullif(b("at") - a("at"), F.lit(0))
    value = F.when(F.col("a").isNull(), b("v")).when(F.col("b").isNull() | (F.col("t") == a("at")), a("v")).otherwise(a("v") + (b("v") - a("v")) * fn.eased(share, b("curve")))
    return _beside(keys, probes, by, "at", ahead=True).select(by, "t", value.alias("v"))


def resolve_observations(rows: DataFrame, by: str, order: str, *, least: float, policies: dict[str, str]) -> DataFrame:
    """Observations (by, order, status, confidence, v) as visible, held, hidden or failed, with the value of the first two.

    One is usable if it is visible and sure enough.  Else the policy of its
    status (of ``low`` where only the confidence is too small) says what to do:
    hide, fail, or hold the last usable one, which fails where there is none.
    """
    usable = F.coalesce((F.col("status") == "visible") & (F.col("confidence") >= least), F.lit(False))
    why = F.when(F.col("status") == "visible", "low").otherwise(F.col("status"))
    policy = F.lit("fail")
    for name, what in policies.items():
        policy = F.when(why == name, what).otherwise(policy)
    last = F.last(F.when(usable, F.col("v")), ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_last": last, "_policy": policy})
    state = F.when(usable, "visible").when(F.col("_policy") == "hide", "hidden").when((F.col("_policy") == "hold") & F.col("_last").isNotNull(), "held").otherwise("failed")
    return rows.withColumn("state", state).select(by, order, "state", F.when(F.col("state").isin("visible", "held"), F.col("_last")).alias("v"))


def slice_ramps(points: DataFrame, cuts: DataFrame, by: str) -> DataFrame:
    """(by, at, rate): the points of a linear ramp (by, at, rate) strictly inside each cut (by, start, end), re-based to its
    start, and the interpolated rates at both ends; a cut outside the ramp has no rows."""
    ends = cuts.select(by, F.explode(F.array("start", "end")).alias("t")).distinct()
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    rate = F.when(F.col("t") == a("at"), a("rate")).when(F.col("b").isNotNull(), a("rate") + (b("rate") - a("rate")) * (F.col("t") - a("at")) / (b("at") - a("at")))
    at_ends = _beside(points, ends, by, "at", ahead=True).filter("a is not null").select(by, "t", rate.alias("rate")).filter("rate is not null")
    one = cuts.join(at_ends.select(by, F.col("t").alias("start"), F.col("rate").alias("_r0")), [by, "start"]).join(at_ends.select(by, F.col("t").alias("end"), F.col("rate").alias("_r1")), [by, "end"]).filter("start < end")
    inner = one.join(points, by).filter((F.col("at") > F.col("start")) & (F.col("at") < F.col("end"))).select(by, (F.col("at") - F.col("start")).alias("at"), F.col("rate"))
    outer = one.select(by, F.explode(F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("_r0").alias("rate")), F.struct((F.col("end") - F.col("start")).cast("long").alias("at"), F.col("_r1").alias("rate")))).alias("p")).select(by, "p.*")
    return outer.unionByName(inner)


def tempo_map(points: DataFrame, by: str) -> DataFrame:
    """Segments (by, start, end, bpm, beats60): tempo points (by, at, bpm, total) in seconds, each up to the next or the total,
    and sixty times the beats before each."""
    order = Window.partitionBy(by).orderBy("at")
    rows = points.withColumn("end", F.coalesce(F.lead("at").over(order), F.col("total")))
    before = F.coalesce(F.sum(F.col("bpm") * (F.col("end") - F.col("at"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select(by, F.col("at").alias("start"), "end", "bpm", before.alias("beats60"))


def times_of_beats(segments: DataFrame, beats: DataFrame, by: str) -> DataFrame:
    """(by, beat60, t): when each beat (by, beat60) falls by a tempo map; beats after the last segment have no row."""
    known = segments.select(by, "beats60", "start", "bpm", (F.col("beats60") + F.col("bpm") * (F.col("end") - F.col("start"))).alias("until"))
    met = _beside(known, beats.select(by, F.col("beat60").alias("t")), by, "beats60").filter("a is not null and t <= a.until")
    return met.select(by, F.col("t").alias("beat60"), (F.col("a.start") + (F.col("t") - F.col("a.beats60")) / F.col("a.bpm")).alias("t"))


# --- charts


def auto_domain(values: DataFrame, value: str) -> DataFrame:
    """(lo, hi): the values' range with zero in it; -1 to 1 where all are zero."""
    d = values.agg(F.least(F.lit(0), F.min(value)).alias("lo"), F.greatest(F.lit(0), F.max(value)).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    return d.select(F.when(flat, -1).otherwise(F.col("lo")).alias("lo"), F.when(flat, 1).otherwise(F.col("hi")).alias("hi"))


def outside_domain(values: DataFrame, value: str, lo: float, hi: float) -> DataFrame:
    """The rows that an explicit domain doesn't hold; an empty or backward domain is refused."""
    if not lo < hi:
        raise ValueError("a domain's least value must be below its greatest")
    return values.filter((F.col(value) < lo) | (F.col(value) > hi))


def decade_ticks(lo: Column, hi: Column) -> Column:
    """Both ends (whole, positive) and the powers of ten strictly between, in order."""
    tens = F.transform(F.sequence(F.lit(0), F.lit(18)), lambda e: F.pow(F.lit(10.0), e).cast("long"))
    return F.array_distinct(F.concat(F.array(lo), F.filter(tens, lambda p: (p > lo) & (p < hi)), F.array(hi)))


def thin_labels(labels: DataFrame, by: str, gap: int) -> DataFrame:
    """Labels (by, i, centre, size) with ``shown``: the first and last always, and of the rest, in order of place, whatever is
    clear of the last one shown and of the end; at most ``MOST_LABELS`` an axis.  Where both ends clash, ``shown`` is null."""
    rows = F.array_sort(F.collect_list(F.struct("centre", "i", (F.col("centre") * 2 - F.col("size")).alias("s"), (F.col("centre") * 2 + F.col("size")).alias("e"))))
    axis = labels.groupBy(by).agg(rows.alias("all"), F.assert_true(F.count(F.lit(1)) <= MOST_LABELS).alias("_ok"))
    last = F.element_at("all", -1)
    clear = lambda e, s: e + 2 * gap <= s
    start = F.struct(F.col("all")[0]["e"].alias("e"), F.array(F.col("all")[0]["i"]).alias("kept"))
    step = lambda a, x: F.when(clear(a["e"], x["s"]) & clear(x["e"], last["s"]), F.named_struct(F.lit("e"), x["e"], F.lit("kept"), F.concat(a["kept"], F.array(x["i"])))).otherwise(a)
    inner = F.slice("all", F.lit(2), F.greatest(F.size("all") - 2, F.lit(0)))
    kept = F.concat(F.aggregate(inner, start, step)["kept"], F.array(last["i"]))
    fits = (F.size("all") == 1) | clear(F.col("all")[0]["e"], last["s"])
    out = axis.select(by, F.explode("all").alias("l"), fits.alias("_fits"), kept.alias("_kept"), "_ok")
    return out.select(by, F.col("l.i").alias("i"), F.when(F.col("_fits"), F.array_contains("_kept", F.col("l.i"))).alias("shown"))


def flow_legend(items: DataFrame, by: str, width: int, gap: int) -> DataFrame:
    """Items (by, i, size) in rows of at most ``width``: row and x of each; null where one is wider than that."""
    start = F.struct(F.lit(0).alias("row"), F.lit(0).cast("long").alias("x"), F.array().cast("array<struct<i:bigint,row:int,x:bigint>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        wraps = (a["x"] > 0) & (a["x"] + gap + x["size"] > width)
        row = a["row"] + wraps.cast("int")
        at = F.when(wraps | (a["x"] == 0), F.lit(0).cast("long")).otherwise(a["x"] + gap)
        return F.struct(row.alias("row"), (at + x["size"]).alias("x"), F.concat(a["out"], F.array(F.struct(x["i"].alias("i"), row.alias("row"), at.alias("x")))).alias("out"))

    legend = items.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "size"))).alias("all"), F.max("size").alias("_most"), F.assert_true(F.count(F.lit(1)) <= MOST_LABELS).alias("_ok"))
    placed = F.aggregate("all", start, step)["out"]
    out = legend.select(by, F.explode(placed).alias("p"), (F.col("_most") <= width).alias("_fits"), "_ok")
    return out.select(by, F.col("p.i").alias("i"), F.when(F.col("_fits"), F.col("p.row")).alias("row"), F.when(F.col("_fits"), F.col("p.x")).alias("x"))


# --- queries

_T = "timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event of a user and second, with a number of its place."""
    e = read(spark, sf_dir, "events").groupBy("user_id", F.expr(_T).alias("t")).agg(F.max(F.round("value")).cast("long").alias("v"), F.max("event_id").alias("event_id"))
    return e.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy("t")) - 1)


def _curve(k: Column) -> Column:
    return F.get(F.array(*map(F.lit, ("linear", "in-cubic", "out-cubic", "in-out-cubic"))), (k % 4).cast("int"))


def _noons(e: DataFrame) -> DataFrame:
    day = F.floor(F.col("t") / 86400)
    return e.groupBy("user_id").agg(F.explode(F.sequence(F.min(day), F.max(day))).alias("day")).select("user_id", (F.col("day") * 86400 + 43200).cast("long").alias("t"))


def track_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noon values where even events move over a day from half their value and odd ones set it."""
    e = _events(spark, sf_dir)
    moves = F.col("nth") % 2 == 0
    events = e.select("user_id", F.col("t").alias("start"), F.when(moves, F.col("t") + 86400).alias("end"), (F.col("v") / 2).alias("v0"), F.col("v").cast("double").alias("v1"), _curve(F.col("nth")).alias("curve"))
    return sample_tracks(events, _noons(e), "user_id", -1.0).withColumn("v", F.round("v", 6))


def keyframe_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    keys = e.select("user_id", F.col("t").alias("at"), F.col("v").cast("double").alias("v"), _curve(F.col("nth")).alias("curve"))
    return sample_keyframes(keys, _noons(e), "user_id").withColumn("v", F.round("v", 6))


def observation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    status = F.get(F.array(*map(F.lit, ("visible", "visible", "occluded", "out"))), (F.col("event_id") % 4).cast("int"))
    rows = e.select("user_id", "nth", status.alias("status"), (F.col("v") % 10 / 10).alias("confidence"), "v")
    return resolve_observations(rows, "user_id", "nth", least=0.3, policies={"low": "hold", "occluded": "hold", "out": "hide"})


def ramp_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third to tenth day of each user's ramp."""
    e = _events(spark, sf_dir)
    points = e.select("user_id", F.col("t").alias("at"), F.col("v").cast("double").alias("rate"))
    cuts = e.groupBy("user_id").agg((F.min("t") + 172800).alias("start"), (F.min("t") + 864000).alias("end"))
    return slice_ramps(points, cuts, "user_id").withColumn("rate", F.round("rate", 6))


def _tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("user_id", F.col("t").alias("at"), (F.col("v") + 40).alias("bpm"), (F.max("t").over(Window.partitionBy("user_id")) + 3600).alias("total"))


def tempo_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tempo_map(_tempo(spark, sf_dir), "user_id")


def tempo_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When every hundred thousandth beat of a user falls."""
    segments = tempo_segments(spark, sf_dir)
    most = segments.groupBy("user_id").agg(F.max(F.col("beats60") + F.col("bpm") * (F.col("end") - F.col("start"))).alias("m"))
    beats = most.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("m") / 6_000_000))).alias("k")).select("user_id", (F.col("k") * 6_000_000).alias("beat60"))
    return times_of_beats(segments, beats, "user_id").withColumn("t", F.round("t", 4))


def chart_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic domains of two measures of the months."""
    m = monthly(spark, sf_dir)
    one = lambda c, name: auto_domain(m.withColumn("x", c), "x").select(F.lit(name).alias("measure"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    return one(F.col("n_orders"), "orders").unionByName(one(F.lit(0) - F.col("revenue"), "negative")).unionByName(one(F.lit(0), "flat"))


def domain_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outside_domain(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", 5, 45)


def log_decades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks from the least to the greatest quantity, size and revenue."""
    ranges = read(spark, sf_dir, "part").agg(F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi")).withColumn("measure", F.lit("key"))
    ranges = ranges.unionByName(monthly(spark, sf_dir).agg(F.min("revenue").alias("lo"), F.max("revenue").alias("hi")).withColumn("measure", F.lit("revenue")))
    return ranges.select("measure", F.posexplode(decade_ticks(F.greatest("lo", F.lit(1).cast("long")), F.col("hi"))).alias("i", "tick"))


def label_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each brand as labels on an axis, their names' lengths as sizes."""
    p = read(spark, sf_dir, "part").filter("p_partkey <= 5000").select("p_brand", F.col("p_partkey").cast("long").alias("i"), (F.col("p_partkey") * 37 % 4001).alias("centre"), (F.char_length("p_name") * 20).cast("long").alias("size"))
    few = p.withColumn("n", F.row_number().over(Window.partitionBy("p_brand").orderBy("i"))).filter(F.col("n") <= 40).drop("n")
    return thin_labels(few, "p_brand", 16)


def legend_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").cast("long").alias("i"), (F.char_length("n_name") * 8 + 12).cast("long").alias("size"))
    return flow_legend(p, "n_regionkey", 200, 10)


QUERIES = {f.__name__: f for f in (track_samples, keyframe_samples, observation_states, ramp_slices, tempo_segments, tempo_inverse, chart_domain, domain_outliers, log_decades, label_thinning, legend_rows)}

_E = """e0 AS (SELECT user_id, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS t, CAST(max(round(value)) AS BIGINT) AS v, max(event_id) AS event_id FROM events GROUP BY 1, 2),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS nth, ['linear', 'in-cubic', 'out-cubic', 'in-out-cubic'][(row_number() OVER (PARTITION BY user_id ORDER BY t) - 1) % 4 + 1] AS curve FROM e0),
p AS (SELECT user_id, unnest(range(CAST(floor(min(t) / 86400.0) AS BIGINT), CAST(floor(max(t) / 86400.0) AS BIGINT) + 1)) * 86400 + 43200 AS t FROM e GROUP BY 1)"""
_EASE = "CASE curve WHEN 'in-cubic' THEN x**3 WHEN 'out-cubic' THEN 1 - (1 - x)**3 WHEN 'in-out-cubic' THEN CASE WHEN x < 0.5 THEN 4 * x**3 ELSE 1 - (2 - 2 * x)**3 / 2 END ELSE x END"
_M = """m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n_orders, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS revenue FROM orders GROUP BY 1)"""
_S = f"""{_E}, g AS (SELECT user_id, t AS start, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), max(t) OVER (PARTITION BY user_id) + 3600) AS "end", v + 40 AS bpm FROM e),
s AS (SELECT *, CAST(coalesce(sum(bpm * ("end" - start)) OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS beats60 FROM g)"""
ORACLES = {
    "track_samples": f"""WITH {_E}, j AS (SELECT p.user_id, p.t, e.t AS s, v, nth, curve FROM p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.t >= e.t), k AS (SELECT *, least((t - s) / 86400.0::DOUBLE, 1.0::DOUBLE) AS x FROM j)
SELECT user_id, t, round(CASE WHEN s IS NULL THEN -1.0::DOUBLE WHEN nth % 2 = 1 OR t >= s + 86400 THEN CAST(v AS DOUBLE) ELSE v / 2.0::DOUBLE + v / 2.0::DOUBLE * ({_EASE}) END, 6) AS v FROM k""",
    "keyframe_samples": f"""WITH {_E}, a AS (SELECT p.user_id, p.t, e.t AS t0, e.v AS v0, e.nth AS n0 FROM p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.t >= e.t),
b AS (SELECT a.*, e.t AS t1, e.v AS v1, e.curve, (a.t - t0) / CAST(e.t - t0 AS DOUBLE) AS x FROM a LEFT JOIN e ON e.user_id = a.user_id AND e.nth = coalesce(n0, -1) + 1)
SELECT user_id, t, round(CASE WHEN t0 IS NULL THEN CAST(v1 AS DOUBLE) WHEN t1 IS NULL OR t = t0 THEN CAST(v0 AS DOUBLE) ELSE v0 + (v1 - v0) * ({_EASE}) END, 6) AS v FROM b""",
    "observation_states": f"""WITH {_E}, o AS (SELECT user_id, nth, v, event_id % 4 AS k, event_id % 4 < 2 AND v % 10 >= 3 AS u FROM e), l AS (SELECT *, last_value(CASE WHEN u THEN v END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY nth ROWS UNBOUNDED PRECEDING) AS lv FROM o),
s AS (SELECT *, CASE WHEN u THEN 'visible' WHEN k = 3 THEN 'hidden' WHEN lv IS NOT NULL THEN 'held' ELSE 'failed' END AS state FROM l)
SELECT user_id, CAST(nth AS INTEGER) AS nth, state, CASE WHEN state IN ('visible', 'held') THEN lv END AS v FROM s""",
    "ramp_slices": f"""WITH {_E}, c AS (SELECT user_id, min(t) + 172800 AS s, min(t) + 864000 AS f, max(t) AS hi FROM e GROUP BY 1), q AS (SELECT user_id, s, f, unnest([s, f]) AS t FROM c WHERE f <= hi),
a AS (SELECT q.*, e.t AS t0, e.v AS v0, e.nth AS n0 FROM q ASOF JOIN e ON q.user_id = e.user_id AND q.t >= e.t), b AS (SELECT a.*, v0 + coalesce((e.v - v0) * (a.t - t0) / CAST(e.t - t0 AS DOUBLE), 0) AS r FROM a LEFT JOIN e ON e.user_id = a.user_id AND e.nth = n0 + 1)
SELECT user_id, t - s AS "at", round(r, 6) AS rate FROM b UNION ALL SELECT e.user_id, e.t - s, round(CAST(v AS DOUBLE), 6) FROM e JOIN c ON e.user_id = c.user_id WHERE f <= hi AND e.t > s AND e.t < f""",
    "tempo_segments": f"WITH {_S} SELECT * FROM s",
    "tempo_inverse": f"""WITH {_S}, m AS (SELECT user_id, unnest(range(max(beats60 + bpm * ("end" - start)) // 6000000 + 1)) * 6000000 AS beat60 FROM s GROUP BY 1)
SELECT m.user_id, beat60, round(start + (beat60 - beats60) / CAST(bpm AS DOUBLE), 4) AS t FROM m ASOF JOIN s ON m.user_id = s.user_id AND m.beat60 >= s.beats60""",
    "chart_domain": f"WITH {_M} SELECT 'orders' AS measure, least(0, min(n_orders)) AS lo, greatest(0, max(n_orders)) AS hi FROM m UNION ALL SELECT 'negative', least(0, min(-revenue)), greatest(0, max(-revenue)) FROM m UNION ALL SELECT 'flat', -1, 1",
    "domain_outliers": "SELECT p_partkey, p_size FROM part WHERE p_size < 5 OR p_size > 45",
    "log_decades": f"""WITH {_M}, r AS (SELECT 'key' AS measure, greatest(min(p_partkey), 1) AS lo, max(p_partkey) AS hi FROM part UNION ALL SELECT 'revenue', greatest(min(revenue), 1), max(revenue) FROM m),
t AS (SELECT measure, lo AS tick FROM r UNION SELECT measure, hi FROM r UNION SELECT measure, p FROM r, (SELECT CAST(10 ** e AS BIGINT) AS p FROM range(19) x(e)) WHERE p > lo AND p < hi)
SELECT measure, CAST(row_number() OVER (PARTITION BY measure ORDER BY tick) - 1 AS INTEGER) AS i, tick FROM t""",
    "label_thinning": """WITH RECURSIVE p AS (SELECT p_brand, p_partkey AS i, p_partkey * 37 % 4001 AS c, length(p_name) * 20 AS z, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_partkey <= 5000),
o AS (SELECT p_brand, i, c * 2 - z AS s, c * 2 + z AS e, row_number() OVER (PARTITION BY p_brand ORDER BY c, i) AS k, count(*) OVER (PARTITION BY p_brand) AS m FROM p WHERE n <= 40),
w AS (SELECT a.p_brand, a.m, a.e AS e0, b.s AS s1 FROM o a JOIN o b ON a.p_brand = b.p_brand AND a.k = 1 AND b.k = b.m),
g AS (SELECT p_brand, CAST(1 AS BIGINT) AS k, e0 AS e, true AS shown FROM w UNION ALL
SELECT g.p_brand, o.k, CASE WHEN o.k < w.m AND g.e + 32 <= o.s AND o.e + 32 <= s1 THEN o.e ELSE g.e END, o.k = w.m OR (g.e + 32 <= o.s AND o.e + 32 <= s1) FROM g JOIN o ON o.p_brand = g.p_brand AND o.k = g.k + 1 JOIN w ON w.p_brand = g.p_brand)
SELECT o.p_brand, o.i, CASE WHEN w.m = 1 OR e0 + 32 <= s1 THEN g.shown END AS shown FROM o JOIN g USING (p_brand, k) JOIN w USING (p_brand)""",
    "legend_rows": """WITH RECURSIVE p AS (SELECT n_regionkey, CAST(n_nationkey AS BIGINT) AS i, length(n_name) * 8 + 12 AS z, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, max(length(n_name) * 8 + 12) OVER (PARTITION BY n_regionkey) AS most FROM nation),
g AS (SELECT n_regionkey, k, i, 0 AS r, CAST(0 AS BIGINT) AS x, CAST(z AS BIGINT) AS c, most FROM p WHERE k = 1 UNION ALL
SELECT p.n_regionkey, p.k, p.i, CASE WHEN g.c + 10 + z > 200 THEN r + 1 ELSE r END, CASE WHEN g.c + 10 + z > 200 THEN 0 ELSE g.c + 10 END, CASE WHEN g.c + 10 + z > 200 THEN z ELSE g.c + 10 + z END, p.most FROM g JOIN p ON p.n_regionkey = g.n_regionkey AND p.k = g.k + 1)
SELECT n_regionkey, i, CASE WHEN most <= 200 THEN r END AS "row", CASE WHEN most <= 200 THEN x END AS x FROM g""",
}
