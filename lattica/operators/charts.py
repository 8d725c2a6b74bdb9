"""Series and their geometry: long form, scales, ticks, bars and number texts; and sampling of signals over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import even_text, fixed_text
from lattica.sources import read


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by month: a few dozen rows, however many orders."""
    o = read(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month"))
    return o.agg(F.count(F.lit(1)).alias("n_orders"), F.sum(F.round(F.col("o_totalprice")).cast("long")).alias("revenue"))


def series_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(spark, sf_dir).unpivot(["month"], ["n_orders", "revenue"], "series", "value")


def _all():
    """All of a few dozen aggregated rows."""
    return Window.partitionBy(F.lit(1))



def scale_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places between least and most in parts per million."""
    m = monthly(spark, sf_dir)
    lo, hi = F.min("n_orders").over(_all()), F.max("n_orders").over(_all())
    return m.select("month", F.floor((F.col("n_orders") - lo) * 1000000 / F.greatest(hi - lo, F.lit(1))).cast("long").alias("place_ppm"))


def linear_ticks(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    m = monthly(spark, sf_dir).agg(F.min("revenue").alias("lo"), F.max("revenue").alias("hi"))
    return m.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), "lo", "hi").select("i", F.floor(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (n - 1)).cast("long").alias("tick"))


def scale_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = monthly(spark, sf_dir).filter("revenue > 0")
    lo, hi = F.ln(F.min("revenue").over(_all()).cast("double")), F.ln(F.max("revenue").over(_all()).cast("double"))
    return m.select("month", F.round((F.ln(F.col("revenue").cast("double")) - lo) / (hi - lo), 6).alias("place"))


def scale_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories in order of first appearance, centres at (2 i + 1) / (2 n)."""
    c = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("first_key"))
    i = F.row_number().over(Window.orderBy("first_key")) - 1
    return c.select("p_brand", i.cast("long").alias("i"), F.count(F.lit(1)).over(_all()).alias("n")).select("p_brand", "i", F.floor((2 * F.col("i") + 1) * 1000000 / (2 * F.col("n"))).cast("long").alias("centre_ppm"))


def scale_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = monthly(spark, sf_dir)
    lo, hi = F.min("month").over(_all()), F.max("month").over(_all())
    return m.select("month", F.floor(F.datediff("month", lo).cast("long") * 1000000 / F.datediff(hi, lo)).cast("long").alias("place_ppm"))


def date_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month steps anchored on the 31st: the day is clamped each time, never carried on."""
    days = spark.range(36).select(F.col("id").cast("int").alias("i"))
    return days.select("i", F.add_months(F.lit("2023-01-31").cast("date"), F.col("i")).alias("tick"))


def bar_layout(spark: SparkSession, sf_dir: str, width: int = 1200000, height: int = 400000) -> DataFrame:
    """Slots of equal width, and bars from the baseline at the place of 0, in whole units."""
    m = monthly(spark, sf_dir)
    i, n = F.row_number().over(Window.orderBy("month")) - 1, F.count(F.lit(1)).over(_all())
    top = F.greatest(F.max("n_orders").over(_all()), F.lit(0))
    return m.select("month", F.floor(i * width / n).cast("long").alias("x"), F.floor(F.lit(width) / n).cast("long").alias("slot"), F.floor(F.col("n_orders") * height / top).cast("long").alias("bar"))


def number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves away from zero, and halves to even, as texts."""
    x = (F.col("p_retailprice").cast("decimal(18,2)") / 8).cast("decimal(18,6)")
    return read(spark, sf_dir, "part").select("p_partkey", fixed_text(x, 2, " u").alias("away"), even_text(x.cast("decimal(18,3)"), 2).alias("even"))


def asof_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of the customer with the user's number at or before each event's day: union, then last value in order."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.dayofmonth("ts").cast("long").alias("d"), F.lit(1).alias("probe"), "event_id", F.lit(None).cast("long").alias("orderkey"))
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.dayofmonth("o_orderdate").cast("long").alias("d")).agg(F.max("o_orderkey").alias("orderkey")).select("k", "d", F.lit(0).alias("probe"), F.lit(None).cast("long").alias("event_id"), "orderkey")
    order = Window.partitionBy("k").orderBy("d", "probe").rowsBetween(Window.unboundedPreceding, 0)
    return e.unionByName(o).withColumn("last_order", F.last("orderkey", ignorenulls=True).over(order)).filter("probe = 1").select("event_id", "last_order")


_T = "timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"
def _by_time():
    return Window.partitionBy("user_id").orderBy("t", "event_id")



def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_T).alias("t"), F.round("value").cast("long").alias("v"))


def _at_noons(s: DataFrame, days: DataFrame) -> DataFrame:
    """Values of a signal at noon of each (user_id, day) between the samples beside it; held before the first and after the last."""
    s = s.select("user_id", "t", "v", "event_id", F.lit(0).alias("probe"))
    noons = days.select("user_id", (F.col("day") * 86400 + 43200).cast("long").alias("t"), F.lit(None).cast("long").alias("v"), F.lit(None).cast("long").alias("event_id"), F.lit(1).alias("probe"))
    order = Window.partitionBy("user_id").orderBy("t", "probe", "event_id")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col("probe") == 0, F.struct("t", "v"))
    all_ = s.unionByName(noons).withColumns({"a": F.last(point, ignorenulls=True).over(back), "b": F.first(point, ignorenulls=True).over(ahead)}).filter("probe = 1")
    between = F.floor(F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))).cast("long")
    return all_.select("user_id", "t", F.when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull(), F.col("a.v")).otherwise(between).alias("v"))


def keyframe_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at noon of each day from a user's first sample to the last."""
    s = _signal(spark, sf_dir)
    day = F.floor(F.col("t") / 86400)
    return _at_noons(s, s.groupBy("user_id").agg(F.explode(F.sequence(F.min(day), F.max(day))).alias("day")))


def hold_last_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values under a bound are not usable; the last usable one stands in."""
    back = _by_time().rowsBetween(Window.unboundedPreceding, 0)
    return _signal(spark, sf_dir).select("event_id", F.last(F.when(F.col("v") >= 20, F.col("v")), ignorenulls=True).over(back).alias("held"))


def ramp_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the area under the line through a user's samples up to each of them."""
    s = _signal(spark, sf_dir)
    area = F.coalesce((F.col("v") + F.lag("v").over(_by_time())) * (F.col("t") - F.lag("t").over(_by_time())), F.lit(0))
    return s.withColumn("area", area).select("event_id", F.sum("area").over(_by_time().rowsBetween(Window.unboundedPreceding, 0)).alias("area2"))


def tempo_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats before each sample when every value is the tempo from there on, times 60."""
    s = _signal(spark, sf_dir)
    beats = F.col("v") * (F.lead("t").over(_by_time()) - F.col("t"))
    return s.withColumn("b", beats).select("event_id", F.coalesce(F.sum("b").over(_by_time().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("beats60"))


#: The second name of a query over all days, from when the first took some.
QUERIES = {"keyframe_linear_all": keyframe_linear} | {f.__name__: f for f in (series_long, scale_linear, linear_ticks, scale_log, scale_categorical, scale_date, date_ticks, bar_layout, number_format, asof_step, keyframe_linear, hold_last_usable, ramp_integral, tempo_beats)}

_M = """m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n_orders, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS revenue FROM orders GROUP BY 1)"""
_E = """s AS (SELECT user_id, event_id, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS t, CAST(round(value) AS BIGINT) AS v FROM events)"""
ORACLES = {
    "number_format": """WITH x AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part), y AS (SELECT *, c * 10 // 8 + CASE WHEN c * 10 % 8 >= 4 THEN 1 ELSE 0 END AS t, c // 8 + CASE WHEN c % 8 >= 4 THEN 1 ELSE 0 END AS a FROM x),
e AS (SELECT *, t // 10 + CASE WHEN t % 10 > 5 OR (t % 10 = 5 AND t // 10 % 2 = 1) THEN 1 ELSE 0 END AS b FROM y)
SELECT p_partkey, printf('%d.%02d u', a // 100, a % 100) AS away, printf('%d.%02d', b // 100, b % 100) AS even FROM e""",
    "series_long": f"WITH {_M} SELECT month, 'n_orders' AS series, n_orders AS value FROM m UNION ALL SELECT month, 'revenue', revenue FROM m",
    "scale_linear": f"WITH {_M} SELECT month, CAST((n_orders - min(n_orders) OVER ()) * 1000000 // greatest(max(n_orders) OVER () - min(n_orders) OVER (), 1) AS BIGINT) AS place_ppm FROM m",
    "linear_ticks": f"WITH {_M}, r AS (SELECT min(revenue) AS lo, max(revenue) AS hi FROM m) SELECT CAST(i AS INTEGER) AS i, lo + (hi - lo) * i // 4 AS tick FROM r, range(5) t(i)",
    "scale_log": f"WITH {_M} SELECT month, round((ln(CAST(revenue AS DOUBLE)) - ln(CAST(min(revenue) OVER () AS DOUBLE))) / (ln(CAST(max(revenue) OVER () AS DOUBLE)) - ln(CAST(min(revenue) OVER () AS DOUBLE))), 6) AS place FROM m",
    "scale_categorical": "WITH c AS (SELECT p_brand, min(p_partkey) AS k FROM part GROUP BY 1), i AS (SELECT p_brand, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM c) SELECT p_brand, i, (2 * i + 1) * 1000000 // (2 * n) AS centre_ppm FROM i",
    "scale_date": f"WITH {_M} SELECT month, CAST(date_diff('day', min(month) OVER (), month) * 1000000 // date_diff('day', min(month) OVER (), max(month) OVER ()) AS BIGINT) AS place_ppm FROM m",
    "date_ticks": "SELECT CAST(i AS INTEGER) AS i, CAST(DATE '2023-01-31' + to_months(CAST(i AS INTEGER)) AS DATE) AS tick FROM range(36) t(i)",
    "bar_layout": f"WITH {_M} SELECT month, (row_number() OVER (ORDER BY month) - 1) * 1200000 // count(*) OVER () AS x, 1200000 // count(*) OVER () AS slot, n_orders * 400000 // max(n_orders) OVER () AS bar FROM m",
    "asof_step": """WITH o AS (SELECT o_custkey AS k, CAST(day(o_orderdate) AS BIGINT) AS d, max(o_orderkey) AS orderkey FROM orders GROUP BY 1, 2), e AS (SELECT event_id, user_id AS k, CAST(day(ts) AS BIGINT) AS d FROM events)
SELECT event_id, orderkey AS last_order FROM e ASOF LEFT JOIN o ON e.k = o.k AND e.d >= o.d""",
    "hold_last_usable": f"WITH {_E} SELECT event_id, last_value(CASE WHEN v >= 20 THEN v END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM s",
    "ramp_integral": f"WITH {_E}, a AS (SELECT *, coalesce((v + lag(v) OVER o) * (t - lag(t) OVER o), 0) AS area FROM s WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT event_id, CAST(sum(area) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS area2 FROM a",
    "tempo_beats": f"WITH {_E}, b AS (SELECT *, v * (lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) - t) AS b FROM s) SELECT event_id, CAST(coalesce(sum(b) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS beats60 FROM b",
    "keyframe_linear": f"""WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM s), p AS (SELECT user_id, unnest(range(CAST(floor(min(t) / 86400.0) AS BIGINT), CAST(floor(max(t) / 86400.0) AS BIGINT) + 1)) * 86400 + 43200 AS t FROM s GROUP BY 1),
x AS (SELECT p.user_id, p.t, (SELECT max(rn) FROM r WHERE r.user_id = p.user_id AND r.t <= p.t) AS i FROM p)
SELECT x.user_id, x.t, CASE WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL THEN a.v ELSE CAST(floor(a.v + (b.v - a.v) * (x.t - a.t) / CAST(b.t - a.t AS DOUBLE)) AS BIGINT) END AS v
FROM x LEFT JOIN r a ON a.user_id = x.user_id AND a.rn = x.i LEFT JOIN r b ON b.user_id = x.user_id AND b.rn = coalesce(x.i, 0) + 1""",
}
ORACLES["keyframe_linear_all"] = ORACLES["keyframe_linear"]
