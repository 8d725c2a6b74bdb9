"""Windows over ordered samples: statistics of hops and sections, onsets, islands, pauses, phrases, envelopes and changes.

Samples are each user's event values in order of time; every window is
partitioned by user, so users spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import round_half_up
from lattica.sources import read

MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
def _by_time():
    """Each user's samples in order of time."""
    return Window.partitionBy("user_id").orderBy("ts")



def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, i (from 0), n, t in microseconds and v, the value in whole hundredths."""
    df = read(spark, sf_dir, "events")
    return df.select("user_id", "ts", F.expr(MICROS).alias("t"), F.round(F.col("value") * 100).cast("long").alias("v")).withColumns({"i": (F.row_number().over(_by_time()) - 1).cast("long"), "n": F.count(F.lit(1)).over(Window.partitionBy("user_id"))})


def hop_windows(spark: SparkSession, sf_dir: str, width: int = 8, hop: int = 4) -> DataFrame:
    """Windows of ``width`` samples every ``hop`` from the first on, tails cut short: peak, sums and activity."""
    s = samples(spark, sf_dir)
    first = F.greatest(F.floor((F.col("i") - width) / hop) + 1, F.lit(0))
    w = s.withColumn("w", F.explode(F.sequence(first, F.floor(F.col("i") / hop)))).groupBy("user_id", "w")
    return w.agg(F.count(F.lit(1)).alias("n_samples"), F.max(F.abs("v")).alias("peak"), F.sum(F.col("v") * F.col("v")).alias("energy"), F.sum(F.abs("v")).alias("abs_sum"), F.sum(F.when(F.abs("v") >= 5000, 1).otherwise(0)).cast("long").alias("n_active"))


def section_rms(spark: SparkSession, sf_dir: str, sections: int = 8) -> DataFrame:
    """Energy of equal index sections, section s from floor(n s / 8) on."""
    s = samples(spark, sf_dir).withColumn("section", F.floor((F.col("i") * sections + sections - 1) / F.col("n")).cast("long"))
    fix = F.when(F.floor(F.col("n") * F.col("section") / sections) > F.col("i"), F.col("section") - 1).otherwise(F.col("section"))
    return s.withColumn("section", fix).groupBy("user_id", "section").agg(F.count(F.lit(1)).alias("n_samples"), F.sum(F.col("v") * F.col("v")).alias("energy"))


def onset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rises against the sample before, and their share of the user's largest in parts per million."""
    s = samples(spark, sf_dir).withColumn("onset", F.greatest(F.lit(0), F.col("v") - F.coalesce(F.lag("v").over(_by_time()), F.lit(0))))
    most = F.max("onset").over(Window.partitionBy("user_id"))
    return s.select("user_id", "i", "onset", F.when(most > 0, F.floor(F.col("onset") * 1000000 / most)).otherwise(0).cast("long").alias("onset_ppm"))


def silence_islands(spark: SparkSession, sf_dir: str, threshold: int = 3000) -> DataFrame:
    """Runs of samples at or below a threshold."""
    s = samples(spark, sf_dir).withColumn("quiet", F.col("v") <= threshold)
    s = s.withColumn("change", F.when(F.col("quiet") != F.coalesce(F.lag("quiet").over(_by_time()), ~F.col("quiet")), 1).otherwise(0))
    s = s.withColumn("run", F.sum("change").over(_by_time().rowsBetween(Window.unboundedPreceding, 0))).filter("quiet")
    return s.groupBy("user_id", "run").agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.min("t").alias("start"), F.max("t").alias("end")).drop("run")


def pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between neighbours of an hour or more, by class."""
    s = samples(spark, sf_dir).withColumn("gap", F.lead("t").over(_by_time()) - F.col("t")).filter(F.col("gap") >= 3600000000)
    kind = F.when(F.col("gap") < 14400000000, "short").when(F.col("gap") < 43200000000, "medium").otherwise("long")
    order = Window.partitionBy("user_id").orderBy("t")
    return s.select("user_id", "t", "gap", kind.alias("kind")).withColumn("id", F.format_string("pause.%06d", F.row_number().over(order)))


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    ends = (F.lag("role").over(order) != F.col("role")) | F.coalesce(F.lag("text").over(order).rlike("[.!?]$"), F.lit(False))
    turns = turns.withColumn("cut", F.when(F.coalesce(ends, F.lit(False)), 1).otherwise(0))
    return turns.withColumns({"phrase": F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)), "size": F.char_length("text").cast("long")})


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in a row that neither a change of speaker nor closing punctuation parts."""
    return _phrases(spark, sf_dir).groupBy("conv_id", "phrase").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.min("role").alias("role"), F.sum("size").alias("size"))


def contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each phrase's size against the speaker's phrase before, in parts per million, and its direction."""
    order = Window.partitionBy("conv_id", "role").orderBy("phrase")
    p = phrases(spark, sf_dir).withColumn("was", F.lag("size").over(order)).filter("was > 0")
    delta = F.floor((F.col("size") - F.col("was")) * 1000000 / F.col("was")).cast("long")
    return p.select("conv_id", "phrase", delta.alias("delta_ppm"), F.when(delta > 50000, "rising").when(delta < -50000, "falling").otherwise("level").alias("shape"))


def emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of at least 1.5 times their role's median size in the conversation."""
    t = _phrases(spark, sf_dir)
    med = t.groupBy("conv_id", "role").agg(round_half_up(F.percentile("size", 0.5)).alias("median"))
    return t.join(med, ["conv_id", "role"]).filter(F.col("size") * 2 >= F.col("median") * 3).select("conv_id", "turn", "role", "size", "median")


def change_events(spark: SparkSession, sf_dir: str, step: int = 1000) -> DataFrame:
    """Quantised values where they differ from the one before (0 at first), and a closing zero."""
    s = samples(spark, sf_dir).withColumn("level", F.floor(F.col("v") / step))
    moved = s.withColumn("was", F.coalesce(F.lag("level").over(_by_time()), F.lit(0))).filter("level <> was")
    last = s.filter("i = n - 1 and level <> 0").select("user_id", F.col("n").alias("i"), F.lit(0).cast("long").alias("level"))
    return moved.select("user_id", "i", "level").unionByName(last)


def envelopes(rows: DataFrame, by: str, order: str, value: str, up: int = 500, down: int = 100) -> DataFrame:
    """(by, order, envelope): an envelope that rises fast and falls slowly, in whole numbers.

    env += (x - env) * (up or down) // 1000 from the first value on.  Each value
    needs the one before, so a ``by`` is walked in order, as a stream with one
    number carried on and nothing gathered.
    """
    schema = T.StructType([rows.schema[by], rows.schema[order], T.StructField("envelope", T.LongType())])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, env = None, 0  # keys are never null here
        for rb in batches:
            out = []
            for key, x in zip(rb.column(by).to_pylist(), rb.column(value).to_pylist()):
                env = env + (x - env) * (up if x > env else down) // 1000 if key == who else x
                who = key
                out.append(env)
            yield pa.RecordBatch.from_pydict({by: rb.column(by), order: rb.column(order), "envelope": pa.array(out, pa.int64())})

    return rows.select(by, order, value).dropna().repartition(by).sortWithinPartitions(by, order).mapInArrow(walked, schema)


def envelope_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope at every sample."""
    return envelopes(samples(spark, sf_dir), "user_id", "i", "v")


def autocorr(spark: SparkSession, sf_dir: str, lags: int = 4) -> DataFrame:
    """Products of samples with those some places earlier, by lag; each lag is a window column, so one shuffle serves all."""
    s = samples(spark, sf_dir)
    s = s.select("user_id", "v", *[F.lag("v", k).over(_by_time()).alias(f"v{k}") for k in range(1, lags + 1)])
    sums = s.groupBy("user_id").agg(*[F.sum(F.col("v") * F.col(f"v{k}")).alias(str(k)) for k in range(1, lags + 1)])
    return sums.unpivot(["user_id"], [str(k) for k in range(1, lags + 1)], "lag", "product").withColumn("lag", F.col("lag").cast("long")).filter("product is not null")


def correlated(rows: DataFrame, by: str, order: str, value: str, lags: range) -> DataFrame:
    """(by, lag, score_ppm): sum x[i] x[i - lag] over the root of both sides' energies, as whole parts per million.

    Only places that have a partner count; a lag without energy has no row.
    """
    w = Window.partitionBy(by).orderBy(order)
    wide = rows.select(by, F.col(value).cast("double").alias("x"), *[F.lag(F.col(value).cast("double"), k).over(w).alias(f"y{k}") for k in lags])
    part = lambda k, e: F.sum(F.when(F.col(f"y{k}").isNotNull(), e))
    sums = wide.groupBy(by).agg(*[F.struct(F.lit(k).cast("long").alias("lag"), part(k, F.col("x") * F.col(f"y{k}")).alias("xy"), part(k, F.col("x") * F.col("x")).alias("xx"), part(k, F.col(f"y{k}") * F.col(f"y{k}")).alias("yy")).alias(f"s{k}") for k in lags])
    each = sums.select(by, F.explode(F.array(*[F.col(f"s{k}") for k in lags])).alias("s")).select(by, "s.*").filter("xx > 0 and yy > 0")
    return each.select(by, "lag", round_half_up(F.round(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")), 9) * 1e6).alias("score_ppm"))


def spaced(scores: DataFrame, by: str, place: str, score: str, distance: int, most: int, lags: range) -> DataFrame:
    """The best ``most`` places of each ``by`` of which no two are nearer than ``distance``; ties to the smaller place.

    Greedy by score.  A ``by`` has at most as many rows as there are ``lags``, a
    parameter, so its places fit one array and the choice is a fold over them.
    """
    if len(lags) > 4096:
        raise ValueError("at most 4096 places can be spaced at once")
    ranked = scores.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(place).alias("p")))).alias("all"))
    free = lambda kept, x: (F.size(kept) < most) & ~F.exists(kept, lambda k: F.abs(k["p"] - x["p"]) < distance)
    none = F.array().cast("array<struct<s:bigint,p:bigint>>")
    chosen = F.aggregate("all", none, lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return ranked.select(by, F.posexplode(chosen).alias("i", "k")).select(by, (F.col("i") + 1).alias("place"), F.col("k.p").alias("lag"), (-F.col("k.s")).alias("score_ppm"))


#: Lags of the tempo search.
LAGS = range(2, 13)


def tempo_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's three best lags, two apart at least."""
    return spaced(correlated(samples(spark, sf_dir), "user_id", "i", "v", LAGS), "user_id", "lag", "score_ppm", 2, 3, LAGS)


def comb_phases(rows: DataFrame, lags: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, lag, phase, total): of each (by, lag), the phase whose samples at that stride sum to most; ties to the lowest."""
    sums = rows.join(lags.select(by, "lag"), by).groupBy(by, "lag", (F.col(order) % F.col("lag")).alias("phase")).agg(F.sum(value).alias("total"))
    best = sums.groupBy(by, "lag").agg(F.max(F.struct("total", (-F.col("phase")).alias("p"))).alias("m"))
    return best.select(by, "lag", (-F.col("m.p")).alias("phase"), F.col("m.total").alias("total"))


def comb_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phase of each of a user's best lags."""
    return comb_phases(samples(spark, sf_dir), tempo_lags(spark, sf_dir), "user_id", "i", "v")


def fir_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed filter of four taps, zeros before the first sample."""
    taps = (3, 2, 2, 1)
    y = sum((F.coalesce(F.lag("v", k).over(_by_time()), F.lit(0)) * c for k, c in enumerate(taps) if k), F.col("v") * taps[0])
    return samples(spark, sf_dir).select("user_id", "i", y.alias("y"))


def peak_first_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest magnitude with its first place."""
    s = samples(spark, sf_dir).groupBy("user_id").agg(F.max(F.struct(F.abs("v").alias("peak"), (-F.col("i")).alias("at"))).alias("m"))
    return s.select("user_id", F.col("m.peak").alias("peak"), (-F.col("m.at")).alias("at"))


def running_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts as running sums of the durations before."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    size = F.char_length("text").cast("long")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), size.alias("duration"))


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that a gap of six hours ends."""
    df = read(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("s"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("s")


QUERIES = {f.__name__: f for f in (tempo_lags, comb_phase, hop_windows, section_rms, onset_diff, silence_islands, pauses, phrases, contours, emphasis, change_events, envelope_ema, autocorr, fir_filter, peak_first_tie, running_cursor, session_windows)}

_S = """s AS (SELECT user_id, ts, epoch_us(ts) AS t, CAST(round(value * 100) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""
_P = """p0 AS (SELECT *, CASE WHEN lag(role) OVER o <> role OR regexp_matches(lag(text) OVER o, '[.!?]$') THEN 1 ELSE 0 END AS cut, CAST(length(text) AS BIGINT) AS size FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS phrase FROM p0),
ph AS (SELECT conv_id, phrase, min(turn) AS first_turn, max(turn) AS last_turn, min(role) AS role, CAST(sum(size) AS BIGINT) AS size FROM p GROUP BY 1, 2)"""

ORACLES = {
    "hop_windows": f"""WITH {_S}, w AS (SELECT *, unnest(range(CAST(greatest(floor((i - 8) / 4.0) + 1, 0) AS BIGINT), CAST(floor(i / 4.0) + 1 AS BIGINT))) AS w FROM s)
SELECT user_id, w, count(*) AS n_samples, max(abs(v)) AS peak, CAST(sum(v * v) AS BIGINT) AS energy, CAST(sum(abs(v)) AS BIGINT) AS abs_sum, count(*) FILTER (abs(v) >= 5000) AS n_active FROM w GROUP BY 1, 2""",
    "section_rms": f"""WITH {_S}, b AS (SELECT s.*, (SELECT max(k) FROM range(8) r(k) WHERE (n * k) // 8 <= i) AS section FROM s)
SELECT user_id, section, count(*) AS n_samples, CAST(sum(v * v) AS BIGINT) AS energy FROM b GROUP BY 1, 2""",
    "onset_diff": f"""WITH {_S}, d AS (SELECT *, greatest(0, v - coalesce(lag(v) OVER (PARTITION BY user_id ORDER BY ts), 0)) AS onset FROM s)
SELECT user_id, i, onset, CASE WHEN max(onset) OVER (PARTITION BY user_id) > 0 THEN onset * 1000000 // max(onset) OVER (PARTITION BY user_id) ELSE 0 END AS onset_ppm FROM d""",
    "silence_islands": f"""WITH {_S}, q AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM s WHERE v <= 3000)
SELECT user_id, min(i) AS first_i, max(i) AS last_i, min(t) AS start, max(t) AS "end" FROM q GROUP BY user_id, g""",
    "pauses": f"""WITH {_S}, g AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) - t AS gap FROM s)
SELECT user_id, t, gap, CASE WHEN gap < 14400000000 THEN 'short' WHEN gap < 43200000000 THEN 'medium' ELSE 'long' END AS kind,
  printf('pause.%06d', row_number() OVER (PARTITION BY user_id ORDER BY t)) AS id FROM g WHERE gap >= 3600000000""",
    "phrases": f"WITH {_P} SELECT * FROM ph",
    "contours": f"""WITH {_P}, c AS (SELECT *, lag(size) OVER (PARTITION BY conv_id, role ORDER BY phrase) AS was FROM ph), d AS (SELECT *, CAST(floor((size - was) * 1000000 / CAST(was AS DOUBLE)) AS BIGINT) AS delta_ppm FROM c WHERE was > 0)
SELECT conv_id, phrase, delta_ppm, CASE WHEN delta_ppm > 50000 THEN 'rising' WHEN delta_ppm < -50000 THEN 'falling' ELSE 'level' END AS shape FROM d""",
    "emphasis": f"""WITH {_P}, m AS (SELECT conv_id, role, CAST(floor(quantile_cont(CAST(size AS DOUBLE), 0.5) + 0.5) AS BIGINT) AS median FROM p GROUP BY 1, 2)
SELECT p.conv_id, turn, p.role, size, median FROM p JOIN m ON p.conv_id = m.conv_id AND p.role = m.role WHERE size * 2 >= median * 3""",
    "change_events": f"""WITH {_S}, l AS (SELECT *, CAST(floor(v / 1000.0) AS BIGINT) AS level FROM s), c AS (SELECT *, coalesce(lag(level) OVER (PARTITION BY user_id ORDER BY ts), 0) AS was FROM l)
SELECT user_id, i, level FROM c WHERE level <> was UNION ALL SELECT user_id, n, 0 FROM l WHERE i = n - 1 AND level <> 0""",
    "envelope_ema": f"""WITH RECURSIVE {_S}, r AS (SELECT user_id, i, n, v AS envelope FROM s WHERE i = 0 UNION ALL
SELECT s.user_id, s.i, s.n, r.envelope + CAST(floor((s.v - r.envelope) * (CASE WHEN s.v > r.envelope THEN 500 ELSE 100 END) / 1000.0) AS BIGINT) FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)
SELECT user_id, i, envelope FROM r""",
    "tempo_lags": f"""WITH {_S}, c AS (SELECT a.user_id, a.i - b.i AS lag, CAST(floor(round(sum(CAST(a.v AS DOUBLE) * b.v) / sqrt(sum(CAST(a.v AS DOUBLE) * a.v) * sum(CAST(b.v AS DOUBLE) * b.v)), 9) * 1e6 + 0.5) AS BIGINT) AS score_ppm FROM s a JOIN s b ON a.user_id = b.user_id AND a.i - b.i BETWEEN 2 AND 12 GROUP BY 1, 2 HAVING sum(a.v * a.v) > 0 AND sum(b.v * b.v) > 0),
a AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY c.user_id ORDER BY c.score_ppm DESC, c.lag) = 1),
b AS (SELECT c.* FROM c JOIN a ON a.user_id = c.user_id AND abs(a.lag - c.lag) >= 2 QUALIFY row_number() OVER (PARTITION BY c.user_id ORDER BY c.score_ppm DESC, c.lag) = 1),
d AS (SELECT c.* FROM c JOIN a ON a.user_id = c.user_id AND abs(a.lag - c.lag) >= 2 JOIN b ON b.user_id = c.user_id AND abs(b.lag - c.lag) >= 2 QUALIFY row_number() OVER (PARTITION BY c.user_id ORDER BY c.score_ppm DESC, c.lag) = 1)
SELECT user_id, CAST(place AS INTEGER) AS place, lag, score_ppm FROM (SELECT user_id, 1 AS place, lag, score_ppm FROM a UNION ALL SELECT user_id, 2, lag, score_ppm FROM b UNION ALL SELECT user_id, 3, lag, score_ppm FROM d)""",
    "autocorr": f"""WITH {_S} SELECT a.user_id, a.i - b.i AS lag, CAST(sum(a.v * b.v) AS BIGINT) AS product FROM s a JOIN s b ON a.user_id = b.user_id AND a.i - b.i BETWEEN 1 AND 4 GROUP BY 1, 2""",
    "fir_filter": f"""WITH {_S} SELECT user_id, i, 3 * v + 2 * coalesce(lag(v) OVER o, 0) + 2 * coalesce(lag(v, 2) OVER o, 0) + coalesce(lag(v, 3) OVER o, 0) AS y FROM s WINDOW o AS (PARTITION BY user_id ORDER BY ts)""",
    "peak_first_tie": f"""WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(v) DESC, i) AS k FROM s) SELECT user_id, abs(v) AS peak, i AS "at" FROM r WHERE k = 1""",
    "running_cursor": """SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(length(text) AS BIGINT) AS duration FROM conversations""",
    "session_windows": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS cut FROM events),
k AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM k GROUP BY user_id, k""",
}
ORACLES["comb_phase"] = ORACLES["tempo_lags"].rsplit("\nSELECT", 1)[0] + """, l AS (SELECT user_id, lag FROM a UNION ALL SELECT user_id, lag FROM b UNION ALL SELECT user_id, lag FROM d),
p AS (SELECT s.user_id, l.lag, s.i % l.lag AS phase, CAST(sum(v) AS BIGINT) AS total FROM s JOIN l ON s.user_id = l.user_id GROUP BY 1, 2, 3)
SELECT user_id, lag, phase, total FROM (SELECT *, row_number() OVER (PARTITION BY user_id, lag ORDER BY total DESC, phase) AS k FROM p) WHERE k = 1"""
