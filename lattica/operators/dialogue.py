"""Words with times: phrases and sentences, contours, emphasis, space for other sound, ranges by id and captions through edits.

A word table has ``conv``, ``i`` (from 0, in order of time), ``id``, ``speaker``,
``word``, ``start``, ``end`` (whole milliseconds), ``quiet`` (whether what follows it
is silence) and ``level`` (thousandths of a decibel).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica import functions as fn
from lattica.operators.intervals import bucketed_overlap
from lattica.sources import dealt, read

#: Pauses in milliseconds: shorter than the first are none, then short, medium and long; and from where one ends a sentence.
PAUSES, SENTENCE_PAUSE = (100, 250, 700), 1000
#: Changes, in ppm of the rate and thousandths of a decibel, from which a contour has a direction.
RATE_DELTA, LEVEL_DELTA = 100_000, 1500
#: What emphasises a word: its length against its phrase's median, in ppm, and its level over the phrase's.
LENGTHENED, LOUDER = 1_500_000, 2500
#: Room left before and after a phrase, and on both sides inside a pause.
BEFORE, AFTER, MARGIN = 120, 200, 50
#: Characters of the turns whose words a task sorts.
TASK_CHARS = 1_000_000


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of conversations with times, levels and pauses by rule."""
    order = Window.partitionBy("conv").orderBy("turn", "pos")
    turns = dealt(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", TASK_CHARS, F.char_length("text"))
    w = turns.select(F.col("conv_id").alias("conv"), "turn", F.col("role").alias("speaker"), F.posexplode(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))).alias("pos", "word"))
    n = F.char_length("word")
    gap = F.when(F.col("word").rlike("[.!?]$"), 300 + (F.col("pos") * 97 + F.col("turn") * 53) % 1100).when(F.col("word").rlike("[,;:]$"), 260).otherwise((F.col("pos") * 31) % 290)
    w = w.withColumns({"dur": (60 + 40 * n).cast("long"), "gap": gap.cast("long"), "level": (-12000 - (n * 997 + F.col("turn") * 131 + F.col("pos") * 1717) % 6000).cast("long"), "i": (F.row_number().over(order) - 1).cast("long")})
    w = w.withColumn("start", F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return w.select("conv", "i", F.format_string("w.%06d", F.col("i") + 1).alias("id"), "speaker", "word", "start", (F.col("start") + F.col("dur")).alias("end"), (F.col("pos") % 7 != 0).alias("quiet"), "level")


def _order():
    return Window.partitionBy("conv").orderBy("i")


def pause_kind(length: Column) -> Column:
    return F.when(length >= PAUSES[2], "long").when(length >= PAUSES[1], "medium").when(length >= PAUSES[0], "short")


def segmented(rows: DataFrame) -> DataFrame:
    """Words with ``pause`` (what follows each), and the numbers of their ``phrase`` and ``sentence``.

    A sentence ends where the speaker changes, after closing punctuation or a
    long enough quiet pause; a phrase ends with its sentence, after other
    punctuation or a quiet pause that isn't short.
    """
    pause = F.lead("start").over(_order()) - F.col("end")
    rows = rows.withColumns({"pause": pause, "kind": pause_kind(pause), "_next": F.lead("speaker").over(_order())})
    sentence = F.col("_next").isNull() | ~F.col("_next").eqNullSafe(F.col("speaker")) | F.col("word").rlike(r"[.!?…]") | (F.col("quiet") & (F.col("pause") >= SENTENCE_PAUSE))
    phrase = sentence | F.col("word").rlike("[,;:]") | (F.col("quiet") & F.coalesce(F.col("kind").isin("medium", "long"), F.lit(False)))
    before = _order().rowsBetween(Window.unboundedPreceding, -1)
    number = lambda flag: F.coalesce(F.sum(F.coalesce(flag, F.lit(False)).cast("long")).over(before), F.lit(0)) + 1
    return rows.withColumns({"sentence": number(sentence), "phrase": number(phrase)}).drop("_next")


def phrases(rows: DataFrame) -> DataFrame:
    """Phrases of segmented words: speaker, sentence, times, words, words a minute in thousandths, median length and mean level."""
    dur = F.col("end") - F.col("start")
    p = rows.groupBy("conv", "phrase").agg(F.min("sentence").alias("sentence"), F.min("speaker").alias("speaker"), F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_words"), fn.round_half_up(F.percentile(dur, 0.5)).alias("median"), F.floor(F.sum(F.col("level") * dur) / F.sum(dur)).cast("long").alias("level"))
    return p.withColumn("rate", F.floor((F.col("n_words") * 60_000_000 * 2 + (F.col("end") - F.col("start"))) / ((F.col("end") - F.col("start")) * 2)).cast("long"))


def contours(p: DataFrame) -> DataFrame:
    """Each phrase against the one before it, if the speaker is the same: change of rate and of level, and their directions."""
    last = F.lag(F.struct("speaker", "rate", "level")).over(Window.partitionBy("conv").orderBy("phrase"))
    rows = p.withColumn("_l", last).filter(F.col("_l").isNotNull() & F.col("_l.speaker").eqNullSafe(F.col("speaker")))
    rate = F.when(F.col("_l.rate") == 0, 0).otherwise(F.floor(((F.col("rate") - F.col("_l.rate")) * 2_000_000 + F.col("_l.rate")) / (F.col("_l.rate") * 2))).cast("long")
    way = lambda d, least, up, down: F.when(d >= least, up).when(d <= -least, down).otherwise("steady")
    rows = rows.withColumns({"rate_ppm": rate, "level_delta": F.col("level") - F.col("_l.level")})
    return rows.select("conv", "phrase", "rate_ppm", way(F.col("rate_ppm"), RATE_DELTA, "faster", "slower").alias("rate_way"), "level_delta", way(F.col("level_delta"), LEVEL_DELTA, "louder", "quieter").alias("level_way"))


def emphasised(rows: DataFrame, p: DataFrame) -> DataFrame:
    """Words after a quiet pause that isn't short, much longer than their phrase's median or louder than it, with the reasons."""
    dur = F.col("end") - F.col("start")
    last = F.lag(F.struct("quiet", "kind")).over(_order())
    rows = rows.withColumn("_l", last).join(p.select("conv", "phrase", "median", F.col("level").alias("_level")), ["conv", "phrase"])
    why = F.array_compact(F.array(F.when(F.col("_l.quiet") & F.col("_l.kind").isin("medium", "long"), "isolated"), F.when(dur * 1_000_000 >= F.col("median") * LENGTHENED, "lengthened"), F.when(F.col("level") - F.col("_level") >= LOUDER, "louder")))
    return rows.select("conv", "id", "phrase", F.array_join(why, ",").alias("reasons")).filter("reasons <> ''")


def spaces(rows: DataFrame, p: DataFrame) -> DataFrame:
    """What to do with the time, numbered in order: phrases to protect, with room on both sides within the conversation, and
    quiet pauses that aren't short to use, less their margins, with the longest event that fits half of each."""
    whole = rows.groupBy("conv").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    protect = p.join(whole, "conv").select("conv", F.lit("protect").alias("kind"), F.greatest("lo", F.col("start") - BEFORE).alias("start"), F.least("hi", F.col("end") + AFTER).alias("end"), F.lit(None).cast("long").alias("longest"))
    a, b = F.col("end") + MARGIN, F.col("end") + F.col("pause") - MARGIN
    use = rows.filter(F.col("quiet") & F.col("kind").isin("medium", "long") & (b > a)).select("conv", F.lit("accent").alias("kind"), a.alias("start"), b.alias("end"), F.greatest(F.lit(1), F.floor((b - a) / 2)).cast("long").alias("longest"))
    order = Window.partitionBy("conv").orderBy("start", "end", "kind")
    return protect.unionByName(use).withColumn("id", F.format_string("space.%06d", F.row_number().over(order)))


def select_range(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Per conversation the words from one id through another: how many, text, and times; or why not (ID, ORDER)."""
    at = lambda x: F.max(F.when(F.col("id") == x, F.col("i"))).over(Window.partitionBy("conv"))
    rows = rows.withColumns({"_a": at(first), "_b": at(last)})
    inside = F.col("i").between(F.col("_a"), F.col("_b"))
    pick = lambda c: F.when(inside, F.col(c))
    out = rows.groupBy("conv", "_a", "_b").agg(F.count(pick("i")).alias("n_words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("i", "word")))), lambda x: x["word"]), " ").alias("text"), F.min(pick("start")).alias("start"), F.max(pick("end")).alias("end"))
    refused = F.when(F.col("_a").isNull() | F.col("_b").isNull(), "ID").when(F.col("_b") < F.col("_a"), "ORDER")
    return out.select("conv", refused.alias("refused"), "n_words", F.when(refused.isNull(), F.col("text")).alias("text"), "start", "end")


def words_in_segments(rows: DataFrame, segments: DataFrame, width: int) -> DataFrame:
    """(conv, seg, n_words, text): the words that overlap each segment (conv, seg, start, end); a word may be in several."""
    a = rows.select("conv", "i", "word", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    pairs = bucketed_overlap(a, segments.select("conv", "seg", F.col("start").alias("b_start"), F.col("end").alias("b_end")), width, on=["conv"])
    return pairs.groupBy("conv", "seg").agg(F.count(F.lit(1)).alias("n_words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("text"))


def project_words(rows: DataFrame, kept: DataFrame, width: int) -> DataFrame:
    """Words at their places after an edit, that keeps the ranges (conv, src_start, src_end, at): those wholly inside one are
    moved, those that a cut goes through are refused with CUT, and the rest are gone."""
    a = rows.select("conv", "id", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = kept.select("conv", F.col("src_start").alias("b_start"), F.col("src_end").alias("b_end"), "at")
    met = bucketed_overlap(a, b, width, on=["conv"])
    whole = (F.col("b_start") <= F.col("a_start")) & (F.col("a_end") <= F.col("b_end"))
    move = F.when(whole, F.col("at") + F.col("a_start") - F.col("b_start"))
    out = met.groupBy("conv", "id", "a_start", "a_end").agg(F.max(move).alias("start"))
    return out.select("conv", "id", "start", (F.col("start") + F.col("a_end") - F.col("a_start")).alias("end"), F.when(F.col("start").isNull(), "CUT").alias("refused"))


def asr_words(rows: DataFrame, by: str, rate: int) -> DataFrame:
    """Recognised words (by, start_sample, end_sample, word) as transcript words: ids, exact times as fractions of a second, and
    how each joins the one before: not at all for the first and for words that begin with closing punctuation, else by a blank."""
    order = Window.partitionBy(by).orderBy("start_sample", "end_sample", "word")
    n = F.row_number().over(order)
    rows = rows.withColumn("_n", n)
    join = F.when((F.col("_n") == 1) | F.col("word").rlike(r"^[.,;:!?…)\]}]"), "none").otherwise("space")
    return rows.select(by, F.format_string("asr.%06d", "_n").alias("id"), fn.fraction_text(F.col("start_sample"), F.lit(rate).cast("long")).alias("start"), fn.fraction_text(F.col("end_sample"), F.lit(rate).cast("long")).alias("end"), "word", join.alias("join"))


# --- queries


def prosody_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(segmented(words(spark, sf_dir)))


def prosody_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contours(prosody_phrases(spark, sf_dir))


def prosody_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segmented(words(spark, sf_dir))
    return emphasised(rows, phrases(rows))


def prosody_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segmented(words(spark, sf_dir))
    return spaces(rows, phrases(rows))


def word_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_range(words(spark, sf_dir), "w.000012", "w.000120")


def segment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by windows of 1600 ms every 1500."""
    w = words(spark, sf_dir)
    s = w.groupBy("conv").agg(F.max("end").alias("hi")).select("conv", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("hi") / 1500))).alias("seg"))
    return words_in_segments(w, s.select("conv", "seg", (F.col("seg") * 1500).alias("start"), (F.col("seg") * 1500 + 1600).alias("end")), 1500)


def caption_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words after every fifth second has been cut out."""
    w = words(spark, sf_dir)
    k = w.groupBy("conv").agg(F.max("end").alias("hi")).select("conv", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("hi") / 5000))).alias("k"))
    return project_words(w, k.select("conv", (F.col("k") * 5000).alias("src_start"), (F.col("k") * 5000 + 4000).alias("src_end"), (F.col("k") * 4000).alias("at")), 4000)


def asr_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    return asr_words(w.select("conv", (F.col("start") * 48).alias("start_sample"), (F.col("end") * 48).alias("end_sample"), "word"), "conv", 48000)


QUERIES = {f.__name__: f for f in (prosody_phrases, prosody_contours, prosody_emphasis, prosody_spaces, word_range, segment_words, caption_projection, asr_materialise)}

_W = r"""w0 AS (SELECT conv_id AS conv, turn, role AS speaker, unnest(regexp_extract_all(text, '[^ \n]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^ \n]+'), 1) - 1 AS pos FROM conversations),
w1 AS (SELECT *, 60 + 40 * length(word) AS dur, CASE WHEN regexp_matches(word, '[.!?]$') THEN 300 + (pos * 97 + turn * 53) % 1100 WHEN regexp_matches(word, '[,;:]$') THEN 260 ELSE pos * 31 % 290 END AS gap, -12000 - (length(word) * 997 + turn * 131 + pos * 1717) % 6000 AS level, row_number() OVER (PARTITION BY conv ORDER BY turn, pos) - 1 AS i FROM w0),
w2 AS (SELECT *, CAST(coalesce(sum(dur + gap) OVER (PARTITION BY conv ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM w1),
w AS (SELECT conv, i, printf('w.%06d', i + 1) AS id, speaker, word, start, start + dur AS "end", pos % 7 <> 0 AS quiet, level FROM w2)"""
_S = _W + """, s0 AS (SELECT *, lead(start) OVER (PARTITION BY conv ORDER BY i) - "end" AS pause, lead(speaker) OVER (PARTITION BY conv ORDER BY i) AS nxt FROM w),
s1 AS (SELECT *, CASE WHEN pause >= 700 THEN 'long' WHEN pause >= 250 THEN 'medium' WHEN pause >= 100 THEN 'short' END AS kind, coalesce(nxt IS NULL OR nxt <> speaker OR regexp_matches(word, '[.!?…]') OR (quiet AND pause >= 1000), false) AS se FROM s0),
s2 AS (SELECT *, se OR regexp_matches(word, '[,;:]') OR (quiet AND coalesce(pause >= 250, false)) AS pe FROM s1),
s AS (SELECT *, CAST(coalesce(sum(CAST(se AS BIGINT)) OVER b, 0) AS BIGINT) + 1 AS sentence, CAST(coalesce(sum(CAST(pe AS BIGINT)) OVER b, 0) AS BIGINT) + 1 AS phrase FROM s2 WINDOW b AS (PARTITION BY conv ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p0 AS (SELECT conv, phrase, min(sentence) AS sentence, min(speaker) AS speaker, min(i) AS first_i, max(i) AS last_i, min(start) AS start, max("end") AS "end", count(*) AS n_words, CAST(floor(quantile_cont(CAST("end" - start AS DOUBLE), 0.5) + 0.5) AS BIGINT) AS median, CAST(floor(sum(level * ("end" - start)) / CAST(sum("end" - start) AS DOUBLE)) AS BIGINT) AS level FROM s GROUP BY 1, 2),
p AS (SELECT *, (n_words * 120000000 + "end" - start) // (("end" - start) * 2) AS rate FROM p0)"""
ORACLES = {
    "prosody_phrases": f"WITH {_S} SELECT * FROM p",
    "prosody_contours": f"""WITH {_S}, l AS (SELECT *, lag(speaker) OVER o AS ls, lag(rate) OVER o AS lr, lag(level) OVER o AS ll FROM p WINDOW o AS (PARTITION BY conv ORDER BY phrase)),
d AS (SELECT conv, phrase, CAST(floor(((rate - lr) * 2000000 + lr) / CAST(lr * 2 AS DOUBLE)) AS BIGINT) AS rate_ppm, level - ll AS level_delta FROM l WHERE ls = speaker)
SELECT conv, phrase, rate_ppm, CASE WHEN rate_ppm >= 100000 THEN 'faster' WHEN rate_ppm <= -100000 THEN 'slower' ELSE 'steady' END AS rate_way, level_delta, CASE WHEN level_delta >= 1500 THEN 'louder' WHEN level_delta <= -1500 THEN 'quieter' ELSE 'steady' END AS level_way FROM d""",
    "prosody_emphasis": f"""WITH {_S}, e AS (SELECT s.conv, s.id, s.phrase, concat_ws(',', CASE WHEN lag(s.quiet) OVER o AND lag(s.kind) OVER o IN ('medium', 'long') THEN 'isolated' END, CASE WHEN (s."end" - s.start) * 2 >= p.median * 3 THEN 'lengthened' END, CASE WHEN s.level - p.level >= 2500 THEN 'louder' END) AS reasons FROM s JOIN p USING (conv, phrase) WINDOW o AS (PARTITION BY s.conv ORDER BY s.i))
SELECT * FROM e WHERE reasons <> ''""",
    "prosody_spaces": f"""WITH {_S}, r AS (SELECT conv, min(start) AS lo, max("end") AS hi FROM s GROUP BY 1),
u AS (SELECT p.conv, 'protect' AS kind, greatest(lo, start - 120) AS start, least(hi, "end" + 200) AS "end", NULL::BIGINT AS longest FROM p JOIN r USING (conv)
UNION ALL SELECT conv, 'accent', "end" + 50, "end" + pause - 50, greatest(1, (pause - 100) // 2) FROM s WHERE quiet AND pause >= 250)
SELECT *, printf('space.%06d', row_number() OVER (PARTITION BY conv ORDER BY start, "end", kind)) AS id FROM u""",
    "word_range": f"""WITH {_W}, a AS (SELECT conv, bool_or(i = 11) AND bool_or(i = 119) AS ok FROM w GROUP BY 1), g AS (SELECT conv, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t, min(start) AS s, max("end") AS e FROM w WHERE i BETWEEN 11 AND 119 GROUP BY 1)
SELECT a.conv, CASE WHEN NOT ok THEN 'ID' END AS refused, CASE WHEN ok THEN n ELSE 0 END AS n_words, CASE WHEN ok THEN t END AS text, CASE WHEN ok THEN s END AS start, CASE WHEN ok THEN e END AS "end" FROM a LEFT JOIN g USING (conv)""",
    "segment_words": f"""WITH {_W}, s AS (SELECT conv, unnest(range(max("end") // 1500 + 1)) AS seg FROM w GROUP BY conv)
SELECT s.conv, seg, count(*) AS n_words, string_agg(word, ' ' ORDER BY i) AS text FROM s JOIN w ON w.conv = s.conv AND w.start < seg * 1500 + 1600 AND seg * 1500 < w."end" GROUP BY 1, 2""",
    "caption_projection": f"""WITH {_W}, k AS (SELECT conv, unnest(range(max("end") // 5000 + 1)) AS k FROM w GROUP BY conv), m AS (SELECT w.*, k.k FROM w JOIN k ON w.conv = k.conv AND w.start < k.k * 5000 + 4000 AND k.k * 5000 < w."end"),
g AS (SELECT conv, id, "end" - start AS d, max(CASE WHEN k * 5000 <= start AND "end" <= k * 5000 + 4000 THEN k * 4000 + start - k * 5000 END) AS pl FROM m GROUP BY conv, id, start, "end")
SELECT conv, id, pl AS start, pl + d AS "end", CASE WHEN pl IS NULL THEN 'CUT' END AS refused FROM g""",
    "asr_materialise": rf"""WITH {_W}, f AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY start, "end", word) AS n FROM w), t AS (SELECT *, gcd(start, 1000) AS gs, gcd("end", 1000) AS ge FROM f)
SELECT conv, printf('asr.%06d', n) AS id, CASE WHEN 1000 // gs = 1 THEN CAST(start // gs AS VARCHAR) ELSE concat(start // gs, '/', 1000 // gs) END AS start, CASE WHEN 1000 // ge = 1 THEN CAST("end" // ge AS VARCHAR) ELSE concat("end" // ge, '/', 1000 // ge) END AS "end", word, CASE WHEN n = 1 OR regexp_matches(word, '^[.,;:!?…)\]}}]') THEN 'none' ELSE 'space' END AS "join" FROM t""",
}
