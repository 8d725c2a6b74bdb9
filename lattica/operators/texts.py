"""Forms of texts, dates and numbers over whole tables: normal forms, word rules, fractions, calendar days, levels and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import functions as fn
from lattica.sources import read

#: Words that ``text_forms`` asks for.
ASKED = ("the", "en")


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the NFC form, length without spare white space, words by two rules, and whether all asked words are inside."""
    text, asked = F.col("text"), F.array(*map(F.lit, ASKED))
    # each form of a text is made once, and what follows counts in it
    forms = read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2(fn.normalised(text, "NFC"), 256).alias("nfc_sha256"), fn.collapsed(text).alias("flat"), F.lower(text).alias("low"))
    forms = forms.withColumn("parts", F.split("low", r"\W+"))
    n_blanks = F.char_length("flat") - F.char_length(F.replace("flat", F.lit(" "), F.lit("")))
    # parts are empty only at the ends
    empty = lambda at: (F.element_at("parts", at) == "").cast("long")
    return forms.select(
        "doc_id",
        "nfc_sha256",
        F.char_length("flat").cast("long").alias("n_collapsed"),
        F.when(F.col("flat") == "", 0).otherwise(n_blanks + 1).cast("long").alias("n_blank_words"),
        (F.size("parts") - empty(1) - F.when(F.size("parts") > 1, empty(-1)).otherwise(0)).cast("long").alias("n_ascii_words"),
        fn.contains_all(F.col("low"), asked).alias("has_all"),
    )


def fraction_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes against keys as fractions in lowest terms; signs alternate."""
    n = F.col("p_size").cast("long") * 6 * F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(-1)
    return read(spark, sf_dir, "part").select("p_partkey", fn.fraction_text(n, F.col("p_partkey") % 36).alias("fraction"))


def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in three forms, and whether the day with another number is of the calendar."""
    day = F.col("o_orderdate").cast("date")
    other = F.concat(F.date_format(day, "yyyy-MM-"), F.lpad((F.col("o_orderkey") % 33).cast("string"), 2, "0"))
    return read(spark, sf_dir, "orders").select("o_orderkey", fn.date_text(day, "iso-date").alias("iso"), fn.date_text(day, "year-month").alias("year_month"), fn.date_text(day, "year").alias("year"), other.alias("other"), fn.is_date(other).alias("other_is_date"))


def level_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as levels against 100, carried to a range, with a stagger of 40 a user from 7 on; and a looked-up property."""
    v = F.col("value")
    return read(spark, sf_dir, "events").select(
        "event_id",
        fn.dbfs_milli(v / 100).alias("dbfs_milli"),
        fn.round_half_up(fn.mapped(v / 128, F.lit(-45.0), F.lit(45.0)) * 1000).alias("angle_milli"),
        fn.staggered(F.col("user_id"), F.lit(40), F.lit(7)).cast("long").alias("starts"),
        F.element_at(F.from_json("props", "map<string,string>"), "k").cast("long").alias("k"),
    )


def map_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers spread over the globe by rule, and their places on a map."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 37 % 361 - 180).cast("double").alias("lon"), (F.col("s_suppkey") * 53 % 181 - 90).cast("double").alias("lat"))
    x, y = fn.natural_earth(F.col("lon"), F.col("lat"))
    return s.select("s_suppkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def pooled_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label, mean over its vectors of the largest of some components, weighted by a length; in parts per million.

    ``groups`` of components stand for mapped classes: each vector's score for a
    group is the largest of its components, 0 at least.
    """
    groups = {"even": (0, 2, 4), "odd": (1, 3, 5), "far": (60, 61, 62, 63)}
    v = read(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("e"), (F.col("vec_id") % 7 + 1).alias("w"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), fn.max_at(F.col("e"), F.array(*map(F.lit, places))).alias("score")) for name, places in groups.items()])).alias("g")
    sums = v.select("label", "w", each).groupBy("label", F.col("g.name").alias("name")).agg((F.sum(F.col("g.score") * F.col("w")) / F.sum("w")).alias("mean"))
    return sums.select("label", "name", fn.ppm(F.round("mean", 9)).alias("mean_ppm"))


QUERIES = {f.__name__: f for f in (text_forms, fraction_texts, date_forms, level_forms, map_places, pooled_classes)}

_E = "e AS (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, vec_id % 7 + 1 AS w FROM embeddings)"
ORACLES = {
    "text_forms": f"""WITH d AS (SELECT doc_id, text, trim(regexp_replace(text, '[{fn.BLANKS}]+', ' ', 'g')) AS c FROM documents WHERE text IS NOT NULL)
SELECT doc_id, sha256(nfc_normalize(text)) AS nfc_sha256, CAST(length(c) AS BIGINT) AS n_collapsed, CAST(len(list_filter(string_split(c, ' '), lambda t: t <> '')) AS BIGINT) AS n_blank_words,
CAST(len(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) AS BIGINT) AS n_ascii_words, contains(lower(text), 'the') AND contains(lower(text), 'en') AS has_all FROM d""",
    "fraction_texts": """WITH f AS (SELECT p_partkey, CAST(p_size AS BIGINT) * 6 * CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS n, p_partkey % 36 AS d FROM part)
SELECT p_partkey, CASE WHEN d = 0 THEN NULL WHEN d // gcd(n, d) = 1 THEN CAST(n // gcd(n, d) AS VARCHAR) ELSE concat(n // gcd(n, d), '/', d // gcd(n, d)) END AS fraction FROM f""",
    "date_forms": """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%Y-%m-') || lpad(CAST(o_orderkey % 33 AS VARCHAR), 2, '0') AS other FROM orders)
SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS iso, strftime(d, '%Y-%m') AS year_month, strftime(d, '%Y') AS year, other, try_cast(other AS DATE) IS NOT NULL AS other_is_date FROM o""",
    "level_forms": """SELECT event_id, CASE WHEN value > 0 THEN greatest(CAST(floor(log10(value / 100) * 20000 + 0.5) AS BIGINT), -120000) ELSE -120000 END AS dbfs_milli,
CAST(floor((-45.0 + 90.0 * (value / 128)) * 1000 + 0.5) AS BIGINT) AS angle_milli, user_id * 40 + 7 AS starts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "map_places": """WITH s AS (SELECT s_suppkey, radians(CAST(s_suppkey * 37 % 361 - 180 AS DOUBLE)) AS l, radians(CAST(s_suppkey * 53 % 181 - 90 AS DOUBLE)) AS p FROM supplier)
SELECT s_suppkey, round(l * (0.870700 - 0.131979 * p**2 - 0.013791 * p**4 + 0.003971 * p**10 - 0.001529 * p**12), 6) AS x, round(p * (1.007226 + 0.015085 * p**2 - 0.044475 * p**6 + 0.028874 * p**8 - 0.005916 * p**10), 6) AS y FROM s""",
    "pooled_classes": f"""WITH {_E}, g AS (SELECT label, w, unnest([{{n: 'even', s: greatest(e[1], e[3], e[5], 0.0)}}, {{n: 'odd', s: greatest(e[2], e[4], e[6], 0.0)}}, {{n: 'far', s: greatest(e[61], e[62], e[63], e[64], 0.0)}}]) AS g FROM e)
SELECT label, g.n AS name, CAST(floor(round(sum(g.s * w) / sum(w), 9) * 1e6 + 0.5) AS BIGINT) AS mean_ppm FROM g GROUP BY 1, 2""",
}
