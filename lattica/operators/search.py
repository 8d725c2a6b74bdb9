"""Vector, lexical and evidence search, ranking factors and rights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import clamp, dot, norm, ppm, tokens
from lattica.sources import read
from lattica.storage import Scratch


def scored_vectors(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """Every row of ``vectors`` with its cosine to the one row of ``query``, within -1 and 1, and in parts per million."""
    one = F.broadcast(query.select(F.col("embedding").alias("_q")).limit(1))
    cosine = F.round(clamp(dot(F.col("embedding"), F.col("_q")) / (norm(F.col("embedding")) * norm(F.col("_q"))), F.lit(-1.0), F.lit(1.0)), 9)
    return vectors.crossJoin(one).withColumn("score_ppm", ppm(cosine)).drop("_q")


def vector_topk(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    top = scored_vectors(v, v.filter("vec_id = 0")).filter("score_ppm >= 0").orderBy(F.desc("score_ppm"), "vec_id").limit(k)
    return top.select("vec_id", "label", "score_ppm", F.row_number().over(Window.orderBy(F.desc("score_ppm"), "vec_id")).alias("place"))


def vector_meanpool_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of unit vectors of a label, made a unit vector again; in whole millionths, component by component."""
    v = read(spark, sf_dir, "embeddings")
    parts = v.select("label", F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("pos", "x"), norm(F.col("embedding")).alias("n"))
    mean = parts.groupBy("label", "pos").agg(F.avg(F.col("x") / F.col("n")).alias("m"))
    length = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("label")))
    return mean.select("label", F.col("pos").cast("long").alias("pos"), F.round(F.col("m") / length * 1e4).cast("long").alias("x"))


def suppress_overlaps(matches: DataFrame, by: list[str], start: str, end: str, best: list[Column], limit: int) -> DataFrame:
    """Greedy suppression: rows from the best on, one that overlaps a kept one of its group goes, ``limit`` stay in all.

    ``best`` orders rows, greatest first, and no two rows of a group alike.
    Suppression never crosses groups, so each group keeps its own and the limit
    is taken over all at last.

    Rounds, each over all rows not decided yet: spans lie in cells of the largest
    length, in two at most; a row that is the best of all its cells is the best of
    all it overlaps, so greedy keeps it, and what overlaps a kept row goes.  Kept
    rows don't overlap, so a cell has few of them, and no group is ever gathered.
    """
    scratch = Scratch(matches.sparkSession, "suppress")
    rows = scratch.put(matches.withColumns({"_best": F.struct(*best), "_row": F.monotonically_increasing_id()}), "open")
    width = rows.agg(F.max(F.col(end) - F.col(start))).first()[0]
    if width is None:
        return matches.limit(limit)
    width = max(width, 1)
    cells = F.explode(F.sequence(F.floor(F.col(start) / width), F.greatest(F.floor(F.col(start) / width), F.ceil(F.col(end) / width) - 1))).alias("_cell")
    kept = []
    while not rows.isEmpty():
        dealt = rows.select(*by, start, end, "_best", "_row", cells)
        tops = dealt.groupBy(*by, "_cell").agg(F.max(F.struct("_best", "_row")).alias("_top"))
        won = dealt.join(tops, [*by, "_cell"]).groupBy("_row").agg(F.min(F.col("_top._row") == F.col("_row")).alias("_won")).filter("_won").select("_row")
        kept.append(scratch.put(rows.join(won, "_row", "left_semi"), f"kept-{len(kept)}"))
        wall = kept[-1].select(*by, F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(F.sequence(F.floor(F.col(start) / width), F.greatest(F.floor(F.col(start) / width), F.ceil(F.col(end) / width) - 1))).alias("_cell"))
        gone = dealt.join(wall, [*by, "_cell"]).filter((F.col(start) < F.col("_e")) & (F.col("_s") < F.col(end))).select("_row").distinct()
        rows = scratch.put(rows.join(gone.union(won).distinct(), "_row", "left_anti"), "open")
    return reduce(DataFrame.union, kept).orderBy(F.desc("_best")).limit(limit).drop("_best", "_row")


def vector_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best matches when vectors of a label are spans of 10 every 4 places."""
    v = read(spark, sf_dir, "embeddings")
    s = scored_vectors(v, v.filter("vec_id = 0")).select("vec_id", "label", "score_ppm", (F.col("vec_id") * 4).alias("start"), (F.col("vec_id") * 4 + 10).alias("end"))
    return suppress_overlaps(s, ["label"], "start", "end", [F.col("score_ppm"), (-F.col("vec_id")).alias("tie")], 50)


def having_words(docs: DataFrame, *words: str) -> DataFrame:
    """Documents that have all of the words, in whole tokens; those without a word's letters anywhere are passed over first."""
    docs = docs.filter(reduce(lambda a, b: a & b, [F.contains(F.lower("text"), F.lit(w)) for w in words]))
    return docs.withColumn("t", tokens(F.col("text"))).filter(F.forall(F.array(*map(F.lit, words)), lambda w: F.array_contains("t", w))).select("doc_id", F.size("t").cast("long").alias("n_tokens"))


def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``having_words`` of all documents, whatever their language."""
    return having_words(read(spark, sf_dir, "documents"), "the", "with", "from")


def catalog_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by how they match: the exact id, a name that begins so, or one that contains it."""
    name = F.lower("p_name")
    tier = F.when(F.col("p_partkey") == 7, 0).when(name.startswith("part"), 1).otherwise(2)
    return read(spark, sf_dir, "part").filter((F.col("p_partkey") == 7) | name.contains("1")).select("p_partkey", tier.alias("tier"))


def evidence_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the best evidence of each wanted word: declared by brand, else seen in the type; all words must be found."""
    wanted = spark.createDataFrame([("brand",), ("size",)], "token string")
    p = read(spark, sf_dir, "part").select("p_partkey", tokens(F.col("p_brand")).alias("declared"), F.lower("p_type").alias("type"), "p_size")
    score = F.when(F.exists("declared", lambda d: d.startswith(F.col("token"))), 1000000).when((F.col("token") == "size") & (F.col("p_size") > 10), F.col("p_size") * 10000)
    e = p.crossJoin(F.broadcast(wanted)).withColumn("score", score.cast("long")).filter("score is not null")
    return e.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg("score") + 0.5).cast("long").alias("mean_ppm")).filter("n = 2").drop("n")


def rights_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose (stand-in) license grants all uses: free, by attribution, or by a contract with a receipt."""
    kind = F.element_at(F.array(*map(F.lit, ("CC0", "CC-BY", "CC-BY-NC", "contract"))), (F.col("s_nationkey") % 4 + 1).cast("int"))
    s = read(spark, sf_dir, "supplier").withColumn("license", kind)
    ok = F.col("license").isin("CC0", "CC-BY") | ((F.col("license") == "contract") & (F.col("s_acctbal") > 0))
    return s.select("s_suppkey", "license", ok.alias("granted"))


def candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each brand by weighted factors in whole parts per million, largest first."""
    p = read(spark, sf_dir, "part")
    role, mood, energy = (F.col("p_partkey") % 5) * 200000, (F.col("p_size") % 10) * 100000, (F.col("p_partkey") * 7 % 11) * 90000
    score = F.floor((role * 4 + mood * 3 + energy * 3) / 10).cast("long")
    order = Window.partitionBy("p_brand").orderBy(F.desc("score"), "p_partkey")
    return p.select("p_partkey", "p_brand", score.alias("score")).withColumn("place", F.row_number().over(order)).filter("place <= 5")


def levelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain toward a target level, held by the room to the peak ceiling and a bound both ways.

    Values of at most ten decimal places are summed exactly, so that a mean
    halfway between two levels doesn't hang on the order of its rows.
    """
    exact = F.col("value").try_cast("decimal(28,10)")
    mean = F.when(F.count_if(exact.cast("double") == F.col("value")) == F.count("value"), F.sum(exact).cast("double") / F.count("value")).otherwise(F.avg("value"))
    g = read(spark, sf_dir, "events").groupBy("user_id").agg(F.round(mean).cast("long").alias("level"), F.round(F.max("value")).cast("long").alias("peak"))
    return g.select("user_id", "level", "peak", F.greatest(F.least(F.lit(60) - F.col("level"), F.lit(200) - F.col("peak"), F.lit(12)), F.lit(-12)).cast("long").alias("gain"))


def transcript_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns from the second to the fourth of each conversation as one text."""
    t = read(spark, sf_dir, "conversations").filter("turn between 1 and 3")
    all_turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(all_turns, lambda x: x["text"]), " ").alias("joined"))


#: The second name of a query over all languages, from when the first took one.
QUERIES = {"lexical_search_all": lexical_search} | {f.__name__: f for f in (vector_topk, vector_meanpool_by_label, vector_nms, lexical_search, catalog_tiers, evidence_search, rights_predicate, candidate_rank, levelling, transcript_range)}

_V = """q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, label, CAST(floor(round(greatest(-1, least(1, list_inner_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), q) / (sqrt(list_inner_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(embedding, lambda x: CAST(x AS DOUBLE)))) * sqrt(list_inner_product(q, q))))), 9) * 1e6 + 0.5) AS BIGINT) AS score_ppm FROM embeddings, q)"""
ORACLES = {
    "vector_nms": f"""WITH RECURSIVE {_V}, o AS (SELECT label, vec_id, score_ppm, vec_id * 4 AS start, vec_id * 4 + 10 AS "end", row_number() OVER (PARTITION BY label ORDER BY score_ppm DESC, vec_id) AS k FROM s),
g AS (SELECT label, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT label FROM o)
  UNION ALL SELECT g.label, o.k, CASE WHEN len(list_filter(g.kept, lambda x: o.start < x + 10 AND x < o."end")) = 0 THEN list_append(g.kept, o.start) ELSE g.kept END FROM g JOIN o ON o.label = g.label AND o.k = g.k + 1),
w AS (SELECT label, unnest(arg_max(kept, k)) AS start FROM g GROUP BY label)
SELECT vec_id, label, score_ppm, start, "end" FROM o JOIN w USING (label, start) ORDER BY score_ppm DESC, vec_id LIMIT 50""",
    "vector_topk": f"WITH {_V}, r AS (SELECT *, CAST(row_number() OVER (ORDER BY score_ppm DESC, vec_id) AS INTEGER) AS place FROM s WHERE score_ppm >= 0) SELECT vec_id, label, score_ppm, place FROM r WHERE place <= 10",
    "vector_meanpool_by_label": """WITH n AS (SELECT label, e, sqrt(list_inner_product(e, e)) AS n FROM (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)),
p AS (SELECT label, unnest(range(64)) AS pos, unnest(e) / n AS x FROM n), m AS (SELECT label, pos, avg(x) AS m FROM p GROUP BY 1, 2)
SELECT label, pos, CAST(round(m / sqrt(sum(m * m) OVER (PARTITION BY label)) * 1e4) AS BIGINT) AS x FROM m""",
    "lexical_search": r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents)
SELECT doc_id, CAST(len(list_distinct(t)) AS BIGINT) AS n_tokens FROM t WHERE list_has_all(t, ['the', 'with', 'from'])""",
    "catalog_tiers": "SELECT p_partkey, CAST(CASE WHEN p_partkey = 7 THEN 0 WHEN starts_with(lower(p_name), 'part') THEN 1 ELSE 2 END AS INTEGER) AS tier FROM part WHERE p_partkey = 7 OR contains(lower(p_name), '1')",
    "evidence_search": r"""WITH e AS (SELECT p_partkey, CASE WHEN len(list_filter(regexp_extract_all(lower(p_brand), '[\p{L}\p{N}]+'), lambda d: starts_with(d, token))) > 0 THEN 1000000 WHEN token = 'size' AND p_size > 10 THEN p_size * 10000 END AS score FROM part, (VALUES ('brand'), ('size')) w(token))
SELECT p_partkey, CAST(floor(avg(score) + 0.5) AS BIGINT) AS mean_ppm FROM e WHERE score IS NOT NULL GROUP BY 1 HAVING count(*) = 2""",
    "rights_predicate": """WITH l AS (SELECT *, ['CC0', 'CC-BY', 'CC-BY-NC', 'contract'][s_nationkey % 4 + 1] AS license FROM supplier) SELECT s_suppkey, license, license IN ('CC0', 'CC-BY') OR (license = 'contract' AND s_acctbal > 0) AS granted FROM l""",
    "candidate_rank": """WITH s AS (SELECT p_partkey, p_brand, CAST(((p_partkey % 5) * 200000 * 4 + (p_size % 10) * 100000 * 3 + (p_partkey * 7 % 11) * 90000 * 3) // 10 AS BIGINT) AS score FROM part),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS INTEGER) AS place FROM s) SELECT * FROM r WHERE place <= 5""",
    "levelling": """WITH g AS (SELECT user_id, CAST(round(avg(value)) AS BIGINT) AS level, CAST(round(max(value)) AS BIGINT) AS peak FROM events GROUP BY 1) SELECT *, greatest(least(60 - level, 200 - peak, 12), -12) AS gain FROM g""",
    "transcript_range": "SELECT conv_id, count(*) AS n_turns, string_agg(text, ' ' ORDER BY turn) AS joined FROM conversations WHERE turn BETWEEN 1 AND 3 GROUP BY 1",
}
ORACLES["lexical_search_all"] = ORACLES["lexical_search"]
