"""Catalog and evidence search, rights, weighted ranking, greedy assignment, and checks of plans and references.

Each operator is a function of tables and parameters; the queries apply them to
the driver's tables.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica import functions as fn
from lattica.sources import read


def search_form(text: Column) -> Column:
    return F.lower(fn.normalised(text, "NFKC"))


def _query_form(query: str) -> str:
    return unicodedata.normalize("NFKC", query.strip()).lower()


def search_catalog(entries: DataFrame, query: str, *, fields: list[str], kind: str | None = None, limit: int = 20) -> DataFrame:
    """Entries (id, label, kind and more) of which some field holds each of the query's words, best tier first, then by id.

    Tier 0 is the id itself, 1 a label that begins with the query, 2 the rest.  A
    ``kind`` leaves out all others; no words match everything.
    """
    whole = _query_form(query)
    hay = search_form(F.concat_ws(" ", *[F.col(f).cast("string") for f in fields]))
    rows = entries if kind is None else entries.filter(F.col("kind") == kind)
    rows = rows.filter(reduce(lambda a, b: a & b, [F.contains(hay, F.lit(w)) for w in whole.split()], F.lit(True)))
    tier = F.when(search_form(F.col("id").cast("string")) == whole, 0).when(F.startswith(search_form(F.col("label")), F.lit(whole)), 1).otherwise(2)
    rows = rows.withColumn("tier", tier).orderBy("tier", F.col("id").cast("string")).limit(limit)
    return rows.withColumn("place", F.row_number().over(Window.orderBy("tier", F.col("id").cast("string"))))


def search_evidence(entries: DataFrame, words: list[str], *, keep: Column | None = None, limit: int = 20) -> DataFrame:
    """Entries (id, declared: words, classes: label words, score and index) that have evidence of every word, best first.

    A declared word counts in full; else the best class that has it as a whole
    word, with a score over 0, counts by its score.  The total is the mean.
    """
    rows = entries if keep is None else entries.filter(keep)
    full = F.lit(1_000_000).cast("long")
    seen = lambda w: F.array_max(F.transform(F.filter("classes", lambda c: (c["score"] > 0) & F.array_contains(c["words"], w)), lambda c: c["score"].cast("long")))
    each = [F.when(F.array_contains("declared", w), full).otherwise(seen(w)) for w in words]
    rows = rows.withColumns({"_scores": F.array(*each), "n_declared": reduce(lambda a, b: a + b, [F.array_contains("declared", w).cast("int") for w in words])})
    rows = rows.filter(~F.exists("_scores", lambda s: s.isNull()))
    total = fn.round_half_up(F.aggregate("_scores", F.lit(0).cast("long"), lambda a, s: a + s) / len(words))
    rows = rows.withColumn("total_ppm", total).orderBy(F.desc("total_ppm"), F.desc("n_declared"), "id").limit(limit)
    return rows.select("id", "total_ppm", "n_declared", F.row_number().over(Window.orderBy(F.desc("total_ppm"), F.desc("n_declared"), "id")).alias("place"))


def grants_use(license_: Column, version: Column, basis: Column, review: Column, *grants: Column) -> Column:
    """Whether catalog data declare commercial use with moving pictures: an approved entry under CC0 1.0, CC BY 4.0 or a
    contract with a receipt, not under a license that names NC, ND or SA nor an unknown one, and all grants given.

    A grant is a struct of commercial, modification, sync and share_alike.
    """
    cc0 = (license_ == "CC0-1.0") & (version == "1.0")
    by = (license_ == "CC-BY-4.0") & (version == "4.0")
    barred = license_.rlike(r"(?i)^CC-(?:[A-Z0-9.]+-)*(?:NC|ND|SA)(?:-|$)") | license_.rlike(r"(?i)(?:^|[-.])(?:unknown|noassertion|none)(?:[-.]|$)")
    given = [g["commercial"] & g["modification"] & g["sync"] & ~g["share_alike"] for g in grants]
    return F.coalesce((review == "approved") & ~barred & (cc0 | by | (basis == "contract-receipt")) & reduce(lambda a, b: a & b, given), F.lit(False))


#: Factors of a candidate's score: of the catalog, of the signal, and how much each side counts; in parts per million.
CATALOG = {"role": 400_000, "mood": 300_000, "energy": 200_000, "duration": 100_000}
SIGNAL = {"activity": 600_000, "tempo": 400_000}
SIDES = (800_000, 200_000)
#: Most that advice may move a score.
MOST_ADVICE = 20_000


def rank_candidates(rows: DataFrame, by: list[str], id_col: str, top: int) -> DataFrame:
    """The ``top`` candidates of each group by weighted factors (columns of the names above, in ppm) and bounded ``advice``."""
    part = lambda weights: F.expr(f"({' + '.join(f'cast({c} as bigint) * {w}' for c, w in weights.items())} + 500000) div 1000000")
    rows = rows.withColumns({"catalog_ppm": part(CATALOG), "signal_ppm": part(SIGNAL)})
    rows = rows.withColumn("base", part({"catalog_ppm": SIDES[0], "signal_ppm": SIDES[1]}))
    total = fn.clamp(F.col("base") + fn.clamp(F.coalesce("advice", F.lit(0)), F.lit(-MOST_ADVICE), F.lit(MOST_ADVICE)), F.lit(0), F.lit(1_000_000)).cast("long")
    order = Window.partitionBy(*by).orderBy(F.desc("total_ppm"), id_col)
    return rows.withColumn("total_ppm", total).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).select(*by, id_col, "catalog_ppm", "signal_ppm", "total_ppm", "place")


def assign_greedily(moments: DataFrame, wishes: list[str]) -> DataFrame:
    """(wish, id, score_ppm): for each wish in turn the best moment (id, text, salience) that no wish before it took.

    A score is the share of the wish's words that the text holds, 0.65 of the
    salience, and 0.35 more for the first wish where the salience is over 0.95;
    ties go to the smaller id.  One best row is taken a wish, so the driver holds
    as many rows as there are wishes.
    """
    taken: list[tuple] = []
    for i, wish in enumerate(wishes):
        words = re.findall("[a-z0-9_]+", wish.lower())
        held = reduce(lambda a, b: a + b, [F.contains(F.lower("text"), F.lit(w)).cast("int") for w in words], F.lit(0))
        score = held / max(len(words), 1) + F.col("salience") * 0.65 + (F.when(F.col("salience") > 0.95, 0.35).otherwise(0.0) if i == 0 else F.lit(0.0))
        rest = moments.filter(~F.col("id").isin([t[1] for t in taken])) if taken else moments
        best = rest.select("id", fn.ppm(F.round(score, 9)).alias("s")).orderBy(F.desc("s"), "id").first()
        if best:
            taken.append((i, best[0], best[1]))
    return moments.sparkSession.createDataFrame(taken, f"wish int, id {moments.schema['id'].dataType.simpleString()}, score_ppm long")


def moments_of(assets: DataFrame, segments: DataFrame, scenes: DataFrame) -> DataFrame:
    """Moments of assets (asset): their transcript segments (asset, nth, text), or their scenes (asset, nth) where there are none.

    A segment's salience grows with its text up to 170 characters; a scene's falls with its number.
    """
    spoken = segments.select("asset", "nth", "text", F.least(F.lit(0.99), F.least(F.char_length("text"), F.lit(170)) / 500 + 0.65).alias("salience"))
    seen = scenes.join(segments.select("asset").distinct(), "asset", "left_anti").select("asset", "nth", F.lit("").alias("text"), F.greatest(F.lit(0.5), F.lit(1.0) - F.col("nth") * 0.02).alias("salience"))
    return spoken.unionByName(seen).join(assets.select("asset"), "asset", "left_semi")


def plan_faults(selections: DataFrame, catalog: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """(plan, nth, fault) of selections (plan, nth, moment, role, line, wanted_line): ROLE, ORDER, UNKNOWN or REPEATED moment."""
    known = catalog.select("moment").distinct().withColumn("_known", F.lit(True))
    times = F.count(F.lit(1)).over(Window.partitionBy("plan", "moment"))
    rows = selections.withColumn("_times", times).join(known, "moment", "left")
    faults = F.array_compact(F.array(F.when(~F.col("role").isin(*roles), "ROLE"), F.when(F.col("line") != F.col("wanted_line"), "ORDER"), F.when(F.col("_known").isNull(), "UNKNOWN"), F.when(F.col("_times") > 1, "REPEATED")))
    return rows.select("plan", "nth", F.explode(faults).alias("fault"))


def reference_faults(records: DataFrame, references: DataFrame) -> DataFrame:
    """(id, fault): record ids (id) that repeat, and references (owner, ref) that repeat within their owner or lead nowhere."""
    again = records.groupBy("id").count().filter("count > 1").select("id", F.lit("DUPLICATE").alias("fault"))
    twice = references.groupBy("owner", "ref").count().filter("count > 1").select(F.col("owner").alias("id"), F.lit("REPEATED").alias("fault"))
    lost = references.join(records.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti").select(F.col("owner").alias("id"), F.lit("MISSING").alias("fault"))
    return again.union(twice).union(lost)


# --- queries


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("kind"), "p_brand", "p_size")


def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_catalog(_parts(spark, sf_dir), "Red brand#1", fields=["id", "label", "kind", "p_brand"], kind="ECONOMY").select("id", "label", "tier", "place")


def catalog_search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_catalog(_parts(spark, sf_dir), "small", fields=["id", "label", "kind", "p_brand"], limit=50).select("id", "label", "tier", "place")


def catalog_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    made = lambda col, score: F.struct(fn.tokens(F.col(col)).alias("words"), score.cast("long").alias("score"))
    entries = p.select("id", fn.tokens(F.col("label")).alias("declared"), F.array(made("kind", F.col("p_size") * 20000), made("p_brand", (F.col("id") % 50) * 20000)).alias("classes"), "kind")
    return search_evidence(entries, ["red", "economy"], keep=F.col("kind") != "LARGE", limit=40)


def rights_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers under stand-in licenses and grants."""
    names = F.array(*map(F.lit, ("CC0-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "cc-by-sa-4.0", "CC-BY-ND-4.0", "x-unknown", "house")))
    k = F.col("s_suppkey")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.get(names, (k % 7).cast("int")).alias("license"))
    grant = lambda m: F.struct(F.lit(True).alias("commercial"), (k % m != 0).alias("modification"), F.lit(True).alias("sync"), (k % 13 == 0).alias("share_alike"))
    ok = grants_use(F.col("license"), F.when(F.col("license") == "CC0-1.0", "1.0").otherwise("4.0"), F.when(k % 2 == 0, "contract-receipt").otherwise("license"), F.when(k % 5 == 0, "open").otherwise("approved"), grant(11), grant(17))
    return s.select("s_suppkey", "license", ok.alias("granted"))


def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_brand", ((k % 5) * 250000).alias("role"), ((F.col("p_size") % 11) * 100000).alias("mood"), (k * 7 % 11 * 90000).alias("energy"), (k % 3 * 333333).alias("duration"), (k * 31 % 101 * 9901).alias("activity"), (k % 2 * 1000000).alias("tempo"), ((k % 9 - 4) * 7000).alias("advice"))
    return rank_candidates(rows, ["p_brand"], "p_partkey", 5)


def greedy_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"), (F.col("p_partkey") % 100 / 100).alias("salience"))
    return assign_greedily(moments, ["red widget", "proof: small bolt", "red widget"])


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("asset"), F.col("turn").alias("nth"), "text")


def index_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as segments of two thirds of the conversations, and as scenes of the rest."""
    t = _turns(spark, sf_dir)
    m = moments_of(t.select("asset").distinct(), t.filter("asset % 3 <> 0"), t)
    return m.select("asset", "nth", "text", fn.ppm(F.round("salience", 9)).alias("salience_ppm"))


ROLES = ("hook", "problem", "turn", "proof", "resolution", "broll")


def plan_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, (*ROLES, "other")))
    s = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long").alias("nth"), F.col("l_partkey").alias("moment"), F.get(names, (F.col("l_suppkey") % 7).cast("int")).alias("role"))
    s = s.withColumns({"wanted_line": F.col("nth"), "line": F.col("nth") + (F.col("plan") % 11 == 0).cast("int")})
    return plan_faults(s, read(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("moment")), ROLES)


def reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of which some are missing and some twice, and orders that refer to them."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).filter("id % 10 <> 0")
    records = c.union(c.filter("id % 29 = 0"))
    return reference_faults(records, read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1000 + 1000000).alias("owner"), F.col("o_custkey").alias("ref")))


QUERIES = {f.__name__: f for f in (catalog_search, catalog_search_prefix, catalog_evidence, rights_declared, candidate_scores, greedy_assignment, index_moments, plan_validation, reference_check)}

_P = "p AS (SELECT p_partkey AS id, p_name AS label, p_type AS kind, p_brand, p_size FROM part)"
_A = "SELECT id, CAST(floor(round((CASE WHEN contains(t, '{0}') THEN 1 ELSE 0 END + CASE WHEN contains(t, '{1}') THEN 1 ELSE 0 END{3}) / CAST({2} AS DOUBLE) + s * 0.65{4}, 9) * 1e6 + 0.5) AS BIGINT) AS score_ppm FROM m"
ORACLES = {
    "catalog_search": f"""WITH {_P}, h AS (SELECT *, CASE WHEN CAST(id AS VARCHAR) = 'red brand#1' THEN 0 WHEN starts_with(lower(label), 'red brand#1') THEN 1 ELSE 2 END AS tier FROM p WHERE kind = 'ECONOMY' AND contains(lower(concat_ws(' ', id, label, kind, p_brand)), 'red') AND contains(lower(concat_ws(' ', id, label, kind, p_brand)), 'brand#1')),
r AS (SELECT *, row_number() OVER (ORDER BY tier, CAST(id AS VARCHAR)) AS k FROM h) SELECT id, label, CAST(tier AS INTEGER) AS tier, CAST(k AS INTEGER) AS place FROM r WHERE k <= 20""",
    "catalog_search_prefix": f"""WITH {_P}, h AS (SELECT *, CASE WHEN CAST(id AS VARCHAR) = 'small' THEN 0 WHEN starts_with(lower(label), 'small') THEN 1 ELSE 2 END AS tier FROM p WHERE contains(lower(concat_ws(' ', id, label, kind, p_brand)), 'small')),
r AS (SELECT *, row_number() OVER (ORDER BY tier, CAST(id AS VARCHAR)) AS k FROM h) SELECT id, label, CAST(tier AS INTEGER) AS tier, CAST(k AS INTEGER) AS place FROM r WHERE k <= 50""",
    "catalog_evidence": rf"""WITH {_P}, w AS (SELECT id, kind, unnest(['red', 'economy']) AS word, regexp_extract_all(lower(label), '[\p{{L}}\p{{N}}]+') AS d, regexp_extract_all(lower(kind), '[\p{{L}}\p{{N}}]+') AS a, regexp_extract_all(lower(p_brand), '[\p{{L}}\p{{N}}]+') AS b, p_size * 20000 AS sa, id % 50 * 20000 AS sb FROM p WHERE kind <> 'LARGE'),
e AS (SELECT id, list_contains(d, word) AS own, CASE WHEN list_contains(d, word) THEN 1000000 ELSE nullif(greatest(CASE WHEN list_contains(a, word) THEN sa ELSE 0 END, CASE WHEN list_contains(b, word) THEN sb ELSE 0 END), 0) END AS s FROM w),
t AS (SELECT id, CAST(floor(avg(s) + 0.5) AS BIGINT) AS total_ppm, CAST(count(*) FILTER (own) AS INTEGER) AS n_declared FROM e GROUP BY id HAVING count(s) = 2)
SELECT *, CAST(row_number() OVER (ORDER BY total_ppm DESC, n_declared DESC, id) AS INTEGER) AS place FROM t QUALIFY place <= 40""",
    "rights_declared": """WITH s AS (SELECT s_suppkey AS k, ['CC0-1.0', 'CC-BY-4.0', 'CC-BY-NC-4.0', 'cc-by-sa-4.0', 'CC-BY-ND-4.0', 'x-unknown', 'house'][s_suppkey % 7 + 1] AS license FROM supplier)
SELECT k AS s_suppkey, license, k % 5 <> 0 AND k % 11 <> 0 AND k % 17 <> 0 AND k % 13 <> 0 AND (license IN ('CC0-1.0', 'CC-BY-4.0') OR (license = 'house' AND k % 2 = 0)) AS granted FROM s""",
    "candidate_scores": """WITH f AS (SELECT p_partkey, p_brand, (k % 5 * 250000 * 400000 + CAST(p_size AS BIGINT) % 11 * 100000 * 300000 + k * 7 % 11 * 90000 * 200000 + k % 3 * 333333 * 100000 + 500000) // 1000000 AS catalog_ppm, (k * 31 % 101 * 9901 * 600000 + k % 2 * 1000000 * 400000 + 500000) // 1000000 AS signal_ppm, (k % 9 - 4) * 7000 AS advice FROM (SELECT *, p_partkey AS k FROM part)),
t AS (SELECT *, greatest(0, least(1000000, (catalog_ppm * 800000 + signal_ppm * 200000 + 500000) // 1000000 + greatest(-20000, least(20000, advice)))) AS total_ppm FROM f)
SELECT p_brand, p_partkey, catalog_ppm, signal_ppm, total_ppm, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY total_ppm DESC, p_partkey) AS INTEGER) AS place FROM t QUALIFY place <= 5""",
    "greedy_assignment": f"""WITH m AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS t, p_partkey % 100 / CAST(100 AS DOUBLE) AS s FROM part),
a AS ({_A.format('red', 'widget', 2, '', ' + CASE WHEN s > 0.95 THEN 0.35 ELSE 0 END')} ORDER BY score_ppm DESC, id LIMIT 1),
b AS ({_A.format('proof', 'small', 3, " + CASE WHEN contains(t, 'bolt') THEN 1 ELSE 0 END", '')} WHERE id NOT IN (SELECT id FROM a) ORDER BY score_ppm DESC, id LIMIT 1),
c AS ({_A.format('red', 'widget', 2, '', '')} WHERE id NOT IN (SELECT id FROM a UNION ALL SELECT id FROM b) ORDER BY score_ppm DESC, id LIMIT 1)
SELECT CAST(wish AS INTEGER) AS wish, id, score_ppm FROM (SELECT 0 AS wish, * FROM a UNION ALL SELECT 1, * FROM b UNION ALL SELECT 2, * FROM c)""",
    "index_moments": """SELECT conv_id AS asset, turn AS nth, CASE WHEN conv_id % 3 <> 0 THEN text ELSE '' END AS text, CAST(floor(round(CASE WHEN conv_id % 3 <> 0 THEN least(0.99::DOUBLE, least(length(text), 170) / 500::DOUBLE + 0.65::DOUBLE) ELSE greatest(0.5::DOUBLE, 1.0::DOUBLE - turn * 0.02::DOUBLE) END, 9) * 1e6 + 0.5) AS BIGINT) AS salience_ppm FROM conversations""",
    "plan_validation": """WITH s AS (SELECT l_orderkey AS plan, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth, l_partkey AS moment, l_suppkey % 7 = 6 AS bad_role, count(*) OVER (PARTITION BY l_orderkey, l_partkey) AS times FROM lineitem)
SELECT plan, nth, 'ROLE' AS fault FROM s WHERE bad_role UNION ALL SELECT plan, nth, 'ORDER' FROM s WHERE plan % 11 = 0 UNION ALL SELECT plan, nth, 'REPEATED' FROM s WHERE times > 1 UNION ALL SELECT plan, nth, 'UNKNOWN' FROM s WHERE moment NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)""",
    "reference_check": """WITH c AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 10 <> 0), o AS (SELECT o_orderkey % 1000 + 1000000 AS owner, o_custkey AS ref FROM orders)
SELECT id, 'DUPLICATE' AS fault FROM c WHERE id % 29 = 0 UNION ALL SELECT owner, 'REPEATED' FROM (SELECT owner, ref FROM o GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT owner, 'MISSING' FROM o WHERE ref NOT IN (SELECT id FROM c)""",
}
