"""Keyed diffs of two versions of a table, and graphs: levels, ranks, expansion counts and Merkle hashes.

Graph operators relax all edges once a level and end when nothing changes; each
level is one join and one partial aggregate, and is written as a table, which
cuts its lineage and the constraints that the optimizer would carry along.  The
joins are sort-merge joins: a level is never collected on the driver to be broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.sources import dealt, read
from lattica.storage import Scratch

#: Levels of a graph, at most; a deeper one, or one with a cycle, is refused.
MOST_DEPTH = 512
#: Leading hex digits of a child's hash that name its bucket: no hash of a node is made of more than 16 ** 4 parts at once.
BUCKET_DIGITS = 4


# --- diffs


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and a copy in which some are gone, some new and some changed, by rule."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority", F.round("o_totalprice").cast("long").alias("price"))
    kept = o.filter("id % 17 <> 0").withColumns({"price": F.when(F.col("id") % 11 == 0, F.col("price") + 1).otherwise(F.col("price")), "o_orderpriority": F.when(F.col("id") % 13 == 0, "changed").otherwise(F.col("o_orderpriority"))})
    return o, kept.unionByName(o.filter("id % 19 = 0").withColumn("id", -F.col("id")))


FIELDS = ("o_orderstatus", "o_orderpriority", "price")


def keyed_diff(before: DataFrame, after: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Rows that were added, removed or modified, by one full outer join on the key and digests of the fields."""
    packed = lambda df, name: df.select(key, F.sha2(F.to_json(F.struct(*fields)), 256).alias(name))
    both = packed(before, "old").join(packed(after, "new"), key, "full_outer")
    op = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "remove").when(F.col("old") != F.col("new"), "modify")
    return both.select(key, op.alias("op")).filter("op is not null")


def semantic_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_diff(*versions(spark, sf_dir), "id", FIELDS)


def field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that differ in rows of both versions, with both values as texts."""
    before, after = versions(spark, sf_dir)
    both = before.alias("a").join(after.alias("b"), "id")
    each = F.explode(F.array(*[F.struct(F.lit(f"/{f}").alias("path"), F.col(f"a.{f}").cast("string").alias("old"), F.col(f"b.{f}").cast("string").alias("new")) for f in FIELDS])).alias("d")
    return both.select("id", each).select("id", "d.*").filter(~F.col("old").eqNullSafe(F.col("new")))


def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic_diff(spark, sf_dir).groupBy("op").agg(F.count(F.lit(1)).alias("n_rows"))


# --- graphs


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of parts: k has edges from k div 2 and from k div 3, so that it has no cycle."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("dst")).filter("dst > 1")
    return p.select(F.floor(F.col("dst") / 2).alias("src"), "dst").union(p.filter("dst > 2").select(F.floor(F.col("dst") / 3), "dst")).distinct()


def missing_nodes(nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """(node) that an edge names but ``nodes`` (node) lacks."""
    return graph.select(F.col("src").alias("node")).union(graph.select("dst")).distinct().join(nodes, "node", "left_anti")


def longest_path(graph: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, rank): 0 without edges in, else one more than the largest rank before.

    With ``nodes`` (node), those without edges have a rank too, and an edge to a
    node that is not among them raises ValueError; so does a cycle, or more than
    ``MOST_DEPTH`` levels.
    """
    scratch = Scratch(graph.sparkSession, "longest-path")
    if nodes is None:
        nodes = graph.select(F.col("src").alias("node")).union(graph.select("dst")).distinct()
    elif not (lost := missing_nodes(nodes, graph)).isEmpty():
        raise ValueError(f"edges name nodes that are not there, as {lost.first()[0]}")
    graph = scratch.put(graph, "graph")
    front, fronts = scratch.put(nodes.withColumn("rank", F.lit(0)), "0"), []
    while not front.isEmpty():
        fronts.append(front)
        if len(fronts) > MOST_DEPTH:
            raise ValueError("the graph has a cycle, or more levels than are allowed")
        step = front.hint("merge").join(graph, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().withColumn("rank", F.lit(len(fronts)))
        front = scratch.put(step, str(len(fronts)))
    return reduce(DataFrame.union, fronts).groupBy("node").agg(F.max("rank").alias("rank")) if fronts else nodes.withColumn("rank", F.lit(0))


def longest_path_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_path(edges(spark, sf_dir))


def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes each level of a topological order has."""
    return longest_path(edges(spark, sf_dir)).groupBy("rank").agg(F.count(F.lit(1)).alias("n_nodes"))


def expansions(graph: DataFrame, alone: DataFrame | None = None) -> DataFrame:
    """(root, visits) of every node when all paths are walked down from it: 1 and the visits of all children; raises for a cycle.

    A level holds how many paths of its length begin at each node, got from the
    children's of the level before, so one join and aggregate serves all nodes.
    ``alone`` (root) may name nodes that no edge has.
    """
    nodes = graph.select(F.col("src").alias("root")).union(graph.select("dst"))
    nodes = (nodes if alone is None else nodes.union(alone)).distinct()
    scratch = Scratch(graph.sparkSession, "expansions")
    graph = scratch.put(graph, "graph")
    front, levels = scratch.put(nodes.withColumn("paths", F.lit(1).cast("long")), "0"), []
    while not front.isEmpty():
        levels.append(front)
        if len(levels) > MOST_DEPTH:
            raise ValueError("the graph has a cycle, or more levels than are allowed")
        step = graph.join(front.hint("merge"), F.col("dst") == F.col("root")).groupBy(F.col("src").alias("root")).agg(F.sum("paths").alias("paths"))
        front = scratch.put(step, str(len(levels)))
    if not levels:
        return nodes.withColumn("visits", F.lit(1).cast("long"))
    return reduce(DataFrame.union, levels).groupBy("root").agg(F.sum("paths").alias("visits"))


def expansion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``expansions`` of every part, also of those without edges."""
    return expansions(edges(spark, sf_dir), read(spark, sf_dir, "part").select("p_partkey"))


def reachable(graph: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) for every node that paths from the ``roots`` (root) lead to, the root itself included, by whole frontiers."""
    scratch = Scratch(graph.sparkSession, "reachable")
    graph = scratch.put(graph, "graph")
    front, fronts = scratch.put(roots.select("root", F.col("root").alias("node")).distinct(), "0"), []
    while not fronts or not front.isEmpty():
        fronts.append(front)
        step = front.hint("merge").join(graph, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        front = scratch.put(step.join(reduce(DataFrame.union, fronts).hint("merge"), ["root", "node"], "left_anti"), str(len(fronts)))
    return reduce(DataFrame.union, fronts)


def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes the sources 2 and 3 reach."""
    return reachable(edges(spark, sf_dir), spark.createDataFrame([(2,), (3,)], "root long")).groupBy("root").agg(F.count(F.lit(1)).alias("n_nodes"))


def merkle(nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """(node, hash) of ``nodes`` (node, name) by edges from src to its children dst, from the leaves up.

    A hash covers the node's own name and its children's hashes: these are dealt
    to buckets by their first digits, each bucket has the hash of its sorted
    members, and the node that of its name and of the buckets in order.  So a
    node with very many children is summed up in bounded parts.
    """
    scratch = Scratch(nodes.sparkSession, "merkle")
    height = scratch.put(longest_path(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst")), nodes.select("node")), "height")
    levels, top = [], height.agg(F.max("rank")).first()[0]
    if top is None:
        return nodes.select("node", F.lit(None).cast("string").alias("hash"))
    own = nodes.join(height.hint("merge"), "node")
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "")
    for rank in range(top + 1):
        now = own.filter(F.col("rank") == rank)
        if levels:
            below = graph.join(now.hint("merge"), F.col("src") == F.col("node")).select("src", "dst").join(reduce(DataFrame.union, levels).hint("merge"), F.col("dst") == F.col("node"))
            buckets = below.groupBy("src", F.substring("hash", 1, BUCKET_DIGITS).alias("bucket")).agg(F.sha2(joined("hash"), 256).alias("h")).select("src", F.struct("bucket", "h").alias("part"))
            parts = buckets.groupBy(F.col("src").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["h"]), "").alias("parts"))
            now = now.join(parts.hint("merge"), "node", "left").withColumn("name", F.concat("name", F.coalesce("parts", F.lit(""))))
        levels.append(scratch.put(now.select("node", F.sha2("name", 256).alias("hash")), f"level-{rank}"))
    return reduce(DataFrame.union, levels)


def merkle_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashes of regions, over their nations and those nations' customers."""
    r, n, c = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    key = lambda kind, col: F.concat(F.lit(kind), F.col(col).cast("string"))
    nodes = r.select(key("r", "r_regionkey").alias("node"), F.col("r_name").alias("name")).union(n.select(key("n", "n_nationkey"), "n_name")).union(c.select(key("c", "c_custkey"), "c_name"))
    graph = n.select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst")).union(c.select(key("n", "c_nationkey"), key("c", "c_custkey")))
    return merkle(nodes, graph).join(r.select(key("r", "r_regionkey").alias("node"), "r_name"), "node").select("r_name", "hash")


def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses of the new version's rows against a manifest of digests of the old one."""
    before, after = versions(spark, sf_dir)
    digest = F.sha2(F.to_json(F.struct("id", *FIELDS)), 256).alias("digest")
    manifest = before.select(digest).withColumn("hit", F.lit(True))
    return after.select("id", digest).join(manifest, "digest", "left").select("id", F.when(F.col("hit"), "hit").otherwise("miss").alias("state"))


def reusable_chunks(sources: DataFrame, chunks: DataFrame, prior_sources: DataFrame, prior_chunks: DataFrame) -> DataFrame:
    """(source, chunk, reuse) of chunks (source, chunk, digest): reused only where the source (source, digest) is unchanged and
    all its chunks, and no others, were there before."""
    def sides(now: DataFrame, was: DataFrame, *cols: str) -> DataFrame:
        """How often each row is on either side; the columns begin with the source, by which both may be dealt already."""
        both = now.select(*cols, F.lit(1).alias("now"), F.lit(0).alias("was")).unionByName(was.select(*cols, F.lit(0).alias("now"), F.lit(1).alias("was")))
        return both.filter("source is not null").groupBy(*cols).agg(F.sum("now").alias("now"), F.sum("was").alias("was"))

    same = sides(sources, prior_sources, "source", "digest").filter("now > 0 and was > 0 and digest is not null").groupBy("source").agg(F.lit(True).alias("same"))
    known = (F.col("was") > 0) & F.col("chunk").isNotNull() & F.col("digest").isNotNull()
    sums = sides(chunks, prior_chunks, "source", "chunk", "digest").groupBy("source").agg(F.sum("now").alias("n"), F.sum("was").alias("n_prior"), F.sum(F.when(known, F.col("now")).otherwise(0)).alias("n_known"))
    whole = sums.filter("n_known > 0 and n_known = n and n = n_prior").join(same.hint("merge"), "source").select("source", F.lit(True).alias("reuse"))
    return chunks.join(whole.hint("merge"), "source", "left").select("source", "chunk", F.coalesce("reuse", F.lit(False)).alias("reuse"))


def index_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sources and their lines as chunks, against a version with some of both changed, new or gone."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), F.sha2("o_orderpriority", 256).alias("digest"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    c = dealt(read(spark, sf_dir, "lineitem"), "l_orderkey").select(F.col("l_orderkey").alias("source"), F.row_number().over(order).cast("long").alias("chunk"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("digest"))
    mark = lambda df, when: df.withColumn("digest", F.when(when, F.sha2("digest", 256)).otherwise(F.col("digest")))
    return reusable_chunks(o, c, mark(o, F.col("source") % 5 == 0), mark(c.filter("not (chunk = 2 and source % 7 = 0)"), (F.col("chunk") == 1) & (F.col("source") % 3 == 0)))


#: The second name of a query over all nodes, from when the first took some.
QUERIES = {"expansion_counts_all": expansion_counts} | {f.__name__: f for f in (index_reuse, semantic_diff, field_diff, diff_summary, longest_path_rank, topo_levels, expansion_counts, reachability, merkle_hash, incremental_plan)}

_D = """a AS (SELECT o_orderkey AS id, o_orderstatus, o_orderpriority, CAST(round(o_totalprice) AS BIGINT) AS price FROM orders),
b AS (SELECT id, o_orderstatus, CASE WHEN id % 13 = 0 THEN 'changed' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN id % 11 = 0 THEN price + 1 ELSE price END AS price FROM a WHERE id % 17 <> 0 UNION ALL SELECT -id, o_orderstatus, o_orderpriority, price FROM a WHERE id % 19 = 0),
d AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'add' WHEN b.id IS NULL THEN 'remove' ELSE 'modify' END AS op FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR (a.o_orderstatus, a.o_orderpriority, a.price) IS DISTINCT FROM (b.o_orderstatus, b.o_orderpriority, b.price))"""
_G = """e AS (SELECT DISTINCT src, dst FROM (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey > 1 UNION ALL SELECT p_partkey // 3, p_partkey FROM part WHERE p_partkey > 2)), v AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"""
_R = f"WITH RECURSIVE {_G}, w AS (SELECT node, 0 AS rank FROM v UNION SELECT e.dst, w.rank + 1 FROM w JOIN e ON e.src = w.node), r AS (SELECT node, CAST(max(rank) AS INTEGER) AS rank FROM w GROUP BY 1)"
ORACLES = {
    "index_reuse": """WITH c AS (SELECT l_orderkey AS source, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS chunk FROM lineitem), m AS (SELECT source, max(chunk) AS m FROM c GROUP BY 1)
SELECT source, chunk, source IN (SELECT o_orderkey FROM orders) AND source % 5 <> 0 AND source % 3 <> 0 AND NOT (m >= 2 AND source % 7 = 0) AS reuse FROM c JOIN m USING (source)""",
    "semantic_diff": f"WITH {_D} SELECT id, op FROM d",
    "diff_summary": f"WITH {_D} SELECT op, count(*) AS n_rows FROM d GROUP BY 1",
    "field_diff": f"""WITH {_D}, f AS (SELECT a.id, unnest([{{p: '/o_orderstatus', o: a.o_orderstatus, n: b.o_orderstatus}}, {{p: '/o_orderpriority', o: a.o_orderpriority, n: b.o_orderpriority}}, {{p: '/price', o: CAST(a.price AS VARCHAR), n: CAST(b.price AS VARCHAR)}}]) AS x FROM a JOIN b ON a.id = b.id)
SELECT id, x.p AS path, x.o AS old, x.n AS "new" FROM f WHERE x.o IS DISTINCT FROM x.n""",
    "longest_path_rank": f"{_R} SELECT node, rank FROM r",
    "topo_levels": f"{_R} SELECT rank, count(*) AS n_nodes FROM r GROUP BY 1",
    "expansion_counts": f"WITH RECURSIVE {_G}, w AS (SELECT node AS root, node FROM (SELECT node FROM v UNION SELECT p_partkey FROM part) UNION ALL SELECT w.root, e.dst FROM w JOIN e ON e.src = w.node) SELECT root, count(*) AS visits FROM w GROUP BY 1",
    "reachability": f"WITH RECURSIVE {_G}, w AS (SELECT CAST(node AS BIGINT) AS root, CAST(node AS BIGINT) AS node FROM (VALUES (2), (3)) s(node) UNION SELECT w.root, e.dst FROM w JOIN e ON e.src = w.node) SELECT root, count(*) AS n_nodes FROM w GROUP BY 1",
    "merkle_hash": """WITH c AS (SELECT c_nationkey AS k, sha256(c_name) AS h FROM customer), cb AS (SELECT k, left(h, 4) AS b, sha256(string_agg(h, '' ORDER BY h)) AS p FROM c GROUP BY 1, 2),
n AS (SELECT n_regionkey AS k, sha256(n_name || coalesce(string_agg(p, '' ORDER BY b), '')) AS h FROM nation LEFT JOIN cb ON n_nationkey = cb.k GROUP BY n_nationkey, n_regionkey, n_name),
nb AS (SELECT k, left(h, 4) AS b, sha256(string_agg(h, '' ORDER BY h)) AS p FROM n GROUP BY 1, 2)
SELECT r_name, sha256(r_name || coalesce(string_agg(p, '' ORDER BY b), '')) AS hash FROM region LEFT JOIN nb ON r_regionkey = nb.k GROUP BY r_regionkey, r_name""",
    "incremental_plan": f"WITH {_D} SELECT b.id, CASE WHEN a.id IS NOT NULL THEN 'hit' ELSE 'miss' END AS state FROM b LEFT JOIN a ON a.id = b.id AND (a.o_orderstatus, a.o_orderpriority, a.price) IS NOT DISTINCT FROM (b.o_orderstatus, b.o_orderpriority, b.price)",
}
ORACLES["expansion_counts_all"] = ORACLES["expansion_counts"]
