"""Typed table queries over the driver's tables: filters, keyed joins, groups, exact aggregates, order and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.plans import query as q
from lattica.sources import read

ORDERS = q.Source("orders", (("o_orderkey", q.NUMBER), ("o_custkey", q.NUMBER), ("o_totalprice", q.NUMBER), ("o_orderpriority", q.STRING), ("o_orderdate", q.DATE)), ("o_orderkey",))
CUSTOMER = q.Source("customer", (("c_custkey", q.NUMBER), ("c_name", q.STRING), ("c_mktsegment", q.STRING)), ("c_custkey",))


def filter_predicate_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """and / or / not over comparisons of fields with literals, pushed down to the scan."""
    df = read(spark, sf_dir, "lineitem")
    keep = (F.col("l_quantity") >= 25) & ((F.col("l_returnflag") == "R") | (F.col("l_linestatus") != "O")) & ~(F.col("l_discount") > 0.05)
    return df.filter(keep).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")


def planned_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole plan: filter, inner join with projection, group, five aggregates, sort, as a checked plan."""
    plan = q.Plan(
        (ORDERS, CUSTOMER),
        (
            q.Filter("large", "orders", q.Logic("and", (q.Compare("gte", "o_totalprice", 1000), q.Logic("not", (q.Compare("eq", "o_orderpriority", "5-LOW"),))))),
            q.Join("both", "large", "customer", (("o_custkey", "c_custkey"),), (("left", "o_orderkey", "id"), ("left", "o_totalprice", "price"), ("left", "o_orderdate", "day"), ("right", "c_mktsegment", "segment")), ("id",)),
            q.Group("by_segment", "both", (("segment", "segment"),)),
            q.Aggregate("sums", "by_segment", (("count", None, "n_rows"), ("sum", "price", "total"), ("mean", "price", "average"), ("min", "day", "first_day"), ("max", "price", "largest"))),
            q.Sort("ranked", "sums", (("total", "desc"),)),
        ),
        "ranked",
    )
    tables = {s.name: q.conformed(read(spark, sf_dir, s.name), s, [F.col(s.key[0])]) for s in plan.sources}
    out = q.ordered(q.execute(plan, tables))
    return out.withColumn("mean_cents", F.floor(F.col("average") * 100).cast("long")).drop("average")


def planned_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan whose order is carried from a sort through a join and a group to a series of points, by place."""
    plan = q.Plan(
        (ORDERS, CUSTOMER),
        (
            q.Sort("urgent", "orders", (("o_orderpriority", "desc"), ("o_totalprice", "asc"))),
            q.Join("both", "urgent", "customer", (("o_custkey", "c_custkey"),), (("left", "o_orderkey", "id"), ("left", "o_totalprice", "price"), ("right", "c_name", "buyer"), ("right", "c_mktsegment", "segment")), ("id",)),
            q.Group("by_buyer", "both", (("buyer", "buyer"), ("segment", "segment"))),
            q.Aggregate("sums", "by_buyer", (("count", None, "n_rows"), ("sum", "price", "total"))),
            q.Series("points", "sums", "segment", ("n_rows", "total")),
        ),
        "points",
    )
    tables = {s.name: q.conformed(read(spark, sf_dir, s.name), s, [F.col(s.key[0])]) for s in plan.sources}
    return q.placed(q.execute(plan, tables))


def join_projection_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("buyer"), F.col("o_orderpriority").alias("priority"))


def join_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a join would have, from the keys' histograms alone."""
    left = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    right = read(spark, sf_dir, "supplier").groupBy(F.col("s_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("m"))
    return left.join(right, "k").agg(F.sum(F.col("n") * F.col("m")).alias("n_rows"))


def join_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys without a partner, from either side."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey")).distinct()
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))
    missing = lambda a, b, side: a.join(b, "custkey", "left_anti").select("custkey", F.lit(side).alias("side"))
    return missing(orders, customer, "orders").unionByName(missing(customer, orders, "customer"))


def group_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("first_ord"), F.count(F.lit(1)).alias("n_rows"))


def agg_exact_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(price).cast("decimal(38,2)").alias("total"), F.min(price).alias("least"), F.max(price).alias("most"),
        F.floor(F.sum(price) * 100 / F.count(F.lit(1))).cast("long").alias("mean_cents"), F.min("l_shipdate").cast("date").alias("first_day"),
    )


def sort_stable_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within each brand by size descending, ties by input order; brands bound the windows."""
    order = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.row_number().over(order).alias("place"))


def count_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n_rows"))


def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that several rows share."""
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def schema_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break a declared contract, by rule."""
    item = read(spark, sf_dir, "lineitem")
    rules = {"quantity_positive": F.col("l_quantity") > 0, "discount_in_range": F.col("l_discount").between(0, 0.1), "flag_known": F.col("l_returnflag").isin("A", "N", "R"), "key_present": F.col("l_orderkey").isNotNull()}
    counts = item.agg(*[F.sum(F.when(ok, 0).otherwise(1)).cast("long").alias(name) for name, ok in rules.items()])
    return counts.unpivot([], list(rules), "rule", "n_broken")


def rollup_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("l_suppkey").alias("n_suppliers"))
    return df.select(F.coalesce("l_returnflag", F.lit("all")).alias("returnflag"), F.coalesce("l_linestatus", F.lit("all")).alias("linestatus"), "n_rows", "n_suppliers")


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference of two key sets."""
    a = read(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("custkey"))
    b = read(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.distinct().exceptAll(b)}
    return reduce(DataFrame.unionByName, [df.withColumn("op", F.lit(op)) for op, df in parts.items()])


QUERIES = {f.__name__: f for f in (filter_predicate_tree, planned_query, planned_series, join_projection_keyed, join_cardinality, join_coverage, group_first_seen, agg_exact_decimal, sort_stable_rank, count_by, key_uniqueness, schema_contract, rollup_extension, set_operations)}

ORACLES = {
    "planned_series": """WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderpriority DESC, CAST(o_totalprice AS DECIMAL(38,6)), o_orderkey) AS r FROM orders),
g AS (SELECT c_name AS buyer, c_mktsegment AS segment, min(r) AS r, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(38,6))) AS t FROM o JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT CAST(row_number() OVER (ORDER BY r) AS BIGINT) AS place, buyer, segment, CAST(n AS DECIMAL(38,6)) AS n_rows, CAST(t AS DECIMAL(38,6)) AS total FROM g""",
    "filter_predicate_tree": """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM lineitem
WHERE l_quantity >= 25 AND (l_returnflag = 'R' OR l_linestatus <> 'O') AND NOT (l_discount > 0.05)""",
    "planned_query": """SELECT c_mktsegment AS segment, CAST(count(*) AS DECIMAL(38,6)) AS n_rows, CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DECIMAL(38,6)) AS total,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) // count(*) AS BIGINT) AS mean_cents, min(CAST(o_orderdate AS DATE)) AS first_day,
  max(CAST(o_totalprice AS DECIMAL(38,6))) AS largest
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 1000 AND NOT (o_orderpriority = '5-LOW') GROUP BY 1""",
    "join_projection_keyed": "SELECT o_orderkey AS id, c_name AS buyer, o_orderpriority AS priority FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_cardinality": "SELECT CAST(count(*) AS BIGINT) AS n_rows FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "join_coverage": """SELECT DISTINCT o_custkey AS custkey, 'orders' AS side FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
    "group_first_seen": "SELECT event_type, min(event_id) AS first_ord, count(*) AS n_rows FROM events GROUP BY 1",
    "agg_exact_decimal": """SELECT l_returnflag, l_linestatus, count(*) AS n_rows, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total,
  min(CAST(l_extendedprice AS DECIMAL(18,2))) AS least, max(CAST(l_extendedprice AS DECIMAL(18,2))) AS most,
  CAST(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS HUGEINT) // count(*) AS BIGINT) AS mean_cents, min(CAST(l_shipdate AS DATE)) AS first_day
FROM lineitem GROUP BY 1, 2""",
    "sort_stable_rank": "SELECT p_partkey, p_brand, p_size, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS INTEGER) AS place FROM part",
    "count_by": "SELECT o_orderstatus, o_orderpriority, count(*) AS n_rows FROM orders GROUP BY 1, 2",
    "key_uniqueness": "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "schema_contract": """WITH c AS (SELECT count(*) FILTER (NOT l_quantity > 0) AS a, count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.1) AS b, count(*) FILTER (l_returnflag NOT IN ('A','N','R')) AS c, count(*) FILTER (l_orderkey IS NULL) AS d FROM lineitem)
SELECT 'quantity_positive' AS rule, a AS n_broken FROM c UNION ALL SELECT 'discount_in_range', b FROM c UNION ALL SELECT 'flag_known', c FROM c UNION ALL SELECT 'key_present', d FROM c""",
    "rollup_extension": """SELECT coalesce(l_returnflag, 'all') AS returnflag, coalesce(l_linestatus, 'all') AS linestatus, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_suppliers
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "set_operations": """WITH a AS (SELECT o_custkey AS custkey FROM orders WHERE o_totalprice > 200000), b AS (SELECT c_custkey AS custkey FROM customer WHERE c_acctbal > 0)
SELECT custkey, 'union' AS op FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT custkey, 'intersect' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT custkey, 'except' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
}
