"""The flagship query: filter, two keyed joins, exact group aggregates and a ranked order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines by market segment: rows, exact sums, means and date range, largest total first."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter(F.col("l_returnflag") == "R")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    rows = (
        item.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("segment"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.col("l_extendedprice").cast(MONEY)).cast("decimal(38,2)").alias("total"),
            F.min(F.col("l_shipdate").cast("date")).alias("first_day"),
            F.max(F.col("l_shipdate").cast("date")).alias("last_day"),
            F.min(F.col("l_quantity").cast("long")).alias("min_quantity"),
            F.max(F.col("l_quantity").cast("long")).alias("max_quantity"),
        )
    )
    # five segments: the group count is bounded by the key's domain, so the ranking window is tiny
    order = Window.orderBy(F.col("total").desc(), F.col("segment"))
    return rows.withColumn("place", F.row_number().over(order))


QUERIES = {"table_flagship": table_flagship}

ORACLES = {
    "table_flagship": """
WITH g AS (
  SELECT c_mktsegment AS segment, count(*) AS n_rows,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total,
         min(CAST(l_shipdate AS DATE)) AS first_day, max(CAST(l_shipdate AS DATE)) AS last_day,
         min(CAST(l_quantity AS BIGINT)) AS min_quantity, max(CAST(l_quantity AS BIGINT)) AS max_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE l_returnflag = 'R' GROUP BY 1)
SELECT *, CAST(row_number() OVER (ORDER BY total DESC, segment) AS INTEGER) AS place FROM g""",
}
