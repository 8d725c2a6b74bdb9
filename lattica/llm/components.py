"""Connected components of an edge table by label propagation with pointer jumping.

Defined cases: rows with a null end make no link and no node; loops and repeated
edges change nothing; an empty table gives an empty result; columns other than
``a`` and ``b`` are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component is named by its smallest node.

    Every round gives a node the smallest label among its neighbours and itself
    and then its label's own label, so labels travel twice as far each round.
    The aggregates are partial, so a node with very many edges is no hot spot.
    The result is the one table of ``scratch`` that is left, under ``name``.
    """
    edges = edges.select("a", "b").dropna()
    both = scratch.put(edges.union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = scratch.put(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), name)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        least = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        least = scratch.put(least, f"{name}-least")
        own = least.select(F.col("node").alias("label"), F.col("component").alias("next"))
        labels = scratch.put(least.join(own, F.col("component") == F.col("label"), "left").select("node", "was", F.least("component", "next").alias("component")), name)
        if labels.filter(F.col("component") != F.col("was")).isEmpty():
            scratch.drop(f"{name}-edges", f"{name}-least")
            return labels.select("node", "component")
        labels = labels.select("node", "component")
