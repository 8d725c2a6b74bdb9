"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are turned into whole numbers, floor(scale * x), so scores are exact.
Rows fall into candidate blocks and queries into query blocks, both of bounded
size; every two of them meet in one cell.  In a cell each dimension has a list
of the block's rows sorted by that component.  For a query, all lists are read
together from their better end; a row met in any list is scored in full, and no
row still unmet can score more than the query's product with the components now
at the lists' heads.  Once that bound is below the k-th score, the rest of the
block is left unread.  The cells' k best are ranked at last.

Defined cases: vectors that are null, empty, or hold a null or non-finite
component take no part; only vectors of one length are compared; a row repeated
with its id and vector counts once, and rows of the query's own id are not its
candidates; ties go to the smaller id; without candidates a query has no rows;
the result's columns are fixed, whatever other columns there are; scores are 64-bit
whole numbers, so vectors whose products pass 2^63 (components of a million at a
thousand dimensions, scaled) are refused where they meet; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a candidate block and of a query block.
CANDIDATES, QUERIES = 8192, 1024
#: List entries read before the bound is first looked at; doubled each time.
FIRST_DEPTH = 16


class Lists:
    """A block's rows with their ids, and each dimension's rows in ascending order of the component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.lists = np.argsort(self.rows, axis=0, kind="stable")
        most = int(np.abs(rows).max(initial=0))
        # float64 products of whole numbers are exact below 2^53, and fast
        self.fast = self.rows.astype(np.float64) if most * most * rows.shape[1] < 1 << 53 else None

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.fast is None:
            return self.rows[at] @ q
        return (self.fast[at] @ q.astype(np.float64)).astype(np.int64)

    def top(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, best first."""
        n, dims = len(self.ids), np.flatnonzero(q)
        if not len(dims):
            dims = np.arange(1)
        up = q[dims] > 0
        met, depth, read = np.zeros(n, bool), FIRST_DEPTH, 0
        met[self.ids == own] = True
        best_at, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while read < n:
            depth = min(depth, n)
            part = np.concatenate([self.lists[n - depth : n - read, dims[up]].ravel(), self.lists[read:depth, dims[~up]].ravel()])
            fresh = np.zeros(n, bool)
            fresh[part] = True
            at = np.flatnonzero(fresh & ~met)
            met[at] = True
            best_at, best = np.concatenate([best_at, at]), np.concatenate([best, self.scores(at, q)])
            keep = np.lexsort((self.ids[best_at], -best))[:k]
            best_at, best = best_at[keep], best[keep]
            edge = np.where(up, n - depth, depth - 1)
            heads = self.rows[self.lists[edge, dims], dims]
            if len(best) == k and int(heads @ q[dims]) < best[-1]:
                break
            read, depth = depth, 2 * depth
        return self.ids[best_at], best


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(n, -1)


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows; ``is_query`` marks the queries."""
    v = F.col(f"`{vector_col}`")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.filter(usable & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), whole.alias("v"), is_query.alias("asks")).withColumn("dim", F.size("v")).dropDuplicates(["id", "v"])
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    blocks, groups = max(1, -(-n // candidates)), max(1, -(-n_queries // queries))
    block, group = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.select("dim", "id", "v", block.alias("block"), each(groups).alias("grp"))
    asked = rows.filter("asks").select("dim", "id", "v", each(blocks).alias("block"), group.alias("grp"))

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            vectors_, asked_ = _matrix(left["v"], left.num_rows), _matrix(right["v"], right.num_rows)
            if float(np.abs(vectors_).max()) * float(np.abs(asked_).max()) * vectors_.shape[1] >= 2.0**63:
                raise OverflowError("products of these vectors may pass 64 bits: scale them down")
            lists = Lists(left["id"].to_numpy(), vectors_)
            for own, q in zip(right["id"].to_numpy(), asked_):
                ids, scores = lists.top(own, q, k)
                found.append((np.full(len(ids), own), ids, scores))
        cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found) if found else ([], [], []))]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, cols))))

    near = held.groupBy("dim", "block", "grp").cogroup(asked.groupBy("dim", "block", "grp")).applyInArrow(met, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.dropDuplicates().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
