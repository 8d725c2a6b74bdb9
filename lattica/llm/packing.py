"""Packing of tokenised documents into sequences by shortest-pack-first over the length histogram.

Documents longer than a sequence are cut into whole sequences and a last piece.
The histogram of the last pieces' lengths has at most ``size`` bars, however
many documents there are, so the driver packs bars instead of documents: lengths
are placed longest first, each into the shortest pack that it fits, and packing
patterns carry counts.  Pieces then find their place by joining (length, rank
within the length) to the patterns' rank ranges.

Ids stay in the task that encodes them: a piece's checksum depends only on its
document, so what is shuffled is a few numbers a document.

Defined cases: null text is an empty document, which has the closing id alone;
repeated rows are packed each; the result's columns are fixed, whatever other
columns the documents have; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm import tokenizing as tz
from lattica.llm.shared import local_table, map_batches, written

SEQUENCE = 1024
CLOSING_ID = 0
#: Documents that one task ranks.
RANKED = 1 << 19


def spfhp(histogram: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """Packing patterns for a histogram of lengths: (number of packs, {length: how many in each such pack}).

    Lengths are placed longest first.  A length goes to the shortest packs that
    still have room for it, as many at a time as there are packs of that pattern;
    only without any such pack are new ones begun.  A pattern takes several
    pieces of one length at once while no other pack becomes shorter than it.
    """
    open_packs: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)  # by tokens in the pack
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fill = next((n for n in sorted(open_packs) if open_packs[n] and n + length <= size), None)
            if fill is None:
                # with no room anywhere, new packs take one piece each, until the pieces that are left fill them up
                fit = size // length
                packs, rest = divmod(left, fit)
                if packs:
                    open_packs[length * fit].append((packs, {length: fit}))
                if rest:
                    open_packs[length * rest].append((1, {length: rest}))
                break
            packs, pattern = open_packs[fill].pop()
            take = min(packs, left)
            if packs > take:
                open_packs[fill].append((packs - take, pattern))
            open_packs[fill + length].append((take, pattern | {length: pattern.get(length, 0) + 1}))
            left -= take
    return [entry for n in sorted(open_packs) for entry in open_packs[n]]


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = tz.BYTE_BPE, kind: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Per document: id, doc_tokens with the closing id, and the CRC-32 of each piece's ids."""
    path, kind = tz.tokenizer_path(tokenizer), kind or tokenizer
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("doc_tokens", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closing, encoder = np.array([CLOSING_ID], "<u4").tobytes(), tz.Encoder(path, kind)
        for rb in batches:
            n, crcs = np.zeros(rb.num_rows, np.int64), []
            for i, ids in enumerate(tz.token_ids(rb.column(text_col), encoder)):
                raw = ids.astype("<u4").tobytes() + closing
                n[i] = len(raw) // 4
                crcs.append([zlib.crc32(raw[a : a + 4 * size]) for a in range(0, len(raw), 4 * size)])
            yield pa.RecordBatch.from_pydict({"doc_id": rb.column(id_col), "doc_tokens": pa.array(n), "crcs": pa.array(crcs, pa.list_(pa.int64()))})

    return map_batches(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), cut, schema)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = tz.BYTE_BPE, kind: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset in it."""
    spark = docs.sparkSession
    cut = written(pieces(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer, kind=kind, size=size), "pieces")
    cut = cut.withColumns({"n_full": F.size("crcs") - 1, "last": F.col("doc_tokens") - (F.size("crcs") - 1) * F.lit(size)})
    n_docs = cut.count()
    buckets = max(1, -(-n_docs // RANKED)) * 8
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "doc_tokens", "crcs"), F.lit(buckets)).cast("int"))

    # bars of the histogram by bucket; their number depends on size and buckets alone
    bars = cut.groupBy("last", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_full").alias("fulls"))
    before = Window.partitionBy("last").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bars = written(bars.withColumn("rank_base", F.coalesce(F.sum("n").over(before), F.lit(0))), "histogram")
    histogram = {r[0]: r[1] for r in bars.groupBy("last").agg(F.sum("n")).collect()}

    ranges, sequences, used = [], 0, defaultdict(int)
    for packs, pattern in spfhp(histogram, size):
        offset = 0
        for length, each in pattern.items():
            ranges.append((length, used[length], used[length] + packs * each, each, sequences, offset))
            used[length] += packs * each
            offset += length * each
        sequences += packs
    places = local_table(spark, ranges, "last long, rank_from long, rank_to long, each long, first_sequence long, base long")

    # whole sequences come after the packed ones, numbered by length and bucket
    full_bases = bars.select("last", "bucket", "rank_base", "fulls").withColumn("full_base", F.coalesce(F.sum("fulls").over(before), F.lit(0)))
    per_length = full_bases.groupBy("last").agg(F.sum("fulls").alias("f"))
    lengths = {r[0]: r[1] for r in per_length.collect()}
    at, starts = sequences, []
    for length in sorted(lengths):
        starts.append((length, at))
        at += lengths[length]
    starts = local_table(spark, starts, "last long, length_base long")
    # a row for each length and bucket, so it grows with the documents: no broadcast is asked for
    bases = full_bases.join(F.broadcast(starts), "last").select("last", "bucket", "rank_base", (F.col("full_base") + F.col("length_base")).alias("full_base"))

    order = Window.partitionBy("last", "bucket").orderBy("doc_id", "doc_tokens", "crcs")
    ranked = (
        cut.withColumns({"rank": F.row_number().over(order) - 1, "fulls_before": F.coalesce(F.sum("n_full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
        .join(bases, ["last", "bucket"])
        .withColumns({"rank": F.col("rank") + F.col("rank_base"), "full_base": F.col("full_base") + F.col("fulls_before")})
    )
    placed = ranked.join(F.broadcast(places), "last").filter((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    nth = F.col("rank") - F.col("rank_from")
    placed = placed.withColumns({"last_sequence": F.col("first_sequence") + F.floor(nth / F.col("each")), "last_offset": F.col("base") + F.pmod(nth, F.col("each")) * F.col("last")})
    one = placed.select("doc_id", "doc_tokens", "n_full", "last", "full_base", "last_sequence", "last_offset", F.posexplode("crcs").alias("i", "ids_crc32"))
    is_last = F.col("i") == F.col("n_full")
    return one.select(
        "doc_id",
        (F.col("i") * F.lit(size)).cast("long").alias("start"),
        F.when(is_last, F.col("last")).otherwise(F.lit(size)).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        F.when(is_last, F.col("last_sequence")).otherwise(F.col("full_base") + F.col("i")).cast("long").alias("sequence_id"),
        F.when(is_last, F.col("last_offset")).otherwise(F.lit(0)).cast("long").alias("offset"),
    )
