"""Benchmark decontamination: documents that hold n-word windows of benchmark items.

The windows of the benchmark's texts, lower-cased and reduced to words, go to
every task as a broadcast hash set: sorted hashes with each window's item and
its place in the items' words.  Tasks scan the token windows of whole texts
against it, compare the words behind each equal hash, and report, cut out or
drop what they hit.

The broadcast is bounded: a benchmark of more than ``slice_bytes`` of text is
dealt into slices by item, and the documents are scanned once for each slice,
one slice at a time, with the hits so far written to the shared folder.  A slice
takes its text and 24 bytes a window, so at most 13 times its text (5 times at
five bytes a word), and 4 MB for each window length there is.  An item is never
cut, so a slice is as large as its largest item at least.

Defined cases: null and empty texts have no words and no hits; null item ids
and items without words have no windows; repeated rows are judged one by one,
repeated items count once by id; a column of the documents with the name of a
result column gives way to it; empty tables give empty or hitless results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm import textkit as tk
from lattica.llm.shared import Scratch, map_batches

#: Most bytes of benchmark text that one broadcast stands for.
SLICE_BYTES = 8 << 20
#: Words in a window.
WINDOW = 10

_FLAGS = 1 << 22  # entries of the first, inexact lookup

HIT = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_HITS = pa.list_(pa.struct([(f.name, pa.string() if f.name == "item_id" else pa.int64()) for f in HIT]))
#: item, first word, words, start byte and end byte of one occurrence
Hit = tuple[str, int, int, int, int]


class WindowSet:
    """Windows of items by length: sorted hashes, and for each its item's number and its bytes in ``spelt``."""

    def __init__(self, items: list[tuple[str, str]], n: int) -> None:
        names = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(names)}
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        spelt, base = [], 0
        for batch in tk.rounds(pa.array([t for _, t in items], pa.string())):
            w = tk.words(batch, tk.ALNUM_WORDS)
            low = tk.LOWER[batch.data]
            own = np.array([number[item] for item, _ in items[batch.rows]], np.int32)
            # the words of the batch, each followed by a blank
            ends = np.cumsum(w.ends - w.starts + 1)
            starts = ends - (w.ends - w.starts + 1)
            text = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
            text[np.repeat(starts - w.starts, w.ends - w.starts) + _ranges(w.starts, w.ends)] = low[_ranges(w.starts, w.ends)]
            count = np.diff(w.first)
            for size in np.unique(np.minimum(count, n)).tolist():
                if size:
                    g = tk.grams(w.hashes, size)
                    of = np.flatnonzero(np.minimum(count, n) == size)
                    at = _ranges(w.first[of], w.first[of] + count[of] - size + 1)
                    item = np.repeat(own[of], count[of] - size + 1)
                    found.setdefault(size, []).append((g[at], item, base + starts[at], (ends[at + size - 1] - 1 - starts[at]).astype(np.int32)))
            spelt.append(text)
            base += len(text)
        self.names, self.spelt = names, np.concatenate(spelt).tobytes() if spelt else b""
        self.entries, self.flags = {}, {}
        for size, parts in found.items():
            h, item, at, length = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((item, h))
            h, item, at, length = h[order], item[order], at[order], length[order]
            again = np.flatnonzero((h[1:] == h[:-1]) & (item[1:] == item[:-1])) + 1
            same = [k for k in again.tolist() if self._bytes(at[k], length[k]) == self._bytes(at[k - 1], length[k - 1])]
            keep = np.ones(len(h), bool)
            keep[same] = False
            self.entries[size] = tuple(x[keep] for x in (h, item, at, length))
            self.flags[size] = np.zeros(_FLAGS, bool)
            self.flags[size][h % np.uint64(_FLAGS)] = True

    def _bytes(self, at: int, length: int) -> bytes:
        return self.spelt[at : at + length]

    def hits(self, batch: tk.Texts, w: tk.Words) -> dict[int, list[Hit]]:
        """The occurrences of windows by text number."""
        out: dict[int, list] = {}
        low = None
        for size, (h, item, start, length) in self.entries.items():
            g = tk.grams(w.hashes, size)
            at = np.flatnonzero(self.flags[size][g % np.uint64(_FLAGS)])
            if not len(at):
                continue
            first, last = np.searchsorted(h, g[at], side="left"), np.searchsorted(h, g[at], side="right")
            doc = np.searchsorted(w.first, at, side="right") - 1
            inside = (last > first) & (at + size <= w.first[doc + 1])
            low = tk.LOWER[batch.data] if low is None else low
            for k, d, lo, hi in zip(at[inside].tolist(), doc[inside].tolist(), first[inside].tolist(), last[inside].tolist()):
                words = _spelt(low, w, k, size)
                for e in range(lo, hi):
                    if words == self._bytes(start[e], length[e]):
                        base = batch.bounds[d]
                        out.setdefault(d, []).append((self.names[item[e]], k - int(w.first[d]), size, int(w.starts[k] - base), int(w.ends[k + size - 1] - base)))
        return out


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the half-open ranges, one range after the other."""
    size = ends - starts
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - starts, size)


def _spelt(low: np.ndarray, w: tk.Words, k: int, size: int) -> bytes:
    return b" ".join(low[s:e].tobytes() for s, e in zip(w.starts[k : k + size], w.ends[k : k + size]))


def _slices(benchmark: DataFrame, item_col: str, text_col: str, slice_bytes: int) -> Iterator[tuple[bool, list[tuple[str, str]]]]:
    """The items of each slice, and whether it is the last."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t")).dropna()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // slice_bytes))
    for k in range(n):
        yield k == n - 1, [tuple(r) for r in items.filter(F.pmod(F.xxhash64("i"), F.lit(n)) == k).collect()]


Finish = Callable[[pa.RecordBatch, np.ndarray, list[list[Hit]]], pa.RecordBatch]


def _scanned(docs: DataFrame, benchmark: DataFrame, finish: Finish, schema: T.StructType, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows that ``finish`` makes of a batch, its texts' numbers of words and their hits."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "decontaminate")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.lit(None).cast(T.ArrayType(HIT)).alias("hits"))
    for last, items in _slices(benchmark, item_col, item_text_col, slice_bytes):
        known = spark.sparkContext.broadcast(WindowSet(items, n))

        def scan(batches: Iterator[pa.RecordBatch], known=known, last=last) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                own = rb.column("own")
                n_words, hits = np.zeros(rb.num_rows, np.int64), [[tuple(h.values()) for h in found or ()] for found in rb.column("hits").to_pylist()]
                for part in tk.rounds(own.field(text_col)):
                    w = tk.words(part, tk.ALNUM_WORDS)
                    n_words[part.rows] = np.diff(w.first)
                    for i, found in known.value.hits(part, w).items():
                        hits[part.rows.start + i] += found
                if last:
                    yield finish(pa.RecordBatch.from_arrays(own.flatten(), schema=pa.schema(list(own.type))), n_words, hits)
                else:
                    yield pa.RecordBatch.from_pydict({"own": own, "hits": _hit_lists(hits)})

        if last:
            return map_batches(rows, scan, schema)
        rows = scratch.put(map_batches(rows, scan, rows.schema), "hits")
        known.destroy()


def _hit_lists(hits: list[list[Hit]]) -> pa.Array:
    """Hits as a column; null for texts without any."""
    return pa.array([[dict(zip(HIT.names, h)) for h in found] or None for found in hits], _HITS)


def scan(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with ``n_words`` and ``hits``: each occurrence of an item's window in the text, with word and byte positions."""
    names = ("n_words", "hits")

    def finish(rb: pa.RecordBatch, n_words: np.ndarray, hits: list[list[Hit]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: rb.column(c) for c in rb.schema.names if c not in names} | {"n_words": pa.array(n_words), "hits": _hit_lists(hits)})

    kept = [f for f in docs.schema.fields if f.name not in names]
    return _scanned(docs, benchmark, finish, T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(HIT))]), **options)


def _merged(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges that cover what the spans cover; touching ones become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: words, words hit, items found and their digest, and whether it is contaminated."""
    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, t) for c, t in (("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())))])

    def finish(rb: pa.RecordBatch, n_words: np.ndarray, hits: list[list[Hit]]) -> pa.RecordBatch:
        n_hit = np.array([sum(b - a for a, b in _merged((h[1], h[1] + h[2]) for h in found)) for found in hits], np.int64)
        items = [sorted({h[0] for h in found}) for found in hits]
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        return pa.RecordBatch.from_pydict({id_col: rb.column(id_col), "n_words": pa.array(n_words), "n_hit": pa.array(n_hit), "n_items": pa.array([len(x) for x in items], pa.int64()), "items_sha256": pa.array(digest, pa.string()), "contaminated": pa.array(n_hit > 0)})

    return _scanned(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), benchmark, finish, schema, text_col=text_col, **options)


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit, with their own columns."""

    def finish(rb: pa.RecordBatch, n_words: np.ndarray, hits: list[list[Hit]]) -> pa.RecordBatch:
        return rb.filter(pa.array([not found for found in hits], pa.bool_()))

    return _scanned(docs, benchmark, finish, docs.schema, **options)


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """All documents, the bytes from the first to the last word of every hit cut out of their texts."""

    def finish(rb: pa.RecordBatch, n_words: np.ndarray, hits: list[list[Hit]]) -> pa.RecordBatch:
        if not any(hits):
            return rb
        texts = rb.column(text_col)
        texts = pa.array([_without(t, found) if found else t for t, found in zip(texts.to_pylist(), hits)], texts.type)
        return pa.RecordBatch.from_pydict({c: texts if c == text_col else rb.column(c) for c in rb.schema.names})

    return _scanned(docs, benchmark, finish, docs.schema, text_col=text_col, **options)


def _without(text: str, hits: list[Hit]) -> str:
    raw, kept, at = text.encode(), [], 0
    for a, b in _merged((h[3], h[4]) for h in hits):
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]).decode()
