"""Token counts through a digest cache.

Each text's normalised content has a digest.  The cache is a Parquet table of
(tokenizer_version, digest, n_tokens).  Documents are joined to it by digest;
only distinct contents that it lacks are encoded, and their counts are appended
before every document takes its count from the cache.

The version is the digest of the vocabulary file with the library's version, so
counts of another tokenizer are never mistaken for one's own.  Normalising is
only what cannot change a count: for the lower-casing word BPE, runs of blanks,
tabs and line ends become one blank; for byte-level BPE, nothing.

Defined cases: null text counts as empty (no tokens, no bytes); repeated rows
each get their row; the result's columns are the id and the counts, whatever
other columns the documents have; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm import textkit as tk
from lattica.llm import tokenizing as tz
from lattica.llm.shared import fresh_path, map_batches

CACHE = T.StructType([T.StructField("tokenizer_version", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
#: Texts of more tokens are over the limit.
LIMIT = 2048


@functools.cache
def tokenizer_version(path: str) -> str:
    import tokenizers

    with open(path, "rb") as f:
        return f"{hashlib.sha256(f.read()).hexdigest()}-{tokenizers.__version__}"


def normal_form(text: Column, kind: str) -> Column:
    """Text that has the same number of tokens and the same digest as all its spacings."""
    whole = F.coalesce(text, F.lit(""))
    return F.regexp_replace(whole, "[ \\t\\r\\n]+", " ") if kind == tz.WORD_BPE else whole


def _digest(normal: Column) -> Column:
    return F.unhex(F.sha2(normal, 256))


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose digest this task has not passed on yet, so that a hot text crosses the shuffle once a task."""
    seen: set[bytes] = set()
    for rb in batches:
        keep = np.zeros(rb.num_rows, bool)
        for i, d in enumerate(rb.column("digest").to_pylist()):
            if d not in seen:
                seen.add(d)
                keep[i] = True
        yield rb.filter(pa.array(keep))


def read_cache(docs: DataFrame, cache_path: str, version: str) -> DataFrame | None:
    """The counts known for this version, one for each digest; None where there is no cache yet."""
    try:
        found = docs.sparkSession.read.schema(CACHE).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found.filter(F.col("tokenizer_version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def append_misses(docs: DataFrame, cache_path: str, *, text_col: str = "text", tokenizer: str = tz.WORD_BPE, kind: str | None = None) -> None:
    """Encodes the distinct contents that the cache lacks and appends their counts to it."""
    path = tz.tokenizer_path(tokenizer)
    kind, version = kind or tokenizer, tokenizer_version(path)
    normal = docs.select(normal_form(F.col(f"`{text_col}`"), kind).alias("normal"))
    keyed = normal.select(_digest(F.col("normal")).alias("digest"), "normal")
    texts = map_batches(keyed, _first_of_each, keyed.schema)
    known = read_cache(docs, cache_path, version)
    if known is not None:
        texts = texts.join(known, "digest", "left_anti")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tz.Encoder(path, kind)
        for rb in _first_of_each(batches):
            n = np.zeros(rb.num_rows, np.int64)
            for part in tk.rounds(rb.column("normal")):
                n[part.rows] = enc.counts(part)
            yield pa.RecordBatch.from_pydict({"tokenizer_version": pa.array([version] * rb.num_rows, pa.string()), "digest": rb.column("digest"), "n_tokens": pa.array(n)})

    map_batches(texts.repartition("digest").select("digest", "normal"), encoded, CACHE).write.mode("append").parquet(cache_path)


def count_tokens(docs: DataFrame, cache_path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = tz.WORD_BPE, kind: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per document: its id, n_bytes (UTF-8), n_tokens and over_limit.

    ``cache_path`` is a table that later runs use again; without one, the cache
    is a new table in the shared folder.
    """
    cache_path = cache_path or fresh_path(docs.sparkSession, "token-counts")
    append_misses(docs, cache_path, text_col=text_col, tokenizer=tokenizer, kind=kind)
    known = read_cache(docs, cache_path, tokenizer_version(tz.tokenizer_path(tokenizer)))
    text = F.col(f"`{text_col}`")
    keyed = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), _digest(normal_form(text, kind or tokenizer)).alias("digest"))
    return keyed.join(known, "digest").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
