"""Vectorised words and word n-grams over the UTF-8 bytes of whole Arrow batches.

Tasks get Arrow batches from Spark; here a batch's texts are seen as one byte
buffer, so words are found and hashed by a few numpy passes instead of a Python
loop over words.  All word rules used in this subpackage treat every byte of a
multi-byte character alike, so they can be decided byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes handled by one round of numpy passes; one longer text is a round of its own.
ROUND_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def byte_table(inside) -> np.ndarray:
    """256 flags: whether a byte belongs to a word."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Words [^\x20\x09-\x0D]+
SPACE_WORDS = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, to be used after lower-casing
ALNUM_WORDS = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


@dataclass
class Texts:
    """Some consecutive texts of a batch: bytes (8 spare ones at the end) and where each text starts and ends."""

    rows: slice
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def rounds(column: pa.Array, most: int = ROUND_BYTES) -> Iterator[Texts]:
    """The texts of a string or binary column in rounds of about ``most`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, side="right")) - 1)
        j = min(j, n)
        part = np.empty(int(ends[j] - ends[i]) + 8, dtype=np.uint8)
        part[:-8] = raw[ends[i] : ends[j]]
        part[-8:] = 0
        yield Texts(slice(i, j), part, ends[i : j + 1] - ends[i])
        i = j


@dataclass
class Words:
    """Words of some texts: byte starts and ends, a 64-bit hash each, and each text's first word number."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)


def runs(classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of maximal runs of one class that don't cross text bounds, and the end of all; empty if no bytes."""
    n = int(bounds[-1])
    if not n:
        return np.zeros(1, np.int64)
    change = np.empty(n + 1, dtype=bool)
    change[0] = change[n] = True
    np.not_equal(classes[1:n], classes[: n - 1], out=change[1:n])
    change[bounds] = True
    return np.flatnonzero(change)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, read eight bytes at a time."""
    eight = np.ndarray((max(0, len(data) - 7),), dtype="<u8", buffer=data, strides=(1,))
    size = ends - starts
    h = mix(size.astype(np.uint64) * _K1 ^ eight[starts] & _MASKS[np.minimum(size, 8)]) if len(starts) else np.zeros(0, np.uint64)
    todo, k = np.flatnonzero(size > 8), 8
    while len(todo):
        chunk = eight[starts[todo] + k] & _MASKS[np.minimum(size[todo] - k, 8)]
        h[todo] = mix(h[todo] * _K1 ^ chunk)
        k += 8
        todo = todo[size[todo] > k]
    return h


def words(texts: Texts, table: np.ndarray, lower: bool = True) -> Words:
    """The words of each text by a byte table, of the lower-cased bytes if ``lower``."""
    data = LOWER[texts.data] if lower else texts.data
    inside = table[data]
    edge = runs(inside, texts.bounds)
    keep = inside[edge[:-1]]
    starts, ends = edge[:-1][keep], edge[1:][keep]
    first = np.searchsorted(starts, texts.bounds)
    return Words(starts, ends, hash_spans(data, starts, ends), first)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every ``n`` consecutive hashes; the result has n - 1 fewer entries.

    Hashes of 2, 4, 8, ... neighbours are made by doubling and joined to ``n``.
    """
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    whole, done, part, size = None, 0, hashes, 1
    while size <= n:
        if n & size:
            whole = part[:m].copy() if whole is None else mix(whole * _K1 + part[done : done + m])
            done += size
        part = mix(part[:-size] * _K1 + part[size:]) if 2 * size <= n else part
        size *= 2
    return whole


def short_gram(hashes: np.ndarray) -> np.uint64:
    """One hash of a whole sequence shorter than a gram; its length is part of it."""
    g = np.array([len(hashes)], dtype=np.uint64) * _K3
    for h in hashes:
        g = mix(g * _K1 + h)
    return g[0]


def shingle_sets(texts: Texts, n: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of ``n``-word shingles, words parted by white space, A-Z lower-cased.

    A text of fewer words has its whole sequence as one shingle, one without words the empty set.
    """
    w = words(texts, SPACE_WORDS)
    g = grams(w.hashes, n)
    out = []
    for i in range(len(texts)):
        a, b = w.first[i], w.first[i + 1]
        if b - a >= n:
            s = np.sort(g[a : b - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
        elif b > a:
            out.append(np.array([short_gram(w.hashes[a:b])]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def int64(x: np.ndarray) -> np.ndarray:
    """The same bits as signed numbers, which is what Spark has."""
    return x.view(np.int64)
