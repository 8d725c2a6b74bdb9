"""Token ids and token counts of whole texts by a public BPE tokenizer, each distinct word encoded once per task.

A BPE tokenizer first cuts a text into words and then encodes every word on its
own.  For texts of plain characters (ASCII and the Latin letters of the western
European languages, no special strings, no clipped English endings) the cut is
made here for a whole batch by numpy, and the library's model encodes the words
a task has not met yet.  Every other text goes to the library whole, so the ids
are the library's in any case.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from lattica.llm import textkit as tk

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"

#: Words that a task remembers before it starts afresh.
MEMO_WORDS = 1 << 20

_LETTER, _DIGIT, _OTHER, _SPACE = 1, 2, 3, 0
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x09, 0x0A, 0x0D, 0x20]] = _SPACE
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = _LETTER
_PLAIN = np.zeros(256, bool)
_PLAIN[[0x09, 0x0A, 0x0D, 0xC3, 0xC5]] = _PLAIN[0x20:0x7F] = _PLAIN[0x80:0xC0] = True


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file ``name`` lies; a path stays as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _byte_letters() -> dict[int, str]:
    """The printable character by which byte-level BPE vocabularies spell each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memo:
    """A hash table from 64-bit word hashes to numbers, looked up and filled by whole arrays."""

    def __init__(self, most: int = MEMO_WORDS) -> None:
        self.most, self.slots = most, 2 * most
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.n = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32), 0

    def get(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where unknown."""
        out, at, left = np.full(len(h), -1, np.int32), (h % np.uint64(self.slots)).astype(np.int64), np.arange(len(h))
        while len(left):
            key = self.keys[at]
            same = key == h[left]
            out[left[same]] = self.values[at[same]]
            on = ~same & (key != 0)
            left, at = left[on], (at[on] + 1) % self.slots
        return out

    def put(self, h: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct unknown hashes; the table doubles when a single round would overfill it."""
        if self.n + len(h) > 0.7 * self.slots:
            full = np.flatnonzero(self.keys)
            keys, old, self.slots = self.keys[full], self.values[full], 2 * self.slots
            self.clear()
            self.put(keys, old)
            return self.put(h, values)
        at, left = (h % np.uint64(self.slots)).astype(np.int64), np.arange(len(h))
        self.n += len(h)
        while len(left):
            free = np.flatnonzero(self.keys[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.keys[at[won]], self.values[at[won]] = h[left[won]], values[left[won]]
            on = np.ones(len(left), bool)
            on[won] = False
            left, at = left[on], (at[on] + 1) % self.slots


class Encoder:
    """Token ids, or counts of them, by the vocabulary file at ``path``; ``kind`` is how it cuts words.

    A task makes its own and drops it with its vocabulary and words, so that a reused Python process doesn't keep them.
    """

    def __init__(self, path: str, kind: str) -> None:
        if kind not in (WORD_BPE, BYTE_BPE):
            raise ValueError(f"unknown kind of tokenizer: {kind}")
        self.tokenizer, self.kind, self.memo = load(path), kind, Memo()
        self.reset()

    def reset(self) -> None:
        self.memo.clear()
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size, self.n_words = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _known(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word in this task's store, unknown ones encoded and added."""
        h = tk.hash_spans(data, starts, ends)
        h[h == 0] = 1
        if self.memo.n > self.memo.most - (1 << 18):
            self.reset()
        number = self.memo.get(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh, one = np.unique(h[new], return_index=True)
            rows, spell, model = new[one], _byte_letters(), self.tokenizer.model
            found = [[t.id for t in model.tokenize(data[s:e].tobytes().decode("latin-1").translate(spell))] for s, e in zip(starts[rows].tolist(), ends[rows].tolist())]
            size = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(size.sum()))
            self.ids, self.at, self.size = _room(self.ids, self.n_ids + len(flat)), _room(self.at, self.n_words + len(found)), _room(self.size, self.n_words + len(found))
            put = slice(self.n_words, self.n_words + len(found))
            self.ids[self.n_ids : self.n_ids + len(flat)] = flat
            self.at[put], self.size[put] = self.n_ids + np.cumsum(size) - size, size
            self.memo.put(fresh, np.arange(put.start, put.stop, dtype=np.int32))
            self.n_ids, self.n_words = self.n_ids + len(flat), put.stop
            number[new] = self.memo.get(h[new])
        return number

    def _cut(self, texts: tk.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, word starts, word ends, and whether each text is plain."""
        data = texts.data
        plain = np.ones(len(texts), bool)
        odd = ~_PLAIN[data[:-8]]
        nxt = data[1:-7]
        odd |= (data[:-8] == 0xC3) & ((nxt == 0x97) | (nxt == 0xB7)) | (data[:-8] == 0xC5) & (nxt != 0x92) & (nxt != 0x93)
        odd |= (data[:-8] == 0x3C) & (nxt == 0x7C)
        if self.kind == WORD_BPE:
            data = tk.LOWER[data]
            lead = np.flatnonzero(data[:-8] == 0xC3) + 1
            data[lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E)]] += 0x20
            lead = np.flatnonzero(data[:-8] == 0xC5) + 1
            data[lead[data[lead] == 0x92]] += 1
        quote = np.flatnonzero(data[:-8] == 0x27)
        odd[quote[np.isin(data[quote + 1], np.frombuffer(b"strvmld", np.uint8))]] = True
        plain[np.unique(np.searchsorted(texts.bounds, np.flatnonzero(odd), side="right") - 1)] = False
        cls = _CLASS[data]
        edge = tk.runs(cls, texts.bounds)
        a, b = edge[:-1].copy(), edge[1:]
        kind = cls[a]
        if self.kind == WORD_BPE:
            keep = kind != _SPACE
            a, b, kind = a[keep], b[keep], kind[keep]
            times = np.where(kind == _DIGIT, b - a, 1)
            if len(times) and times.max() > 1:
                nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                kind, a, b = np.repeat(kind, times), np.repeat(a, times) + nth, np.repeat(b, times)
                b = np.where(kind == _DIGIT, a + 1, b)
            return data, a, b, plain
        space = np.flatnonzero(kind == _SPACE)
        last = np.zeros(len(a), bool)
        last[np.searchsorted(a, texts.bounds[1:][np.diff(texts.bounds) > 0]) - 1] = True  # a text's last run
        inner = space[~last[space]]
        blank = data[b[inner] - 1] == 0x20
        first_end, second = b.copy(), np.zeros(len(a), bool)
        first_end[inner] -= 1
        a_next = a.copy()
        a_next[inner[blank] + 1] -= 1
        second[inner[~blank]] = True
        starts, ends = np.stack([a_next, b - 1], 1).ravel(), np.stack([first_end, b], 1).ravel()
        keep = np.stack([first_end > a_next, second], 1).ravel()
        return data, starts[keep], ends[keep], plain

    def counts(self, texts: tk.Texts) -> np.ndarray:
        """Tokens of each text."""
        data, starts, ends, plain = self._cut(texts)
        number = self._known(data, starts, ends) if len(starts) else np.zeros(0, np.int32)
        size = self.size[number]
        total = np.concatenate([[0], np.cumsum(size)])
        first = np.searchsorted(starts, texts.bounds)
        out = total[first[1:]] - total[first[:-1]]
        for i, ids in self._whole(texts, plain):
            out[i] = len(ids)
        return out

    def encode(self, texts: tk.Texts) -> list[np.ndarray]:
        """Token ids (uint32) of each text."""
        data, starts, ends, plain = self._cut(texts)
        number = self._known(data, starts, ends) if len(starts) else np.zeros(0, np.int32)
        size, at = self.size[number], self.at[number]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        first = total[np.searchsorted(starts, texts.bounds)]
        out = [flat[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        for i, ids in self._whole(texts, plain):
            out[i] = np.array(ids, np.uint32)
        return out

    def _whole(self, texts: tk.Texts, plain: np.ndarray) -> Iterable[tuple[int, list[int]]]:
        rest = np.flatnonzero(~plain).tolist()
        return zip(rest, (e.ids for e in self.tokenizer.encode_batch([texts.text(i).decode() for i in rest], add_special_tokens=False))) if rest else ()


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(len(x), n - len(x)), x.dtype)])


def token_ids(column: pa.Array, encoder: Encoder) -> Iterable[np.ndarray]:
    for part in tk.rounds(column):
        yield from encoder.encode(part)
