"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Tokens are maximal runs of ASCII letters, digits and non-ASCII bytes.  The field
tags each as the begin (B) or inside (I) of a secret or as outside (O), from its
shape, from words and separators beside it and from features of the whole file,
and the best tagging is found by Viterbi.  Its weights are fitted on the driver
to lines that a seeded generator writes: a thousand, whatever the corpus.

Decoding is exact but seldom needs the whole chain.  Where a token's score for O
exceeds its others by more than all that two transitions could make up, every
best tagging has O there, so the chain falls into short independent segments
between such tokens; these are decoded together, one step at a time.

Defined cases: null and empty texts have no secrets; repeated rows are scanned
each; a column of the documents with the name of a result column gives way to
it; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm import textkit as tk
from lattica.llm.shared import map_batches

# fixed values: the base patterns, by kind in the order in which ties are listed
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

#: Words beside a token that speak for a secret.
HINTS = ("password", "passwd", "pwd", "pass", "passphrase", "secret", "token", "key", "apikey", "api", "auth", "authorization", "bearer", "credential", "credentials", "private", "access", "client", "signature", "sas")
#: Lines that the generator writes for the fit.
TRAINING_LINES = 1000
TAGS = 3  # O, B, I

_BITS = np.zeros(256, np.uint8)  # what a token's bytes are: a-f, g-z, A-F, G-Z, digit, non-ASCII
_BITS[0x61:0x67], _BITS[0x67:0x7B], _BITS[0x41:0x47], _BITS[0x47:0x5B], _BITS[0x30:0x3A], _BITS[0x80:] = 1, 2, 4, 8, 16, 32
_SEPARATOR = np.full(256, 5, np.uint8)  # text end, blank, quote, assignment, joiner, other
_SEPARATOR[0], _SEPARATOR[[0x09, 0x0A, 0x0D, 0x20]], _SEPARATOR[[0x22, 0x27, 0x60]], _SEPARATOR[[0x3A, 0x3D]], _SEPARATOR[[0x2B, 0x2F, 0x5F, 0x2E, 0x2D]] = 0, 1, 2, 3, 4
_JOINER = 4
_HEX = np.zeros(256, bool)
_HEX[0x30:0x3A] = _HEX[0x61:0x67] = True
_LENGTHS = np.array([4, 8, 16, 24, 40])
_SWITCHES = np.array([1, 2, 4, 8])
#: Sizes of the feature families, in the order of ``features``.
FAMILIES = (64 * 6, 6 * 5, 6, 6, 2 * 6, 2, 2, 3 * 3)
_OFFSETS = np.cumsum((0, *FAMILIES))[:-1]

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


@functools.cache
def _hints() -> np.ndarray:
    raw = np.frombuffer(b" ".join(h.encode() for h in HINTS) + b" " * 8, np.uint8)
    ends = np.cumsum([len(h) + 1 for h in HINTS]) - 1
    return np.sort(tk.hash_spans(raw, ends - [len(h) for h in HINTS], ends))


class Tokens:
    """Tokens of some texts with the number of each one's feature in every family."""

    def __init__(self, texts: tk.Texts) -> None:
        data, bounds = texts.data, texts.bounds
        bits = _BITS[data]
        edge = tk.runs(bits > 0, bounds)
        keep = bits[edge[:-1]] > 0
        a, b = edge[:-1][keep], edge[1:][keep]
        self.starts, self.ends, self.first = a, b, np.searchsorted(a, bounds)
        if not len(a):
            self.features = [np.zeros(0, np.int32)] * len(FAMILIES)
            return
        doc_of = np.repeat(np.arange(len(texts)), np.diff(self.first))
        size = np.searchsorted(_LENGTHS, b - a, side="right")
        mask = np.bitwise_or.reduceat(bits[:-8], a)  # separators up to the next token are 0
        digit = bits == 16
        change = np.concatenate([[0], np.cumsum(digit[1:-8] != digit[:-9])])
        switches = np.searchsorted(_SWITCHES, change[b - 1] - change[a], side="right")
        start_of, end_of = bounds[doc_of], bounds[doc_of + 1]
        before = np.where(a > start_of, _SEPARATOR[data[np.maximum(a - 1, 0)]], 0)
        after = np.where(b < end_of, _SEPARATOR[data[b]], 0)
        known, h = _hints(), tk.hash_spans(tk.LOWER[data], a, b)
        hint = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
        one_back, two_back, ahead = np.zeros(len(a), bool), np.zeros(len(a), bool), np.zeros(len(a), bool)
        one_back[1:] = hint[:-1] & (doc_of[1:] == doc_of[:-1])
        two_back[2:] = hint[:-2] & (doc_of[2:] == doc_of[:-2])
        ahead[:-1] = hint[1:] & (doc_of[1:] == doc_of[:-1])
        gap_assign = np.zeros(len(a), bool)  # "=" or ":" within the three bytes before the token
        for k in (1, 2, 3):
            gap_assign |= (a - k >= start_of) & (_SEPARATOR[data[np.maximum(a - k, 0)]] == 3)
        total = np.maximum(np.diff(self.first), 1)
        share = lambda x: np.searchsorted([0.02, 0.2], np.bincount(doc_of, x, len(texts)) / total, side="right")
        file = 3 * share(gap_assign) + share(mask >= 16)
        self.features = [mask.astype(np.int32) * 6 + size, size * 5 + switches, before, after, one_back * 6 + np.where(gap_assign, 3, before), two_back.astype(np.int32), ahead.astype(np.int32), file[doc_of]]


def emissions(tokens: Tokens, weights: np.ndarray) -> np.ndarray:
    """Scores of B and I over O for each token."""
    e = np.zeros((len(tokens.starts), 2), np.float32)
    for offset, f in zip(_OFFSETS, tokens.features):
        e += weights[offset + f]
    return e


def viterbi(tokens: Tokens, weights: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The best tags of every text's chain."""
    tags = np.zeros(len(tokens.starts), np.int8)
    if not len(tags):
        return tags
    e = emissions(tokens, weights)
    gain = max(0.0, float((transitions[:, 1:] - transitions[:, :1]).max())) + max(0.0, float((transitions[1:] - transitions[:1]).max()))
    unsure = e.max(1) + gain >= 0
    starts_doc = np.zeros(len(tags) + 1, bool)
    starts_doc[tokens.first[:-1]] = starts_doc[-1] = True
    todo = np.flatnonzero(unsure)
    if not len(todo):
        return tags
    new = np.ones(len(todo), bool)
    new[1:] = (todo[1:] != todo[:-1] + 1) | starts_doc[todo[1:]]
    begin = todo[new]
    length = np.diff(np.append(np.flatnonzero(new), len(todo)))
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    full = np.concatenate([np.zeros((len(e), 1), np.float32), e], 1)
    # before a segment stands an O, or the start of the text, and after it likewise
    score = full[begin] + np.where(starts_doc[begin][:, None], 0, transitions[0][None])
    back, steps = [], int(length[0])
    for t in range(1, steps):
        k = int(np.searchsorted(-length, -t, side="left"))
        paths = score[:k, :, None] + transitions[None]
        back.append(paths.argmax(1).astype(np.int8))
        score[:k] = paths.max(1) + full[begin[:k] + t]
    closing = np.where(starts_doc[begin + length][:, None], 0, transitions[:, 0][None])
    tag = (score + closing).argmax(1).astype(np.int8)
    for t in range(steps - 1, -1, -1):
        k = int(np.searchsorted(-length, -t, side="left"))
        tags[begin[:k] + t] = tag[:k]
        if t:
            tag[:k] = back[t - 1][np.arange(k), tag[:k]]
    return tags


# --- the generator and the fit


def _lines(n: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """Short files with the character spans of their secrets, written by rule from a seed."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    run = lambda chars, lo, hi: "".join(pick(chars) for _ in range(rng.integers(lo, hi)))
    word = lambda: (lambda w: w.capitalize() if rng.random() < 0.15 else w.upper() if rng.random() < 0.08 else w)(run(lower if rng.random() < 0.9 else lower + "éüñöß", 1, 14))

    def secret() -> str:
        kind = rng.integers(5)
        if kind == 0:
            return run("0123456789abcdef", 16, 48)
        if kind == 1:
            return pick(["AKIA", "ASIA", "ghp_", "sk-", "xoxb-"]) + run(upper + digits, 16, 24)
        if kind == 2:
            return run(lower + upper + digits, 12, 44)
        if kind == 3:
            return "/".join(run(lower + upper + digits, 6, 16) for _ in range(rng.integers(2, 4))) + "=="
        return run(lower + digits, 3, 8) + run(digits + upper, 3, 8) + run(lower, 1, 6)

    def harmless() -> str:
        kind = rng.integers(9)
        return [
            lambda: f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}",
            lambda: ".".join(str(rng.integers(256)) for _ in range(4)),
            lambda: f"+{rng.integers(1, 99)} ({rng.integers(100, 999)}) {rng.integers(100, 999)}-{rng.integers(1000, 9999)}",
            lambda: run(digits, 1, 18),
            lambda: f"{run(lower, 3, 10)}.{rng.integers(100)}@{run(lower, 3, 8)}{rng.integers(10)}.example.com",
            lambda: f"v{rng.integers(9)}.{rng.integers(20)}.{rng.integers(9)}",
            lambda: f"https://{run(lower, 3, 10)}.example.org/{run(lower, 2, 9)}/{rng.integers(1000)}?page={rng.integers(9)}",
            lambda: f"{run(lower, 2, 9)}_{run(lower, 2, 9)}{rng.integers(10)} = {run(lower, 3, 9)}({rng.integers(100)})",
            lambda: f"{pick(['key', 'token', 'password', 'Secret'])} {pick(['of', 'is', 'was'])} {run(lower, 3, 12)}",
        ][kind]()

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.integers(3, 12)):
            draw = rng.random()
            if draw < 0.12:
                lead = rng.random()
                if lead < 0.55:
                    quote = pick(['"', "'", ""])
                    name = pick(HINTS) if rng.random() < 0.8 else f"{run(lower, 2, 6)}_{pick(HINTS)}"
                    text += (name.upper() if rng.random() < 0.3 else name) + pick(["=", " = ", ": ", ":"]) + quote
                elif lead < 0.75:
                    quote, text = "", text + pick(["Bearer ", "token ", "key ", "password "])
                else:
                    quote = ""
                s = secret()
                spans.append((len(text), len(text) + len(s)))
                text += s + quote
            else:
                text += harmless() if draw < 0.3 else " ".join(word() for _ in range(rng.integers(1, 8)))
            text += pick([" ", " ", ", ", ". ", "\n", "!! ", "%%% ", " | "])
        out.append((text, spans))
    return out


@functools.cache
def model(n_lines: int = TRAINING_LINES, rounds: int = 80, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights of (feature, B or I over O) and transitions (from, to), by gradient ascent on the likelihood."""
    lines = _lines(n_lines)
    raw = [t.encode() for t, _ in lines]
    (texts,) = tk.rounds(pa.array(raw, pa.binary()), most=1 << 40)
    tok = Tokens(texts)
    gold = np.zeros(len(tok.starts), np.int8)
    for i, (text, spans) in enumerate(lines):
        at = slice(tok.first[i], tok.first[i + 1])
        s, t = tok.starts[at] - texts.bounds[i], tok.ends[at] - texts.bounds[i]
        for a, b in spans:
            lo, hi = len(text[:a].encode()), len(text[:b].encode())
            inside = np.flatnonzero((s >= lo) & (t <= hi))
            gold[at.start + inside] = 2
            if len(inside):
                gold[at.start + inside[0]] = 1
    cells = np.stack([o + f for o, f in zip(_OFFSETS, tok.features)], 1)
    n, steps = np.diff(tok.first), int(np.diff(tok.first).max())
    place = tok.first[:-1, None] + np.arange(steps)[None]
    live = np.arange(steps)[None] < n[:, None]
    place = np.where(live, place, 0)
    weights, trans = np.zeros((sum(FAMILIES), 2)), np.zeros((3, 3))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(trans), np.zeros_like(trans)]
    truth = np.zeros((len(gold), 3))
    truth[np.arange(len(gold)), gold] = 1
    pair_truth = np.zeros((3, 3))
    follows = np.ones(len(gold), bool)
    follows[tok.first[:-1]] = False
    np.add.at(pair_truth, (gold[:-1][follows[1:]], gold[1:][follows[1:]]), 1)
    for step in range(1, rounds + 1):
        e = np.concatenate([np.zeros((len(gold), 1)), weights[cells].sum(1)], 1)[place]
        grow, ahead = np.zeros((len(n), steps, 3)), np.zeros((len(n), steps, 3))
        peak = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        grow[:, 0] = e[:, 0]
        for t in range(1, steps):
            grow[:, t] = np.where(live[:, t, None], peak(grow[:, t - 1, :, None] + trans[None], 1) + e[:, t], grow[:, t - 1])
        for t in range(steps - 2, -1, -1):
            ahead[:, t] = np.where(live[:, t + 1, None], peak(trans[None] + (e[:, t + 1] + ahead[:, t + 1])[:, None, :], 2), 0)
        whole = peak(grow[:, -1], 1)
        one = np.exp(grow + ahead - whole[:, None, None])
        both = np.zeros((3, 3))
        for t in range(1, steps):
            p = np.exp(grow[:, t - 1, :, None] + trans[None] + (e[:, t] + ahead[:, t])[:, None, :] - whole[:, None, None])
            both += (p * live[:, t, None, None]).sum(0)
        post = one[live]  # rows in token order
        grad = np.zeros_like(weights)
        for k in range(cells.shape[1]):
            for j in (0, 1):
                grad[:, j] += np.bincount(cells[:, k], truth[:, j + 1] - post[:, j + 1], len(grad))
        for x, g, m, v in ((weights, grad / len(n) - l2 / 50 * weights, moments[0], moments[1]), (trans, (pair_truth - both) / len(n) - l2 / 50 * trans, moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return weights.astype(np.float32), trans.astype(np.float32)


# --- the operator


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns in code points, by start and then kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _suspects(texts: tk.Texts) -> np.ndarray:
    """Numbers of the texts that may hold a base span."""
    raw = texts.data.tobytes()
    low, at = raw.lower(), []
    for name, where in [*((n, low) for n in NAMES), (b"AKIA", raw)]:
        i = where.find(name)
        while i >= 0:
            at.append(i)
            i = where.find(name, i + 1)
    inside = _HEX[texts.data]
    edge = tk.runs(inside, texts.bounds)
    long = (np.diff(edge) >= LEAST_HEX) & inside[edge[:-1]]
    return np.unique(np.searchsorted(texts.bounds, np.concatenate([np.array(at, np.int64), edge[:-1][long]]), side="right") - 1)


def find(texts: tk.Texts, weights: np.ndarray, transitions: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
    """All spans by text number, in code points; those of the field only where no base span lies."""
    out = {int(i): spans for i in _suspects(texts) if i < len(texts) and (spans := base_spans(texts.text(i).decode()))}
    tok = Tokens(texts)
    tags = viterbi(tok, weights, transitions)
    hit = np.flatnonzero(tags)
    if len(hit):
        # a secret begins at B, or at I after O, and goes on through I's that only joiners part from it
        new = np.ones(len(hit), bool)
        new[1:] = (tags[hit[1:]] == 1) | (hit[1:] != hit[:-1] + 1) | np.isin(hit[1:], tok.first)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(hit)) - 1
        begin, end = tok.starts[hit[first]], tok.ends[hit[last]]
        doc = np.searchsorted(texts.bounds, begin, side="right") - 1
        for d in np.unique(doc).tolist():
            lead = np.concatenate([[0], np.cumsum((texts.data[texts.bounds[d] : texts.bounds[d + 1]] & 0xC0) != 0x80)])
            known = out.get(d, [])
            # how many base spans begin before a point, and how many end by it: all, unless one lies across
            opens, closes = np.sort([s for _, s, _ in known]), np.sort([e for _, _, e in known])
            a, b = lead[begin[doc == d] - texts.bounds[d]], lead[end[doc == d] - texts.bounds[d]]
            free = np.searchsorted(opens, b, side="left") == np.searchsorted(closes, a, side="right")
            known = known + [("crf", int(x), int(y)) for x, y in zip(a[free], b[free])]
            if known:
                out[d] = sorted(known, key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def _scanned(docs: DataFrame, finish: Callable[[pa.RecordBatch, list[list[tuple]]], pa.RecordBatch], schema: T.StructType, text_col: str) -> DataFrame:
    """Rows that ``finish`` makes of a batch and the spans (kind, start, end) of its texts."""
    known = docs.sparkSession.sparkContext.broadcast(model())

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            spans: list[list[tuple]] = [[] for _ in range(rb.num_rows)]
            for part in tk.rounds(rb.column(text_col)):
                for i, found in find(part, *known.value).items():
                    spans[part.rows.start + i] = found
            yield finish(rb, spans)

    return map_batches(docs, scanned, schema)


def scan(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: the kind, start and end (code points, end exclusive) of each secret."""
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "secrets"])
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def finish(rb: pa.RecordBatch, spans: list[list[tuple]]) -> pa.RecordBatch:
        found = pa.array([[dict(zip(SPAN.names, s)) for s in own] for own in spans], span)
        return pa.RecordBatch.from_pydict({c: rb.column(c) for c in rb.schema.names} | {"secrets": found})

    return _scanned(kept, finish, T.StructType([*kept.schema.fields, T.StructField("secrets", T.ArrayType(SPAN))]), text_col)


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base spans by kind, their digest, and all spans spelt ``kind:start:end``."""
    found = scan(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))).select("id", "secrets")
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    spelt = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    return found.select(F.col("id").alias(id_col), of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(spelt(base), 256).alias("base_sha256"), spelt(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """All documents, every secret in their texts replaced by ``mark``; overlapping ones by a single mark."""

    def finish(rb: pa.RecordBatch, spans: list[list[tuple]]) -> pa.RecordBatch:
        if not any(spans):
            return rb
        texts = [_hide(t, own, mark) if own else t for t, own in zip(rb.column(text_col).to_pylist(), spans)]
        return pa.RecordBatch.from_pydict({c: pa.array(texts, rb.column(c).type) if c == text_col else rb.column(c) for c in rb.schema.names})

    return _scanned(docs, finish, docs.schema, text_col)


def _hide(text: str, spans: list[tuple], mark: str) -> str:
    out, at = [], 0
    for _, start, end in spans:
        if end > at:
            if start >= at:
                out += [text[at:start], mark]
            at = end
    return "".join([*out, text[at:]])
