"""Quality of documents by hierarchical empirical Bayes.

A classifier, fitted to a bounded sample of labelled rows, turns each document
into evidence: the log likelihood ratio of being good, and of being toxic.
Sites then say how far to trust it.  Grouped sums over all documents give each
host's and each path's rate; a host's is shrunk toward the global rate and a
path's toward its host's, the more so the fewer documents there are, with
strengths estimated from how much the groups really differ (method of moments).
A document's posterior is its own evidence on top of its path's rate, which is
taken without the document itself.

Each text is scored once and never shuffled: documents and their evidence are
written to the shared folder (without texts, if the result has none), summed by
group, and read again for the decisions, when the groups' table is joined (Spark
broadcasts it where it is small, and splits skewed keys where it isn't).

Defined cases: a null host or path is a group of its own, named ""; texts
without words, null ones included, are no good (posterior 0) and not toxic, and
don't count for their groups; labels that are null or belong to no document are
not used, and without labels of both kinds a target's evidence is 0; repeated
rows are judged each; a column of the documents with the name of a result column
gives way to it in ``posteriors`` and stays in ``keep_good``; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm import textkit as tk
from lattica.llm.shared import local_table, map_batches, written

#: Labelled rows that the classifier is fitted to, and bytes of their texts, at most.
FIT_ROWS, FIT_BYTES = 6000, 24 << 20
#: A word is a feature if so many documents of the sample have it.
LEAST_DOCUMENTS = 6
#: A word speaks for a target only if its rates among the target's two kinds differ by so many standard errors.
LEAST_Z = 4.5
#: Bars of each measure.
BARS = 12
TARGETS = ("quality", "toxic")
#: Evidence is kept within these natural logs of odds: a classifier is never surer than its sample.
MOST_EVIDENCE = 7.0
#: Least and greatest strength of shrinking, in documents.
STRENGTHS = (5.0, 1000.0)

_UPPER, _LETTER, _DIGIT, _SYMBOL, _BLANK = (np.zeros(256, np.int64) for _ in range(5))
_UPPER[0x41:0x5B] = 1
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = 1
_DIGIT[0x30:0x3A] = 1
_SYMBOL[[ord(c) for c in "#$%&*!|@^~<>=_{}[]\\+"]] = 1
_BLANK[[0x09, 0x0A, 0x0D, 0x20]] = 1
#: How many measures a text has.
MEASURES = 9
#: Besides whole words, their first so many bytes are features, as inflected and compound words share these.
PREFIXES = (4, 6)


def measures(texts: tk.Texts) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each text's measures, and the distinct hashes of its words and their prefixes."""
    w = tk.words(texts, tk.ALNUM_WORDS)
    size = np.diff(texts.bounds).astype(float)
    data = texts.data[:-8]
    share = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag[data])])[texts.bounds]) / np.maximum(size, 1)
    n = np.diff(w.first).astype(float)
    low = tk.LOWER[texts.data]
    heads = [tk.mix(tk.hash_spans(low, w.starts, np.minimum(w.ends, w.starts + k)) + np.uint64(k)) for k in PREFIXES]
    distinct, most, sets = np.zeros(len(texts)), np.zeros(len(texts)), []
    for i in range(len(texts)):
        s, times = np.unique(w.hashes[w.first[i] : w.first[i + 1]], return_counts=True)
        sets.append(np.concatenate([s, *(np.unique(p[w.first[i] : w.first[i + 1]]) for p in heads)]) if len(s) else s)
        if len(s):
            distinct[i], most[i] = len(s), times.max()
    length = np.concatenate([[0], np.cumsum(w.ends - w.starts)])
    mean = (length[w.first[1:]] - length[w.first[:-1]]) / np.maximum(n, 1)
    heaps = np.log1p(distinct) / np.maximum(np.log1p(n), 1e-9)
    return np.stack([np.log1p(n), share(_UPPER), share(_LETTER), share(_DIGIT), share(_SYMBOL), share(_BLANK), mean, heaps, most / np.maximum(n, 1)], 1), sets


@dataclass
class Classifier:
    """Additive log odds: a table for each measure's bars and one for words, by target; evidence is without the prior."""

    edges: np.ndarray
    bars: np.ndarray
    words: np.ndarray
    weights: np.ndarray
    base: np.ndarray

    def evidence(self, texts: tk.Texts) -> np.ndarray:
        """(texts, targets); NaN for texts without words."""
        m, sets = measures(texts)
        out = np.tile(self.base, (len(texts), 1))
        for k in range(MEASURES):
            out += self.bars[k, np.searchsorted(self.edges[k], m[:, k], side="right")]
        for i, s in enumerate(sets):
            if not len(s):
                out[i] = np.nan
            elif len(self.words):
                at = np.minimum(np.searchsorted(self.words, s), len(self.words) - 1)
                out[i] += self.weights[at[self.words[at] == s]].sum(0)
        return np.clip(out, -MOST_EVIDENCE, MOST_EVIDENCE)


def fit(texts: list[str | None], labels: np.ndarray, rounds: int = 300, l2: float = 0.3) -> Classifier:
    """Logistic regression of each target (columns of 0 and 1) on the bars of measures and on words."""
    n = len(texts)
    none = Classifier(np.zeros((MEASURES, BARS - 1)), np.zeros((MEASURES, BARS, len(TARGETS))), np.zeros(0, np.uint64), np.zeros((0, len(TARGETS))), np.zeros(len(TARGETS)))
    if not n:
        return none
    found, sets = [], []
    for part in tk.rounds(pa.array(texts, pa.string())):
        m, s = measures(part)
        found.append(m)
        sets += s
    m = np.concatenate(found)
    edges = np.quantile(m, np.arange(1, BARS) / BARS, axis=0).T.copy()
    words, times = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
    words = words[times >= LEAST_DOCUMENTS]
    rows, cols = [], []
    for k in range(MEASURES):
        rows.append(np.arange(n, dtype=np.int32))
        cols.append((k * BARS + np.searchsorted(edges[k], m[:, k], side="right")).astype(np.int32))
    for i, s in enumerate(sets if len(words) else ()):
        at = np.minimum(np.searchsorted(words, s), len(words) - 1)
        at = at[words[at] == s]
        rows.append(np.full(len(at), i, np.int32))
        cols.append((MEASURES * BARS + at).astype(np.int32))
    sets.clear()
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    width = MEASURES * BARS + len(words)
    weights, base = np.zeros((width, len(TARGETS))), np.zeros(len(TARGETS))
    used = np.zeros(width, bool)
    for j in range(len(TARGETS)):
        y = labels[:, j].astype(float)
        if y.min() == y.max():
            continue
        prior = np.log(y.mean() / (1 - y.mean()))
        with_word, p = np.bincount(cols, y[rows], width), np.bincount(cols, minlength=width) / n
        rate = with_word / y.sum() - (p * n - with_word) / (n - y.sum())
        use = np.abs(rate) >= LEAST_Z * np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / y.sum() + 1 / (n - y.sum())))
        use[: MEASURES * BARS] = True
        r, c = rows[use[cols]], cols[use[cols]]
        w, b, first, second, bias = np.zeros(width), 0.0, np.zeros(width), np.zeros(width), 0.0
        for step in range(1, rounds + 1):
            p = 1 / (1 + np.exp(-(prior + b + np.bincount(r, w[c], n))))
            g = np.bincount(c, (y - p)[r], width) - l2 * w
            bias = 0.9 * bias + 0.1 * (y - p).mean()
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            w += 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            b += bias
        weights[:, j], base[j] = w, b
        used |= use
    return Classifier(edges, weights[: MEASURES * BARS].reshape(MEASURES, BARS, -1), words[used[MEASURES * BARS :]], weights[MEASURES * BARS :][used[MEASURES * BARS :]], base)


def fitted(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Classifier:
    """The classifier of a sample of labelled documents, taken in order of the ids' hashes, whole texts each, as long as
    they are at most ``fit_rows`` rows and ``fit_bytes`` bytes."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), *[F.col(t) for t in TARGETS]).dropna().dropDuplicates(["id"])
    chosen = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(fit_rows))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sizes = rows.join(chosen, "id").select("id", F.xxhash64("text").alias("mark"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), *TARGETS).distinct()
    total, taken = 0, {}
    for r in sizes.orderBy(F.xxhash64("id"), "id", "mark").limit(fit_rows).collect():
        total += r["size"]
        if total <= fit_bytes:
            taken[r["id"], r["mark"]] = [r[t] for t in TARGETS]
    if not taken:
        return fit([], np.zeros((0, len(TARGETS))))
    keys = local_table(docs.sparkSession, list(taken), T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("mark", T.LongType())]))
    texts = {(r["id"], r["mark"]): r["text"] for r in rows.withColumn("mark", F.xxhash64("text")).join(F.broadcast(keys), ["id", "mark"]).dropDuplicates(["id", "mark"]).collect()}
    order = sorted(texts)
    return fit([texts[k] for k in order], np.array([taken[k] for k in order]))


def scored(docs: DataFrame, classifier: Classifier, *, text_col: str, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``e_quality`` and ``e_toxic``, null for texts without words; without the text unless ``keep_text``."""
    known = docs.sparkSession.sparkContext.broadcast(classifier)
    names = [f"e_{t}" for t in TARGETS]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            e = np.zeros((rb.num_rows, len(TARGETS)))
            for part in tk.rounds(rb.column(text_col)):
                e[part.rows] = known.value.evidence(part)
            yield pa.RecordBatch.from_pydict({c: rb.column(c) for c in rb.schema.names if keep_text or c != text_col} | {name: pa.array(e[:, j], mask=np.isnan(e[:, j])) for j, name in enumerate(names)})

    return map_batches(docs, measured, T.StructType([*(f for f in docs.schema.fields if keep_text or f.name != text_col), *(T.StructField(name, T.DoubleType()) for name in names)]))


def _rate(e: Column, odds: Column) -> Column:
    """Probability by log evidence on top of log odds."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(e + odds)))


def _strength(groups: DataFrame, n: str, total: str, mean: Column) -> Column:
    """Beta prior strength (in documents) from the spread of groups' rates round ``mean`` beyond what chance makes."""
    rate = F.col(total) / F.col(n)
    spread, chance = F.sum(F.col(n) * (rate - mean) ** 2), F.sum(mean * (1 - mean))
    between = (spread - chance) / F.greatest(F.sum(n), F.lit(1))
    guess = F.avg(mean * (1 - mean)) / F.greatest(between, F.lit(1e-9)) - 1
    return F.least(F.greatest(F.coalesce(guess, F.lit(STRENGTHS[1])), F.lit(STRENGTHS[0])), F.lit(STRENGTHS[1]))


def site_rates(evidence: DataFrame, base: dict[str, float]) -> DataFrame:
    """Per host and path: documents, summed rates and shrunk host rates, all that a document's posterior needs.

    ``evidence`` has host, path, e_quality and e_toxic.  Paths are summed first
    and hosts from paths, so a hot host is a handful of partial sums.
    """
    soft = [_rate(F.col(f"e_{t}"), F.lit(base[t])).alias(f"p_{t}") for t in TARGETS]
    rows = evidence.filter(F.col("e_quality").isNotNull()).select("host", "path", *soft)
    paths = written(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"p_{t}").alias(f"s_{t}") for t in TARGETS]), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(f"s_{t}").alias(f"host_{t}") for t in TARGETS])
    total = hosts.agg(F.sum("host_n").alias("n"), *[F.sum(f"host_{t}").alias(t) for t in TARGETS]).first()
    means = {t: (total[t] or 0.5) / total["n"] if total["n"] else 0.5 for t in TARGETS}
    strong = hosts.agg(*[_strength(hosts, "host_n", f"host_{t}", F.lit(means[t])).alias(t) for t in TARGETS]).first()
    shrunk = hosts.select("host", *[((F.col(f"host_{t}") + strong[t] * means[t]) / (F.col("host_n") + strong[t])).alias(f"rate_{t}") for t in TARGETS])
    both = paths.join(shrunk, "host")
    inner = both.agg(*[_strength(both, "n", f"s_{t}", F.col(f"rate_{t}")).alias(t) for t in TARGETS]).first()
    return written(both.select("host", "path", "n", *[F.col(f"s_{t}") for t in TARGETS], *[F.col(f"rate_{t}") for t in TARGETS], *[F.lit(float(inner[t])).alias(f"strength_{t}") for t in TARGETS]), "site-rates")


RESULTS = ("p_quality", "p_toxic", "keep")


def posteriors(docs: DataFrame, labels: DataFrame, *, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (only ``columns`` of it, if given) with posteriors ``p_quality`` and ``p_toxic`` and whether to ``keep``:
    likelier good than not, and not likelier toxic."""
    model = fitted(docs, labels, id_col=id_col, text_col=text_col, fit_rows=fit_rows)
    known = labels.select(*TARGETS).dropna().agg(*[F.avg(t).alias(t) for t in TARGETS]).first()
    base = {t: float(np.log(r / (1 - r))) if (r := min(max(known[t] if known[t] is not None else 0.5, 0.01), 0.99)) else 0.0 for t in TARGETS}
    site = [F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path")]
    own = [c for c in docs.columns if c not in RESULTS and (columns is None or c in columns)]
    rest = F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in own if c != text_col]).alias("own")
    packed = docs.select(rest, *site, F.col(f"`{text_col}`").alias("text"))
    evidence = written(scored(packed, model, text_col="text", keep_text=text_col in own), "evidence")
    judged = evidence.join(site_rates(evidence, base), ["host", "path"], "left")
    out = {}
    for t in TARGETS:
        e = F.col(f"e_{t}")
        mine = _rate(e, F.lit(base[t]))
        rate = (F.col(f"s_{t}") - mine + F.col(f"strength_{t}") * F.col(f"rate_{t}")) / (F.col("n") - 1 + F.col(f"strength_{t}"))
        rate = F.least(F.greatest(rate, F.lit(1e-3)), F.lit(1 - 1e-3))
        out[f"p_{t}"] = F.coalesce(_rate(e, F.log(rate / (1 - rate))), F.lit(0.0))
    kept = [F.col("text").alias(c) if c == text_col else F.col("own")[c].alias(c) for c in own]
    judged = judged.withColumns(out)
    return judged.select(*kept, "p_quality", "p_toxic", ((F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, *, host: Column, path: Column, **options) -> DataFrame:
    """The documents that ``posteriors`` keeps, with their own columns."""
    given = {c: f"__own_{c}" for c in docs.columns if c in RESULTS}
    sited = docs.withColumns({"__host": host, "__path": path}).withColumnsRenamed(given)
    found = posteriors(sited, labels, host=F.col("__host"), path=F.col("__path"), **options).filter("keep")
    return found.drop("__host", "__path", *RESULTS).withColumnsRenamed({v: k for k, v in given.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])
