"""The pipeline on planted documents: what each stage must drop, keep and change, worked out by plain Python."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lattica.llm import tokenizing  # noqa: E402


def test_planted_documents(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words, n))
    good = {i: prose(60) + (" x1 = 57; y" if i % 2 else "") for i in range(40)}
    junk = {100 + i: prose(40).replace(" ", "$$$ ") for i in range(30)}
    item = prose(14)
    good[50], good[51] = good[3], good[4] + " more"  # a copy and a near copy
    good[60] = prose(20) + " " + item + " " + prose(20)  # a benchmark passage
    good[61] = prose(30) + " password=abc123def456 " + prose(10)  # a secret
    rows = [(i, t, "en", "src", len(t)) for i, t in (good | junk).items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, int(i < 100), 0) for i in [*range(30), *range(100, 125)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = (set(good) | set()) - {50, 51, 60}
    assert {p.doc_id for p in pieces} == left
    tok = tokenizing.load(tokenizing.tokenizer_path(tokenizing.BYTE_BPE))
    clean = {**good, 61: good[61].replace("password=abc123def456", "[secret]")}
    want = {i: len(tok.encode(clean[i], add_special_tokens=False).ids) + 1 for i in left}
    assert {p.doc_id: p.doc_tokens for p in pieces} == want and sum(p.length for p in pieces) == sum(want.values())
