"""Cases that the docstrings define: nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import numpy as np
import pytest

pytest.importorskip("lattica.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from lattica.llm import components, decontaminate, licenses, packing, quality, secrets, shared, tokencount, tokenizing, topk, warc  # noqa: E402

LONG = "".join(f"word{i % 997} " for i in range(60_000))  # half a megabyte
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def docs(spark, rows):
    """Documents whose other columns have the names of results and of inner columns."""
    clash = {c: F.lit("own") for c in ("n_words", "hits", "own", "n_hit", "n_bytes", "digest", "n_tokens", "crcs", "last", "licenses", "id", "low", "secrets", "e_quality", "host", "path", "p_quality", "keep", "evidence", "rank", "bucket")}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash)


def test_top_k_ties_repeats_and_empty(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (7, [2.0, 5.0]), (3, [2.0, -1.0]), (3, [2.0, -1.0]), (9, [1.5, 0.0]), (200, None), (None, [9.0, 9.0]), (11, []), (12, [9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "rank": F.lit(0), "query_id": F.lit(1)})
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score").orderBy("query_id", "rank").collect()]
    assert got == [(100, 1, 3, 2048 * 1024), (100, 2, 7, 2048 * 1024), (100, 3, 9, 1536 * 1024)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).isEmpty()
    assert topk.top_k(df.filter("vec_id = 100"), F.col("vec_id") % 100 == 0).isEmpty()


def test_decontamination_cases(spark):
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "short one"), (2, "Short ONE!"), (None, "clean words"), (4, None), (5, "..."), (6, ITEM + " lambda")], "item_id long, text string")
    rows = [(1, f"x {ITEM} y"), (1, f"x {ITEM} y"), (2, "a short one here, a short one"), (3, "clean words"), (4, None), (5, ""), (6, LONG + ITEM.upper() + " lambda"), (None, "short one")]
    digest = lambda *items: hashlib.sha256(",".join(items).encode()).hexdigest()
    want = sorted([(1, 12, 10, 2, digest("1", "6"), True)] * 2 + [(2, 7, 4, 1, digest("2"), True), (3, 2, 0, 0, digest(), False), (4, 0, 0, 0, digest(), False), (5, 0, 0, 0, digest(), False), (6, 60_011, 11, 2, digest("1", "6"), True), (0, 2, 2, 1, digest("2"), True)])
    for size in (decontaminate.SLICE_BYTES, 60):  # 60: several slices
        got = decontaminate.report(docs(spark, rows), bench, slice_bytes=size).collect()
        assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    kept = decontaminate.remove_documents(docs(spark, rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5] and kept.columns == docs(spark, rows).columns and kept.first().hits == "own"
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs(spark, rows), bench, slice_bytes=60).collect()}
    assert cut[1] == "x  y" and cut[2] == "a  here, a " and cut[4] is None and cut[6] == LONG
    assert decontaminate.report(docs(spark, []), bench).isEmpty()
    assert decontaminate.report(docs(spark, rows), bench.limit(0)).filter("contaminated").isEmpty()
    assert decontaminate.scan(docs(spark, rows), bench).filter("hits is null").count() == 3


def test_slices_are_scanned_one_by_one(spark):
    bench = spark.createDataFrame([(i, f"{ITEM} item{i}") for i in range(12)], "item_id long, text string")
    rows = spark.createDataFrame([(i, f"{ITEM} item{i} tail") for i in range(12)], "doc_id long, text string")
    assert sum(1 for _ in decontaminate._slices(bench, "item_id", "text", 300)) >= 3
    sliced = decontaminate.report(rows, bench, slice_bytes=300)
    plan = sliced._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # the scans before it are tables by now
    assert sorted(map(tuple, sliced.collect())) == sorted(map(tuple, decontaminate.report(rows, bench).collect()))


def test_long_texts(spark):
    rows = [(1, LONG), (2, LONG + " released under the MIT license."), (3, None)]
    tok = tokenizing.load(tokenizing.tokenizer_path(tokenizing.WORD_BPE))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(docs(spark, rows)).collect()}
    assert got == {i: (len(t or ""), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows}
    ids = len(tokenizing.load(tokenizing.tokenizer_path(tokenizing.BYTE_BPE)).encode(LONG, add_special_tokens=False).ids) + 1
    pieces = packing.pack(docs(spark, rows)).filter("doc_id = 1").orderBy("start").collect()
    assert sum(p.length for p in pieces) == ids and [p.start for p in pieces] == list(range(0, ids, 1024))
    assert {r.doc_id: r.licenses for r in licenses.report(docs(spark, rows)).collect()} == {1: "", 2: "MIT", 3: ""}
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    judged = {r.doc_id: r.keep for r in quality.posteriors(docs(spark, rows).drop("host", "path"), labels, host=F.lit(None), path=F.lit("p")).collect()}
    assert set(judged) == {1, 2, 3} and judged[3] is False
    assert secrets.report(docs(spark, [(1, LONG + "token=abcdefgh")])).first().n_assign == 1


def test_archive_cases(spark):
    page = "<p>" + "é" * 80
    rows = [(5, "a", page), (5, "b", page), (None, "c", page), (2, None, page), (8, "d", None), (8, "e", ""), (9, "f", "x" * 100), (10, "g", "x" * 99), (11, "h", "x" * 99)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("digest", "payload", "record_type", "refers_to", "path", "n_records")})
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.round_trip(df).collect())
    # the smallest id's record is the response; rows without an id are responses each
    assert got == sorted([(2, 163, "response", 0), (5, 163, "revisit", 2), (5, 163, "revisit", 2), (0, 163, "response", 0), (8, 0, "response", 0), (8, 0, "response", 0), (9, 100, "response", 0), (10, 99, "response", 0), (11, 99, "response", 0)])
    assert warc.round_trip(df.limit(0)).isEmpty()


def test_components_cases(spark):
    rows = [(1, 2), (2, 1), (3, 3), (None, 4), (5, None), (2, 9), (7, 8), (7, 8)]
    edges = spark.createDataFrame(rows, "a long, b long").withColumn("node", F.lit("own"))
    made = lambda e: components.components(e, shared.Scratch(spark, "t"))
    assert sorted(map(tuple, made(edges).collect())) == [(1, 1), (2, 1), (3, 3), (7, 7), (8, 7), (9, 1)]
    assert made(edges.limit(0)).isEmpty()
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.component for r in made(chain).collect()} == {0}


def corpus(spark, path, rows, items, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(rng.choice([f"good{i}" for i in range(300)], n))
    texts = {i: prose(50) for i in range(40)}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    rows += [(40, texts[3], None, None, None), (None, texts[4], "en", None, None), (None, prose(50), None, "s", None), (41, None, "en", "s", 0), (42, "", "en", "s", 0), (5, texts[5], "en", "s", 1), (6, prose(50), "en", "s", 2), (43, prose(90_000), "en", "s", None)]
    rows += [(100 + i, "$$ %% junk## " * 20, "en", "s", 1) for i in range(20)]
    path = corpus(spark, tmp_path, rows, [(None, "none here"), (1, None), (2, " ".join(texts[7].split()[5:17]))], [(i, int(i < 100), 0) for i in [*range(30), *range(100, 115)]] + [(None, 1, None), (3, None, 0)])
    df = spark.read.parquet(f"{path}/documents.parquet")
    got = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = shared.written(stage(spark, got, path), "stage-test")
        assert got.columns == df.columns, name
    left = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in got.collect())
    want = [(i, t) for i, t in texts.items() if i != 7] + [(-1, rows[42][1]), (6, rows[46][1]), (43, rows[47][1])]
    assert left == sorted(want)
    pieces = corpus_pipeline.STAGES[-1][1](spark, got, path).collect()
    assert {(p.doc_id if p.doc_id is not None else -1) for p in pieces} == {i for i, _ in want}
    empty = corpus(spark, tmp_path / "empty", [], [], [])
    assert corpus_pipeline.run(spark, empty).isEmpty()
