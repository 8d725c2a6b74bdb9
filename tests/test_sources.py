"""Sources, sinks and functions that no driver table reaches, and what they refuse."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica import functions as fn
from lattica import sources, storage


def test_json_faults(spark, tmp_path):
    cases = {"ok": '{"a": [1, {"b": "x"}]}', "bad": '{"a": ', "twice": '{"a": {"b": 1, "b": 2}}', "deep": "[" * 80 + "]" * 80, "long": json.dumps({"a": "x" * (sources.MOST_TEXT + 1)})}
    for name, text in cases.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {r.path.rsplit("/", 1)[-1]: r.fault for r in sources.json_faults(sources._documents(spark, str(tmp_path))).collect()}
    assert got == {"bad.json": "MALFORMED", "twice.json": "DUPLICATE_NAME", "deep.json": "DEPTH", "long.json": "TEXT"}
    assert sources.json_fault("[1, 2, 3]", nodes=3) == "NODES" and sources.json_fault("[1, 2]", nodes=3) is None


def test_schema_difference():
    a = T._parse_datatype_string("a int, b struct<c: array<struct<d: string>>>")
    assert sources.schema_difference(a, a) is None
    assert sources.schema_difference(a, T._parse_datatype_string("a int, b struct<c: array<struct<d: int>>>")) == "$.b.c[].d"
    assert sources.schema_difference(a, T._parse_datatype_string("b struct<c: array<struct<d: string>>>")) == "$.a"
    assert sources.schema_difference(a, T._parse_datatype_string("a int, b struct<c: array<struct<d: string>>>, e int")) == "$.e"


def test_files_against_declared(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / name).write_text(name * 3)
    files = sources.verified_files(spark, str(tmp_path))
    declared = files.filter(~F.col("path").endswith("/c")).withColumn("sha256", F.when(F.col("path").endswith("/b"), "0").otherwise(F.col("sha256")))
    declared = declared.unionByName(spark.createDataFrame([("file:/gone", 1, "x")], "path string, n_bytes long, sha256 string"))
    assert sorted((r.path[-1], r.fault) for r in sources.file_faults(files, declared).collect()) == [("b", "DIGEST"), ("c", "UNDECLARED"), ("e", "MISSING")]


def test_transcripts(spark, tmp_path):
    word = lambda i, s, e, j="space": {"id": f"w{i}", "start": s, "end": e, "text": "x", "join": j}
    (tmp_path / "a.json").write_text(json.dumps({"words": [word(1, "0", "1/2", "none"), word(2, "1/2", "3/4"), word(2, "2/3", "1"), word(4, "2", "2", "dash")]}))
    words = sources.read_transcripts(spark, str(tmp_path / "a.json"))
    assert sorted((r.ord, r.fault) for r in sources.transcript_faults(words).collect()) == [(1, "ID"), (2, "ID"), (2, "TIME"), (3, "JOIN"), (3, "TIME")]


def test_catalog_and_report(spark, tmp_path):
    entry = {"id": "a", "label": "A", "kind": "audio", "description": "", "tags": ["x", "y"], "downloadUrl": "https://e.org/a", "sha256": "0", "bytes": 3, "provenance": {"creator": "c", "license": "CC0-1.0", "licenseUrl": "u", "sourceUrl": "s", "attribution": "t"}}
    (tmp_path / "a.json").write_text(json.dumps({"entries": [entry, entry | {"id": "b"}]}))
    rows = sources.read_catalog(spark, str(tmp_path / "a.json"))
    want = json.dumps(entry, sort_keys=True, separators=(",", ":"))
    line = rows.filter("id = 'a'").drop("digest")
    assert line.select(sources.canonical_json(line)).first()[0] == want
    sources.write_report(line, f"file://{tmp_path}/report")
    sources.write_report(line, f"file://{tmp_path}/report")  # the older one gives way
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/report").collect()] == [want]
    (tmp_path / "b.json").write_text(json.dumps({"entries": [entry, entry]}))
    with pytest.raises(sources.SourceError, match="DUPLICATE"):
        sources.read_catalog(spark, str(tmp_path / "b.json"))


def test_functions(spark):
    df = spark.createDataFrame([("ﬁne  Ⅳ", "2024-02-29", 6, -4, 1), ("plain", "2023-02-29", 0, 5, 0), (None, "2024-2-1", 7, 0, 2)], "t string, d string, n long, m long, k int")
    got = df.select(fn.normalised(F.col("t")).alias("t"), fn.is_date(F.col("d")).alias("d"), fn.fraction_text(F.col("n"), F.col("m")).alias("f"), fn.collapsed(F.concat(F.lit("　 a\t b "), F.lit("﻿"))).alias("c")).collect()
    assert [tuple(r) for r in got] == [("fine  IV", True, "-3/2", "a b"), ("plain", False, "0", "a b"), (None, False, None, "a b")]
    curves = spark.createDataFrame([(0.25, c) for c in ("in-cubic", "out-cubic", "in-out-cubic", "linear")], "t double, c string")
    assert [round(r[0], 6) for r in curves.select(fn.eased(F.col("t"), F.col("c"))).collect()] == [0.015625, 0.578125, 0.0625, 0.25]
    version = spark.createDataFrame([("1.10.0",), ("1.9.3",), ("x",)], "v string").select("v", fn.semver_key(F.col("v")).alias("k")).orderBy("k").collect()
    assert [r.v for r in version] == ["x", "1.9.3", "1.10.0"]


def test_scratch_drops_what_is_replaced(spark):
    s = storage.Scratch(spark, "t")
    a = s.put(spark.range(5), "a")
    b = s.put(a.filter("id > 2"), "b")
    first = s.paths["a"]
    s.put(b, "a")
    files = spark._jvm.org.apache.hadoop.fs.Path(first).getFileSystem(spark._jsc.hadoopConfiguration())
    assert not files.exists(spark._jvm.org.apache.hadoop.fs.Path(first)) and b.count() == 2
