"""Every core query with SQL gives the rows that DuckDB gives for it."""

import os

import duckdb
import pytest

from lattica import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{DATA}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(r[names.index(c)] for c in cols) for r in found.fetchall()), key=repr)


def test_captions_and_keyed_json(spark, tmp_path):
    from pyspark.sql import types as T

    from lattica import sources

    df = spark.createDataFrame([(1, "WEBVTT\n\n00:01.000 --> 00:02.500\na\nb\n\n00:00:02.000 --> 00:00:03.000\nc")], "id int, t string")
    cues = sources.parse_captions(df, "id", "t").orderBy("cue").collect()
    assert [(c.start_ms, c.end_ms, c.lines, c.overlaps) for c in cues] == [(1000, 2500, ["a", "b"], False), (2000, 3000, ["c"], True)]
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.LongType())])
    (tmp_path / "a.json").write_text('{"rows": [{"id": "x", "v": 1}, {"id": "y", "v": 2}]}')
    assert sources.read_keyed_json(spark, str(tmp_path / "a.json"), schema, ["id"]).count() == 2
    (tmp_path / "b.json").write_text('{"rows": [{"id": "x", "v": 1, "v": 2}]}')
    with pytest.raises(sources.SourceError):
        sources.read_keyed_json(spark, str(tmp_path / "b.json"), schema, ["id"])
