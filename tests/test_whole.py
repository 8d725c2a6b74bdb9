"""Queries over whole tables, against brute force on small ones."""

import datetime

import pytest

from lattica import catalog


def stored(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def rows(name, spark, path):
    return sorted(tuple(r) for r in catalog.queries()[name](spark, path).collect())


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Orders of a month, of which the 40th and 80th are few; some before 1992, and their spans."""
    keys = [(k, (k * 7) % 31 - 3) for k in range(1, 91)]
    at = datetime.datetime(1992, 1, 1)
    df = spark.createDataFrame([(k, at + datetime.timedelta(days=d, hours=k % 24)) for k, d in keys], "o_orderkey long, o_orderdate timestamp_ntz").selectExpr("*", "o_orderkey % 7 as o_custkey")
    spans = [(k, d, d + 3 + k % 10) for k, d in keys], [(k, d, d + 5) for k, d in keys]
    return stored(spark, tmp_path_factory.mktemp("orders"), orders=df), *spans


@pytest.mark.parametrize(
    ("name", "holds"),
    [
        ("interval_overlap_join_all", lambda s, e, x, y: s < y and x < e),
        ("interval_contained_all", lambda s, e, x, y: x <= s and e <= y),
        ("interval_touches_all", lambda s, e, x, y: s == y or x == e),
        ("point_in_interval_all", lambda s, e, x, y: x <= s < y),
    ],
)
def test_joins_of_all_intervals(spark, orders, name, holds):
    path, a, b = orders
    assert rows(name, spark, path) == sorted((i, k) for i, s, e in a for k, x, y in b if holds(s, e, x, y))


def test_weighted_overlap_of_all_intervals(spark, orders):
    path, a, b = orders
    sums = {k: sum(max(min(e, y) - max(s, x), 0) * (i % 100) for i, s, e in a) for k, x, y in b}
    assert rows("weighted_overlap_all", spark, path) == sorted((k, (2 * s + 5) // 10) for k, s in sums.items())


def test_expansion_counts_of_all_nodes(spark, tmp_path):
    path = stored(spark, tmp_path, part=spark.range(201).withColumnRenamed("id", "p_partkey"))
    children = {}
    for dst in range(2, 201):
        for src in {dst // 2} | ({dst // 3} if dst > 2 else set()):
            children.setdefault(src, []).append(dst)
    visits = {}
    for node in range(200, -1, -1):
        visits[node] = 1 + sum(visits[c] for c in children.get(node, []))
    assert rows("expansion_counts_all", spark, path) == sorted(visits.items()) and visits[0] == 1


def test_expansion_of_a_cycle_is_refused(spark):
    from lattica.operators import graphs

    with pytest.raises(ValueError, match="cycle"):
        graphs.expansions(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"))


def test_keyframes_on_each_users_own_days(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    samples = [(1, 1, -30, 10.0), (2, 1, 12, 52.0), (3, 2, 24 * 40, 7.0), (4, 2, 24 * 42, 55.0)]
    df = spark.createDataFrame([(i, u, at + datetime.timedelta(hours=h), v) for i, u, h, v in samples], "event_id long, user_id long, ts timestamp_ntz, value double")
    noon = lambda d: d * 86400 + 43200
    want = [(1, noon(-2), 10), (1, noon(-1), 28), (1, noon(0), 52), (2, noon(40), 19), (2, noon(41), 43), (2, noon(42), 55)]
    assert rows("keyframe_linear_all", spark, stored(spark, tmp_path, events=df)) == want


def test_search_in_all_languages(spark, tmp_path):
    df = spark.createDataFrame([(1, "From the start, with care", "en"), (2, "THE mit with und FROM von", "de"), (3, "with the, from", None), (4, "with them from", "fr"), (5, None, "es")], "doc_id long, text string, lang string")
    assert rows("lexical_search_all", spark, stored(spark, tmp_path, documents=df)) == [(1, 5), (2, 6), (3, 3)]


@pytest.mark.parametrize("name", ["interval_overlap_join_all", "interval_contained_all", "interval_touches_all", "point_in_interval_all"])
def test_pairs_of_all_intervals_are_dealt_to_all_tasks(spark, orders, name, monkeypatch):
    from lattica.operators import intervals

    path, a, b = orders
    whole = rows(name, spark, path)
    monkeypatch.setattr(intervals, "BLOCK", 2)  # days have more orders than a block
    df = catalog.queries()[name](spark, path)
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(tuple(r) for r in df.collect()) == whole


@pytest.mark.parametrize("name", ["interval_overlap_join_all", "interval_contained_all", "interval_touches_all", "point_in_interval_all"])
def test_tasks_of_all_intervals_have_neighbours(spark, orders, name, monkeypatch):
    """Tasks grow in number with the pairs, and each has days of its own, so that few ids fill its part of the result."""
    from pyspark.sql import functions as F

    from lattica.operators import intervals

    path, a, b = orders
    whole, start = rows(name, spark, path), {k: x for k, x, _ in b}
    monkeypatch.setattr(intervals, "TASK_PAIRS", len(whole) // 9, raising=False)
    df = catalog.queries()[name](spark, path).withColumn("part", F.spark_partition_id())
    got = [tuple(r) for r in df.collect()]
    assert sorted(r[:2] for r in got) == whole
    days = {}
    for _, k, part in got:
        days.setdefault(part, set()).add(start[k])
    spans = sorted((min(d), max(d)) for d in days.values())
    assert len(spans) >= 8 and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


@pytest.mark.parametrize("name", ["interval_contained_all", "interval_touches_all", "point_in_interval_all"])
def test_repeated_and_null_keys_of_all_intervals(spark, tmp_path, name):
    import duckdb

    at = datetime.datetime(1995, 1, 1)
    keys = [(k, at + datetime.timedelta(days=d % 9)) for d, k in enumerate([5, 5, None, None, *range(40)])] + [(77, None), (None, None)]
    path = stored(spark, tmp_path, orders=spark.createDataFrame(keys, "o_orderkey long, o_orderdate timestamp_ntz").selectExpr("*", "1L as o_custkey"))
    duck = duckdb.connect()
    duck.execute(f"create view orders as select * from '{path}/orders.parquet/*.parquet'")
    got = [tuple(r) for r in catalog.queries()[name](spark, path).collect()]
    assert sorted(got, key=repr) == sorted(duck.execute(catalog.oracle_sql()[name]).fetchall(), key=repr)
    assert any(k is None for _, k in got)
