from decimal import Decimal

import pytest

from lattica.plans import query as q

SALES = q.Source("sales", (("id", q.STRING), ("region", q.STRING), ("day", q.DATE), ("active", q.BOOLEAN), ("amount", q.NUMBER)), ("id",))
REGIONS = q.Source("regions", (("code", q.STRING), ("label", q.STRING)), ("code",))
STEPS = (
    q.Filter("on", "sales", q.Compare("eq", "active", True)),
    q.Join("both", "on", "regions", (("region", "code"),), (("left", "id", "id"), ("left", "amount", "amount"), ("left", "day", "day"), ("right", "label", "label")), ("id",)),
    q.Group("by", "both", (("label", "label"),)),
    q.Aggregate("sums", "by", (("sum", "amount", "total"), ("mean", "amount", "mean"), ("count", None, "n"), ("min", "day", "first"), ("max", "day", "last"))),
    q.Sort("ranked", "sums", (("total", "desc"),)),
)


def tables(spark):
    from pyspark.sql import functions as F

    sales = spark.createDataFrame([(0, "s1", "north", "2024-02-29", True, "2.5"), (1, "s2", "south", "2024-03-01", True, "3"), (2, "s3", "north", "2024-03-02", False, "0.5"), (3, "s4", "north", "2024-03-03", True, "3.5")], "o int, id string, region string, day string, active boolean, amount string")
    regions = spark.createDataFrame([(0, "south", "South"), (1, "north", "North")], "o int, code string, label string")
    return {"sales": q.conformed(sales, SALES, [F.col("o")]), "regions": q.conformed(regions, REGIONS, [F.col("o")])}


def test_whole_plan(spark):
    rows = q.ordered(q.execute(q.Plan((SALES, REGIONS), STEPS, "ranked"), tables(spark))).collect()
    assert [(r.label, r.total, r["mean"], r.n) for r in rows] == [("North", Decimal("6.000000"), Decimal("3.000000"), 2), ("South", Decimal("3.000000"), Decimal("3.000000"), 1)]
    assert (str(rows[0].first), str(rows[0]["last"])) == ("2024-02-29", "2024-03-03")


@pytest.mark.parametrize(
    ("step", "code"),
    [
        (q.Filter("x", "nothing", q.Compare("eq", "id", "a")), "UNKNOWN_INPUT"),
        (q.Filter("x", "sales", q.Compare("lt", "active", True)), "PREDICATE_TYPE"),
        (q.Join("x", "sales", "regions", (("amount", "code"),), (("left", "id", "id"),), ("id",)), "JOIN_TYPE"),
        (q.Aggregate("x", "sales", (("sum", "amount", "s"),)), "INPUT_KIND"),
        (q.Series("x", "sales", "active", ("amount",)), "SERIES_X"),
        (q.Sort("x", "sales", (("amount", "up"),)), "SORT_KEYS"),
    ],
)
def test_refusals(step, code):
    with pytest.raises(q.QueryError) as e:
        q.check(q.Plan((SALES, REGIONS), (step,), "x"))
    assert e.value.code == code and e.value.path.startswith("steps[0]")


def test_plan_id_follows_meaning():
    plan = q.Plan((SALES, REGIONS), STEPS, "ranked")
    assert q.plan_id(plan) == q.plan_id(q.Plan((REGIONS, SALES), STEPS, "ranked")) != q.plan_id(q.Plan((SALES, REGIONS), STEPS[:-1], "sums"))


def test_input_order_of_rows_does_not_matter(spark):
    plan = q.Plan((SALES, REGIONS), STEPS, "ranked")
    mixed = {k: df.repartition(3) for k, df in tables(spark).items()}
    assert q.ordered(q.execute(plan, mixed)).collect() == q.ordered(q.execute(plan, tables(spark))).collect()


def _refused(spark, plan, rows=None):
    with pytest.raises(q.QueryError) as e:
        q.execute(plan, rows or tables(spark))
    return e.value.code, e.value.path


def test_literals_and_repeated_group_fields_are_refused(spark):
    of = lambda field, value: q.Plan((SALES, REGIONS), (q.Filter("f", "sales", q.Compare("eq", field, value)),), "f")
    for field, value in (("amount", "3"), ("amount", True), ("id", 3), ("active", 1), ("day", "2023-02-29"), ("day", 3)):
        assert _refused(spark, of(field, value)) == ("PREDICATE_TYPE", "steps[0].where")
    twice = q.Plan((SALES,), (q.Group("g", "sales", (("region", "a"), ("region", "b"))), q.Aggregate("x", "g", (("count", None, "n"),))), "x")
    assert _refused(spark, twice) == ("DUPLICATE_FIELD", "steps[0]")


def test_keys_are_checked_on_the_data(spark):
    good = tables(spark)
    again = {**good, "regions": good["regions"].union(good["regions"].filter("code = 'north'"))}
    plan = q.Plan((SALES, REGIONS), STEPS, "ranked")
    assert _refused(spark, plan, again) == ("SOURCE_KEY", "sources[1]")
    from pyspark.sql import functions as F

    none = {**good, "sales": good["sales"].withColumn("id", F.when(F.col("id") != "s2", F.col("id")))}
    assert _refused(spark, plan, none) == ("SOURCE_KEY", "sources[0]")
    by_label = q.Join("both", "sales", "regions", (("region", "code"),), (("right", "label", "label"),), ("label",))
    assert _refused(spark, q.Plan((SALES, REGIONS), (by_label,), "both")) == ("JOIN_RESULT_KEY", "steps[0]")
    assert q.execute(plan, again, verify=False)[0].count() > 0


def test_order_survives_groups_and_joins(spark):
    for field, way, want in (("amount", "desc", ["north", "south"]), ("id", "desc", ["north", "south"]), ("day", "asc", ["north", "south"]), ("amount", "asc", ["north", "south"]), ("active", "desc", ["north", "south"]), ("region", "desc", ["south", "north"])):
        steps = (q.Sort("s", "sales", ((field, way),)), q.Join("j", "s", "regions", (("region", "code"),), (("left", "id", "id"), ("left", "region", "region")), ("id",)), q.Group("g", "j", (("region", "region"),)), q.Aggregate("a", "g", (("count", None, "n"),)), q.Series("points", "a", "region", ("n",)))
        result = q.execute(q.Plan((SALES, REGIONS), steps, "points"), tables(spark))
        assert [r.region for r in q.ordered(result).collect()] == want, (field, way)
        assert [(r.place, r.region) for r in q.placed(result).orderBy("place").collect()] == list(enumerate(want, 1))
