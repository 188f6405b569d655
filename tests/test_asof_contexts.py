import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import asof


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def at(df, *cols):
    return df.withColumns({c: F.timestamp_seconds(F.col(c)) for c in cols})


def test_each_context_is_the_latest_known_one(spark):
    left = at(frame(spark, [("a", t, i) for i, t in enumerate((0, 50, 100, 100, 90_000, 200_000))] + [("b", 100, 9), ("a", None, 10)], "symbol string, ts long, id int"), "ts")
    bars = at(frame(spark, [("a", 50, 1.0), ("a", 100, 2.0), ("b", 101, 3.0), ("a", None, 7.0)], "symbol string, available_at long, x double"), "available_at")
    slow = at(frame(spark, [(50, 10), (99_999, 11)], "known long, y int"), "known")
    got = asof.contexts(left, {"bar": asof.Context(bars, ["x"]), "late": asof.Context(bars.withColumnRenamed("x", "z"), ["z"], strict=True), "slow": asof.Context(slow, ["y"], "known", keyed=False)})
    rows = sorted((r.id, r.x, r.z, r.y, r.bar_at is None) for r in got.collect())
    assert rows == [
        (0, None, None, None, True), (1, 1.0, None, 10, False), (2, 2.0, 1.0, 10, False), (3, 2.0, 1.0, 10, False), (4, 2.0, 2.0, 10, False), (5, 2.0, 2.0, 11, False),
        (9, None, None, 10, True), (10, None, None, None, True),
    ]
    assert got.columns == ["symbol", "ts", "id", "bar_at", "x", "late_at", "z", "slow_at", "y"]


def test_two_rows_of_a_side_at_one_time_stop_the_job(spark):
    left = at(frame(spark, [("a", 100, 1)], "symbol string, ts long, id int"), "ts")
    twice = at(frame(spark, [("a", 50, 1.0), ("a", 50, 2.0)], "symbol string, available_at long, x double"), "available_at")
    with pytest.raises(PySparkException, match="two rows of bar at one time"):
        asof.contexts(left, {"bar": asof.Context(twice, ["x"])}).collect()
    assert asof.contexts(left, {"bar": asof.Context(twice.limit(0), ["x"])}).first().x is None


def test_rows_are_dealt_once(spark):
    left = at(frame(spark, [("a", 100, 1)], "symbol string, ts long, id int"), "ts")
    bars = at(frame(spark, [("a", 50, 1.0)], "symbol string, available_at long, x double"), "available_at")
    got = asof.contexts(left, {n: asof.Context(bars.withColumnRenamed("x", n), [n]) for n in "uvw"})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") <= 2  # the rows once, and again to sum up buckets where the exchange isn't reused
