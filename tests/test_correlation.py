import numpy as np
import pandas as pd
import pytest

from tidemark.operators import correlation


def test_against_pandas_with_ties_nulls_and_constants(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=900)
    f = pd.DataFrame({
        "a": x, "b": np.exp(x), "c": 0.85 * x + 0.55 * rng.normal(size=900), "half": np.where(rng.random(900) < 0.5, 0.0, x), "ties": rng.integers(0, 4, 900).astype(float),
        "one": 1.0, "late": x, "later": -x, "odd": rng.normal(size=900), "inf": np.where(rng.random(900) < 0.02, np.inf, x), "none": np.nan,
    })
    f.loc[:40, ["late", "later"]] = np.nan
    f.loc[rng.random(900) < 0.1, "odd"] = np.nan
    df = spark.createDataFrame(f).repartition(5)
    got = {(r.a, r.b): (r.rho, r.n) for r in correlation.spearman(df, list(f.columns)).collect()}
    want = f.corr(method="spearman")
    for (a, b), (rho, n) in got.items():
        assert n == (np.isfinite(f[a]) & np.isfinite(f[b])).sum()
        assert rho is None and np.isnan(want.loc[a, b]) or abs(rho - want.loc[a, b]) < 1e-9, (a, b, rho, want.loc[a, b])
    assert len(got) == 55


def test_pruning_keeps_the_first_of_near_duplicates(spark):
    rng = np.random.default_rng(42)
    keep = rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"keep_first": keep, "drop_second": keep, "independent": rng.normal(size=200)}))
    names = ["keep_first", "drop_second", "independent"]
    kept, gone, audit = correlation.pruned(correlation.spearman(df, names), names)
    assert kept == ["keep_first", "independent"] and gone == ["drop_second"] and audit == [("keep_first", "drop_second", pytest.approx(1.0), "drop_second")]
    first = rng.normal(size=1000)
    df = spark.createDataFrame(pd.DataFrame({"first": first, "second": 0.85 * first + 0.55 * rng.normal(size=1000)}))
    kept, gone, audit = correlation.pruned(correlation.spearman(df, ["first", "second"]), ["first", "second"])
    assert kept == ["first", "second"] and gone == [] and audit[0][3] == "report_only"
    with pytest.raises(ValueError):
        correlation.pruned(df, [], 0.5, 0.6)


def test_interval_names():
    from tidemark.functions import times

    assert [times.interval(x) for x in ("15m", "1h", "1d", "1w")] == ["15 minutes", "60 minutes", "1440 minutes", "10080 minutes"]
    assert [times.horizon(x) for x in ("m15", "h4", "D1", 7, "12")] == [1, 16, 96, 7, 12]
    assert [times.horizon_name(x) for x in (1, 4, 6, 96)] == ["m15", "h1", "m90", "d1"]
    for bad in ("15", "m", "0h", "h1"):
        with pytest.raises(ValueError):
            times.interval(bad)
    for bad in ("m20", "x", "m0", ""):
        with pytest.raises(ValueError):
            times.horizon(bad)


def test_a_kernel_sees_each_window_once_whatever_the_chunk(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.series import rolling_kernel

    rng = np.random.default_rng(1)
    v = [None if rng.random() < 0.02 else float(rng.normal()) for _ in range(500)]
    df = spark.createDataFrame([(s, i, x) for s in "ab" for i, x in enumerate(v)], "symbol string, t long, x double").withColumn("ts", F.timestamp_seconds(F.col("t") * 3600))
    want = {i: max(v[i - 6 : i + 1]) if i >= 6 and None not in v[i - 6 : i + 1] else None for i in range(500)}
    for chunk in (7, 64, 10**6):
        got = rolling_kernel(df, ["x"], 7, lambda x: x.max(axis=1), "top", chunk=chunk).collect()
        assert len(got) == 1000 and all(r.top == want[r.t] for r in got)
