"""Hand-made cases, chunk invariance and causality of the operators; SQL agreement is in test_queries."""

import math
import random

import pandas as pd
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.functions import text
from tidemark.operators import asof, economics, features, gates, intervals, labels, models, series, splits, stories
from tidemark.plans.base import fine, hourly
from tidemark.plans.evaluation import one


def same(a, b, keys):
    x, y = (d.toPandas().sort_values(keys).reset_index(drop=True) for d in (a, b))
    pd.testing.assert_frame_equal(x, y[x.columns], check_exact=False, rtol=1e-9, check_like=True)


def test_results_do_not_depend_on_chunks(spark):
    h = hourly(spark, SF)
    step = lambda f: {"m": F.avg("close").over(f.over(7)), "s": f.full(F.stddev_samp("close"), "close", 5)}
    same(series.rolling(h, 7, step), series.rolling(h, 7, step, chunk=20), ["symbol", "ts"])
    n = series.numbered(h)
    assert n.groupBy("symbol").agg((F.max("row_no") + 1 - F.count(F.lit(1))).alias("d"), F.count_distinct("row_no").alias("k"), F.count(F.lit(1)).alias("n")).where("d <> 0 or k <> n").count() == 0


def test_decayed_mean_against_pandas(spark):
    h = hourly(spark, SF)
    got = series.ewm(h, {"e": "close"}, 0.3).toPandas().sort_values(["symbol", "ts"])
    want = got.groupby("symbol")["close"].transform(lambda x: x.ewm(alpha=0.3, adjust=False).mean())
    assert (got["e"] - want).abs().max() < 1e-9


def test_the_future_does_not_move_the_past(spark):
    h = hourly(spark, SF)
    cut = F.lit("2024-01-15").cast("timestamp")
    moved = h.withColumns({c: F.when(F.col("ts") < cut, F.col(c)).otherwise(F.col(c) * 1.5) for c in ("open", "high", "low", "close", "volume")})
    for make in (features.returns, features.volatility, features.channel, features.candles, features.rsi):
        a, b = make(h).where(F.col("ts") < cut), make(moved).where(F.col("ts") < cut)
        same(a, b, ["symbol", "ts"])


def test_asof_over_empty_and_far_rows(spark):
    left = spark.createDataFrame([("a", "2024-01-05 00:00:00"), ("a", "2024-01-01 00:00:00"), ("b", "2024-01-05 00:00:00")], "symbol string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    right = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-02 03:00:00", 2.0)], "symbol string, available_at string, v double").withColumn("available_at", F.col("available_at").cast("timestamp"))
    got = {(r.symbol, r.ts.day): r.v for r in asof.backward(left, right, ["v"]).collect()}
    assert got == {("a", 5): 2.0, ("a", 1): 1.0, ("b", 5): None}
    assert {(r.symbol, r.ts.day): r.v for r in asof.backward(left, right, ["v"], strict=True).collect()}[("a", 1)] is None
    assert asof.backward(left, right.limit(0), ["v"]).where("v is not null").count() == 0


def test_greedy_against_a_loop(spark):
    r = random.Random(3)
    rows = [("ab"[i % 2], i, r.randrange(4000), r.randrange(1, 200)) for i in range(400)]
    df = spark.createDataFrame(rows, "symbol string, id long, s long, d long").select("symbol", "id", F.timestamp_seconds("s").alias("start"), F.timestamp_seconds(F.col("s") + F.col("d")).alias("end"))
    want = {}
    for k in "ab":
        last = -1
        for _, i, s, d in sorted((x for x in rows if x[0] == k), key=lambda x: (x[2], x[1])):
            want[i] = s > last
            last = s + d if want[i] else last
    assert {x.id: x.accepted for x in intervals.greedy(df, "id").collect()} == want


def test_triple_barrier_by_hand(spark):
    rows = [("a", i, *x) for i, x in enumerate([(100.0, 100.0, 100.0), (100.5, 98.9, 100.0), (101.2, 99.5, 101.0), (103.0, 98.0, 100.0), (100.0, 100.0, 100.0)])]
    b = spark.createDataFrame(rows, "symbol string, i int, high double, low double, close double").withColumn("ts", F.timestamp_seconds(F.col("i") * 3600))
    assert [r.label for r in labels.triple_barrier(b, 0.01, 0.01, 2).orderBy("i").collect()] == [0, 2, 0, -1, -1]


def test_stop_goes_before_target(spark):
    d = spark.createDataFrame([("a", "x", 1, 100.0, 99.0, 101.0), ("a", "y", -1, 100.0, 101.0, 97.0)], "symbol string, id string, side int, entry double, stop double, target double").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    b = spark.createDataFrame([("a", 0, 100.0, 100.4, 99.6, 100.0), ("a", 300, 100.0, 102.0, 98.0, 99.0)], "symbol string, t long, open double, high double, low double, close double").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.id: (r.outcome, r.r_gross) for r in labels.bracket(d, b, "id", 600).collect()}
    assert got == {"x": ("stop", -1.0), "y": ("stop", -1.0)}


def test_fold_ends_and_uniqueness(spark):
    s = spark.createDataFrame([("a", 1, 0, 120), ("a", 2, 60, 180), ("a", 3, 600, 700)], "symbol string, id int, s long, e long").select("symbol", "id", F.timestamp_seconds("s").alias("start"), F.timestamp_seconds("e").alias("end"))
    got = {r.id: r.uniqueness for r in intervals.uniqueness(s, "id").collect()}
    assert got == {1: 0.75, 2: 0.75, 3: 1.0}
    b = splits.blocked(hourly(spark, SF), 4, 0.5, 2).groupBy("symbol", "fold", "role").count().collect()
    assert {r.role for r in b} == {"train", "embargo", "test"} and all(r["count"] == 2 for r in b if r.role == "embargo")


def test_bootstrap_interval(spark):
    b = spark.range(400).select(F.col("id"), (F.rand(1) - 0.4).alias("t"), F.lit(1.0).alias("c"))
    r = economics.block_bootstrap(b, "t", "c", draws=600).first()
    se = 1 / math.sqrt(12 * 400)
    assert r.low < r.point < r.high and abs((r.high - r.low) / (2 * 1.96 * se) - 1) < 0.15


def test_draw_sums_against_a_second_implementation(spark):
    b = spark.createDataFrame([(f"e{i}", (i * 37 % 101) / 50 - 0.9, 1.0 + i % 3) for i in range(300)], "id string, t double, c double")
    mask = (1 << 64) - 1
    rows = b.select(F.xxhash64("id", F.lit(7)).alias("h"), "t", "c").collect()
    want = []
    for draw in range(1, 41):
        t = c = 0.0
        for r in rows:
            z = (r.h + draw * 0x9E3779B97F4A7C15) & mask
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
            z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
            u, k, p = ((z ^ z >> 31) >> 11) / 2**53, 0, math.exp(-1)
            total = p
            while u >= total and k < 12:
                k += 1
                p /= k
                total += p
            t, c = t + k * r.t, c + k * r.c
        want.append((draw, t, c))
    got = sorted(tuple(r) for r in economics.draw_sums(b.repartition(5), "t", "c", 40, 7).collect())
    assert all(g[0] == w[0] and abs(g[1] - w[1]) < 1e-9 and abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want, strict=True))
    r = economics.block_bootstrap(b, "t", "c", draws=40).first()
    assert abs(r.point - sum(x.t for x in rows) / sum(x.c for x in rows)) < 1e-12
    assert economics.block_bootstrap(b.limit(0), "t", "c", draws=5).first().point is None


def test_spaced_and_crossings(spark):
    rows = [("a", i, t, s) for i, (t, s) in enumerate([(0, 0.9), (10, 0.1), (20, 0.9), (30, 0.2), (95, 0.95), (105, 0.1), (115, 0.9), (200, 0.99)])]
    df = spark.createDataFrame(rows, "symbol string, id int, t long, score double").withColumn("ts", F.timestamp_seconds("t"))
    up = gates.upward_crossings(df, "score", 0.5)
    assert [r.id for r in up.orderBy("id").collect()] == [0, 2, 4, 6]
    assert {r.id: r.taken for r in gates.spaced(up, "id", 90).collect()} == {0: True, 2: False, 4: True, 6: False}
    assert [r.id for r in gates.rearmed(df, "score", 0.5, 60).orderBy("id").collect()] == [0, 4]


def test_indel_and_story_ledger(spark):
    assert text.indel_ratio("abcd", "abcd") == 100 and text.indel_ratio("", "") == 100 and abs(text.indel_ratio("abcd", "abxd") - 75) < 1e-9
    rows = [
        (1, "2024-01-01 00:00:00", "Fed raises rates by 25 points today again", "https://a.com/x?u=1"),
        (2, "2024-01-01 01:00:00", "Fed raises rates by 25 points today again!", "https://b.com/y"),
        (3, "2024-01-01 02:00:00", "Fed raises rates by 50 points today again", "https://b.com/z"),
        (4, "2024-01-01 03:00:00", "Fed raises something else altogether", "https://www.a.com/x/"),
        (5, "2024-01-05 03:00:00", "Fed raises rates by 25 points today again", "https://c.com/q"),
        (6, "2024-01-01 04:00:00", "Fed raises rates by 25 pointz today again", "https://d.com/q"),
    ]
    df = spark.createDataFrame(rows, "id long, ts string, title string, url string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.id: (r.story_id, r.keep, r.reason) for r in stories.story_ledger(df).collect()}
    assert got[1] == (1, True, "new") and got[2] == (1, False, "title") and got[3][1] and got[4] == (1, False, "url") and got[5] == (5, True, "new") and got[6] == (1, False, "fuzzy")


def test_story_ledger_meets_urls_under_other_titles(spark):
    t = lambda h: f"2024-01-0{1 + h // 24} {h % 24:02}:00:00"
    rows = [
        (1, t(0), "Central bank lifts rates", "https://a.com/x"), (2, t(5), "Quite another headline here", "https://a.com/x"),
        (3, t(80), "Third wording of it", "https://a.com/x"), (4, t(81), "", "https://b.com/1"), (5, t(82), "", "https://c.com/2"), (6, t(83), "Third wording of it", "https://d.com/9"),
    ]
    df = spark.createDataFrame(rows, "id long, ts string, title string, url string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.id: (r.story_id, r.keep, r.reason) for r in stories.story_ledger(df).collect()}
    assert got == {1: (1, True, "new"), 2: (1, False, "url"), 3: (3, True, "new"), 4: (4, True, "new"), 5: (5, True, "new"), 6: (3, False, "title")}


def test_html_and_relevance(spark):
    df = spark.createDataFrame([("<title>A &amp; B</title><script>x</script><main><p>Hi <b>you</b></p></main>", "He was fed up"), ("<h1>H</h1>", "Powell spoke"), (None, None)], "h string, t string")
    got = df.select(text.unescape(text.html_title(F.col("h"))).alias("a"), text.html_text(F.col("h")).alias("b"), text.relevant(F.col("t")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("A & B", "Hi you", False), ("H", "H", True), (None, None, False)]


def test_models_learn_and_calibrate(spark):
    df = spark.range(600).select((F.col("id") % 7 - 3).cast("double").alias("x"), F.rand(3).alias("z"), (F.col("id") % 3).alias("fold")).withColumn("label", (F.col("x") > 0).cast("double"))
    for family in ("logistic", "tree"):
        got = models.out_of_fold(df, ["x", "z"], "label", family=family)
        assert got.count() == 600 and got.where("pred = label").count() > 590
    q = one(spark, SF).withColumn("hit", (F.col("y") == F.col("pred")).cast("int"))
    assert models.platt(q, q, "conf", "hit", "c").where("c between 0 and 1").count() == q.count()


def test_sources(spark, tmp_path):
    from tidemark.sources import tables

    (tmp_path / "k.csv").write_text("open_time,o\n1704067200000,1,2,0.5,1.5,10,0,1,1,1,1,0\n1704067260000000,1,2,0.5,1.5,10,0,1,1,1,1,0\n1704067260000000,1,0.1,0.5,1.5,10,0,1,1,1,1,0\n")
    k = tables.read_klines(spark, str(tmp_path / "k.csv"), "btc")
    assert [str(r.ts) for r in k.orderBy("ts").limit(2).collect()] == ["2024-01-01 00:00:00", "2024-01-01 00:01:00"] and tables.clean(k).count() == 2
    (tmp_path / "q.csv").write_text("Time (EET), Open,High,Low,Close\n2024.07.01 03:00:00,1,0.9,1.2,1.1\n2024.01.01 02:00:00,1,2,0.5,1\n")
    q = tables.read_quotes(spark, str(tmp_path / "q.csv"), "usa").orderBy("ts").collect()
    assert [str(r.ts) for r in q] == ["2024-01-01 00:00:00", "2024-07-01 00:00:00"] and (q[1].high, q[1].low) == (1.1, 1.0)
    path = str(tmp_path / "m")
    tables.write_monthly(fine(spark, SF), path)
    span = tables.read_span(spark, path, "2024-01-05 00:00:00", "2024-01-06 00:00:00")
    assert span.count() == fine(spark, SF).where("ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-06'").count() > 0
    ledger = str(tmp_path / "l")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    assert tables.append_new(spark, rows, ledger, ["id"]).count() == 2 and spark.read.parquet(ledger).count() == 2
    assert tables.append_new(spark, rows, ledger, ["id"]).count() == 0
    assert spark.read.parquet(ledger).count() == 2
