import gzip
import json

from pyspark.sql import functions as F

from tidemark.sources import tables


def test_positioning_and_funding(spark, tmp_path):
    for day, rows in (("2024-01-01", "2024-01-01 00:05:00,X,10,1\n2024-01-01T00:10:00,X,0,\n2024-01-01 00:05:00,X,12,2\n"), ("2024-03-01", "2024-03-01 00:05:00,X,10,1\n")):
        (tmp_path / f"X-metrics-{day}.csv").write_text("create_time,symbol,sum_open_interest,ratio\n" + rows)
    got = tables.read_positioning(spark, str(tmp_path / "X-metrics-*.csv"), "x", "2024-02-01").collect()
    assert [(str(r.ts), r.sum_open_interest, r.ratio) for r in got] == [("2024-01-01 00:05:00", 12.0, 2.0)]
    (tmp_path / "f.csv").write_text("calc_time,funding_interval_hours,last_funding_rate\n1704067200007,8,0.0001\n1704096000001,8,bad\n")
    assert [(str(r.ts), r.rate) for r in tables.read_funding(spark, str(tmp_path / "f.csv"), "x").collect()] == [("2024-01-01 00:00:00", 0.0001)]


def test_articles_index_and_posts(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("DATE,url,domain,V2Tone,title\n20240101000000,https://a.com/x,a.com,\"-1.5,2,3\",T\nbad,https://a.com/y,a.com,1,U\n")
    got = tables.read_articles(spark, str(tmp_path / "a.csv.gz"), "btc").collect()
    assert [(str(r.ts), r.tone, r.stream) for r in got] == [("2024-01-01 00:00:00", -1.5, "btc")]
    (tmp_path / "i.json").write_text(json.dumps({"data": [{"value": "40", "value_classification": "Fear", "timestamp": "1704067200"}, {"value": "50", "value_classification": "Neutral", "timestamp": "1604067200"}]}))
    assert [(r.value, r.kind) for r in tables.read_daily_index(spark, str(tmp_path / "i.json"), "2024-01-01", "2024-02-01").collect()] == [(40, "Fear")]
    posts = spark.createDataFrame([("2024-01-01T05:00:00Z", "New tariffs on steel", "u"), ("2024-01-02T05:00:00Z", "I was fed up", "u"), ("x", "tariffs", "u")], "datetime string, text string, url string")
    assert [r.iso[:19] for r in tables.social_posts(posts, "2024-01-01", "2024-02-01").collect()] == ["2024-01-01T05:00:00"]


def test_quotes_months_and_grids(spark, tmp_path):
    rows = [("x", f"2024-01-01 00:{m:02}:00", 1.0, 1.0, 1.0, 1.0, 5.0) for m in range(0, 12)]
    bars = spark.createDataFrame(rows, "symbol string, ts string, open double, high double, low double, close double, volume double").withColumn("ts", F.col("ts").cast("timestamp"))
    ask = bars.withColumns({c: F.col(c) + F.when(F.minute("ts") == 3, -0.1).otherwise(0.02) for c in ("open", "high", "low", "close")})
    pair = tables.quote_pair(bars.unionByName(bars.limit(2)), ask).orderBy("ts").collect()
    assert len(pair) == 11 and [r.gap_min for r in pair][:4] == [None, 1.0, 1.0, 2.0] and abs(pair[0].spread_bps - 0.02 / 1.01 * 1e4) < 1e-6
    report = tables.month_report(bars.unionByName(bars.limit(1)).withColumn("month", F.lit("2024-01")), "2024-02-01").first()
    assert (report["rows"], report.repeated, report.outside, report.sealed, report.bad, report.whole) == (13, 1, 0, 0, 0, False)
    audit = {(r.grid, r.bars, r.complete) for r in tables.write_grids(bars, f"file://{tmp_path}/g", {"5 minutes": 5, "15 minutes": 15}).collect()}
    assert audit == {("5 minutes", 3, 2), ("15 minutes", 1, 0)}
    assert tables.cadence_breaks(bars, 60).count() == 0 and tables.cadence_breaks(bars.where("minute(ts) <> 5"), 60).collect()[0].seconds == 120
