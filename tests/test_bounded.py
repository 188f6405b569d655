"""Steps whose work must not grow faster than their input."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import chains, intervals, models


def test_marks_are_joined_by_grid_time(spark):
    """As each trade for itself; repeated trades don't multiply the joined rows."""
    rows = [(i, "ab"[i % 2], i * 37 % 5000, i * 37 % 5000 + 1 + i * 91 % 2400, 100.0 + i % 7) for i in range(300)]
    t = spark.createDataFrame(rows, "id long, symbol string, a long, b long, price double").select("id", "symbol", F.timestamp_seconds("a").alias("start"), F.timestamp_seconds("b").alias("end"), "price")
    bars = spark.createDataFrame([(k, i * 300, 100.0 + i * i % 11) for k in "ab" for i in range(26) if i % 5], "symbol string, s long, close double").select("symbol", F.timestamp_seconds("s").alias("ts"), "close")
    each = intervals.range_join(t, bars, "start", "end", closed=True)
    r = F.ln(F.col("close") / F.coalesce(F.lag("close").over(Window.partitionBy("id").orderBy("ts")), F.col("price")))
    each = each.withColumn("r", r).groupBy("symbol", "ts").agg(F.round(F.sum("r"), 9).alias("ret"), F.count(F.lit(1)).alias("n"))
    got = intervals.marked(t, bars, 300).select("symbol", "ts", F.round("ret", 9).alias("ret"), F.col("open_trades").alias("n"))
    want = {(x.symbol, x.ts): (x.ret, x.n) for x in each.collect()}
    assert {(x.symbol, x.ts): (x.ret, x.n) for x in got.collect()} == want and len(want) > 30


def test_fits_read_their_rows_once_made(spark):
    """What the rows come from isn't run again for each week."""
    rows = spark.range(400).select((F.col("id") * 3600 * 6).alias("s"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3 == 0).cast("double").alias("y"))
    rows = rows.select(F.timestamp_seconds("s").alias("ts"), F.timestamp_seconds(F.col("s") + 60).alias("exit_ts"), "x", "y").repartition(3)
    got = models.weekly_refit(rows, ["x"], "y")
    assert "Exchange" not in got._jdf.queryExecution().toString() and got.where("p_win between 0 and 1").count() > 300


def test_dense_keys_get_narrow_buckets(spark):
    """No bucket has more spans than allowed where time tells them apart; few spans keep the width."""
    df = spark.range(20_000).select((F.col("id") % 2).alias("_key"), (F.col("id") * 60_000_000).alias("_s"))
    width = chains.bucket_width(df, chains.BUCKET, 500)
    most = lambda w: df.groupBy("_key", F.floor(F.col("_s") / w)).count().agg(F.max("count")).first()[0]
    assert most(width) <= 500 < most(width * 2) and chains.bucket_width(df, chains.BUCKET) == chains.BUCKET
