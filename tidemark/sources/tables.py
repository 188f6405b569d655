"""Sources and sinks: exchange CSVs, quote pairs, article exports, partitioned tables, append-only ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import relevant
from tidemark.operators.bars import midpoint, resample
from tidemark.operators.series import previous
from tidemark.sources.scratch import stage

#: The columns of exchange candle files, in order.
KLINE = "open_time open high low close volume close_time quote_volume count taker_buy_base taker_buy_quote ignore".split()


def from_epoch(c: Column) -> Column:
    """Timestamp of a whole number of seconds, milli-, micro- or nanoseconds, told by its size."""
    v = c.cast("long")
    micros = F.when(v >= 10**17, F.floor(v / 1000)).when(v >= 10**14, v).when(v >= 10**11, v * 1000).otherwise(v * 1_000_000)
    return F.timestamp_micros(micros)


def read_klines(spark: SparkSession, paths: str | list[str], symbol: str) -> DataFrame:
    """Bars of candle CSVs with or without a header line."""
    raw = spark.read.schema(", ".join(f"{c} string" for c in KLINE)).csv(paths)
    raw = raw.where(F.col("open_time").rlike(r"^[0-9]+$"))
    num = [F.col(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close", "volume", "quote_volume", "count", "taker_buy_base", "taker_buy_quote")]
    return raw.select(F.lit(symbol).alias("symbol"), from_epoch(F.col("open_time")).alias("ts"), *num)


def clean(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """One row for each (key, ts), those with a null price or volume or with impossible prices out."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    ok = (h >= F.greatest(o, c)) & (l <= F.least(o, c)) & (l > 0) & F.col("volume").isNotNull()
    rows = bars.where(F.coalesce(ok, F.lit(False)))
    return rows.groupBy(key, "ts").agg(F.min(F.struct(*[x for x in bars.columns if x not in (key, "ts")])).alias("_r")).select(key, "ts", "_r.*")


def read_quotes(spark: SparkSession, path: str, symbol: str, zone: str = "Europe/Helsinki", before: str | None = None) -> DataFrame:
    """One side of a quote pair: local times to UTC, cut off before anything else, OHLC repaired."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    time = next(c for c in raw.columns if c.startswith("time"))
    ts = F.to_utc_timestamp(F.to_timestamp(F.trim(F.col(f"`{time}`")), "yyyy.MM.dd HH:mm:ss"), zone)
    o, h, l, c = (F.trim(F.col(x)).try_cast("double") for x in ("open", "high", "low", "close"))
    rows = raw.select(F.lit(symbol).alias("symbol"), ts.alias("ts"), o.alias("open"), F.greatest(h, o, c).alias("high"), F.least(l, o, c).alias("low"), c.alias("close"))
    return rows if before is None else rows.where(F.col("ts") < F.lit(before).cast("timestamp"))


def read_articles(spark: SparkSession, path: str, stream: str) -> DataFrame:
    """Article exports (CSV, also compressed): stamp, url, domain, first number of the tone list, title, stream."""
    raw = spark.read.option("header", True).csv(path)
    own = F.col("stream") if "stream" in raw.columns else F.lit(stream)
    return raw.select(
        F.try_to_timestamp(F.col("DATE"), F.lit("yyyyMMddHHmmss")).alias("ts"), "url", "domain", F.element_at(F.split("V2Tone", ","), 1).try_cast("double").alias("tone"), "title",
        F.coalesce(own, F.lit(stream)).alias("stream"),
    ).where("ts is not null and url is not null")


def releases(observations: DataFrame, times: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """(series, release_time): release date plus the series' local time of day, as UTC; '.' values are none."""
    rows = observations.where("value <> '.'").join(times, "series")
    return rows.select("series", F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.col("date").cast("string"), "local_time")), zone).alias("release_time"), F.col("value").try_cast("double").alias("value"))


def write_monthly(bars: DataFrame, path: str, key: str = "symbol") -> None:
    """Partitioned by key and month, so that a span reads its months only."""
    bars.withColumn("month", F.date_format("ts", "yyyy-MM")).repartition(key, "month").write.partitionBy(key, "month").mode("overwrite").parquet(path)


def read_span(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Rows of [start, end) of a monthly table; other months' files aren't opened. A row outside the month of its file stops the job."""
    df = spark.read.parquet(path)
    own = F.date_format("ts", "yyyy-MM") == F.col("month")
    df = df.where(F.when(own, F.lit(True)).otherwise(F.raise_error(F.lit("a row outside its month")).cast("boolean")))
    months = (F.col("month") >= start[:7]) & (F.col("month") <= end[:7])
    return df.where(months & (F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp"))).drop("month")


def split_sealed(df: DataFrame, sealed_from: str, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Working and sealed rows: no row is in both."""
    cut = F.lit(sealed_from).cast("timestamp")
    return df.where(F.col(ts) < cut), df.where(F.col(ts) >= cut)


def content_hash(df: DataFrame, cols: list[str], bucket: Column) -> DataFrame:
    """(bucket, digest): order-free hash of rows, by bucket; hash the few digests again for one of the whole.

    The hash is of the number of rows and three sums of 60 bits each of their hashes, so partial sums meet, never rows.
    """
    part = lambda k: F.sum(F.conv(F.substring("_h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    rows = df.select(bucket.alias("bucket"), F.sha2(F.concat_ws("|", *cols), 256).alias("_h"))
    return rows.groupBy("bucket").agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *[part(k) for k in range(3)]), 256).alias("digest"))


def append_new(spark: SparkSession, rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append rows whose keys the ledger at ``path`` doesn't have yet; returns those. Doing it again adds nothing.

    What is new is written aside first, so the result doesn't change with the ledger. One writer at a time.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    new = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti") if there else rows
    new = stage(new.dropDuplicates(keys), "new")
    new.write.mode("append").parquet(path)
    return new


def read_positioning(spark: SparkSession, paths: str | list[str], symbol: str, before: str) -> DataFrame:
    """Daily metric files: files whose name's date isn't before ``before`` are left out, stamps in either format, the last row
    of a stamp by file and value counts, open interest has to be above zero, other columns may be null.
    """
    raw = spark.read.option("header", True).csv(paths).withColumn("_file", F.col("_metadata.file_name"))
    raw = raw.where(F.regexp_extract("_file", r"(\d{4}-\d{2}-\d{2})", 1) < before)
    ts = F.coalesce(F.try_to_timestamp("create_time", F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp("create_time", F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    num = [c for c in raw.columns if c not in ("create_time", "symbol", "_file")]
    rows = raw.select(F.lit(symbol).alias("symbol"), ts.alias("ts"), "_file", *[F.col(c).try_cast("double").alias(c) for c in num])
    rows = rows.where("ts is not null").groupBy("symbol", "ts").agg(F.max_by(F.struct(*num), F.struct("_file", *num)).alias("_r"))
    return rows.select("symbol", "ts", "_r.*").where("sum_open_interest > 0")


def read_funding(spark: SparkSession, paths: str | list[str], symbol: str) -> DataFrame:
    """(symbol, ts, rate): stamps in milliseconds that jitter around the hour, cut to it."""
    raw = spark.read.option("header", True).csv(paths)
    ts = F.date_trunc("hour", F.timestamp_millis(F.col("calc_time").cast("long")))
    return raw.select(F.lit(symbol).alias("symbol"), ts.alias("ts"), F.col("last_funding_rate").try_cast("double").alias("rate")).where("rate is not null")


def read_daily_index(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """(ts, value, kind) of a JSON history with epoch seconds, within [start, end)."""
    raw = spark.read.option("multiLine", True).schema("data array<struct<value string, value_classification string, timestamp string>>").json(path)
    rows = raw.select(F.explode("data").alias("d")).select(
        F.timestamp_seconds(F.col("d.timestamp").cast("long")).alias("ts"), F.col("d.value").try_cast("int").alias("value"), F.col("d.value_classification").alias("kind")
    )
    return rows.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))


def social_posts(posts: DataFrame, start: str, end: str) -> DataFrame:
    """(ts, text, url, iso) of relevant posts in [start, end); times that can't be read are left out."""
    ts = F.try_to_timestamp(F.col("datetime"))
    rows = posts.select(ts.alias("ts"), "text", "url").where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    return rows.where(relevant(F.col("text"))).withColumn("iso", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"))


def quote_pair(bid: DataFrame, ask: DataFrame) -> DataFrame:
    """Midpoint bars of both sides with ``spread_bps`` and minutes since the bar before as ``gap_min``; crossed quotes are out. Of rows of a
    side at one time the lowest by open, high, low, close counts."""
    one = lambda d: d.groupBy("symbol", "ts").agg(F.min(F.struct("open", "high", "low", "close")).alias("_r")).select("symbol", "ts", "_r.*")
    mid = midpoint(one(bid), one(ask)).where("spread >= 0").withColumn("spread_bps", F.col("spread") / F.col("close") * 1e4)
    return previous(mid, {"_b": "ts"}).withColumn("gap_min", (F.unix_timestamp("ts") - F.unix_timestamp("_b")) / 60).drop("_b")


def month_report(bars: DataFrame, sealed_from: str) -> DataFrame:
    """(symbol, month, rows, repeated, outside, sealed, bad, whole) of a partitioned table's bars (with ``month``): what a
    month's manifest has to show before it is used.
    """
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    bad = ~F.coalesce((h >= F.greatest(o, c)) & (l <= F.least(o, c)) & (l > 0), F.lit(False))
    per = bars.groupBy("symbol", "month", "ts").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.max((F.date_format("ts", "yyyy-MM") != F.col("month")).cast("int")).alias("outside")
    )
    got = per.groupBy("symbol", "month").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("repeated"), F.sum("outside").alias("outside"), F.count_if(F.col("ts") >= F.lit(sealed_from).cast("timestamp")).alias("sealed"),
        F.sum("bad").alias("bad"),
    )
    return got.withColumn("whole", (F.col("repeated") == 0) & (F.col("outside") == 0) & (F.col("sealed") == 0) & (F.col("bad") == 0))


def write_grids(bars: DataFrame, path: str, grids: dict[str, int]) -> DataFrame:
    """Coarser tables below ``path``, one for each grid (name -> bars expected), and their audit rows (grid, symbol, bars, complete)."""
    out = None
    for grid, expected in grids.items():  # a few grids
        resample(bars, grid, expected).write.mode("overwrite").parquet(f"{path}/{grid.replace(' ', '_')}")
        got = bars.sparkSession.read.parquet(f"{path}/{grid.replace(' ', '_')}")
        audit = got.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.count_if("complete_bar").alias("complete")).select(F.lit(grid).alias("grid"), "symbol", "bars", "complete")
        out = audit if out is None else out.unionByName(audit)
    return out


def cadence_breaks(bars: DataFrame, step_s: int) -> DataFrame:
    """(symbol, ts, seconds) of bars that don't follow the one before by exactly ``step_s``: a span must have none."""
    got = previous(bars.select("symbol", "ts"), {"_b": "ts"}).withColumn("seconds", F.unix_timestamp("ts") - F.unix_timestamp("_b"))
    return got.where(F.col("seconds") != step_s).select("symbol", "ts", "seconds")
