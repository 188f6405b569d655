"""Bars: ticks and finer bars to coarser ones, with completeness, availability and run lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import calendar, islands, previous


def from_ticks(ticks: DataFrame, grid: str, key: str = "symbol", ts: str = "ts", price: str = "price", sums: dict[str, str] | None = None) -> DataFrame:
    """Left-labelled, left-closed bars of ``grid``; empty ones don't occur. ``sums``: name -> column summed."""
    w = F.window(ts, grid)
    flows = [F.sum(c).alias(k) for k, c in (sums or {}).items()]
    got = ticks.groupBy(key, w.alias("_w")).agg(
        F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"),
        *flows, F.count(F.lit(1)).alias("n"),
    )
    return got.withColumn("ts", F.col("_w.start")).drop("_w")


def resample(bars: DataFrame, grid: str, expected: int | None = None, sums: tuple[str, ...] = ("volume",), key: str = "symbol") -> DataFrame:
    """Coarser bars of finer ones with ``minute_count``; with ``expected``, ``available_at`` and ``complete_bar`` too."""
    got = bars.groupBy(key, F.window("ts", grid).alias("_w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        *[F.sum(c).alias(c) for c in sums], F.count("close").alias("minute_count"),
    )
    got = got.withColumn("ts", F.col("_w.start")).withColumn("available_at", F.col("_w.end")).drop("_w")
    return got.withColumn("complete_bar", F.col("minute_count") == expected) if expected else got.drop("available_at")


def intrabar(bars: DataFrame, grid: str, minutes: int, key: str = "symbol") -> DataFrame:
    """What happened inside each coarse bar: realised volatility, range, efficiency, close location, late share."""
    rows = previous(bars, {"_c0": "close"}, key).withColumn("_r", F.ln(F.col("close") / F.col("_c0")))
    rows = rows.withColumn("_w", F.window("ts", grid)).withColumn("_at", F.floor((F.unix_timestamp("ts") - F.unix_timestamp("_w.start")) / 60))
    late = F.col("_at") >= minutes - 5
    got = rows.groupBy(key, "_w").agg(
        F.sqrt(F.sum(F.col("_r") * F.col("_r"))).alias("realized_vol"), F.ln(F.max("high") / F.min("low")).alias("range"),
        F.sum("_r").alias("_net"), F.sum(F.abs("_r")).alias("_path"), F.max("high").alias("_h"), F.min("low").alias("_l"), F.max_by("close", "ts").alias("_c"),
        F.sum(F.when(late, F.col("_r"))).alias("last5_return"), F.avg("imbalance").alias("ofi_mean"), F.stddev_pop("imbalance").alias("ofi_std"),
        F.sum(F.when(late, F.col("volume")).otherwise(0.0)).alias("_late"), F.sum("volume").alias("_vol"),
    )
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    return got.select(
        key, F.col("_w.start").alias("ts"), "realized_vol", "range", F.abs(ratio("_net", "_path")).alias("efficiency"),
        ((F.col("_c") - F.col("_l")) / F.nullif(F.col("_h") - F.col("_l"), F.lit(0.0))).alias("close_location"),
        "last5_return", "ofi_mean", "ofi_std", ratio("_late", "_vol").alias("late_share"),
    )


def completeness(bars: DataFrame, grid: str, expected: int, key: str = "symbol") -> DataFrame:
    """(key, bars, complete): coarse groups and those with ``expected`` rows."""
    per = bars.groupBy(key, F.window("ts", grid).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(key).agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") == expected).alias("complete"))


def run_lengths(bars: DataFrame, step: Column, complete: Column | None = None, key: str = "symbol") -> DataFrame:
    """Add ``gap`` (not ``step`` after the row before) and ``run_len``, the rows of the gap-free run of complete bars so far."""
    rows = bars.withColumn("_whole", F.lit(True) if complete is None else complete)
    rows = previous(rows, {"_before": "ts", "_ok": "_whole"}, key).withColumn("gap", F.coalesce(F.col("ts") != F.col("_before") + step, F.lit(True)))
    rows = islands(rows, F.col("gap") | ~F.col("_whole") | ~F.coalesce("_ok", F.lit(True)), "_run", key, place="_n")
    return rows.withColumn("run_len", F.when(F.col("_whole"), F.col("_n")).otherwise(0)).drop("_whole", "_run", "_n", "_before", "_ok")


def cadence(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """(key, seconds): the most frequent positive distance of neighbouring bars, the shortest of equals."""
    d = (F.unix_timestamp("ts") - F.unix_timestamp("_before")).alias("seconds")
    counts = previous(bars.select(key, "ts"), {"_before": "ts"}, key).select(key, d).where("seconds > 0").groupBy(key, "seconds").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.max_by("seconds", F.struct("n", -F.col("seconds"))).alias("seconds"))


def on_grid(counts: DataFrame, step: str, cols: list[str], key: str = "symbol") -> DataFrame:
    """``counts`` on every grid time between each key's ends, with zero where nothing was."""
    return calendar(counts, step, key).join(counts, [key, "ts"], "left").select(key, "ts", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cols])


def backfill_daily(older: DataFrame, newer: DataFrame, key: str = "symbol") -> DataFrame:
    """Daily closes of both sources; where both have a day the newer source wins."""
    days = newer.groupBy(key, F.to_date("ts").alias("day")).agg(F.max_by("close", "ts").alias("close"))
    return days.unionByName(older.select(key, "day", "close").join(days, [key, "day"], "left_anti"))


def midpoint(bid: DataFrame, ask: DataFrame, key: str = "symbol") -> DataFrame:
    """Midpoint bars of a quote pair; OHLC repaired, ``spread`` as quoted and ``execution_spread`` not below zero."""
    cols = ("open", "high", "low", "close")
    a = bid.select(key, "ts", *[F.col(c).alias(f"_b_{c}") for c in cols])
    both = a.join(ask.select(key, "ts", *[F.col(c).alias(f"_a_{c}") for c in cols]), [key, "ts"])
    mid = {c: (F.col(f"_b_{c}") + F.col(f"_a_{c}")) / 2 for c in cols}
    spread = F.col("_a_close") - F.col("_b_close")
    return both.select(
        key, "ts", mid["open"].alias("open"), F.greatest(*mid.values()).alias("high"), F.least(*mid.values()).alias("low"), mid["close"].alias("close"),
        spread.alias("spread"), F.greatest(spread, F.lit(0.0)).alias("execution_spread"),
    )


def unmatched(a: DataFrame, b: DataFrame, key: str = "symbol") -> DataFrame:
    """(key, ts, side): times that only one of two grids has."""
    x, y = a.select(key, "ts", F.lit(1).alias("in_a")), b.select(key, "ts", F.lit(1).alias("in_b"))
    both = x.join(y, [key, "ts"], "full_outer").where("in_a is null or in_b is null")
    return both.select(key, "ts", F.when(F.col("in_a").isNull(), "b").otherwise("a").alias("side"))
