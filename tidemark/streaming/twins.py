"""Structured Streaming twins of batch operators; those that need rows in order of time are in ``ordered``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(ticks: DataFrame, grid: str, late: str, key: str = "symbol", ts: str = "ts", price: str = "price") -> DataFrame:
    """Completed bars of a stream of ticks: a bar comes out once the watermark has passed its end."""
    w = F.window(ts, grid).alias("_w")
    got = ticks.withWatermark(ts, late).groupBy(key, w).agg(
        F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"), F.count(F.lit(1)).alias("n")
    )
    return got.select(key, F.col("_w.start").alias("ts"), F.col("_w.end").alias("available_at"), "open", "high", "low", "close", "n")


def trailing_counts(events: DataFrame, span: str, slide: str, late: str, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Events of the last ``span`` at every ``slide``."""
    got = events.withWatermark(ts, late).groupBy(key, F.window(ts, span, slide).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return got.select(key, F.col("_w.end").alias("ts"), "n")


def sessions(events: DataFrame, gap: str, late: str, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Runs of events of a key without a pause of ``gap`` or more."""
    got = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return got.select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def available(signals: DataFrame, slow: DataFrame, cols: list[str], stale: str, late: str, key: str = "symbol") -> DataFrame:
    """(key, ts, matched_at, cols) of each signal time: the latest slow row of its key that became available within ``stale``
    before it; null if none did. A time comes out once the watermark has passed it.
    """
    a = signals.withWatermark("ts", late).select(key, "ts").alias("a")
    b = slow.withWatermark("available_at", late).alias("b")
    near = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("b.available_at") <= F.col("a.ts")) & (F.col("b.available_at") >= F.col("a.ts") - F.expr(f"INTERVAL {stale}"))
    both = a.join(b, near, "left_outer").select(F.col(f"a.{key}"), F.col("a.ts"), F.struct(F.col("b.available_at").alias("matched_at"), *[F.col(f"b.{c}") for c in cols]).alias("_v"))
    got = both.groupBy(key, "ts").agg(F.max_by("_v", F.col("_v.matched_at")).alias("_v"))
    return got.select(key, "ts", "_v.*")
