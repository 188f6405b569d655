"""Adapters from the given tables to ticks, bars, panels and articles, in Spark and as SQL with the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, the SQL for the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rnd(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def epoch(c: Column | str = "ts") -> Column:
    """Whole seconds since 1970 (UTC) as a BIGINT."""
    return F.unix_timestamp((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol, ts, event_id, price, volume, taker) of ``events``."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.lit(100.0) + F.col("value")).alias("price"),
        F.lit(1.0).alias("volume"), (F.col("user_id") % 2).cast("double").alias("taker"),
    )


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """One-hour bars of ticks: symbol, ts, open, high, low, close, volume, taker, n."""
    return bars.from_ticks(ticks(spark, sf), "1 hour", sums={"volume": "volume", "taker": "taker"})


def fine(spark: SparkSession, sf: str) -> DataFrame:
    """Five-minute bars of ticks."""
    return bars.from_ticks(ticks(spark, sf), "5 minutes", sums={"volume": "volume", "taker": "taker"})


def bar_sql(name: str, grid: str) -> str:
    return f"""{name} AS (SELECT event_type AS symbol, time_bucket(INTERVAL '{grid}', ts) AS ts, arg_min(100.0 + value, ts) AS open,
  max(100.0 + value) AS high, min(100.0 + value) AS low, arg_max(100.0 + value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume,
  CAST(sum(user_id % 2) AS DOUBLE) AS taker, count(*) AS n FROM events GROUP BY ALL)"""


H = bar_sql("h", "1 hour")
M5 = bar_sql("m5", "5 minutes")
T = "t AS (SELECT event_type AS symbol, ts, event_id, 100.0 + value AS price, CAST(user_id % 2 AS DOUBLE) AS taker FROM events)"
W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def last(n: int) -> str:
    """SQL window of a row and the n-1 before it in its symbol."""
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
