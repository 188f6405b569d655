"""Splits over time with embargo and purging, and sample weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import numbered, ranked


def blocked(df: DataFrame, splits: int, train: float, embargo: int, key: str = "symbol") -> DataFrame:
    """``fold`` and ``role`` (train, embargo, test) by contiguous blocks of each key's rows."""
    rows = numbered(df, key, name="_row")
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(n, key).withColumn("_size", F.floor(F.col("_n") / splits))
    rows = rows.withColumn("fold", F.least(F.floor(F.col("_row") / F.col("_size")), F.lit(splits - 1)).cast("int"))
    rows = rows.withColumn("_len", F.when(F.col("fold") == splits - 1, F.col("_n") - F.col("_size") * (splits - 1)).otherwise(F.col("_size")))
    at, cut = F.col("_row") - F.col("fold") * F.col("_size"), F.floor(F.col("_len") * train)
    return rows.withColumn("role", F.when(at < cut, "train").when(at < cut + embargo, "embargo").otherwise("test")).drop("_row", "_n", "_size", "_len")


def purged(df: DataFrame, folds: DataFrame, episode: str = "episode", key: str = "symbol", start: str = "label_start", end: str = "label_end") -> DataFrame:
    """(fold, key, episode, role): whole episodes before a fold's start with all labels ended by then are train, those
    inside are valid, others purged. ``folds`` (fold, valid_start, valid_end) is small."""
    e = df.groupBy(key, episode).agg(F.min(start).alias("_a"), F.max(end).alias("_b"))
    role = (
        F.when(F.col("_b") < F.col("valid_start"), "train").when((F.col("_a") >= F.col("valid_start")) & (F.col("_b") <= F.col("valid_end")), "valid")
        .when(F.col("_a") >= F.col("valid_end"), None).otherwise("purged")
    )
    return e.crossJoin(F.broadcast(folds)).select("fold", key, episode, role.alias("role")).where("role is not null")


def walk_forward(df: DataFrame, lookback_days: int, step_days: int, ts: str = "ts") -> DataFrame:
    """(window, train_start, test_start, test_end): expanding over the range of ``ts`` in steps."""
    ends = df.agg(F.date_trunc("day", F.min(ts)).alias("a"), F.max(ts).alias("b"))
    day = F.expr("INTERVAL 1 DAY")
    starts = F.sequence(F.col("a") + day * lookback_days, F.col("b"), F.expr(f"INTERVAL {step_days} DAYS"))
    return ends.select("a", F.posexplode(starts).alias("window", "test_start")).select(
        "window", (F.col("test_start") - day * lookback_days).alias("train_start"), "test_start", (F.col("test_start") + day * step_days).alias("test_end")
    )


def chained(df: DataFrame, k: int, episode: str = "episode", ts: str = "ts") -> DataFrame:
    """(episode, block): distinct episodes by first time, in k+1 blocks of equal size, larger ones first; fold i trains on blocks up
    to i and tests on i+1. Episodes are numbered in bands of time, see ``ranked``.
    """
    e = df.groupBy(episode).agg(F.unix_micros(F.min(ts)).alias("_t"))
    e = ranked(e, "_t", [], (episode,)).join(F.broadcast(e.agg(F.count(F.lit(1)).alias("_n"))), F.lit(True))
    size, big, r = F.floor(F.col("_n") / (k + 1)), F.col("_n") % (k + 1), F.col("rank")
    block = F.when(r < big * (size + 1), F.floor(r / (size + 1))).otherwise(big + F.floor((r - big * (size + 1)) / F.greatest(size, F.lit(1))))
    return e.select(episode, block.cast("int").alias("block"))


def fold_spans(df: DataFrame, tenths: list[tuple[int, int]], ts: str = "ts") -> DataFrame:
    """(fold, valid_start, valid_end): stretches between tenths of the days that ``ts`` spans, whole days each."""
    ends = df.agg(F.date_trunc("day", F.min(ts)).alias("a"), (F.datediff(F.max(ts), F.min(ts)) + 1).alias("d"))
    at = lambda k: F.col("a") + F.make_dt_interval(F.floor(F.col("d") * k / 10).cast("int"))
    folds = F.array(*[F.struct(F.lit(i).alias("fold"), at(F.lit(a)).alias("valid_start"), at(F.lit(b)).alias("valid_end")) for i, (a, b) in enumerate(tenths)])
    return ends.select(F.explode(folds).alias("f")).select("f.*")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, weight): rows over classes times rows of the class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    t = c.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return c.crossJoin(t).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))


def effective_size(df: DataFrame, weight: str) -> DataFrame:
    """Kish's effective sample size, one row."""
    w = F.col(weight)
    return df.agg((F.pow(F.sum(w), 2) / F.nullif(F.sum(w * w), F.lit(0.0))).alias("effective"))
