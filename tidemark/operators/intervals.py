"""Intervals: bucketed range joins, containment, overlaps, concurrency sweeps, greedy schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.chains import chained_spans
from tidemark.operators.series import previous, running


def seconds(ts: str | Column) -> Column:
    return F.unix_timestamp(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts)


def range_join(
    spans: DataFrame, points: DataFrame, start: str, end: str, ts: str = "ts", key: str = "symbol", bucket_s: int = 86_400, closed: bool = False
) -> DataFrame:
    """Each span with the points of its key in [start, end) (``closed``: with the end): an equi-join on time buckets."""
    cover = F.sequence(F.floor(seconds(start) / bucket_s), F.floor(seconds(end) / bucket_s))
    a = spans.withColumn("_bucket", F.explode(cover))
    b = points.withColumn("_bucket", F.floor(seconds(ts) / bucket_s))
    upper = F.col(ts) <= F.col(end) if closed else F.col(ts) < F.col(end)
    return a.join(b, [key, "_bucket"]).where((F.col(ts) >= F.col(start)) & upper).drop("_bucket")


def marked(trades: DataFrame, bars: DataFrame, grid_s: int, key: str = "symbol") -> DataFrame:
    """(key, ts, ret, open_trades) of each bar that trades (start, end, price) are open at: the sum of their log returns
    from the bar before, or for a trade's first bar from its price, and their number.

    Bars lie on a grid of ``grid_s`` seconds, so trades of a key whose first and last grid times are the same meet the same bars:
    they are summed up first, and what is joined grows with the grid and the holds, not with the trades.
    """
    at = lambda f, c: F.timestamp_seconds(f(F.unix_micros(F.col(c).cast("timestamp")) / (grid_s * 1_000_000)) * grid_s).alias(c)
    alike = trades.select(key, at(F.ceil, "start"), at(F.floor, "end"), F.signum("price").alias("_sign"), "price").where("start <= end")
    alike = alike.groupBy(key, "start", "end", "_sign").agg(F.count(F.lit(1)).alias("_n"), F.count("price").alias("_priced"), F.sum(F.ln(F.abs("price"))).alias("_log"))
    got = range_join(alike, bars.select(key, "ts", "close"), "start", "end", closed=True)
    before = F.lag("close").over(Window.partitionBy(key, "start", "end", "_sign").orderBy("ts"))
    first = F.when((F.col("_sign") == F.signum("close")) & (F.col("_priced") > 0), F.col("_priced") * F.ln(F.abs("close")) - F.col("_log"))
    got = got.withColumn("_before", before).withColumn("_r", F.when(F.col("_before").isNull(), first).otherwise(F.col("_n") * F.ln(F.col("close") / F.col("_before"))))
    return got.groupBy(key, "ts").agg(F.sum("_r").alias("ret"), F.sum("_n").alias("open_trades"))


def inside_any(points: DataFrame, spans: DataFrame, start: str = "start", end: str = "end", ts: str = "ts", key: str = "symbol") -> DataFrame:
    """``points`` with ``inside``: whether some span of the key has start <= ts <= end, by a running largest end."""
    s = spans.select(key, F.col(start).alias("_t"), F.col(end).cast("timestamp").alias("_end"), F.lit(0).alias("_side"))
    p = points.withColumn("_t", F.col(ts)).withColumn("_side", F.lit(1))
    both = p.unionByName(s, allowMissingColumns=True).withColumn("_key", F.struct("_t", "_side"))
    part = both.withColumn("_bucket", F.date_trunc("day", "_t"))
    tops = part.groupBy(key, "_bucket").agg(F.max("_end").alias("_top"))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(key, "_bucket", F.max("_top").over(earlier).alias("_before"))
    own = Window.partitionBy(key, "_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    got = part.withColumn("_own", F.max("_end").over(own)).join(tops, [key, "_bucket"], "left").where("_side = 1")
    return got.withColumn("inside", F.coalesce(F.greatest("_own", "_before") >= F.col(ts).cast("timestamp"), F.lit(False))).select(*points.columns, "inside")


def without_overlap(cands: DataFrame, base: DataFrame, id_col: str, start: str = "start", end: str = "end", key: str = "symbol", bucket_s: int = 86_400) -> DataFrame:
    """Candidates whose closed interval meets none of the base's, by a left anti join on shared time buckets."""
    cover = lambda: F.explode(F.sequence(F.floor(seconds(start) / bucket_s), F.floor(seconds(end) / bucket_s)))
    b = base.select(key, F.col(start).alias("_s"), F.col(end).alias("_e"), cover().alias("_bucket"))
    a = cands.withColumn("_bucket", cover())
    hit = a.join(b, [key, "_bucket"]).where((F.col(start) <= F.col("_e")) & (F.col(end) >= F.col("_s"))).select(id_col).distinct()
    return cands.join(hit, id_col, "left_anti")


def concurrency(spans: DataFrame, start: str = "start", end: str = "end", key: str = "symbol") -> DataFrame:
    """(key, ts, active): how many half-open spans are open from each boundary on; +1 and -1 events summed in order."""
    up = spans.select(key, F.col(start).alias("ts"), F.lit(1.0).alias("d"))
    steps = up.unionByName(spans.select(key, F.col(end).alias("ts"), F.lit(-1.0).alias("d"))).groupBy(key, "ts").agg(F.sum("d").alias("d"))
    return running(steps, {"active": ("sum", "d")}, key).select(key, "ts", F.col("active").cast("long").alias("active"))


def uniqueness(labels: DataFrame, id_col: str, start: str = "start", end: str = "end", key: str = "symbol") -> DataFrame:
    """(id, uniqueness): time-weighted mean of 1/concurrency over each half-open label.

    The sweep gives elementary intervals; their running sum of width/concurrency is looked up at both ends of a label,
    which are boundaries themselves, so no label is expanded.
    """
    sweep = concurrency(labels, start, end, key)
    sweep = previous(sweep, {"_next": "ts"}, key, ahead=True)
    sweep = sweep.withColumn("_w", F.coalesce((seconds("_next") - seconds("ts")) / F.nullif(F.col("active"), F.lit(0)), F.lit(0.0)))
    acc = running(sweep, {"_acc": ("sum", "_w")}, key).select(key, "ts", (F.col("_acc") - F.col("_w")).alias("_acc"))
    a, b = (acc.select(key, F.col("ts").alias(c), F.col("_acc").alias(f"_{n}")) for c, n in ((start, "a"), (end, "b")))
    share = (F.col("_b") - F.col("_a")) / F.nullif((seconds(end) - seconds(start)).cast("double"), F.lit(0.0))
    return labels.join(a, [key, start]).join(b, [key, end]).select(id_col, share.alias("uniqueness"))


def greedy(
    spans: DataFrame, id_col: str, start: str = "start", end: str = "end", key: str = "symbol", cooldown_s: int = 0, allow_touch: bool = False
) -> DataFrame:
    """(id, accepted): in order of start, a span is taken if it starts after the last taken one's end plus a cooldown.

    ``allow_touch`` lets a span start at that very time. See ``chained_spans``: time buckets are folded in parallel.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    s = spans.select(F.col(key).alias("_key"), F.col(id_col).alias("_id"), micros(start).alias("_s"), (micros(end) + cooldown_s * 1_000_000).alias("_e"))
    return chained_spans(s, allow_touch).select(F.col("_id").alias(id_col), F.col("taken").alias("accepted"))
