"""Series by key and time: row numbers, rolling windows in halo chunks, runs, decayed means, calendars."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of one key that a task windows over; longer series are cut into chunks that overlap by the window's length.
CHUNK = 100_000


def ordered(*keys: str, by: str = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(by)


def numbered(df: DataFrame, key: str = "symbol", ts: str = "ts", name: str = "row_no", bucket: str = "day") -> DataFrame:
    """``df`` with each row's number (from 0) in its key's order of ``ts``, without sorting a key in one task.

    Rows are numbered within (key, time bucket) and shifted by the rows of the buckets before, a sum over small counts.
    """
    part = df.withColumn("_bucket", F.date_trunc(bucket, ts))
    counts = part.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(ts))
    return part.withColumn(name, within - 1).join(base, [key, "_bucket"]).withColumn(name, F.col(name) + F.col("_base")).drop("_bucket", "_base")


def ranked(rows: DataFrame, value: str, by: list[str], tie: tuple[str, ...] = (), bands: int = 256) -> DataFrame:
    """``rows`` with ``rank`` (from 0 in each ``by``) in order of the number ``value``, then ``tie``.

    Values are numbered within bands between approximate quantiles and shifted by the counts of the bands below, so no
    ``by`` is sorted in one task; the numbers are exact whatever the quantiles. Rows equal in all of these get any order.
    """
    cuts = rows.groupBy(*by).agg(F.percentile_approx(value, [i / bands for i in range(1, bands)], 20 * bands).alias("_cuts"))
    part = rows.join(cuts, by) if by else rows.join(F.broadcast(cuts), F.lit(True))
    part = part.withColumn("_band", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    count = part.groupBy(*by, "_band").agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy(*by).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)  # a row a band
    count = count.select(*by, "_band", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"))
    own = F.row_number().over(Window.partitionBy(*by, "_band").orderBy(value, *tie)) - 1
    return part.withColumn("_own", own).join(count, [*by, "_band"]).withColumn("rank", F.col("_own") + F.col("_below")).drop("_own", "_below", "_band")


@dataclass(frozen=True)
class Frame:
    """Window specs inside a chunk: ``over(n)`` the row and the n-1 before, ``before(n)`` the n rows before it."""

    order: WindowSpec

    def over(self, n: int) -> WindowSpec:
        return self.order.rowsBetween(-(n - 1), 0)

    def before(self, n: int) -> WindowSpec:
        return self.order.rowsBetween(-n, -1)

    def full(self, agg: Column, x: str | Column, n: int) -> Column:
        """The aggregate of ``x`` over n rows, null unless all n are there and not null."""
        w = self.over(n)
        return F.when(F.count(x).over(w) == n, agg.over(w))


def rolling(
    df: DataFrame, reach: int, *steps: Callable[[Frame], dict[str, Column]], key: str = "symbol", ts: str = "ts", chunk: int = CHUNK, ahead: int = 0
) -> DataFrame:
    """Add columns computed over the last ``reach`` (and next ``ahead``) rows of each key; later steps may use earlier columns.

    ``reach`` is the sum of the steps' window lengths. A key's series is cut into chunks of ``chunk`` rows; the last
    ``reach`` rows of each chunk are copied to the next as a halo and dropped afterwards, so one long series is windowed
    in parallel and results don't depend on the chunk size.
    """
    chunk = max(chunk, reach, ahead)
    rows = numbered(df, key, ts, "_row")
    own = F.floor(F.col("_row") / chunk)
    spill = F.when(F.col("_row") % chunk >= chunk - reach, F.array(own, own + 1)).otherwise(F.array(own))
    if ahead:
        spill = F.when(F.col("_row") % chunk < ahead, F.array_append(spill, own - 1)).otherwise(spill)
    rows = rows.withColumn("_own", own).withColumn("_chunk", F.explode(spill))
    frame = Frame(Window.partitionBy(key, "_chunk").orderBy("_row"))
    for step in steps:
        rows = rows.withColumns(step(frame))
    return rows.where(F.col("_own") == F.col("_chunk")).drop("_row", "_own", "_chunk")


def rolling_kernel(
    df: DataFrame, cols: list[str], n: int, kernel: Callable[..., np.ndarray], name: str, key: str = "symbol", ts: str = "ts", chunk: int = CHUNK
) -> DataFrame:
    """``df`` with ``name``: ``kernel`` of the last ``n`` rows' ``cols`` in each key, null for the first n-1 rows and where one is null.

    ``kernel`` gets a matrix a column, a row for each place and ``n`` columns (views, not copies), and returns a number a
    row; it is called once for each some thousand places of a chunk, never once a row. Chunks overlap as in ``rolling``.
    """
    chunk = max(chunk, n)
    rows = numbered(df, key, ts, "_row")
    own = F.floor(F.col("_row") / chunk)
    small = rows.select(key, "_row", *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    small = small.withColumn("_chunk", F.explode(F.when(F.col("_row") % chunk >= chunk - (n - 1), F.array(own, own + 1)).otherwise(F.array(own))))
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        keep, out = (pdf["_row"] // chunk == pdf["_chunk"]).to_numpy(), np.full(len(pdf), np.nan)
        if len(pdf) >= n:
            views = [np.lib.stride_tricks.sliding_window_view(pdf[f"_x{i}"].to_numpy(), n) for i in range(len(cols))]
            for at in range(0, len(views[0]), 4096):
                part = [v[at : at + 4096] for v in views]
                whole = np.logical_and.reduce([~np.isnan(v).any(axis=1) for v in part])
                if whole.any():
                    out[np.flatnonzero(whole) + at + n - 1] = kernel(*[v[whole] for v in part])
        return pd.DataFrame({key: pdf[key].to_numpy()[keep], "_row": pdf["_row"].to_numpy()[keep], name: out[keep]})

    got = small.groupBy(key, "_chunk").applyInPandas(run, f"{key} {kind}, _row long, {name} double")
    return rows.join(got, [key, "_row"]).withColumn(name, F.when(~F.isnan(name), F.col(name))).drop("_row")


def previous(df: DataFrame, cols: dict[str, str], key: str = "symbol", ts: str = "ts", tie: tuple[str, ...] = (), bucket: str = "day", ahead: bool = False) -> DataFrame:
    """Add columns (name -> column) with the values of the row before in each key's order (``ahead``: the row after).

    Rows are looked at within (key, time bucket); a bucket's first row takes the last one of the bucket before from a
    table with one row for each bucket, so no key is sorted in one task.
    """
    order, value = [ts, *tie], F.struct(*[F.col(c).alias(n) for n, c in cols.items()])
    part = df.withColumn("_bucket", F.date_trunc(bucket, ts)).withColumn("_v", value)
    place = F.struct(*order)
    ends = part.groupBy(key, "_bucket").agg((F.min_by if ahead else F.max_by)("_v", place).alias("_end"))
    near = F.lead if ahead else F.lag
    ends = ends.select(key, "_bucket", near("_end").over(Window.partitionBy(key).orderBy("_bucket")).alias("_carry"))
    w = Window.partitionBy(key, "_bucket").orderBy(*order)
    edge = F.lead(F.lit(1)).over(w).isNull() if ahead else F.row_number().over(w) == 1
    got = part.withColumns({"_edge": edge, "_near": near("_v").over(w)}).join(ends, [key, "_bucket"])
    found = F.when(F.col("_edge"), F.col("_carry")).otherwise(F.col("_near"))
    return got.withColumn("_found", found).select(*[F.col(c) for c in df.columns if c not in cols], *[F.col(f"_found.{n}").alias(n) for n in cols])


def islands(df: DataFrame, boundary: Column, name: str = "island", key: str = "symbol", ts: str = "ts", place: str | None = None) -> DataFrame:
    """Number the runs of each key: a new one starts where ``boundary`` holds (null counts as false); ``place`` adds a row's
    number, from 1, in its run. Both come from running sums and maxima in two levels.
    """
    rows = df.withColumn("_flag", F.coalesce(boundary.cast("double"), F.lit(0.0)))
    if place is None:
        return running(rows, {name: ("sum", "_flag")}, key, ts).withColumn(name, F.col(name).cast("long")).drop("_flag")
    rows = numbered(rows, key, ts, "_row").withColumn("_from", F.when(F.col("_flag") > 0, F.col("_row")))
    rows = running(rows, {name: ("sum", "_flag"), "_begin": ("max", "_from")}, key, ts)
    got = rows.withColumn(place, F.col("_row") - F.coalesce("_begin", F.lit(0)) + 1).withColumn(name, F.col(name).cast("long"))
    return got.drop("_flag", "_row", "_from", "_begin")


def ewm(df: DataFrame, values: dict[str, str], alpha: float, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Exponential means by row (name -> column), y = (1-alpha) y' + alpha x from the key's first row on; no nulls.

    An affine scan: within chunks of about 15/alpha rows the mean has a closed form over running sums; what comes from
    before is a short weighted sum over the chunks' ends, since a chunk three back weighs less than 1e-19. One numbering
    and one join, whatever the number of columns.
    """
    size, keep = math.ceil(15 / alpha), 1 - alpha
    rows = numbered(df, key, ts, "_row").withColumn("_chunk", F.floor(F.col("_row") / size)).withColumn("_i", F.col("_row") % size)
    first = F.when(F.col("_row") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    run = Window.partitionBy(key, "_chunk").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    grown = F.pow(F.lit(keep), F.col("_i"))
    rows = rows.withColumns({f"_own_{n}": F.sum(F.col(c) * first * F.pow(F.lit(keep), -F.col("_i"))).over(run) * grown for n, c in values.items()})
    ends = rows.groupBy(key, "_chunk").agg(*[F.max_by(f"_own_{n}", "_i").alias(f"_end_{n}") for n in values])
    back, weight = Window.partitionBy(key).orderBy("_chunk"), keep**size
    carry = lambda n: sum((F.coalesce(F.lag(f"_end_{n}", k).over(back), F.lit(0.0)) * weight ** (k - 1) for k in (1, 2, 3)), F.lit(0.0))
    ends = ends.select(key, "_chunk", *[carry(n).alias(f"_carry_{n}") for n in values])
    got = rows.join(ends, [key, "_chunk"]).withColumns({n: F.col(f"_own_{n}") + F.col(f"_carry_{n}") * grown * keep for n in values})
    return got.drop("_row", "_chunk", "_i", *[f"_{k}_{n}" for n in values for k in ("own", "carry")])


def calendar(df: DataFrame, step: str, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """(key, ts): every ``step`` from each key's first time to its last; in stretches of 10,000 steps, so no array is long."""
    ends = df.groupBy(key).agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    far = F.expr(f"INTERVAL {int(step.split()[0]) * 10_000} {step.split()[1]}")
    ends = ends.select(key, "b", F.explode(F.sequence("a", "b", far)).alias("a")).repartition(key, "a")
    one = F.expr(f"INTERVAL {step}")
    return ends.select(key, F.explode(F.sequence("a", F.least("b", F.col("a") + far - one), one)).alias(ts))


def running(df: DataFrame, aggs: dict[str, tuple[str, str]], key: str = "symbol", ts: str = "ts", bucket: str = "day", tie: tuple[str, ...] = ()) -> DataFrame:
    """Running sums and maxima from each key's start: name -> ("sum" or "max", column), in two levels by time bucket."""
    part = df.withColumn("_bucket", F.date_trunc(bucket, ts))
    fn = {"sum": F.sum, "max": F.max}
    totals = part.groupBy(key, "_bucket").agg(*[fn[how](c).alias(f"_t_{k}") for k, (how, c) in aggs.items()])
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, "_bucket", *[fn[how](f"_t_{k}").over(before).alias(f"_b_{k}") for k, (how, _) in aggs.items()])
    own = Window.partitionBy(key, "_bucket").orderBy(ts, *tie).rowsBetween(Window.unboundedPreceding, 0)
    out = part.join(totals, [key, "_bucket"])
    for k, (how, c) in aggs.items():
        mine = fn[how](c).over(own)
        before_k = F.col(f"_b_{k}")
        out = out.withColumn(k, F.coalesce(before_k, F.lit(0.0)) + mine if how == "sum" else F.greatest(before_k, mine))
    return out.drop("_bucket", *[f"_b_{k}" for k in aggs])
