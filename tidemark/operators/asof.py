"""As-of joins by availability: the latest value known at a time, for one or many right sides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def backward(
    left: DataFrame, right: DataFrame, cols: list[str], key: str = "symbol", left_ts: str = "ts", right_ts: str = "available_at", strict: bool = False,
    bucket: str = "day",
) -> DataFrame:
    """``left`` with ``cols`` and ``matched_at`` of the latest right row at or before (``strict``: before) its time.

    Both sides are united and the last right row is carried forward within (key, time bucket); what comes from earlier
    buckets is the last row of each, carried over a table with one row for each bucket. So no key is sorted in one task,
    and no pair of rows is ever compared. Of right rows at one time any one is taken: keep them unique.
    """
    value = F.struct(F.col(right_ts).alias("matched_at"), *cols)
    r = right.select(key, F.col(right_ts).alias("_t"), value.alias("_v"), F.lit(1 if strict else 0).alias("_side")).where("_t is not null")
    l = left.withColumn("_t", F.col(left_ts)).withColumn("_side", F.lit(0 if strict else 1)).withColumn("_left", F.lit(True))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_bucket", F.date_trunc(bucket, "_t"))
    last = both.groupBy(key, "_bucket").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_t"))).alias("_end"))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(key, "_bucket", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    within = Window.partitionBy(key, "_bucket").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_own", F.last("_v", ignorenulls=True).over(within)).where("_left").join(carry, [key, "_bucket"], "left")
    found = F.coalesce("_own", "_carry")
    return both.withColumn("_found", found).select(*[F.col(c) for c in left.columns], "_found.matched_at", *[f"_found.{c}" for c in cols])


@dataclass(frozen=True)
class Context:
    """A right side: its ``rows``, the ``cols`` to carry, the column of the time they can be used ``at``; ``strict``: only after that
    time; ``keyed``: whether it has the key, or holds for every key."""

    rows: DataFrame
    cols: list[str]
    at: str = "available_at"
    strict: bool = False
    keyed: bool = True


def contexts(left: DataFrame, rights: dict[str, Context], key: str = "symbol", left_ts: str = "ts", bucket: str = "day") -> DataFrame:
    """``left`` with the columns of the latest row of each of ``rights`` at or before its time, and ``<name>_at``, when that was usable.

    All sides are united once and dealt once by key and time bucket; one pass in order of time carries the last row of
    every right side, and a table with one row for each bucket carries them over bucket ends. Rows that are equal in
    every column stay apart. Two right rows of a key at one time leave no latest one: the job stops. Right rows without a
    time are left out; a left row without a time finds nothing.
    """
    names = list(rights)
    place = {"strict": 2, "exact": 0}
    both = left.withColumns({"_t": F.col(left_ts).cast("timestamp"), "_side": F.lit(1)})
    both = both.withColumn("_left", F.lit(True))
    for n, r in rights.items():
        rows = r.rows if r.keyed else r.rows.join(F.broadcast(left.select(key).distinct()), F.lit(True))
        value = F.struct(F.col(r.at).cast("timestamp").alias(f"{n}_at"), *r.cols)
        rows = rows.select(key, F.col(r.at).cast("timestamp").alias("_t"), F.lit(place["strict" if r.strict else "exact"]).alias("_side"), value.alias(f"_v_{n}"))
        both = both.unionByName(rows.where("_t is not null"), allowMissingColumns=True)
    both = both.withColumn("_bucket", F.date_trunc(bucket, "_t")).repartition(key, "_bucket")
    ends = both.groupBy(key, "_bucket").agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("_t"))).alias(f"_e_{n}") for n in names])
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(key, "_bucket", *[F.last(f"_e_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in names])
    order = Window.partitionBy(key, "_bucket").orderBy("_t", "_side")
    own = {f"_o_{n}": F.last(f"_v_{n}", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)) for n in names}
    last = {f"_p_{n}": F.last(f"_v_{n}.{n}_at", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)) for n in names}
    both = both.withColumns(own | last)
    keep = F.coalesce(F.col("_left"), F.lit(False))
    for n in names:
        keep = F.when(F.col(f"_v_{n}.{n}_at") == F.col(f"_p_{n}"), F.raise_error(F.lit(f"two rows of {n} at one time")).cast("boolean")).otherwise(keep)
    both = both.where(keep).join(carry, [key, "_bucket"], "left")
    found = {f"_f_{n}": F.coalesce(f"_o_{n}", f"_c_{n}") for n in names}
    return both.withColumns(found).select(*[F.col(c) for c in left.columns], *[f"_f_{n}.{c}" for n, r in rights.items() for c in (f"{n}_at", *r.cols)])


def age_minutes(ts: str = "ts", at: str = "matched_at") -> Column:
    return (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / F.lit(60e6)


def with_age(df: DataFrame, limit: float, ts: str = "ts", at: str = "matched_at") -> DataFrame:
    """Add ``age_min`` and ``stale`` (older than ``limit`` minutes, or nothing matched)."""
    return df.withColumn("age_min", age_minutes(ts, at)).withColumn("stale", F.coalesce(F.col("age_min") > limit, F.lit(True)))


def mask_stale(df: DataFrame, cols: list[str], limit: float) -> DataFrame:
    """Null ``cols`` where ``age_min`` is ``limit`` or more."""
    return df.withColumns({c: F.when(F.col("age_min") < limit, F.col(c)) for c in cols})


def attached(left: DataFrame, right: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """``left`` with ``cols`` of the one right row of its key; raises where a key is missing on the right or there twice."""
    one = right.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in cols])
    got = left.join(one, key, "left")
    bad = got.agg(F.count_if(F.col("_n").isNull()).alias("none"), F.count_if(F.col("_n") > 1).alias("many")).first()
    if bad["none"] or bad["many"]:
        raise ValueError(f"{bad['none']} rows without and {bad['many']} with several on the right")
    return got.drop("_n")
