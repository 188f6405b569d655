"""Greedy choices along time: each taken span rules out those that start before its end."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds of a time bucket: a bucket of a key is folded in one task.
BUCKET = 30 * 86_400_000_000
#: Spans of a bucket at most, as long as a 1024th of BUCKET has no more.
ROWS = 100_000


def bucket_width(spans: DataFrame, bucket: int, most: int = ROWS) -> int:
    """``bucket``, halved up to ten times until no bucket of a key has more than ``most`` spans: one count by key and time cell."""
    cell, k = max(1, bucket >> 10), F.explode(F.sequence(F.lit(0), F.lit(10)))
    cells = spans.groupBy("_key", F.floor(F.col("_s") / cell).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.withColumn("k", k).groupBy("k", "_key", F.expr("shiftright(c, 10 - k)").alias("c")).agg(F.sum("n").alias("n"))
    fits = [r.k for r in sizes.groupBy("k").agg(F.max("n").alias("n")).where(F.col("n") <= most).collect()]
    return max(1, bucket >> min(fits, default=10))


def following(s: np.ndarray, e: np.ndarray, touch: bool) -> np.ndarray:
    """Of sorted starts, the place of the first that may follow each span; the length if none is there."""
    return np.maximum(np.searchsorted(s, e, side="left" if touch else "right"), np.arange(1, len(s) + 1))


def chained_spans(spans: DataFrame, touch: bool, bucket: int = BUCKET) -> DataFrame:
    """(_id, taken) of ``spans`` (_key, _id, _s, _e): in order of (_s, _id), a span is taken if it starts after the last
    taken one's end (``touch``: or at it).

    Three passes. Within a time bucket of a key, by pointer doubling, where a chain that begins at each span leaves the
    bucket. Over the buckets of a key, where the chain enters each: a stream of the spans that it may enter by, those that
    start before all earlier buckets have ended and one more. Then each bucket is marked from its entry. Results don't depend
    on the bucket's size.
    """
    rows = spans.withColumn("_b", F.floor(F.col("_s") / bucket_width(spans, bucket)))
    key, ident = (spans.schema[c].dataType.simpleString() for c in ("_key", "_id"))

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_s", "_id"])
        s, e = pdf["_s"].to_numpy(), pdf["_e"].to_numpy()
        nxt = np.append(following(s, e, touch), len(s))
        end = np.arange(len(s) + 1)  # the last span of the chain so far
        while (nxt[:-1] < len(s)).any():
            end = np.where(nxt < len(s), end[np.minimum(nxt, len(s) - 1)], end)
            nxt = nxt[nxt]
        return pd.DataFrame({"_key": pdf["_key"], "_b": pdf["_b"], "_at": np.arange(len(s)), "_s": s, "_prev": np.r_[s[:1] - 1, s[:-1]], "_out": e[end[:-1]]})

    left = rows.groupBy("_key", "_b").applyInPandas(leave, f"_key {key}, _b long, _at long, _s long, _prev long, _out long")
    before = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("_key", "_b").agg(F.max("_e").alias("_e")).select("_key", "_b", F.max("_e").over(before).alias("_until"))
    left = left.join(ends, ["_key", "_b"]).where((F.col("_at") == 0) | (F.col("_prev") <= F.col("_until"))).drop("_prev", "_until")

    def enter(frames):
        now, until, inside = None, None, None
        for f in frames:
            change = np.flatnonzero(np.r_[True, (f["_key"].to_numpy()[1:] != f["_key"].to_numpy()[:-1]) | (f["_b"].to_numpy()[1:] != f["_b"].to_numpy()[:-1])])
            found = []
            for a, z in zip(change.tolist(), [*change[1:].tolist(), len(f)], strict=True):
                k, b = f["_key"].iloc[a], int(f["_b"].iloc[a])
                if k != now:
                    now, until, inside = k, None, None
                if inside == b:
                    continue
                s = f["_s"].to_numpy()[a:z]
                at = 0 if until is None else int(np.searchsorted(s, until, side="left" if touch else "right"))
                if at < len(s):
                    inside, until = b, int(f["_out"].iloc[a + at])
                    found.append((k, b, int(f["_at"].iloc[a + at])))
            yield pd.DataFrame(found, columns=["_key", "_b", "_entry"])

    entries = left.repartition("_key").sortWithinPartitions("_key", "_b", "_at").mapInPandas(enter, f"_key {key}, _b long, _entry long")

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_s", "_id"])
        taken, at = np.zeros(len(pdf), bool), pdf["_entry"].iloc[0]
        if pd.notna(at):
            nxt, at = following(pdf["_s"].to_numpy(), pdf["_e"].to_numpy(), touch).tolist(), int(at)
            while at < len(pdf):
                taken[at] = True
                at = nxt[at]
        return pd.DataFrame({"_id": pdf["_id"], "taken": taken})

    return rows.join(entries, ["_key", "_b"], "left").groupBy("_key", "_b").applyInPandas(mark, f"_id {ident}, taken boolean")
