"""Streams whose rows are taken in order of event time, however they arrive: trigger sequences, alerts, missing bars, censoring,
retained stories. Needs the RocksDB state store (see ``store``).

Rows wait in the state until the watermark has passed them, so what comes out doesn't depend on micro-batches; rows that
come later than the watermark allows are left out by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.opportunity import advance

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def store(spark: SparkSession) -> None:
    """Set the state store that these operators need; to be called before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class InOrder(StatefulProcessor):
    """Buffers the rows of a key and hands them to ``fold`` in order of (time, the other columns) once the watermark has passed.

    ``fold(state, rows)`` gets the state so far (None at first) and rows as tuples that begin with the time in
    microseconds, and returns the new state and the tuples to put out. One timer a key stands at its earliest row.
    """

    def __init__(self, columns: str, state: str, out: list[str], fold: Callable):
        self.columns, self.state, self.out, self.fold = columns, state, out, fold
        self.width = len(columns.split(", "))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", self.columns)
        self.kept = handle.getValueState("kept", self.state)
        self.alarm = handle.getValueState("alarm", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            own = frame.iloc[:, frame.shape[1] - self.width :]  # after key and watermark column
            values = [tuple(None if pd.isna(x) else x for x in r) for r in own.itertuples(index=False, name=None)]
            values = [(int(v[0]), *v[1:]) for v in values if v[0] is not None]
            if values:
                self.buffer.appendList(values)
                first = min([v[0] for v in values] + ([first] if first is not None else []))
        if first is not None:
            self._wake(-(-first // 1000))
        return iter([])

    def _wake(self, at: int) -> None:
        now = self.alarm.get()[0] if self.alarm.exists() else None
        if now is None or at < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.buffer.get())
        due = sorted((tuple(r) for r in rows if r[0] <= passed), key=lambda r: (r[0], str(r[1:])))
        wait = [tuple(r) for r in rows if r[0] > passed]
        self.buffer.clear()
        self.alarm.clear()
        if wait:
            self.buffer.put(wait)
            self._wake(-(-min(r[0] for r in wait) // 1000))
        state, found = self.fold(tuple(self.kept.get()) if self.kept.exists() else None, due)
        if state is None:
            self.kept.clear()
        else:
            self.kept.update(state)
        if found:
            yield pd.DataFrame([(key[0], pd.Timestamp(r[0], unit="us"), *r[1:]) for r in found], columns=self.out)

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, late: str, columns: dict[str, Column], kinds: str, state: str, out: str, fold: Callable, key: str, ts: str) -> DataFrame:
    """``rows`` through ``InOrder``: ``columns`` with ``kinds`` follow the time; ``out`` follows key and time."""
    kind = rows.schema[key].dataType.simpleString()
    small = rows.withColumn("_time", F.col(ts)).withWatermark("_time", late)
    small = small.select(F.col(key).alias("_key"), "_time", F.unix_micros("_time").alias("_us"), *[c.alias(f"_{n}") for n, c in columns.items()])
    names = [key, ts, *[x.split()[0] for x in out.split(", ")]]
    processor = InOrder(f"us long, {kinds}".rstrip(", "), state, names, fold)
    return small.groupBy("_key").transformWithStateInPandas(processor, f"{key} {kind}, {ts} timestamp, {out}", "Append", "EventTime")


def trigger_sequences(bars: DataFrame, steps: list[Column], reset: Column, expiry: int, late: str, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """(key, ts, fired): the bars where all ``steps`` have come one after another, as ``opportunity.triggers`` finds them.

    State: the number of the last bar, how far a sequence has come and at which bar. A key's bars have times of their own.
    """
    flags = {"reset": F.coalesce(reset, F.lit(False))} | {f"s{k}": F.coalesce(c, F.lit(False)) for k, c in enumerate(steps)}
    n = len(steps)

    def fold(state, rows):
        row, step, at = state or (-1, 0, 0)
        out = []
        for us, back, *hit in rows:
            row += 1
            if back or any(hit):
                step, at, _, fired = advance(step, at, row, back, hit, n, expiry)
                if fired:
                    out.append((us, True))
        return (row, step, at), out

    kinds = "reset boolean, " + ", ".join(f"s{k} boolean" for k in range(n))
    return in_order(bars, late, flags, kinds, "row long, step long, at long", "fired boolean", fold, key, ts)


def alerts(scores: DataFrame, threshold: float, cooldown_s: int, late: str, key: str = "symbol", ts: str = "ts", score: str = "score") -> DataFrame:
    """(key, ts, score): rows at or above the threshold at least ``cooldown_s`` after the key's last alert, as ``gates.spaced`` takes them."""

    def fold(state, rows):
        last, out = state[0] if state else None, []
        for us, x in rows:
            if x is not None and x >= threshold and (last is None or us - last >= cooldown_s * 1_000_000):
                last = us
                out.append((us, x))
        return None if last is None else (last,), out

    return in_order(scores, late, {"score": F.col(score).cast("double")}, "score double", "last long", "score double", fold, key, ts)


def gaps(bars: DataFrame, step_s: int, hold: int, late: str, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """(key, ts, missing, censored) of each bar: how many bars are missing before it, and whether the ``hold`` bars after it
    aren't all there at their steps.

    A bar comes out when its path is whole or the first missing bar shows by a later one; times that repeat count once. State:
    the bars whose path is open, at most ``hold``.
    """
    step = step_s * 1_000_000

    def fold(state, rows):
        last, paths = (state[0], list(state[1])) if state else (None, [])  # open bars one after the other, with no gap between
        before, out = (state[2] if state else 0), []
        for (us,) in rows:
            if us == last:
                continue
            missing = 0 if last is None else max(0, (us - last) // step - 1)
            if last is not None and us - last != step:
                out += [(t, before if i == 0 else 0, True) for i, t in enumerate(paths)]
                paths, before = [], missing
            paths.append(us)
            last = us
            if len(paths) > hold:
                out.append((paths.pop(0), before, False))
                before = 0
        return (last, paths, before), out

    return in_order(bars, late, {}, "", "last long, paths array<long>, before long", "missing long, censored boolean", fold, key, ts)


def retained(articles: DataFrame, key: str, hours: int, late: str, id_col: str = "id", ts: str = "ts") -> DataFrame:
    """(key, ts, id): articles that no *kept* one of their key within ``hours`` comes before, as ``stories.exact_echoes`` keeps them.

    State: the time of the last kept one; echoes don't move it. For URL and title apply it to one, then to what that keeps.
    """
    kind = articles.schema[id_col].dataType.simpleString()

    def fold(state, rows):
        last, out = state[0] if state else None, []
        for us, i in rows:
            if last is None or us - last >= hours * 3_600_000_000:
                last = us
                out.append((us, i))
        return None if last is None else (last,), out

    return in_order(articles, late, {"id": F.col(id_col)}, f"id {kind}", "last long", f"{id_col} {kind}", fold, key, ts)
