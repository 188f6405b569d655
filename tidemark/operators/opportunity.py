"""Opportunity windows and trigger sequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.gates import spaced
from tidemark.operators.intervals import range_join
from tidemark.operators.series import islands, numbered, previous, rolling
from tidemark.sources.scratch import stage


def edge_windows(bars: DataFrame, on: Column, step: Column, aggs: dict[str, Column], key: str = "symbol") -> DataFrame:
    """Runs of bars where ``on`` holds, cut at gaps: start, end, bars and ``aggs`` of each."""
    rows = previous(bars.withColumn("_on", F.coalesce(on, F.lit(False))), {"_bt": "ts", "_bo": "_on"}, key)
    new = F.coalesce(F.col("ts") != F.col("_bt") + step, F.lit(True)) | (F.col("_on") != F.coalesce(F.col("_bo"), ~F.col("_on")))
    rows = rows.withColumn("_new", new)
    rows = islands(rows, F.col("_new"), "_run", key).where("_on")
    return rows.groupBy(key, "_run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("bars"), *[a.alias(k) for k, a in aggs.items()]).drop("_run")


def event_windows(eligible: DataFrame, duration_s: int, key: str = "symbol") -> DataFrame:
    """(window_id, key, start, end): a window opens at an eligible bar once ``duration_s`` has passed since the last one opened."""
    bars = eligible.withColumn("_id", F.concat_ws("|", key, F.unix_timestamp("ts").cast("string")))
    taken = spaced(bars, "_id", duration_s, key).where("taken").select("_id")
    got = bars.join(taken, "_id", "left_semi")
    return got.select(F.substring(F.sha2("_id", 256), 1, 20).alias("window_id"), key, F.col("ts").alias("start"), (F.col("ts") + F.make_dt_interval(secs=F.lit(duration_s))).alias("end"))


def regime_slices(compacted: DataFrame, far: float) -> DataFrame:
    """Rows near the lower rail in a rising regime as ``slice`` long, near the upper in a falling one as short."""
    long, short = (F.col("regime") == 1) & (F.col("centre") <= -far), (F.col("regime") == -1) & (F.col("centre") >= far)
    return compacted.where(long | short).withColumn("slice", F.when(long, "long").otherwise("short"))


def triggers(bars: DataFrame, steps: list[Column], reset: Column, expiry: int, key: str = "symbol") -> DataFrame:
    """See ``_sequence``: ``bars`` with ``fired``, where a sequence ends."""
    return _sequence(bars, steps, reset, expiry, key, "fired")


def advance(state: int, at: int, row: int, reset: bool, hit: list[bool], steps: int, expiry: int) -> tuple[int, int, bool, bool]:
    """(state, at, began, fired) after bar number ``row`` with flags: ``state`` steps have come, the last at bar ``at``."""
    far = row - at
    if state and far > expiry + 1:  # a bar without flags ended it
        state = 0
    if reset:
        return 0, at, False, False
    if state == 0:
        return int(hit[0]), row if hit[0] else at, bool(hit[0]), False
    if far > expiry:
        return 0, at, False, False
    if hit[state]:
        fired = state == steps - 1
        return 0 if fired else state + 1, row, False, fired
    return state, at, False, False


def _sequence(bars: DataFrame, steps: list[Column], reset: Column, expiry: int, key: str, what: str) -> DataFrame:
    """``bars`` with ``fired``: all steps came one after another, each on a later bar and within ``expiry`` bars of the one
    before; or with ``armed``: the first step came while nothing had begun.

    ``reset`` clears the state and so does a pause beyond ``expiry``: each stretch between is folded on its own, in parallel,
    over its bars with a flag. The bar that fires or expires can't arm again.
    """
    rows = numbered(bars, key, name="_row").withColumn("_reset", F.coalesce(reset, F.lit(False)))
    rows = rows.withColumns({f"_s{k}": F.coalesce(c, F.lit(False)) for k, c in enumerate(steps)})
    n, flags = len(steps), [f"_s{k}" for k in range(len(steps))]
    kind = bars.schema[key].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        state, at, out = 0, 0, []
        for row, reset_here, *hit in zip(pdf["_row"], pdf["_reset"], *(pdf[f] for f in flags), strict=True):
            state, at, began, fired = advance(state, at, row, reset_here, hit, n, expiry)
            out.append(began if what == "armed" else fired)
        return pd.DataFrame({key: pdf[key], "ts": pdf["ts"], what: out})

    # Bars without any flag change nothing but the time that has passed; a longer pause, or a reset, ends what was begun.
    small = stage(rows.select(key, "ts", "_row", "_reset", *flags).where(" or ".join(["_reset", *flags])), "flagged")
    small = previous(small, {"_b": "_row"}, key)
    small = islands(small, F.col("_reset") | (F.col("_row") - F.coalesce("_b", F.col("_row")) > expiry + 1), "_seg", key)
    folded = small.select(key, "ts", "_seg", "_row", "_reset", *flags).groupBy(key, "_seg").applyInPandas(fold, f"{key} {kind}, ts timestamp, {what} boolean").where(what)
    got = bars.join(folded, [key, "ts"], "left").withColumn(what, F.coalesce(what, F.lit(False)))
    return got.select(*bars.columns, what)


def two_setups(ctx: DataFrame, expiry: int, outer: float = 0.5, inner: float = 0.2) -> DataFrame:
    """``setup`` (edge or midline) and ``side`` of bars where a sequence ends, null elsewhere; an edge goes before a midline.

    Edge: beyond ``outer`` on the far side of the channel's middle, then back inside. Midline: within ``inner`` of the
    middle, then beyond it on the regime's side. Bars without an allowed regime (0, or the other side) reset a sequence.
    """
    ctx = stage(ctx, "context")  # read for each of the four sequences
    c, out = F.col("centre"), None
    for side in (1, -1):
        reset = F.coalesce(F.col("regime") != side, F.lit(True))
        for name, steps in (("edge", [c * side <= -outer, c * side > -outer]), ("midline", [F.abs(c) <= inner, c * side > inner])):
            got = triggers(ctx, steps, reset, expiry).where("fired").select("symbol", "ts", F.lit(name).alias("setup"), F.lit(side).alias("side"))
            out = got if out is None else out.unionByName(got)
    best = out.groupBy("symbol", "ts").agg(F.min(F.struct("setup", (-F.col("side")).alias("k"))).alias("m"))
    return ctx.join(best.select("symbol", "ts", "m.setup", (-F.col("m.k")).alias("side")), ["symbol", "ts"], "left")


def lifecycles(bars: DataFrame, first: Column, second: Column, reset: Column, expiry: int, key: str = "symbol") -> DataFrame:
    """(key, ts, fate, bars) of every trigger that arms: confirmed by ``second``, cancelled by ``reset`` or expired, and after
    how many bars (``expiry`` + 1 if it expired). Triggers are armed as in ``triggers``.
    """
    first, second, reset = (F.coalesce(c, F.lit(False)) for c in (first, second, reset))
    flagged = bars.withColumns({"_a": first, "_b": second, "_c": reset})

    def then(f):
        w = f.order.rowsBetween(1, expiry)
        ahead = F.collect_list(F.struct("_b", "_c")).over(w)
        return {"_k": F.array_position(F.transform(ahead, lambda x: (x["_b"] | x["_c"]).cast("int")), 1), "_what": F.filter(ahead, lambda x: x["_b"] | x["_c"])}

    got = rolling(flagged, 1, then, key=key, ahead=expiry)
    got = armed(got, F.col("_a"), F.col("_b"), F.col("_c"), expiry, key).where("armed")
    hit = F.try_element_at("_what", F.lit(1))
    fate = F.when(hit.isNull(), "expired").when(hit["_c"], "cancelled").otherwise("confirmed")
    return got.select(key, "ts", fate.alias("fate"), F.when(hit.isNull(), F.lit(expiry + 1)).otherwise(F.col("_k")).cast("long").alias("bars"))


def armed(bars: DataFrame, first: Column, second: Column, reset: Column, expiry: int, key: str = "symbol") -> DataFrame:
    """``bars`` with ``armed``: where a two-step sequence begins."""
    return _sequence(bars, [first, second], reset, expiry, key, "armed")


def confirmed_windows(bars: DataFrame, first: Column, second: Column, reset: Column, expiry: int, cooldown_s: int, hold_s: int) -> DataFrame:
    """(window_id, symbol, start, end): a first trigger confirmed by a later second one, then none for ``cooldown_s``."""
    fired = triggers(bars, [first, second], reset, expiry).where("fired")
    return event_windows(fired, cooldown_s).withColumn("end", F.col("start") + F.make_dt_interval(secs=F.lit(hold_s)))


def fast_confirmed(coarse: DataFrame, fine: DataFrame, armed: Column, level: Column, coarse_s: int, fine_s: int, wait_s: int, buffer_bps: float) -> DataFrame:
    """(symbol, armed_ts, confirmed_ts): coarse bars that arm, confirmed by the first fine close above ``level`` by a buffer.

    The wait begins when the coarse bar is whole. A missing fine bar before the confirmation makes it void.
    """
    a = coarse.where(armed).select("symbol", F.col("ts").alias("armed_ts"), (F.col("ts") + F.make_dt_interval(secs=F.lit(coarse_s))).alias("_from"), level.alias("_level"))
    a = a.withColumn("_until", F.col("_from") + F.make_dt_interval(secs=F.lit(wait_s)))
    p = range_join(a, fine.select("symbol", F.col("ts").alias("bar_ts"), "close"), "_from", "_until", ts="bar_ts", bucket_s=max(600, wait_s))
    p = p.withColumn("_k", F.row_number().over(Window.partitionBy("symbol", "armed_ts").orderBy("bar_ts")) - 1)  # bounded by the wait
    due = F.col("_from") + F.make_interval(secs=F.col("_k") * fine_s)
    ok = F.col("close") >= F.col("_level") * (1 + buffer_bps / 1e4)
    got = p.groupBy("symbol", "armed_ts").agg(F.min(F.when(ok, F.col("bar_ts"))).alias("confirmed_ts"), F.min(F.when(F.col("bar_ts") != due, due)).alias("_gap"))
    return got.where("confirmed_ts is not null and (_gap is null or confirmed_ts < _gap)").select("symbol", "armed_ts", "confirmed_ts")


def observation_episodes(rows: DataFrame, least: int, each_side: int, most: int, fold: str = "fold") -> DataFrame:
    """``rows`` (id, fold, ts, side) with ``episode``: in a fold's order of time an episode ends with the row by which it has
    ``least`` rows and ``each_side`` of both sides, or ``most`` rows. A fold is one group: keep folds bounded in time.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", fold)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "id"])
        episode, up, down, out = 0, 0, 0, []
        for s in pdf["side"]:
            up, down = up + (s > 0), down + (s < 0)
            out.append(episode)
            if up + down >= most or (up + down >= least and min(up, down) >= each_side):
                episode, up, down = episode + 1, 0, 0
        return pd.DataFrame({"id": pdf["id"], fold: pdf[fold], "episode": out})

    return rows.select("id", fold, "ts", "side").where("side <> 0").groupBy(fold).applyInPandas(run, f"id {kinds['id']}, {fold} {kinds[fold]}, episode long")
