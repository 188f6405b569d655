"""Forward-path labels: horizon returns, first touches of barriers on finer bars, bracket outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import range_join
from tidemark.operators.series import previous, rolling


def dead_zone(bars: DataFrame, bps: float, horizon: int = 1, col: str = "label") -> DataFrame:
    """2 up, 0 down, 1 within ``bps`` of no change over ``horizon`` bars; -1 where the horizon isn't there."""
    got = rolling(bars, 1, lambda f: {"_r": F.lead("close", horizon).over(f.order) / F.col("close") - 1}, ahead=horizon)
    r = F.col("_r")
    return got.withColumn(col, F.when(r.isNull(), -1).when(r > bps / 1e4, 2).when(r < -bps / 1e4, 0).otherwise(1)).drop("_r")


def next_in_session(bars: DataFrame, bps: float, step_s: int) -> DataFrame:
    """Next-bar label; -1 if the next bar doesn't follow at once."""
    near = F.unix_timestamp("_next") - F.unix_timestamp("ts") == step_s
    got = previous(dead_zone(bars, bps), {"_next": "ts"}, ahead=True)
    return got.withColumn("label", F.when(F.coalesce(near, F.lit(False)), F.col("label")).otherwise(-1)).drop("_next")


def triple_barrier(bars: DataFrame, up: float, down: float, hold: int) -> DataFrame:
    """First barrier within ``hold`` bars: 2 up, 0 down (down wins a tie), 1 neither, -1 undecided with the path cut short."""
    bars = rolling(bars, 1, lambda f: {"_ahead": F.collect_list(F.struct("high", "low")).over(f.order.rowsBetween(1, hold))}, ahead=hold)
    ahead = F.col("_ahead")
    hit = lambda test: F.array_position(F.transform(ahead, lambda x: test(x).cast("int")), 1)
    d, u = hit(lambda x: x["low"] <= F.col("close") * (1 - down)), hit(lambda x: x["high"] >= F.col("close") * (1 + up))
    far = F.lit(hold + 1)
    first_d, first_u = F.when(d > 0, d).otherwise(far), F.when(u > 0, u).otherwise(far)
    none = F.when(F.size(ahead) < hold, -1).otherwise(1)
    return bars.withColumn("label", F.when((d == 0) & (u == 0), none).when(first_d <= first_u, 0).otherwise(2)).drop("_ahead")


def paths(decisions: DataFrame, bars: DataFrame, hold_s: int, start: str = "ts", bucket_s: int | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Each decision with the bars of [start, start + hold): columns of both, the bar's as ``bar_*``; by time buckets."""
    fine = bars.select("symbol", *[F.col(c).alias(f"bar_{c}") for c in ("ts", "open", "high", "low", "close", *extra)])
    d = decisions.withColumn("_until", F.col(start) + F.make_dt_interval(secs=F.lit(hold_s)))
    return range_join(d, fine, start, "_until", ts="bar_ts", bucket_s=bucket_s or max(600, hold_s)).drop("_until")


def first_touch(decisions: DataFrame, bars: DataFrame, id_col: str, barriers: dict[str, object], hold_s: int, expected: int | None = None) -> DataFrame:
    """(id, bars, last_close, and the time of the first bar for which each barrier's condition holds).

    ``barriers``: name -> Column over the decision's columns and bar_*. One join and one aggregate, whatever the number.
    ``expected`` adds ``whole``, whether the path has that many bars. Decisions without any bar aren't returned.
    """
    p = paths(decisions, bars, hold_s)
    got = p.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("bars"), F.max_by("bar_close", "bar_ts").alias("last_close"), F.max("bar_ts").alias("last_ts"),
        *[F.min(F.when(test, F.col("bar_ts"))).alias(k) for k, test in barriers.items()],
    )
    return got.withColumn("whole", F.col("bars") == expected) if expected else got


def bracket(decisions: DataFrame, bars: DataFrame, id_col: str, hold_s: int, cost_bps: float = 0.0) -> DataFrame:
    """(id, outcome, exit_ts, r_gross, r_net) of decisions with entry, stop, target and side (1 or -1).

    The stop goes before the target in one bar; with neither the last close ends the trade. R is profit over the risk
    taken, costs are in basis points of the entry.
    """
    side = F.col("side")
    sl = F.when(side > 0, F.col("bar_low") <= F.col("stop")).otherwise(F.col("bar_high") >= F.col("stop"))
    tp = F.when(side > 0, F.col("bar_high") >= F.col("target")).otherwise(F.col("bar_low") <= F.col("target"))
    touch = first_touch(decisions, bars, id_col, {"sl": sl, "tp": tp}, hold_s)
    stopped = F.col("sl").isNotNull() & (F.col("tp").isNull() | (F.col("sl") <= F.col("tp")))
    outcome = F.when(stopped, "stop").when(F.col("tp").isNotNull(), "target").otherwise("timeout")
    price = F.when(F.col("outcome") == "stop", F.col("stop")).when(F.col("outcome") == "target", F.col("target")).otherwise(F.col("last_close"))
    when = F.when(F.col("outcome") == "stop", F.col("sl")).when(F.col("outcome") == "target", F.col("tp")).otherwise(F.col("last_ts"))
    risk = F.abs(F.col("entry") - F.col("stop"))
    got = decisions.join(touch.withColumn("outcome", outcome), id_col)
    got = got.withColumn("r_gross", (price - F.col("entry")) * F.col("side") / risk)
    return got.select(id_col, "outcome", when.alias("exit_ts"), "r_gross", (F.col("r_gross") - F.col("entry") * cost_bps / 1e4 / risk).alias("r_net"))


def excursions(decisions: DataFrame, bars: DataFrame, id_col: str, hold_s: int) -> DataFrame:
    """(id, up_bps, down_bps): the largest move each way from ``entry`` over the hold."""
    bps = lambda x: (x / F.first("entry") - 1) * 1e4
    return paths(decisions, bars, hold_s).groupBy(id_col).agg(bps(F.max("bar_high")).alias("up_bps"), bps(F.min("bar_low")).alias("down_bps"))


def symmetric_touch(decisions: DataFrame, bars: DataFrame, id_col: str, move: float, hold_s: int, expected: int) -> DataFrame:
    """(id, label): up, down, ambiguous (both in one bar), none, or censored where the path has a bar missing."""
    barriers = {"up": F.col("bar_high") >= F.col("entry") * (1 + move), "down": F.col("bar_low") <= F.col("entry") * (1 - move)}
    t = first_touch(decisions, bars, id_col, barriers, hold_s, expected)
    u, d = F.col("up"), F.col("down")
    label = (
        F.when(~F.col("whole"), "censored").when(u.isNull() & d.isNull(), "none").when(u == d, "ambiguous")
        .when(d.isNull() | (u < d), "up").otherwise("down")
    )
    return t.select(id_col, label.alias("label"))


def bracket_grid(decisions: DataFrame, bars: DataFrame, id_col: str, stop: float, multiples: list[float], hold_s: int) -> DataFrame:
    """(id, side, multiple, outcome) for both sides and several targets, as shares of entry; the path is joined once."""
    tests = {}
    for side, name in ((1, "long"), (-1, "short")):
        tests[f"{name}_sl"] = F.col("bar_low") <= F.col("entry") * (1 - stop) if side > 0 else F.col("bar_high") >= F.col("entry") * (1 + stop)
        for k, m in enumerate(multiples):
            tests[f"{name}_{k}"] = F.col("bar_high") >= F.col("entry") * (1 + stop * m) if side > 0 else F.col("bar_low") <= F.col("entry") * (1 - stop * m)
    t = first_touch(decisions, bars, id_col, tests, hold_s)
    rows = []
    for name in ("long", "short"):
        for k, m in enumerate(multiples):
            sl, tp = F.col(f"{name}_sl"), F.col(f"{name}_{k}")
            out = F.when(sl.isNotNull() & (tp.isNull() | (sl <= tp)), "stop").when(tp.isNotNull(), "target").otherwise("timeout")
            rows.append(F.struct(F.lit(name).alias("side"), F.lit(float(m)).alias("multiple"), out.alias("outcome")))
    return t.select(id_col, F.explode(F.array(*rows)).alias("x")).select(id_col, "x.*")


def exit_labels(decisions: DataFrame, bars: DataFrame, id_col: str, hold_s: int, step_s: int, gone: Column | None = None, cost_bps: float = 0.0, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, outcome, exit_ts, r_gross, r_net) of decisions with side, entry, stop and target, over bars of ``step_s`` seconds.

    The first of: the stop, the target, the bar where ``gone`` (over bar_* of ``extra``) holds (outcome regime, at its
    close), or the first missing bar (censored, no R). In one bar they go in that order. With none the last close ends the
    trade (timeout). Every decision gets a row.
    """
    step = lambda k: F.col("ts") + F.make_interval(secs=k * step_s)
    side = F.col("side")
    sl = F.when(side > 0, F.col("bar_low") <= F.col("stop")).otherwise(F.col("bar_high") >= F.col("stop"))
    tp = F.when(side > 0, F.col("bar_high") >= F.col("target")).otherwise(F.col("bar_low") <= F.col("target"))
    out = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    p = paths(decisions, bars, hold_s, extra=extra)
    p = p.withColumn("_k", F.row_number().over(Window.partitionBy(id_col).orderBy("bar_ts")) - 1)  # a decision's path, bounded by the hold
    at = lambda on: F.min(F.when(on, F.col("bar_ts")))
    got = p.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("_n"), at(sl).alias("_sl"), at(tp).alias("_tp"), at(out).alias("_go"), F.min_by("bar_close", F.when(out, F.col("bar_ts"))).alias("_gc"),
        F.min(F.when(F.col("bar_ts") != step(F.col("_k")), step(F.col("_k")))).alias("_miss"), F.max_by("bar_close", "bar_ts").alias("_lc"), F.max("bar_ts").alias("_lt"),
    )
    got = decisions.join(got, id_col, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    gap = F.coalesce("_miss", F.when(F.col("_n") < hold_s // step_s, step(F.col("_n"))))
    got = got.withColumn("_gap", gap)
    seen = lambda c: F.when(F.col("_gap").isNull() | (F.col(c) < F.col("_gap")), F.col(c))
    got = got.withColumns({c: seen(c) for c in ("_sl", "_tp", "_go")}).withColumn("_first", F.least("_sl", "_tp", "_go"))
    outcome = (
        F.when(F.col("_sl") == F.col("_first"), "stop").when(F.col("_tp") == F.col("_first"), "target").when(F.col("_go") == F.col("_first"), "regime")
        .when(F.col("_gap").isNotNull(), "censored").otherwise("timeout")
    )
    got = got.withColumn("outcome", outcome)
    o = F.col("outcome")
    price = F.when(o == "stop", F.col("stop")).when(o == "target", F.col("target")).when(o == "regime", F.col("_gc")).when(o == "timeout", F.col("_lc"))
    when = F.coalesce("_first", "_gap", "_lt")
    risk = F.nullif(F.abs(F.col("entry") - F.col("stop")), F.lit(0.0))
    got = got.withColumn("r_gross", (price - F.col("entry")) * side / risk)
    return got.select(id_col, "outcome", when.alias("exit_ts"), "r_gross", (F.col("r_gross") - F.col("entry") * cost_bps / 1e4 / risk).alias("r_net"))


def limit_labels(decisions: DataFrame, bars: DataFrame, id_col: str, offset: float, fill_s: int, hold_s: int, step_s: int, maker_bps: float, taker_bps: float) -> DataFrame:
    """(id, filled, outcome, r_net) of limit orders ``offset`` better than entry, open for ``fill_s``; then as ``exit_labels``.

    The bars after the filling one are the path. Orders that aren't filled have R 0. A target is left by a maker order,
    anything else pays the taker's fee on the way out.
    """
    limit = F.col("entry") * (1 - offset * F.col("side"))
    d = decisions.withColumn("_limit", limit)
    hit = F.when(F.col("side") > 0, F.col("bar_low") <= F.col("_limit")).otherwise(F.col("bar_high") >= F.col("_limit"))
    fill = first_touch(d, bars, id_col, {"_fill": hit}, fill_s).select(id_col, "_fill").where("_fill is not null")
    own = d.join(fill, id_col).withColumns({"entry": F.col("_limit"), "ts": F.col("_fill") + F.make_interval(secs=F.lit(step_s))})
    own = own.withColumns({"target": F.col("target") - F.col("side") * offset * F.col("entry"), "_risk": F.abs(F.col("entry") - F.col("stop"))})
    got = exit_labels(own, bars, id_col, hold_s, step_s).join(own.select(id_col, "entry", "_risk"), id_col)
    bps = maker_bps + F.when(F.col("outcome") == "target", maker_bps).otherwise(taker_bps)
    got = got.select(id_col, "outcome", (F.col("r_gross") - F.col("entry") * bps / 1e4 / F.col("_risk")).alias("r_net"))
    rows = decisions.select(id_col).join(got, id_col, "left")
    filled = F.col("outcome").isNotNull()
    return rows.select(id_col, filled.alias("filled"), F.coalesce("outcome", F.lit("unfilled")).alias("outcome"), F.when(filled, F.col("r_net")).otherwise(0.0).alias("r_net"))


def window_steps(windows: DataFrame, bars: DataFrame, n: int, buffer: float, reward: float, step_s: int) -> DataFrame:
    """Each window's bars as decisions: (id, window_id, symbol, ts, side, entry, stop, target, valid).

    Entry is the next bar's open, if that follows at once; the stop lies beyond the last ``n`` bars' extreme by ``buffer``,
    the target ``reward`` risks away. ``valid``: the risk is above zero.
    """
    then = lambda f: {"_low": F.min("low").over(f.over(n)), "_high": F.max("high").over(f.over(n)), "_next": F.lead("ts").over(f.order), "entry": F.lead("open").over(f.order)}
    b = rolling(bars.select("symbol", "ts", "open", "high", "low"), n, then, ahead=1)
    near = F.unix_timestamp("_next") - F.unix_timestamp("ts") == step_s
    got = range_join(windows.select("symbol", "window_id", "side", "start", "end"), b, "start", "end").where(near)
    stop = F.when(F.col("side") > 0, F.col("_low") * (1 - buffer)).otherwise(F.col("_high") * (1 + buffer))
    got = got.withColumn("stop", stop)
    return got.select(
        F.concat_ws("@", "window_id", F.unix_timestamp("ts").cast("string")).alias("id"), "window_id", "symbol", F.col("_next").alias("ts"), "side", "entry", "stop",
        (F.col("entry") + reward * (F.col("entry") - F.col("stop"))).alias("target"), ((F.col("entry") - F.col("stop")) * F.col("side") > 0).alias("valid"),
    )


def validity(labels: DataFrame, floor: float) -> DataFrame:
    """Which rows may teach which head: ``path_ok`` (not censored), ``direction_ok`` (decided, and beyond ``floor`` R) and
    ``magnitude_ok`` (any exit with an R).
    """
    ok = F.col("outcome") != "censored"
    decided = F.col("outcome").isin("stop", "target")
    return labels.withColumns({"path_ok": ok, "direction_ok": ok & decided & (F.abs(F.col("r_gross")) >= floor), "magnitude_ok": ok & F.col("r_gross").isNotNull()})


def held_states(decisions: DataFrame, bars: DataFrame, id_col: str, hold_s: int) -> DataFrame:
    """(id, ts, held, open_r, best_r, worst_r, to_stop, to_target): the state of each decision at each bar of its hold.

    R of the close, best and worst R since entry by running extremes of the decision's path, and distances left in R.
    """
    p = paths(decisions, bars, hold_s)
    w = Window.partitionBy(id_col).orderBy("bar_ts").rowsBetween(Window.unboundedPreceding, 0)  # bounded by the hold
    risk = F.nullif(F.abs(F.col("entry") - F.col("stop")), F.lit(0.0))
    r = lambda c: (c - F.col("entry")) * F.col("side") / risk
    good, bad = F.when(F.col("side") > 0, F.col("bar_high")).otherwise(F.col("bar_low")), F.when(F.col("side") > 0, F.col("bar_low")).otherwise(F.col("bar_high"))
    now = r(F.col("bar_close"))
    return p.select(
        id_col, F.col("bar_ts").alias("ts"), F.row_number().over(Window.partitionBy(id_col).orderBy("bar_ts")).alias("held"), now.alias("open_r"),
        F.max(r(good)).over(w).alias("best_r"), F.min(r(bad)).over(w).alias("worst_r"), (now + 1).alias("to_stop"), (r(F.col("target")) - now).alias("to_target"),
    )
