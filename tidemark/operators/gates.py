"""Gates and policies: positions from predictions, thresholds, crossings, cooldowns, votes, rules."""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.chains import chained_spans
from tidemark.operators.series import previous


def gated_position(df: DataFrame, pred: str = "pred", conf: str = "conf", tau: float | Column = 0.0) -> DataFrame:
    """``pos``: 1 for class 2, -1 for class 0, else 0; 0 below the confidence gate."""
    side = F.when(F.col(pred) == 2, 1).when(F.col(pred) == 0, -1).otherwise(0)
    return df.withColumn("pos", F.when(F.col(conf) >= tau, side).otherwise(0))


def net_returns(df: DataFrame, fwd: str = "fwd", fee: float = 0.001, pos: str = "pos", by: str = "symbol", ts: str = "ts") -> DataFrame:
    """``net``: position times forward return less ``fee`` for each unit of turnover (from 0 at the start)."""
    turn = F.abs(F.col(pos) - F.coalesce("_p0", F.lit(0)))
    return previous(df, {"_p0": pos}, by, ts).withColumn("net", F.col(pos) * F.col(fwd) - turn * fee).drop("_p0")


def sized(df: DataFrame, conf: str = "conf", tau: float = 0.5, cap: float = 0.9, floor: float = 0.25) -> DataFrame:
    """``size``: ``floor`` at tau, rising to 1 at ``cap``; 0 below tau."""
    ramp = floor + (1 - floor) * F.least((F.col(conf) - tau) / (cap - tau), F.lit(1.0))
    return df.withColumn("size", F.when(F.col(conf) >= tau, ramp).otherwise(0.0))


def side_gates(df: DataFrame, tau_long: float, tau_short: float, pred: str = "pred", conf: str = "conf") -> DataFrame:
    ok = ((F.col(pred) == 2) & (F.col(conf) >= tau_long)) | ((F.col(pred) == 0) & (F.col(conf) >= tau_short))
    return df.withColumn("gated", F.when(ok, F.col(pred)).otherwise(1))


def agreement(df: DataFrame, votes: list[str], k: int) -> DataFrame:
    """``signal``: 2 or 0 if at least k votes say so (and more than for the other side), else 1."""
    n = lambda c: sum(((F.col(v) == c).cast("int") for v in votes), F.lit(0))
    up, down = n(2), n(0)
    return df.withColumn("signal", F.when((up >= k) & (up > down), 2).when((down >= k) & (down > up), 0).otherwise(1))


def nth_smallest(rows: DataFrame, col: str, n: int, bands: int = 4096) -> float | None:
    """The n-th smallest value (from 1), exactly: bands of the range are counted, and the band that holds it cut again.

    Each round is one aggregate; no row is sorted and the driver sees ``bands`` counts.
    """
    x = rows.select(F.col(col).cast("double").alias("x")).where("x is not null")
    low, high = x.agg(F.min("x"), F.max("x")).first()
    if low is None or n < 1:
        return None
    while low < high:
        band = F.least(F.floor((F.col("x") - low) / (high - low) * bands), F.lit(bands - 1))
        inside = x.where((F.col("x") >= low) & (F.col("x") <= high)).groupBy(band.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        got = sorted((r.b, r.n, r.lo, r.hi) for r in inside.collect())
        for _, k, lo, hi in got:
            if n <= k:
                low, high = lo, hi
                break
            n -= k
    return float(low)


def conformal(calibration: DataFrame, df: DataFrame, probs: list[str], truth: str, alpha: float) -> DataFrame:
    """``signal``: the class if the split-conformal set is a single one, else -1.

    The score is one minus the probability of the true class; the quantile is the smallest score that at least
    ceil((n+1)(1-alpha)) scores don't exceed (see ``nth_smallest``).
    """
    p = F.element_at(F.array(*probs), F.col(truth) + 1)
    rows = calibration.select((1 - p).alias("s"))
    n = rows.count()
    need = int(min(math.ceil((n + 1) * (1 - alpha)), n))
    q = df.sparkSession.createDataFrame([(nth_smallest(rows, "s", need),)], "qhat double")
    inside = [(1 - F.col(c) <= F.col("qhat")).cast("int") for c in probs]
    size = sum(inside, F.lit(0))
    pick = reduce(lambda a, ic: F.when(inside[ic] == 1, ic).otherwise(a), range(len(probs)), F.lit(-1))
    return df.crossJoin(F.broadcast(q)).withColumn("signal", F.when(size == 1, pick).otherwise(-1)).drop("qhat")


def first_crossing(scored: DataFrame, window: str, score: str, threshold: float, ts: str = "ts", until: Column | None = None) -> DataFrame:
    """Every row with ``action``: ENTER at the window's first row at or above the threshold, WAIT before, null after.

    Without entry the window's last row says SKIP. ``until`` cancels: rows from the first where it holds on say nothing,
    and that row says CANCEL.
    """
    hit = F.min(F.when(F.col(score) >= threshold, F.col(ts))).over(Window.partitionBy(window))
    stop = F.min(F.when(until, F.col(ts))).over(Window.partitionBy(window)) if until is not None else F.lit(None).cast("timestamp")
    end = F.max(ts).over(Window.partitionBy(window))
    df = scored.withColumns({"_hit": hit, "_stop": stop, "_end": end})
    enters = F.col("_hit").isNotNull() & (F.col("_stop").isNull() | (F.col("_hit") < F.col("_stop")))
    last = F.when(enters, F.col("_hit")).otherwise(F.coalesce("_stop", "_end"))
    action = (
        F.when(F.col(ts) > last, None).when(F.col(ts) < last, "WAIT").when(enters, "ENTER").when(F.col("_stop").isNotNull(), "CANCEL").otherwise("SKIP")
    )
    return df.withColumn("action", action).drop("_hit", "_stop", "_end")


def upward_crossings(scored: DataFrame, score: str, threshold: float, by: str = "symbol", ts: str = "ts") -> DataFrame:
    """Rows at or above the threshold whose row before wasn't (or isn't there)."""
    return previous(scored, {"_b": score}, by, ts).where((F.col(score) >= threshold) & (F.col("_b").isNull() | (F.col("_b") < threshold))).drop("_b")


def rearmed(scored: DataFrame, score: str, threshold: float, refractory_s: int, by: str = "symbol", ts: str = "ts") -> DataFrame:
    """Crossings whose last *candidate*, taken or not, lies at least ``refractory_s`` back: a lag, no state."""
    c = previous(upward_crossings(scored, score, threshold, by, ts), {"_l": ts}, by, ts)
    far = F.unix_micros(F.col(ts)) - F.unix_micros("_l") >= refractory_s * 1_000_000
    return c.where(F.col("_l").isNull() | far).drop("_l")


def spaced(events: DataFrame, id_col: str, spacing_s: int, by: str = "symbol", ts: str = "ts") -> DataFrame:
    """(id, taken): an event is taken if the last *taken* one lies at least ``spacing_s`` back.

    See ``chained_spans``: time buckets are folded in parallel.
    """
    t = F.unix_micros(F.col(ts))
    rows = events.select(F.col(by).alias("_key"), F.col(id_col).alias("_id"), t.alias("_s"), (t + spacing_s * 1_000_000).alias("_e"))
    return chained_spans(rows, touch=True).select(F.col("_id").alias(id_col), "taken")


def replay_capacity(scored: DataFrame, id_col: str, score: str, threshold: float, bucket_s: int, by: str = "symbol", ts: str = "ts") -> DataFrame:
    """One submission for each time bucket: the best score at or above the threshold, ties to the smaller id."""
    ok = scored.where(F.col(score) >= threshold).withColumn("_b", F.floor(F.unix_timestamp(ts) / bucket_s))
    best = ok.groupBy(by, "_b").agg(F.min_by(id_col, F.struct(-F.col(score), F.col(id_col))).alias(id_col))
    return best.select(id_col)


def sweep(df: DataFrame, taus: list[float], apply, by: list[str] | None = None) -> DataFrame:
    """``apply(frame, tau column)`` for each threshold at once: rows are repeated for each of the few thresholds."""
    return apply(df.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus]))), F.col("tau"))


def predicate(tree: dict, allowed: set[str]) -> Column:
    """A condition tree {"all": [{"column", "op", "value"}]} as a Column; null is false, other columns or operators refused."""
    ops = {"eq": operator.eq, "gte": operator.ge, "lte": operator.le, "in": lambda c, v: c.isin(*v)}
    out = F.lit(True)
    for leaf in tree["all"]:
        if leaf["column"] not in allowed or leaf["op"] not in ops:
            raise ValueError(f"not allowed: {leaf}")
        out = out & F.coalesce(ops[leaf["op"]](F.col(leaf["column"]), leaf["value"]), F.lit(False))
    return out


def rule_matches(df: DataFrame, rules: DataFrame, id_col: str, ts: str = "ts") -> DataFrame:
    """(id, rule_id): rules (rule_id, column, value, since, until) all of whose equalities hold while they are active.

    The context columns named by rules are unpivoted and joined on (column, value); a rule matches if as many of its rows
    are met as it has.
    """
    names = [r[0] for r in rules.select("column").distinct().collect()]  # the columns that rules may name are few
    size = rules.groupBy("rule_id").agg(F.count(F.lit(1)).alias("k"))
    long = df.select(id_col, ts, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names])).alias("x")).select(id_col, ts, "x.*")
    hit = long.join(rules, ["column", "value"]).where((F.col(ts) >= F.col("since")) & (F.col(ts) < F.col("until")))
    return hit.groupBy(id_col, "rule_id").agg(F.count(F.lit(1)).alias("n")).join(size, "rule_id").where("n = k").select(id_col, "rule_id")


def menu(conditions: dict[str, Column], df: DataFrame) -> DataFrame:
    """Every named mask as a column, in one pass; null is false."""
    return df.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in conditions.items()})


def union_signal(df: DataFrame, members: list[str]) -> DataFrame:
    """``union_side``: the members' common side where none says the opposite; 0 otherwise (members are -1, 0 or 1)."""
    cols = [F.coalesce(F.col(m), F.lit(0)) for m in members]
    up, down = F.greatest(*cols) > 0, F.least(*cols) < 0
    return df.withColumn("union_side", F.when(up & down, 0).when(up, 1).when(down, -1).otherwise(0))


def top_rate(df: DataFrame, score: str, id_col: str, rate: float) -> DataFrame:
    """The ``rate`` share of rows with the highest scores, ties by a hash of the id: a cut is found, nothing is sorted."""
    frac = F.conv(F.substring(F.sha2(F.col(id_col).cast("string"), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)
    rows = df.withColumn("_h", frac)
    n = int(rows.count() * rate)
    if not n:
        return df.limit(0)
    cut = nth_smallest(rows.select((-F.col(score)).alias("s")), "s", n)
    above = rows.where(F.col(score) > -cut)
    left = n - above.count()
    last = nth_smallest(rows.where(F.col(score) == -cut), "_h", left)
    same = rows.where((F.col(score) == -cut) & (F.col("_h") <= last))
    return above.unionByName(same).drop("_h")


def best_policy(grid: DataFrame, gates: Column, order: list[Column]) -> DataFrame:
    """The first row by ``order`` among those that pass ``gates``; among all if none passes. One row a policy."""
    return grid.withColumn("admissible", F.coalesce(gates, F.lit(False))).orderBy(F.desc("admissible"), *order).limit(1)


def confluent(df: DataFrame, signal: str, other: str) -> DataFrame:
    """``signal`` where ``other`` agrees with it, else 0."""
    return df.withColumn(signal, F.when(F.col(other) == F.col(signal), F.col(signal)).otherwise(0))


def macro_masked(scored: DataFrame, macro: DataFrame, score: str, side: str = "side") -> DataFrame:
    """``score`` null where the day's macro state (symbol, day, state) isn't the row's side."""
    got = scored.join(macro, ["symbol", "day"], "left")
    return got.withColumn(score, F.when(F.col("state") == F.col(side), F.col(score))).drop("state")
