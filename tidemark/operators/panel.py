"""Panels of models' class probabilities: alignment, mixing, weights, calibration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

P = ("p0", "p1", "p2")


def aligned(panel: DataFrame, n: int, key: str = "ts", truth: str = "y") -> DataFrame:
    """Rows of keys that all ``n`` models have, with one truth among them."""
    ok = panel.groupBy(key).agg(F.count_distinct("model").alias("_k"), F.min(truth).alias("_a"), F.max(truth).alias("_b")).where((F.col("_k") == n) & (F.col("_a") == F.col("_b")))
    return panel.join(ok.select(key), key, "left_semi")


def argmax(cols: tuple[str, ...] = P) -> Column:
    """Place of the largest value, the first of equals."""
    a = F.array(*cols)
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def margin(cols: tuple[str, ...] = P) -> Column:
    s = F.sort_array(F.array(*cols), asc=False)
    return F.element_at(s, 1) - F.element_at(s, 2)


def soft_vote(panel: DataFrame, key: str = "ts") -> DataFrame:
    """Mean probabilities, their class, and the directional majority: the side that at least 5/9 of the models take."""
    own = panel.withColumn("_c", argmax())
    got = own.groupBy(key).agg(*[F.avg(p).alias(p) for p in P], *[F.avg((F.col("_c") == c).cast("double")).alias(f"_v{c}") for c in (0, 2)])
    side = F.when(F.col("_v2") >= 5 / 9, 2).when(F.col("_v0") >= 5 / 9, 0).otherwise(1)
    return got.withColumns({"pred": argmax(), "majority": side}).drop("_v0", "_v2")


def weighted_mix(panel: DataFrame, weights: DataFrame, tau: float, key: str = "ts") -> DataFrame:
    """Probabilities mixed by ``weights`` (model, w: a row a model); class 1 (flat) below ``tau`` or where the weights sum to
    nothing. A key's few models are added in their order, so that the sums don't depend on the shuffle.
    """
    w = F.coalesce("w", F.lit(0.0))
    rows = panel.join(F.broadcast(weights), "model", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("model", w.alias("_w"), *P))).alias("_m"))
    add = lambda of: F.aggregate("_m", F.lit(0.0), lambda a, m: a + of(m))
    total = F.nullif(add(lambda m: m["_w"]), F.lit(0.0))
    got = rows.select(key, *[(add(lambda m, p=p: m["_w"] * m[p]) / total).alias(p) for p in P])
    return got.withColumn("pred", F.when(F.col("p0").isNull() | (F.greatest(*P) < tau), 1).otherwise(argmax()))


def meta_features(panel: DataFrame, models: list[str], key: str = "ts") -> DataFrame:
    """One row a key: each model's probabilities, largest probability and margin, side by side."""
    rows = panel.withColumns({"top": F.greatest(*P), "margin": margin()})
    return rows.groupBy(key).pivot("model", models).agg(*[F.first(c).alias(c) for c in (*P, "top", "margin")])


def snapshot(panel: DataFrame, weights: DataFrame, key: str = "ts") -> DataFrame:
    """Ensemble class and confidence of each time, and the share of models that agree with it."""
    mix = weighted_mix(panel, weights, 0.0, key).withColumn("confidence", F.greatest(*P)).select(key, F.col("pred").alias("ensemble"), "confidence")
    own = panel.withColumn("_c", argmax()).join(mix, key)
    return own.groupBy(key).agg(F.first("ensemble").alias("ensemble"), F.first("confidence").alias("confidence"), F.avg((F.col("_c") == F.col("ensemble")).cast("double")).alias("agreement"))


def hedge_weights(cards: DataFrame, eta: float, week: str = "week", payoff: str = "payoff") -> DataFrame:
    """(week, model, w): weights by exp(eta * sum of tanh of payoffs of the weeks before), summing to 1 each week."""
    before = Window.partitionBy("model").orderBy(week).rowsBetween(Window.unboundedPreceding, -1)
    rows = cards.withColumn("_g", F.exp(eta * F.coalesce(F.sum(F.tanh(payoff)).over(before), F.lit(0.0))))
    total = rows.groupBy(week).agg(F.sum("_g").alias("_t"))
    return rows.join(total, week).select(week, "model", (F.col("_g") / F.col("_t")).alias("w"))


def grid_weights(scores: DataFrame, floor: float = 0.05, step: float = 0.01, by: str = "week") -> DataFrame:
    """Weights on a grid of ``step`` with at least ``floor`` each: the rest by score, largest remainders rounded up."""
    n = scores.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.sum("score").alias("_s"))
    units, least = round(1 / step), round(floor / step)
    rows = scores.join(n, by).withColumn("_u", (units - F.col("_n") * least) * F.coalesce(F.col("score") / F.nullif("_s", F.lit(0.0)), 1 / F.col("_n")))
    rows = rows.withColumns({"_f": F.floor(F.round("_u", 9)), "_r": F.round("_u", 9) - F.floor(F.round("_u", 9))})
    spare = rows.groupBy(by).agg((F.first((units - F.col("_n") * least)) - F.sum("_f")).alias("_spare"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_r"), "model"))
    rows = rows.withColumn("_k", rank).join(spare, by)
    return rows.select(by, "model", ((least + F.col("_f") + (F.col("_k") <= F.col("_spare")).cast("int")) * step).alias("w"))


def redundant(panel: DataFrame, value: str, least: float, key: str = "ts") -> DataFrame:
    """(a, b, corr): pairs of models whose values correlate at ``least`` or more; the models are few."""
    a, b = panel.select(key, F.col("model").alias("a"), F.col(value).alias("x")), panel.select(key, F.col("model").alias("b"), F.col(value).alias("y"))
    got = a.join(b, key).where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("corr"))
    return got.where(F.col("corr") >= least)


def temperature(df: DataFrame, grid: list[float], truth: str = "y", probs: tuple[str, ...] = P) -> DataFrame:
    """(temperature, log_loss) of probabilities raised to 1/T and renormalised, for each T of a fixed grid at once."""
    rows = df.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in grid])))
    scaled = [F.pow(F.greatest(F.col(p), F.lit(1e-12)), 1 / F.col("temperature")) for p in probs]
    p = F.element_at(F.array(*scaled), F.col(truth) + 1) / reduce_sum(scaled)
    return rows.groupBy("temperature").agg((-F.avg(F.ln(p))).alias("log_loss"))


def reduce_sum(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.ln(q / (1 - q))


def positive_sharpe_weights(returns: DataFrame, by: str = "model", net: str = "net") -> DataFrame:
    """(model, w): positive parts of mean over deviation, scaled to sum 1; equal weights if none is positive."""
    s = returns.groupBy(by).agg(F.greatest(F.coalesce(F.avg(net) / F.nullif(F.stddev_samp(net), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)).alias("_s"))
    t = s.agg(F.sum("_s").alias("_t"), F.count(F.lit(1)).alias("_n"))
    return s.crossJoin(t).select(by, F.when(F.col("_t") > 0, F.col("_s") / F.col("_t")).otherwise(1 / F.col("_n")).alias("w"))


def hazards(df: DataFrame, hit: str, hazard: list[str], severity: list[str]) -> DataFrame:
    """Timing and severity probabilities: P(hit in interval k), and nested severities as running products."""
    alive, cols = F.col(hit), {}
    for k, h in enumerate(hazard):
        cols[f"time_{k}"] = alive * F.col(h)
        alive = alive * (1 - F.col(h))
    level = F.col(hit)
    for k, s in enumerate(severity):
        level = level * F.col(s)
        cols[f"level_{k}"] = level
    return df.withColumns(cols)


def softmax(cols: list[str], eta: float = 1.0) -> list[Column]:
    e = [F.exp(eta * F.col(c)) for c in cols]
    total = reduce_sum(e)
    return [x / total for x in e]


def normal_tail(t: float) -> float:
    """Two-sided normal p-value of one statistic, on the driver."""
    return math.erfc(abs(t) / math.sqrt(2))
