"""Economics and statistics of returns, trades, predictions and probabilities."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import islands, previous, rolling, running


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def confusion(df: DataFrame, truth: str = "y", pred: str = "p", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), truth, pred).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, classes: list[int], truth: str = "y", pred: str = "p", by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of each class; zero where there is nothing to divide by."""
    by = by or []
    z = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    aggs = []
    for c in classes:
        aggs += [F.count_if((F.col(truth) == c) & (F.col(pred) == c)).alias(f"_t{c}"), F.count_if(F.col(truth) == c).alias(f"_y{c}"), F.count_if(F.col(pred) == c).alias(f"_p{c}")]
    got = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    rows = []
    for c in classes:
        t, y, p = (F.col(f"_{k}{c}") for k in "typ")
        rows.append(F.struct(F.lit(c).alias("class"), z(t, p).alias("precision"), z(t, y).alias("recall"), z(2 * t, p + y).alias("f1"), y.alias("support")))
    return got.select(*by, F.explode(F.array(*rows)).alias("x")).select(*by, "x.*")


def class_metrics(df: DataFrame, classes: list[int], truth: str = "y", pred: str = "p", by: list[str] | None = None) -> DataFrame:
    """Macro F1, balanced accuracy (over the classes that occur) and accuracy of each group."""
    by = by or []
    r = class_report(df, classes, truth, pred, by)
    aggs = [F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy")]
    return r.groupBy(*by).agg(*aggs) if by else r.agg(*aggs)


def by_condition(df: DataFrame, conditions: list[str], classes: list[int], truth: str = "y", pred: str = "p", least: int = 1, by: list[str] | None = None) -> DataFrame:
    """Class metrics of each value of each condition column with at least ``least`` rows: columns unpivoted, grouped once."""
    by = by or []
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.col(c).cast("string").alias("value")) for c in conditions]))
    long = df.select(*by, truth, pred, pairs.alias("x")).select(*by, truth, pred, "x.*")
    keys = [*by, "condition", "value"]
    n = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return class_metrics(long, classes, truth, pred, keys).join(n, keys)


def economics(df: DataFrame, net: str = "net", periods: float = 252.0, by: str = "symbol", ts: str = "ts", traded: Column | None = None) -> DataFrame:
    """Sum and mean of net returns, annualised Sharpe and Sortino over all rows, additive drawdown, trades."""
    curve = running(running(df.withColumn("_r", F.col(net)), {"_c": ("sum", "_r")}, by, ts), {"_p": ("max", "_c")}, by, ts)
    r = F.col("_r")
    down = F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2)))
    scale = math.sqrt(periods)
    return curve.groupBy(by).agg(
        F.sum(r).alias("net_sum"), F.avg(r).alias("net_mean"), ratio(F.avg(r), F.stddev_samp(r)).alias("_sharpe"), ratio(F.avg(r), down).alias("_sortino"),
        F.min(F.col("_c") - F.col("_p")).alias("max_drawdown"), F.count_if(r != 0 if traded is None else traded).alias("trades"), F.count(F.lit(1)).alias("rows"),
    ).withColumns({"sharpe": F.col("_sharpe") * scale, "sortino": F.col("_sortino") * scale}).drop("_sharpe", "_sortino")


def compounded(df: DataFrame, net: str = "net", by: str = "symbol", ts: str = "ts") -> DataFrame:
    """Compounded total and drawdown, Sortino over negative rows only."""
    log = running(df.withColumn("_l", F.log1p(net)), {"_c": ("sum", "_l")}, by, ts)
    curve = running(log.withColumn("_e", F.exp("_c")), {"_p": ("max", "_e")}, by, ts)
    r = F.col(net)
    down = F.sqrt(F.avg(F.when(r < 0, r * r)))
    return curve.groupBy(by).agg(
        (F.exp(F.sum("_l")) - 1).alias("total"), F.min(F.col("_e") / F.greatest("_p", F.lit(1.0)) - 1).alias("max_drawdown"), ratio(F.avg(r), down).alias("sortino")
    )


def trade_stats(ledger: DataFrame, net: str = "net_return", by: str = "symbol") -> DataFrame:
    """Win rate, average win and loss, profit factor, expectancy in basis points, median hold, shares of exit reasons."""
    r = F.col(net)
    return ledger.groupBy(by).agg(
        F.count(F.lit(1)).alias("trades"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(F.when(r > 0, r)).alias("avg_win"), F.avg(F.when(r <= 0, r)).alias("avg_loss"),
        ratio(F.sum(F.greatest(r, F.lit(0.0))), -F.sum(F.least(r, F.lit(0.0)))).alias("profit_factor"), (F.avg(r) * 1e4).alias("expectancy_bps"),
        F.percentile("bars_held", 0.5).alias("median_bars"), F.avg((F.col("exit_reason") == "stop").cast("double")).alias("stop_share"),
    )


def loss_streaks(trades: DataFrame, net: str = "r_net", by: str = "symbol", ts: str = "ts") -> DataFrame:
    """Count, longest, mean and 95th percentile of runs of trades without profit."""
    bad = (F.col(net) <= 0).cast("int")
    rows = previous(trades.withColumn("_b", bad), {"_b0": "_b"}, by, ts)
    rows = islands(rows, F.coalesce(F.col("_b") != F.col("_b0"), F.lit(True)), "_run", by, ts)
    runs = rows.where("_b = 1").groupBy(by, "_run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(by).agg(F.count(F.lit(1)).alias("streaks"), F.max("n").alias("longest"), F.avg("n").alias("mean"), F.percentile("n", 0.95).alias("p95"))


def reliability(df: DataFrame, p: str = "prob", y: str = "y", bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Rows, mean probability and rate of each probability bin; the last bin is closed."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")
    return df.groupBy(*(by or []), b).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def calibration(df: DataFrame, p: str = "prob", y: str = "y", bins: int = 10) -> DataFrame:
    """Brier score, log loss and expected calibration error, one row."""
    q, t = F.greatest(F.least(F.col(p), F.lit(1 - 1e-12)), F.lit(1e-12)), F.col(y).cast("double")
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")
    per = df.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(t).alias("sy"), F.sum(F.pow(F.col(p) - t, 2)).alias("br"), F.sum(-t * F.ln(q) - (1 - t) * F.ln(1 - q)).alias("ll"))
    n = F.sum("n")
    return per.agg((F.sum("br") / n).alias("brier"), (F.sum("ll") / n).alias("log_loss"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / n).alias("ece"))


def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows, missing and non-finite shares and distinct values of each column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select("x.*")
    v = F.col("v")
    return long.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(v.isNull().cast("double")).alias("missing"),
        F.avg(F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(False)).cast("double")).alias("non_finite"), F.count_distinct(v).alias("distinct"),
    )


def deciles(df: DataFrame, score: str, net: str, id_col: str, n: int = 10) -> DataFrame:
    """Rows, mean score and net of each score decile: ranks by rows counted below, over score bands first.

    ``ntile`` would sort everything in one task; here bands of 1/1000 of the score's range are counted, and rows ranked
    within their band.
    """
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    rows = df.crossJoin(F.broadcast(ends))  # one row
    rows = rows.withColumn("_band", F.floor(F.coalesce((F.col(score) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.0)) * 1000))
    counts = rows.groupBy("_band").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_band")  # a thousand bands
    counts = counts.select("_band", (F.sum("_n").over(w) - F.col("_n")).alias("_base"), F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    place = F.row_number().over(Window.partitionBy("_band").orderBy(score, id_col)) - 1 + F.col("_base")
    big, size = F.col("_all") % n, F.floor(F.col("_all") / n)
    bin_ = F.when(place < big * (size + 1), F.floor(place / (size + 1))).otherwise(big + F.floor((place - big * (size + 1)) / F.greatest(size, F.lit(1)))) + 1
    got = rows.join(counts, "_band").withColumn("decile", bin_.cast("int"))
    return got.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(net).alias("mean_net"), F.sum(net).alias("total_net"))


def holm(pvalues: DataFrame, p: str = "p", by: str = "name") -> DataFrame:
    """Holm's step-down adjustment; one row a hypothesis."""
    w = Window.orderBy(p, by)
    m = F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    scaled = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(w) + 1))
    return pvalues.withColumn("_s", scaled).withColumn("p_adjusted", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def diebold_mariano(df: DataFrame, d: str, lags: int, by: str = "symbol", ts: str = "ts") -> DataFrame:
    """Mean loss difference and its t statistic with Newey-West variance (Bartlett weights)."""
    mean = df.groupBy(by).agg(F.avg(d).alias("_m"))
    rows = df.join(mean, by).withColumn("_e", F.col(d) - F.col("_m"))
    rows = rolling(rows, lags + 1, lambda f: {f"_g{k}": F.col("_e") * F.lag("_e", k).over(f.order) for k in range(1, lags + 1)}, key=by, ts=ts)
    n = F.count(F.lit(1))
    var = F.sum(F.col("_e") * F.col("_e")) / n + sum((2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"_g{k}"), F.lit(0.0)) / n for k in range(1, lags + 1)), F.lit(0.0))
    return rows.groupBy(by).agg(F.avg(d).alias("mean"), ratio(F.avg(d), F.sqrt(F.greatest(var, F.lit(0.0)) / n)).alias("t"))


def paired_bootstrap(blocks: DataFrame, delta: str, draws: int = 2000, alpha: float = 0.05, seed: int = 7) -> DataFrame:
    """(point, low, high) of the summed ``delta`` when blocks are drawn anew, see ``block_bootstrap``: blocks count, not rows."""
    n = blocks.count()
    got = block_bootstrap(blocks.withColumn("_one", F.lit(1.0)), delta, "_one", draws, alpha, seed)
    return got.select(*[(F.col(c) * n).alias(c) for c in ("point", "low", "high")])


def top_against_all(scored: DataFrame, score: str, net: str, shares: list[float]) -> DataFrame:
    """(q, n, mean, over_all): rows at or above the score's quantile 1 - q, their mean and its difference to taking all."""
    row = scored.agg(F.percentile(score, F.array(*[F.lit(1 - q) for q in shares])).alias("cut"), F.avg(net).alias("all")).first()
    cuts = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.lit(float(c)).alias("cut")) for q, c in zip(shares, row["cut"], strict=True)])
    rows = scored.withColumn("_c", F.explode(F.filter(cuts, lambda c: F.col(score) >= c["cut"])))
    return rows.groupBy(F.col("_c.q").alias("q")).agg(F.count(F.lit(1)).alias("n"), F.avg(net).alias("mean"), (F.avg(net) - F.lit(row["all"])).alias("over_all"))


def draw_sums(blocks: DataFrame, total: str, count: str, draws: int, seed: int) -> DataFrame:
    """(draw, t, c): sums of ``total`` and ``count`` over blocks (``id``) that each draw takes Poisson(1) times.

    A task adds up a vector with a place for each draw; blocks are never repeated. How often a draw takes a block follows
    from a hash of the block's id, so results don't depend on how blocks are dealt.
    """
    rows = blocks.select(F.xxhash64("id", F.lit(seed)).alias("h"), F.col(total).cast("double").alias("t"), F.col(count).cast("double").alias("c"))
    steps = np.cumsum(np.exp(-1.0) / np.array([math.factorial(i) for i in range(12)]))

    def run(batches):
        sums = np.zeros((2, draws))
        each = np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            h = b.column("h").to_numpy().astype(np.uint64)
            v = np.stack([b.column(c).fill_null(0.0).to_numpy() for c in ("t", "c")])
            for at in range(0, len(h), 256):
                z = h[at : at + 256, None] + each
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
                sums += v[:, at : at + 256] @ np.searchsorted(steps, u, side="right").astype(np.float64)
        yield pa.RecordBatch.from_pydict({"draw": np.arange(1, draws + 1), "t": sums[0], "c": sums[1]})

    return rows.mapInArrow(run, "draw long, t double, c double").groupBy("draw").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def block_bootstrap(blocks: DataFrame, total: str, count: str, draws: int = 2000, alpha: float = 0.05, seed: int = 7) -> DataFrame:
    """(point, low, high) of sum(total)/sum(count) when blocks are drawn anew: a Poisson bootstrap over whole blocks.

    See ``draw_sums``. Blocks need an ``id``; null values count as 0.
    """
    per = draw_sums(blocks, total, count, draws, seed).select((F.col("t") / F.nullif(F.col("c"), F.lit(0.0))).alias("v"))
    point = blocks.agg((F.sum(total) / F.sum(count)).alias("point"))
    ends = per.agg(F.percentile("v", alpha / 2).alias("low"), F.percentile("v", 1 - alpha / 2).alias("high"))
    return point.join(F.broadcast(ends), F.lit(True))  # a row each
