"""Ledgers from signals, and what is read from ledgers: activity, alerts, cards, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import on_grid
from tidemark.operators.intervals import greedy, range_join
from tidemark.operators.labels import bracket
from tidemark.operators.series import islands, previous, rolling, running
from tidemark.sources.scratch import stage


def bracket_ledger(decisions: DataFrame, bars: DataFrame, id_col: str, hold_s: int, cost_bps: float) -> DataFrame:
    """Trades of all decisions whose entry comes after the last taken trade's exit: outcomes first, all at once, then the schedule."""
    out = stage(bracket(decisions, bars, id_col, hold_s, cost_bps), "outcomes")  # the schedule reads them several times
    trades = decisions.join(out, id_col)
    taken = greedy(trades.select("symbol", id_col, F.col("ts").alias("start"), F.col("exit_ts").alias("end")), id_col).where("accepted").select(id_col)
    return trades.join(taken, id_col, "left_semi")


def fixed_hold(bars: DataFrame, signal: Column, hold: int, fee: float) -> DataFrame:
    """(symbol, ts, side, net) of signals entered at the next open and left at the ``hold``-th close; the exit bar may enter again."""
    lead = lambda f, c, n: F.lead(c, n).over(f.order)
    rows = rolling(
        bars.withColumn("side", signal), 1,
        lambda f: {"entry": lead(f, "open", 1), "exit": lead(f, "close", hold), "start": lead(f, "ts", 1), "end": lead(f, "ts", hold)}, ahead=hold,
    )
    rows = rows.where((F.col("side") != 0) & F.col("exit").isNotNull()).withColumn("id", F.concat_ws("-", "symbol", F.unix_timestamp("ts").cast("string")))
    ok = greedy(rows.select("symbol", "id", F.col("ts").alias("start"), "end"), "id", allow_touch=True).where("accepted").select("id")
    net = F.col("side") * (F.col("exit") / F.col("entry") - 1) - 2 * fee
    return rows.join(ok, "id", "left_semi").select("symbol", "ts", "side", net.alias("net"))


def marks(trades: DataFrame, bars: DataFrame, entry: str = "entry", start: str = "start", end: str = "end", id_col: str = "id") -> DataFrame:
    """(symbol, ts, ret): log returns of open trades on each bar, summing to each trade's own."""
    got = range_join(trades, bars.select("symbol", F.col("ts").alias("bar_ts"), F.col("close").alias("mark")), start, end, ts="bar_ts", closed=True)
    before = F.coalesce(F.lag("mark").over(Window.partitionBy(id_col).orderBy("bar_ts")), F.col(entry))
    return got.withColumn("_r", F.col("side") * F.ln(F.col("mark") / before)).groupBy("symbol", F.col("bar_ts").alias("ts")).agg(F.sum("_r").alias("ret"))


def daily_summary(ledger: DataFrame, net: str, costs: list[float], key: str = "symbol") -> DataFrame:
    """Total, additive drawdown from 0 and share of winning days on the whole calendar, for each extra cost a trade."""
    rows = ledger.withColumn("stress", F.explode(F.array(*[F.lit(float(c)) for c in costs]))).withColumn("_k", F.concat_ws("|", key, F.col("stress").cast("string")))
    days = rows.groupBy("_k", F.date_trunc("day", "ts").alias("ts")).agg(F.sum(F.col(net) - F.col("stress")).alias("net"))
    days = running(running(on_grid(days, "1 day", ["net"], "_k"), {"c": ("sum", "net")}, "_k"), {"p": ("max", "c")}, "_k")
    got = days.groupBy("_k").agg(F.sum("net").alias("total"), F.min(F.col("c") - F.greatest("p", F.lit(0.0))).alias("drawdown"), F.avg((F.col("net") > 0).cast("double")).alias("positive_days"))
    return got.select(F.substring_index("_k", "|", 1).alias(key), F.substring_index("_k", "|", -1).cast("double").alias("stress"), "total", "drawdown", "positive_days")


def activity(ledger: DataFrame, key: str = "symbol") -> DataFrame:
    """Days with 0, 1, 2 and 3 or more trades on the whole calendar, and the median."""
    days = on_grid(ledger.groupBy(key, F.date_trunc("day", "ts").alias("ts")).agg(F.count(F.lit(1)).alias("n")), "1 day", ["n"], key)
    n = F.col("n")
    return days.groupBy(key).agg(*[F.count_if(n == k).alias(f"days_{k}") for k in (0, 1, 2)], F.count_if(n >= 3).alias("days_3"), F.percentile("n", 0.5).alias("median"))


def alert_recall(rows: DataFrame, positive: Column, alert: Column, gap: Column, key: str = "symbol") -> DataFrame:
    """Positives clustered by ``gap``: clusters, those with an alert inside, and alerts outside positives."""
    x = rows.withColumns({"_p": F.coalesce(positive, F.lit(False)), "_a": F.coalesce(alert, F.lit(False))})
    pos = previous(x.where("_p"), {"_b": "ts"}, key)
    far = F.coalesce(F.col("ts") - F.col("_b") > gap, F.lit(True))
    c = islands(pos, far, "_c", key).groupBy(key, "_c").agg(F.bool_or("_a").alias("hit")).groupBy(key).agg(F.count(F.lit(1)).alias("clusters"), F.count_if("hit").alias("recalled"))
    return c.join(x.groupBy(key).agg(F.count_if(F.col("_a") & ~F.col("_p")).alias("false_alerts")), key)


def volatility_ratio(bars: DataFrame, a: str, b: str, step: Column) -> DataFrame:
    """Median absolute return between neighbouring bars of ``a`` over that of ``b``, one row."""
    r = F.when(F.col("ts") == F.col("_t0") + step, F.abs(F.ln(F.col("close") / F.col("_c0"))))
    med = lambda s: F.percentile(F.when(F.col("symbol") == s, F.col("_r")), 0.5)
    return previous(bars, {"_t0": "ts", "_c0": "close"}).withColumn("_r", r).agg((med(a) / F.nullif(med(b), F.lit(0.0))).alias("ratio"))


def rolling_cards(cards: DataFrame, spans: list[int], by: str = "model", week: str = "week") -> DataFrame:
    """Cards with the count-weighted mean of the last few weeks, this one in: ``net_4`` for 4 weeks."""
    w = Window.partitionBy(by).orderBy(week)
    mean = lambda k: F.sum(F.col("net") * F.col("n")).over(w.rowsBetween(-(k - 1), 0)) / F.nullif(F.sum("n").over(w.rowsBetween(-(k - 1), 0)), F.lit(0))
    return cards.withColumns({f"net_{k}": mean(k) for k in spans})


def follow_history(payoffs: DataFrame, by: str = "model", week: str = "week", payoff: str = "payoff") -> DataFrame:
    """(week, choice): the policy with the largest sum of the weeks before, ties to the smaller name; none in the first."""
    before = F.sum(payoff).over(Window.partitionBy(by).orderBy(week).rowsBetween(Window.unboundedPreceding, -1))
    rows = payoffs.withColumn("_s", before)
    return rows.groupBy(week).agg(F.min_by(by, F.when(F.col("_s").isNotNull(), F.struct(-F.col("_s"), F.col(by)))).alias("choice"))


def two_members(a: DataFrame, b: DataFrame, tau_a: float, tau_b: float, key: str = "id") -> DataFrame:
    """(key, side): two members' sides over their gates, missing as flat, opposite sides cancel."""
    x, y = (d.select(key, F.when(F.col("conf") >= t, F.col("side")).otherwise(0).alias(n)) for d, t, n in ((a, tau_a, "_x"), (b, tau_b, "_y")))
    s = F.coalesce("_x", F.lit(0)) + F.coalesce("_y", F.lit(0))
    return x.join(y, key, "full_outer").select(key, F.signum(s).cast("int").alias("side"))


def whole_window(signals: DataFrame, bars: DataFrame, hold: int, step_s: int) -> DataFrame:
    """Signals whose next bar follows at once and whose next ``hold`` bars are there without a gap."""
    b = rolling(bars, 1, lambda f: {"_n": F.lead("ts").over(f.order), "_e": F.lead("ts", hold).over(f.order)}, ahead=hold)
    t = F.unix_timestamp("ts")
    ok = b.where((F.unix_timestamp("_n") - t == step_s) & (F.unix_timestamp("_e") - t == step_s * hold)).select("symbol", "ts")
    return signals.join(ok, ["symbol", "ts"], "left_semi")


def outcome_cards(ledger: DataFrame, decisions: DataFrame, horizon: int = 4, name: str = "model", at: str = "available_at", net: str = "net") -> DataFrame:
    """(decision, age_weeks, name, net_bps, trades, drawdown_bps): what each name's closed trades came to in each of the ``horizon``
    weeks before each decision (column ``decision``), newest week 1.

    A trade counts in the week in which it became available, always before the decision. Weeks that begin before the first
    trade of all are left out; a name without trades in a week has zeros. A drawdown starts from zero. Trades of one time
    go by their net.
    """
    week = F.expr("INTERVAL 7 DAYS")
    first = ledger.agg(F.min(at).alias("_first"))
    weeks = decisions.select("decision", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("age_weeks"))
    weeks = weeks.withColumns({"_a": F.col("decision") - week * F.col("age_weeks"), "_b": F.col("decision") - week * (F.col("age_weeks") - 1)})
    weeks = weeks.join(F.broadcast(first), F.col("_a") >= F.col("_first")).drop("_first")  # one row
    # a week's place on a grid of weeks: a trade's own and the next hold all weeks that it may fall into
    at_week = lambda c: F.floor(F.unix_micros(c) / (7 * 86_400_000_000))
    rows = ledger.select(name, F.col(at).alias("_t"), F.col(net).alias("_n")).withColumn("_w", F.explode(F.array(at_week(F.col("_t")), at_week(F.col("_t")) - 1)))
    rows = rows.join(weeks.withColumn("_w", at_week(F.col("_a"))), "_w").where((F.col("_t") >= F.col("_a")) & (F.col("_t") < F.col("_b")))
    own = Window.partitionBy("decision", "age_weeks", name).orderBy("_t", "_n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_c", F.sum("_n").over(own)).withColumn("_top", F.greatest(F.max("_c").over(own), F.lit(0.0)))
    got = rows.groupBy("decision", "age_weeks", name).agg(F.sum("_n").alias("_sum"), F.count(F.lit(1)).alias("trades"), F.max(F.col("_top") - F.col("_c")).alias("_dd"))
    every = weeks.select("decision", "age_weeks").join(F.broadcast(ledger.select(name).distinct()), F.lit(True))  # names are few
    got = every.join(got, ["decision", "age_weeks", name], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)) * 10_000
    return got.select("decision", "age_weeks", name, zero("_sum").alias("net_bps"), F.coalesce("trades", F.lit(0)).alias("trades"), zero("_dd").alias("drawdown_bps"))
