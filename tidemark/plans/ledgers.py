"""Queries on ledgers made from signals, and on cards and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ledgers, panel
from tidemark.operators.series import rolling
from tidemark.plans.base import H, epoch, fine, hourly, last, query, rnd
from tidemark.plans.evaluation import CARDS, LEDGER, ONE, PANEL, cards, decisions, ledger, one, probs


@query("y28_bracket_ledger")
def y28(spark, sf):
    """Outcomes have SQL in l4_bracket, the schedule in y20_non_overlap; this is their composition."""
    d = decisions(spark, sf).withColumns({"stop": F.col("entry") * (1 - 0.02 * F.col("side")), "target": F.col("entry") * (1 + 0.04 * F.col("side"))})
    got = ledgers.bracket_ledger(d, fine(spark, sf), "id", 7200, 10)
    return got.select("id", "symbol", "side", "outcome", epoch("exit_ts").alias("exit_s"), rnd("r_net").alias("r_net"))


@query(
    "y43_fixed_hold",
    f"""WITH RECURSIVE {H}, s AS (SELECT symbol, ts, CASE WHEN close > open * 1.05 THEN 1 WHEN close < open * 0.95 THEN -1 ELSE 0 END AS side, lead(open) OVER w AS entry, lead(close, 3) OVER w AS ex, lead(ts, 3) OVER w AS fin FROM h WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
c AS (SELECT * FROM s WHERE side <> 0 AND ex IS NOT NULL), g AS (SELECT symbol, ts, side, entry, ex, fin FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts) = 1
  UNION ALL SELECT n.* FROM g, LATERAL (SELECT symbol, ts, side, entry, ex, fin FROM c WHERE c.symbol = g.symbol AND c.ts >= g.fin ORDER BY ts LIMIT 1) n)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, side, round(side * (ex / entry - 1) - 0.002, 6) AS net FROM g""",
)
def y43(spark, sf):
    side = F.when(F.col("close") > F.col("open") * 1.05, 1).when(F.col("close") < F.col("open") * 0.95, -1).otherwise(0)
    got = ledgers.fixed_hold(hourly(spark, sf), side, 3, 0.001)
    return got.select("symbol", epoch().alias("ts_s"), "side", rnd("net").alias("net"))


@query(
    "g14_lockbox_summary",
    f"""WITH {LEDGER}, k AS (SELECT unnest([0.0, 0.002]) AS stress), d AS (SELECT symbol, stress, date_trunc('day', ts) AS day, sum(net_return - stress) AS net FROM lg, k GROUP BY ALL),
g AS (SELECT symbol, stress, unnest(generate_series(min(day), max(day), INTERVAL '1 day')) AS day FROM d GROUP BY symbol, stress), z AS (SELECT symbol, stress, day, coalesce(net, 0) AS net FROM g LEFT JOIN d USING (symbol, stress, day)),
c AS (SELECT *, sum(net) OVER (PARTITION BY symbol, stress ORDER BY day) AS c FROM z), p AS (SELECT *, c - greatest(max(c) OVER (PARTITION BY symbol, stress ORDER BY day), 0) AS dd FROM c)
SELECT symbol, CAST(stress AS DOUBLE) AS stress, round(sum(net), 6) AS total, round(min(dd), 6) AS drawdown, round(avg((net > 0)::INT), 6) AS positive_days FROM p GROUP BY symbol, stress""",
)
def g14(spark, sf):
    got = ledgers.daily_summary(ledger(spark, sf), "net_return", [0.0, 0.002])
    return got.select("symbol", "stress", *[rnd(c).alias(c) for c in ("total", "drawdown", "positive_days")])


@query(
    "g15_activity",
    f"""WITH {LEDGER}, d AS (SELECT symbol, date_trunc('day', ts) AS day, count(*) AS n FROM lg GROUP BY ALL), g AS (SELECT symbol, unnest(generate_series(min(day), max(day), INTERVAL '1 day')) AS day FROM d GROUP BY symbol),
z AS (SELECT symbol, coalesce(n, 0) AS n FROM g LEFT JOIN d USING (symbol, day))
SELECT symbol, count_if(n = 0)::BIGINT AS days_0, count_if(n = 1)::BIGINT AS days_1, count_if(n = 2)::BIGINT AS days_2, count_if(n >= 3)::BIGINT AS days_3, quantile_cont(n, 0.5) AS median FROM z GROUP BY symbol""",
)
def g15(spark, sf):
    return ledgers.activity(ledger(spark, sf))


@query(
    "g34_alert_recall",
    f"""WITH {ONE}, x AS (SELECT symbol, ts, y = 2 AS pos, p2 >= 0.4 AS al FROM q), ps AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) > INTERVAL '2 hours', true)::INT AS new FROM x WHERE pos),
c AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts) AS c FROM ps), k AS (SELECT symbol, c, bool_or(al) AS hit FROM c GROUP BY ALL)
SELECT symbol, count(*) AS clusters, count_if(hit)::BIGINT AS recalled, (SELECT count(*) FROM x WHERE x.symbol = k.symbol AND al AND NOT pos) AS false_alerts FROM k GROUP BY symbol""",
)
def g34(spark, sf):
    return ledgers.alert_recall(one(spark, sf), F.col("y") == 2, F.col("p2") >= 0.4, F.expr("INTERVAL 2 HOURS"))


@query(
    "g36_volatility_ratio",
    f"""WITH {H}, r AS (SELECT symbol, CASE WHEN ts = lag(ts) OVER w + INTERVAL '1 hour' THEN abs(ln(close / lag(close) OVER w)) END AS r FROM h WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT round(quantile_cont(CASE WHEN symbol = 'view' THEN r END, 0.5) / quantile_cont(CASE WHEN symbol = 'click' THEN r END, 0.5), 6) AS ratio FROM r""",
)
def g36(spark, sf):
    return ledgers.volatility_ratio(hourly(spark, sf), "view", "click", F.expr("INTERVAL 1 HOUR")).select(rnd("ratio").alias("ratio"))


@query(
    "g27_rolling_cards",
    f"""WITH {PANEL}, c AS (SELECT model, CAST(date_trunc('week', ts) AS DATE) AS week, avg(p2 - p0) AS net, count(*) AS n FROM p GROUP BY ALL)
SELECT model, CAST(week AS VARCHAR) AS week, n, round(sum(net * n) OVER (PARTITION BY model ORDER BY week ROWS 1 PRECEDING) / sum(n) OVER (PARTITION BY model ORDER BY week ROWS 1 PRECEDING), 6) AS net_2,
  round(sum(net * n) OVER (PARTITION BY model ORDER BY week ROWS 3 PRECEDING) / sum(n) OVER (PARTITION BY model ORDER BY week ROWS 3 PRECEDING), 6) AS net_4 FROM c""",
)
def g27(spark, sf):
    c = probs(spark, sf).groupBy("model", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.avg(F.col("p2") - F.col("p0")).alias("net"), F.count(F.lit(1)).alias("n"))
    got = ledgers.rolling_cards(c, [2, 4])
    return got.select("model", F.col("week").cast("string").alias("week"), "n", rnd("net_2").alias("net_2"), rnd("net_4").alias("net_4"))


@query(
    "y41_weekly_router",
    f"""WITH {CARDS}, s AS (SELECT *, sum(payoff) OVER (PARTITION BY model ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM cd)
SELECT CAST(week AS VARCHAR) AS week, arg_min(model, (-s, model)) FILTER (s IS NOT NULL) AS choice FROM s GROUP BY week""",
)
def y41(spark, sf):
    return ledgers.follow_history(cards(spark, sf)).select(F.col("week").cast("string").alias("week"), "choice")


@query(
    "j22_two_members",
    f"""WITH {PANEL}, a AS (SELECT id, CASE WHEN greatest(p0, p1, p2) >= 0.45 THEN CASE WHEN p2 > p0 THEN 1 ELSE -1 END ELSE 0 END AS x FROM p WHERE model = 1), b AS (SELECT id, CASE WHEN greatest(p0, p1, p2) >= 0.4 THEN CASE WHEN p2 > p0 THEN 1 ELSE -1 END ELSE 0 END AS z FROM p WHERE model = 3)
SELECT coalesce(a.id, b.id) AS id, sign(coalesce(x, 0) + coalesce(z, 0))::INT AS side FROM a FULL JOIN b ON a.id = b.id""",
)
def j22(spark, sf):
    p = probs(spark, sf).withColumns({"conf": F.greatest(*panel.P), "side": F.when(F.col("p2") > F.col("p0"), 1).otherwise(-1)})
    return ledgers.two_members(p.where("model = 1"), p.where("model = 3"), 0.45, 0.4)


@query(
    "j23_whole_window",
    f"""WITH {ONE}, b AS (SELECT symbol, ts, lead(ts) OVER w AS n, lead(ts, 4) OVER w AS e FROM h WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT id FROM q JOIN b USING (symbol, ts) WHERE n = ts + INTERVAL '1 hour' AND e = ts + INTERVAL '4 hours' AND pred <> 1""",
)
def j23(spark, sf):
    return ledgers.whole_window(one(spark, sf).where("pred <> 1"), hourly(spark, sf), 4, 3600).select("id")


@query(
    "w34_market_context",
    f"""WITH {H}, r AS (SELECT *, abs(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts))) AS v FROM h), q AS (SELECT *, quantile_cont(v, 1 / 3.0) OVER c AS lo, quantile_cont(v, 2 / 3.0) OVER c AS hi, count(v) OVER c AS k FROM r
  WINDOW c AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING))
SELECT symbol, epoch(ts)::BIGINT AS ts_s, CASE WHEN k < 24 OR v IS NULL THEN NULL WHEN v <= lo THEN 'LOW' WHEN v <= hi THEN 'NORMAL' ELSE 'HIGH' END AS regime FROM q""",
)
def w34(spark, sf):
    def cut(f):
        w, v = f.before(48), F.col("v")
        lo, hi = F.percentile("v", 1 / 3.0).over(w), F.percentile("v", 2 / 3.0).over(w)
        return {"regime": F.when((F.count("v").over(w) < 24) | v.isNull(), None).when(v <= lo, "LOW").when(v <= hi, "NORMAL").otherwise("HIGH")}

    got = rolling(hourly(spark, sf), 50, lambda f: {"v": F.abs(F.ln(F.col("close") / F.lag("close").over(f.order)))}, cut)
    return got.select("symbol", epoch().alias("ts_s"), "regime")


@query(
    "w24_window_extremes",
    f"""WITH {H}, w AS (SELECT *, symbol || CAST(CAST(ts AS DATE) AS VARCHAR) AS win FROM h), m AS (SELECT *, min(low) OVER (PARTITION BY win ORDER BY ts) AS lo, row_number() OVER (PARTITION BY win ORDER BY ts) AS i FROM w),
n AS (SELECT *, coalesce(lo < lag(lo) OVER (PARTITION BY win ORDER BY ts), true) AS new FROM m)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, round(lo, 6) AS running_low, round((close / lo - 1) * 1e4, 4) AS recovery_bps, (i - max(CASE WHEN new THEN i END) OVER (PARTITION BY win ORDER BY ts))::BIGINT AS bars_since FROM n""",
)
def w24(spark, sf):
    from pyspark.sql import Window

    h = hourly(spark, sf).withColumn("win", F.concat("symbol", F.to_date("ts").cast("string")))
    w = Window.partitionBy("win").orderBy("ts")
    h = h.withColumns({"lo": F.min("low").over(w.rowsBetween(Window.unboundedPreceding, 0)), "i": F.row_number().over(w)})
    h = h.withColumn("new", F.coalesce(F.col("lo") < F.lag("lo").over(w), F.lit(True)))
    since = F.col("i") - F.max(F.when(F.col("new"), F.col("i"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return h.select("symbol", epoch().alias("ts_s"), rnd("lo").alias("running_low"), rnd((F.col("close") / F.col("lo") - 1) * 1e4, 4).alias("recovery_bps"), since.cast("long").alias("bars_since"))


@query(
    "w27_window_summaries",
    f"""WITH {H}, w AS (SELECT *, symbol || CAST(CAST(ts AS DATE) AS VARCHAR) AS win FROM h)
SELECT win, count(*) AS bars, round(arg_max(close, ts) - arg_min(close, ts), 6) AS delta, round(avg(close), 6) AS mean, round(stddev_pop(close), 6) AS sd FROM w GROUP BY win""",
)
def w27(spark, sf):
    h = hourly(spark, sf).withColumn("win", F.concat("symbol", F.to_date("ts").cast("string")))
    return h.groupBy("win").agg(
        F.count(F.lit(1)).alias("bars"), rnd(F.max_by("close", "ts") - F.min_by("close", "ts")).alias("delta"), rnd(F.avg("close")).alias("mean"), rnd(F.stddev_pop("close")).alias("sd")
    )


@query(
    "w21_past_horizons",
    f"""WITH {H}, r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM h)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, round(sqrt(sum(r * r) OVER {last(6)}), 6) AS rv_6, round(sqrt(sum(r * r) OVER {last(24)}), 6) AS rv_24, round(max(high) OVER {last(6)} / min(low) OVER {last(6)} - 1, 6) AS range_6 FROM r""",
)
def w21(spark, sf):
    rv = lambda f, n: F.sqrt(F.sum(F.col("r") * F.col("r")).over(f.over(n)))
    got = rolling(
        hourly(spark, sf), 25, lambda f: {"r": F.ln(F.col("close") / F.lag("close").over(f.order))},
        lambda f: {"rv_6": rv(f, 6), "rv_24": rv(f, 24), "range_6": F.max("high").over(f.over(6)) / F.min("low").over(f.over(6)) - 1},
    )
    return got.select("symbol", epoch().alias("ts_s"), *[rnd(c).alias(c) for c in ("rv_6", "rv_24", "range_6")])


@query(
    "g25_scorer_agreement",
    f"""WITH {PANEL} SELECT round(avg(abs(a.p2 - b.p2)), 6) AS mae, round(corr(a.p2, b.p2), 6) AS corr, round(avg(((a.p2 > a.p0) = (b.p2 > b.p0))::INT), 6) AS same_side FROM p a JOIN p b ON a.id = b.id AND a.model = 1 AND b.model = 2""",
)
def g25(spark, sf):
    p = probs(spark, sf)
    a, b = (p.where(f"model = {m}").select("id", F.col("p2").alias(f"u{m}"), (F.col("p2") > F.col("p0")).alias(f"s{m}")) for m in (1, 2))
    j = a.join(b, "id")
    return j.agg(rnd(F.avg(F.abs(F.col("u1") - F.col("u2")))).alias("mae"), rnd(F.corr("u1", "u2")).alias("corr"), rnd(F.avg((F.col("s1") == F.col("s2")).cast("double"))).alias("same_side"))


@query(
    "j7_daily_value",
    f"""WITH {H}, d AS (SELECT symbol, date_trunc('day', ts) + INTERVAL '1 day' AS available_at, 50 + avg(close - open) AS v FROM h GROUP BY ALL)
SELECT h.symbol, epoch(h.ts)::BIGINT AS ts_s, round(coalesce(v, 50), 6) AS level FROM h ASOF LEFT JOIN d ON h.symbol = d.symbol AND h.ts >= d.available_at""",
)
def j7(spark, sf):
    from tidemark.operators import asof

    h = hourly(spark, sf)
    d = h.groupBy("symbol", F.date_trunc("day", "ts").alias("d")).agg((50 + F.avg(F.col("close") - F.col("open"))).alias("v"))
    d = d.select("symbol", (F.col("d") + F.expr("INTERVAL 1 DAY")).alias("available_at"), "v")
    return asof.backward(h, d, ["v"]).select("symbol", epoch().alias("ts_s"), rnd(F.coalesce("v", F.lit(50.0))).alias("level"))


@query(
    "l1_dead_zone",
    f"""WITH {H}, l AS (SELECT symbol, ts, lead(close, 4) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS r FROM h) SELECT symbol, epoch(ts)::BIGINT AS ts_s, CASE WHEN r IS NULL THEN -1 WHEN r > 0.01 THEN 2 WHEN r < -0.01 THEN 0 ELSE 1 END AS label FROM l""",
)
def l1(spark, sf):
    from tidemark.operators import labels

    return labels.dead_zone(hourly(spark, sf), 100, 4).select("symbol", epoch().alias("ts_s"), "label")


@query("u6_prefer_first", f"WITH {PANEL} SELECT a.id, coalesce(c.p2, a.p2) > 0.3 AS signal FROM p a LEFT JOIN p c ON c.id = a.id AND c.model = 3 WHERE a.model = 1")
def u6(spark, sf):
    p = probs(spark, sf)
    c = p.where("model = 3").select("id", F.col("p2").alias("first"))
    return p.where("model = 1").join(c, "id", "left").select("id", (F.coalesce("first", "p2") > 0.3).alias("signal"))


@query("w33_trade_numbers", f"WITH {LEDGER} SELECT id, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS n FROM lg")
def w33(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts")
    return ledger(spark, sf).select("id", F.row_number().over(w).cast("long").alias("n"))

