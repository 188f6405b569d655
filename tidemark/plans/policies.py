"""Queries on policies, panels, folds and statistics of ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import economics, gates, labels, models, policies, splits, stories
from tidemark.plans.base import H, T, epoch, hourly, query, rnd, table, ticks
from tidemark.plans.channels import DAYS  # noqa: F401
from tidemark.plans.evaluation import ARG, CONF, LEDGER, ONE, PANEL, TENTHS, WIN, ledger, one, probs, windows
from tidemark.plans.market import TRADES, trades
from tidemark.plans.models import FEATURES, _rows
from tidemark.plans.outcomes import DX, SIG, brackets, exits, signals
from tidemark.plans.text import ART, articles

BASE = f"{T}, {TRADES}, bs AS (SELECT * FROM tr WHERE price >= 250), cn AS (SELECT * FROM tr WHERE price < 250)"


@query(
    "y21_base_first",
    f"""WITH RECURSIVE {BASE}, ok AS (SELECT * FROM cn c WHERE NOT EXISTS (SELECT 1 FROM bs WHERE bs.symbol = c.symbol AND c.start <= bs."end" AND c."end" >= bs.start)),
g AS (SELECT symbol, id, start, "end" FROM (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY start, id) = 1)
  UNION ALL SELECT n.symbol, n.id, n.start, n."end" FROM g, LATERAL (SELECT * FROM ok WHERE ok.symbol = g.symbol AND ok.start > g."end" ORDER BY start, id LIMIT 1) n)
SELECT c.id, CASE WHEN g.id IS NOT NULL THEN 'taken' WHEN ok.id IS NOT NULL THEN 'busy' ELSE 'base' END AS reason FROM cn c LEFT JOIN ok ON ok.id = c.id LEFT JOIN g ON g.id = c.id""",
)
def y21(spark, sf):
    t = trades(spark, sf)
    return policies.base_first(t.where("price < 250"), t.where("price >= 250"))


VOTES = f"{PANEL}, vt AS (SELECT id, symbol, ts, model, CASE WHEN {CONF} >= 0.4 THEN {ARG} - 1 ELSE 0 END AS side, {CONF} AS conf, p0, p1, p2, y FROM p)"


def votes(spark, sf):
    from tidemark.operators import panel

    conf = F.greatest(*panel.P)
    return probs(spark, sf).withColumns({"conf": conf, "side": F.when(conf >= 0.4, panel.argmax() - 1).otherwise(0)})


@query(
    "y22_side_votes",
    f"""WITH {VOTES}, c AS (SELECT id, count_if(side = 1) AS u, count_if(side = -1) AS d, max(CASE WHEN side <> 0 THEN conf END) AS c FROM vt GROUP BY id),
r AS (SELECT *, CASE WHEN u > 0 AND d = 0 THEN 1 WHEN d > 0 AND u = 0 THEN -1 ELSE 0 END AS s FROM c), t AS (SELECT *, CASE WHEN s <> 0 AND u + d >= 2 THEN 'majority' WHEN s <> 0 AND c >= 0.6 THEN 'solo' END AS route FROM r)
SELECT id, CASE WHEN route IS NULL THEN 0 ELSE s END AS side, route FROM t""",
)
def y22(spark, sf):
    return policies.side_votes(votes(spark, sf), 0.6)


@query(
    "e6_margin_sides",
    f"""WITH {PANEL}, m AS (SELECT id, list_reduce(list(model / 2.0::DOUBLE * (p2 - p0) ORDER BY model), lambda x, y: x + y) AS m, arg_max(sign(p2 - p0), (greatest(p0, p2), -model)) AS s FROM p GROUP BY id)
SELECT id, (CASE WHEN abs(m) > 1e-12 THEN sign(m) ELSE s END)::INT AS side FROM m""",
)
def e6(spark, sf):
    return policies.margin_sides(probs(spark, sf).withColumn("w", F.col("model") / 2.0))


@query(
    "y30_one_bar_trades",
    f"""WITH {H}, s AS (SELECT symbol, ts, CASE WHEN close > open * 1.02 THEN 1 WHEN close < open * 0.98 THEN -1 ELSE 0 END AS side, lead(ts) OVER w AS t, lead(open) OVER w AS o, lead(close) OVER w AS c FROM h WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, epoch(ts)::BIGINT AS ts_s, side, round(side * (c / o - 1) - 0.002, 6) AS net FROM s WHERE side <> 0 AND t = ts + INTERVAL '1 hour'""",
)
def y30(spark, sf):
    side = F.when(F.col("close") > F.col("open") * 1.02, 1).when(F.col("close") < F.col("open") * 0.98, -1).otherwise(0)
    return policies.one_bar_trades(hourly(spark, sf).withColumn("side", side), 3600, 0.001).select("symbol", epoch().alias("ts_s"), "side", rnd("net").alias("net"))


@query(
    "y35_portfolio",
    f"""WITH {LEDGER}, {H}, a AS (SELECT symbol, date_trunc('hour', ts) AS ts, exit_reason AS arm, net_return AS net FROM lg), g AS (SELECT symbol, ts, sum(net) AS total, count(DISTINCT arm) AS arms FROM a GROUP BY ALL)
SELECT h.symbol, epoch(h.ts)::BIGINT AS ts_s, round(coalesce(total, 0), 6) AS total, coalesce(arms, 0)::BIGINT AS arms FROM h LEFT JOIN g USING (symbol, ts)""",
)
def y35(spark, sf):
    arms = ledger(spark, sf).select("symbol", F.date_trunc("hour", "ts").alias("ts"), F.col("exit_reason").alias("arm"), F.col("net_return").alias("net"))
    got = policies.portfolio(arms, hourly(spark, sf))
    return got.select("symbol", epoch().alias("ts_s"), rnd("total").alias("total"), F.col("arms").cast("long").alias("arms"))


@query("y42_spaced_best")
def y42(spark, sf):
    """Greedy by score, not by time: no plain SQL; tests compare with a loop over the given rows."""
    return policies.spaced_best(one(spark, sf).withColumn("score", F.col("p2")), 40, 2 * 3600).select("id", rnd("score").alias("score"))


@query(
    "y44_matched_crossings",
    f"""WITH {PANEL}, n AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p2 DESC) AS k, count(*) OVER (PARTITION BY model) AS c FROM p), t AS (SELECT model, p2 AS cut FROM n WHERE k = greatest(1, floor(c * 0.2)::BIGINT)),
x AS (SELECT p.id, p.model, p.p2 - cut AS l, lag(p.p2 - cut) OVER (PARTITION BY p.symbol, p.model ORDER BY p.ts) AS b FROM p JOIN t ON t.model = p.model) SELECT id, model FROM x WHERE l >= 0 AND (b IS NULL OR b < 0)""",
)
def y44(spark, sf):
    return policies.matched_crossings(probs(spark, sf).withColumn("score", F.col("p2")), 0.2).select("id", "model")


LESSONS = [{"when": "p2 > 0.5", "class": 2, "weight": 0.5}, {"when": "p0 < 0.2 and not (p1 >= 0.5)", "class": 1, "weight": 2.0}, {"when": "p1 > 0.6", "flat": True}]


@query(
    "y38_lessons",
    f"""WITH {ONE}, a AS (SELECT id, p0, p1, CASE WHEN p2 > 0.5 THEN p2 * 0.5 ELSE p2 END AS p2 FROM q), b AS (SELECT id, p0, CASE WHEN p0 < 0.2 AND NOT p1 >= 0.5 THEN p1 * 2 ELSE p1 END AS p1, p2 FROM a), c AS (SELECT *, p1 > 0.6 AS f FROM b)
SELECT id, round(CASE WHEN f THEN 0 ELSE p0 / (p0 + p1 + p2) END, 6) AS p0, round(CASE WHEN f THEN 1 ELSE p1 / (p0 + p1 + p2) END, 6) AS p1, round(CASE WHEN f THEN 0 ELSE p2 / (p0 + p1 + p2) END, 6) AS p2 FROM c""",
)
def y38(spark, sf):
    got = policies.lessons_applied(one(spark, sf), LESSONS, {"p0", "p1", "p2"})
    return got.select("id", *[rnd(c).alias(c) for c in ("p0", "p1", "p2")])


RULES = [{"when": "p2 > 0.4", "model": 2, "times": 0.5}, {"when": "symbol = 'view'", "model": 3, "set": 2.0}, {"when": "p1 > 0.5", "tau": 0.6}]


@query(
    "y39_rules",
    f"""WITH {PANEL} SELECT id, model, CASE WHEN symbol = 'view' AND model = 3 THEN 2.0 WHEN p2 > 0.4 AND model = 2 THEN 0.5 ELSE 1.0 END::DOUBLE AS w, CASE WHEN p1 > 0.5 THEN 0.6 ELSE 0.45 END::DOUBLE AS tau FROM p""",
)
def y39(spark, sf):
    return policies.rules_compiled(probs(spark, sf), RULES, {"p1", "p2", "symbol"}, 0.45).select("id", "model", "w", "tau")


@query("p5_text_condition", f"WITH {ONE} SELECT id, p2 > 0.4 AND NOT (p1 < 0.2 OR p0 >= 0.3) AS holds FROM q")
def p5(spark, sf):
    return one(spark, sf).select("id", policies.condition("p2 > 0.4 and not (p1 < 0.2 or p0 >= 0.3)", {"p0", "p1", "p2"}).alias("holds"))


@query("p10_coverage", f"WITH {PANEL}, a AS (SELECT id, symbol, {ARG} AS pred, p2 FROM p WHERE model = 1), b AS (SELECT id, {ARG} AS pred FROM p WHERE model = 2) SELECT a.id, a.pred = 2 AND b.pred <> 0 AND a.p2 >= 0.4 AND a.p2 < 0.55 AS covered FROM a JOIN b USING (id)")
def p10(spark, sf):
    from tidemark.operators import panel

    p = probs(spark, sf).withColumn("pred", panel.argmax())
    a, b = p.where("model = 1").select("id", F.col("pred").alias("a"), "p2"), p.where("model = 2").select("id", F.col("pred").alias("b"))
    return a.join(b, "id").select("id", ((F.col("a") == 2) & (F.col("b") != 0) & (F.col("p2") >= 0.4) & (F.col("p2") < 0.55)).alias("covered"))


@query(
    "y7_dynamic_gate",
    f"""WITH {ONE}, v AS (SELECT q.id, pred, conf, n >= 4 AS busy, 2 * taker / volume - 1 AS flow FROM q JOIN h USING (symbol, ts))
SELECT id, CASE WHEN conf < CASE WHEN busy THEN 0.5 ELSE 0.4 END THEN 'gate' WHEN (pred - 1) * flow < -0.5 THEN 'veto' WHEN pred = 1 THEN 'flat' ELSE 'pass' END AS reason FROM v""",
)
def y7(spark, sf):
    h = hourly(spark, sf).select("symbol", "ts", (F.col("n") >= 4).alias("busy"), (2 * F.col("taker") / F.col("volume") - 1).alias("flow"))
    q = one(spark, sf).join(h, ["symbol", "ts"])
    reason = F.when(F.col("conf") < F.when(F.col("busy"), 0.5).otherwise(0.4), "gate").when((F.col("pred") - 1) * F.col("flow") < -0.5, "veto").when(F.col("pred") == 1, "flat").otherwise("pass")
    return q.select("id", reason.alias("reason"))


@query(
    "y10_joint_crossing",
    f"""WITH {SIG}, {exits('sg', 'ex', 3)}, w AS (SELECT id, symbol || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS win, ts, CASE WHEN abs(p2 - p0) >= 0.1 THEN 1.5 * greatest(p2, p0) - least(p2, p0) - 0.1 END AS ev FROM sg),
x AS (SELECT *, min(CASE WHEN ev >= 0.4 THEN ts END) OVER (PARTITION BY win) AS hit FROM w) SELECT x.id, outcome, round(rg - CASE WHEN outcome = 'target' THEN 0.0004 ELSE 0.001 END * ex.entry / abs(ex.entry - stop), 5) AS r_net FROM x JOIN ex ON ex.id = x.id WHERE x.ts = hit""",
)
def y10(spark, sf):
    s = signals(spark, sf)
    ev = F.when(F.abs(F.col("p2") - F.col("p0")) >= 0.1, 1.5 * F.greatest("p2", "p0") - F.least("p2", "p0") - 0.1)
    w = s.withColumns({"win": F.concat_ws("-", "symbol", F.to_date("ts").cast("string")), "ev": ev})
    entered = gates.first_crossing(w, "win", "ev", 0.4).where("action = 'ENTER'").select("id")
    got = labels.exit_labels(s, hourly(spark, sf), "id", 3 * 3600, 3600).join(entered, "id").join(s.select("id", "entry", "stop"), "id")
    cost = F.when(F.col("outcome") == "target", 0.0004).otherwise(0.001) * F.col("entry") / F.abs(F.col("entry") - F.col("stop"))
    return got.select("id", "outcome", rnd(F.col("r_gross") - cost, 5).alias("r_net"))


@query(
    "y11_large_move",
    f"""WITH {WIN}, e AS (SELECT id, win, ts, CASE WHEN score + p0 >= 0.6 AND score / (score + p0) >= 0.6 THEN score - p0 END AS ev FROM wn), x AS (SELECT *, min(CASE WHEN ev >= 0.2 THEN ts END) OVER (PARTITION BY win) AS hit FROM e)
SELECT x.id, round(ev, 6) AS ev FROM x WHERE ts = hit""",
)
def y11(spark, sf):
    p, d = F.col("score"), F.col("p0")
    w = windows(spark, sf).withColumn("ev", F.when((p + d >= 0.6) & (p / (p + d) >= 0.6), p - d))
    return gates.first_crossing(w, "win", "ev", 0.2).where("action = 'ENTER'").select("id", rnd("ev").alias("ev"))


@query(
    "y18_frontier",
    f"""WITH {WIN}, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6]) AS threshold), x AS (SELECT threshold, symbol, score >= threshold AND coalesce(lag(score) OVER (PARTITION BY threshold, symbol ORDER BY ts) < threshold, true) AS up, score >= threshold AS on_ FROM wn, t)
SELECT CAST(threshold AS DOUBLE) AS threshold, symbol, count_if(on_)::BIGINT AS rows_on, count_if(up)::BIGINT AS crossings FROM x GROUP BY ALL""",
)
def y18(spark, sf):
    from tidemark.operators.series import previous

    w = windows(spark, sf).select("symbol", "ts", "score")
    w = previous(w, {"before": "score"}).withColumn("threshold", F.explode(F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.4, 0.5, 0.6)))))
    on = F.col("score") >= F.col("threshold")
    return w.groupBy("threshold", "symbol").agg(F.count_if(on).alias("rows_on"), F.count_if(on & F.coalesce(F.col("before") < F.col("threshold"), F.lit(True))).alias("crossings"))


@query(
    "y25_union_qualified",
    f"""WITH {ONE}, {T}, {TRADES}, m AS (SELECT q.id, bool_or(tr.id IS NOT NULL) AS inside FROM q LEFT JOIN tr ON tr.symbol = q.symbol AND tr.start <= q.ts AND tr."end" >= q.ts GROUP BY q.id)
SELECT id, CASE WHEN pred = 1 THEN 'flat' WHEN conf < 0.45 THEN 'weak' WHEN inside THEN 'inside' ELSE 'ok' END AS reason FROM q JOIN m USING (id)""",
)
def y25(spark, sf):
    from tidemark.operators import intervals

    got = intervals.inside_any(one(spark, sf), trades(spark, sf))
    return got.select("id", F.when(F.col("pred") == 1, "flat").when(F.col("conf") < 0.45, "weak").when(F.col("inside"), "inside").otherwise("ok").alias("reason"))


@query("y27_add_on", f"WITH {PANEL}, a AS (SELECT id, p0 + p2 AS move, p2 / (p0 + p2) AS up FROM p WHERE model = 2), b AS (SELECT id, {ARG} AS pred FROM p WHERE model = 1) SELECT a.id, CASE WHEN up >= 0.5 THEN 1 ELSE -1 END AS side FROM a JOIN b USING (id) WHERE pred = 1 AND move >= 0.6 AND greatest(up, 1 - up) >= 0.6")
def y27(spark, sf):
    """Moves that the second member is sure of where the first stays flat."""
    from tidemark.operators import panel

    p = probs(spark, sf)
    a = p.where("model = 2").select("id", (F.col("p0") + F.col("p2")).alias("move"), (F.col("p2") / (F.col("p0") + F.col("p2"))).alias("up"))
    flat = p.where("model = 1").where(panel.argmax() == 1).select("id")
    return a.join(flat, "id").where("move >= 0.6 and greatest(up, 1 - up) >= 0.6").select("id", F.when(F.col("up") >= 0.5, 1).otherwise(-1).alias("side"))


@query(
    "y36_win_filter",
    f"""WITH {SIG}, {exits('sg', 'ex', 3)}, t AS (SELECT unnest([0.4, 0.5, 0.6]) AS theta) SELECT CAST(theta AS DOUBLE) AS theta, count(*) AS trades, round(avg((rg > 0)::INT), 6) AS win_rate, round(sum(rg), 4) AS total_r FROM ex, t WHERE greatest(p0, p2) >= theta AND rg IS NOT NULL GROUP BY theta""",
)
def y36(spark, sf):
    s = signals(spark, sf)
    got = labels.exit_labels(s, hourly(spark, sf), "id", 3 * 3600, 3600).join(s.select("id", F.greatest("p0", "p2").alias("p_win")), "id").where("r_gross is not null")
    kept = got.withColumn("theta", F.explode(F.array(*map(F.lit, (0.4, 0.5, 0.6))))).where("p_win >= theta")
    return kept.groupBy("theta").agg(F.count(F.lit(1)).alias("trades"), rnd(F.avg((F.col("r_gross") > 0).cast("double"))).alias("win_rate"), rnd(F.sum("r_gross"), 4).alias("total_r"))


FSQL = """sp AS (SELECT date_trunc('day', min(start)) AS a0, CAST(max(start) AS DATE) - CAST(min(start) AS DATE) + 1 AS d FROM tr),
fd AS (SELECT fold, CAST(a0 + to_days(CAST(floor(d * lo / 10) AS INTEGER)) AS TIMESTAMP) AS a, CAST(a0 + to_days(CAST(floor(d * hi / 10) AS INTEGER)) AS TIMESTAMP) AS b FROM sp, (VALUES (0, 3, 5), (1, 5, 8), (2, 8, 10)) x(fold, lo, hi))"""


@query(
    "v3_fold_roles",
    f"""WITH {T}, {TRADES}, {FSQL}, z AS (SELECT min(start) AS z FROM tr) SELECT fold, id, CASE WHEN start >= a THEN CASE WHEN "end" > b THEN 'censored' ELSE 'test' END WHEN start < z + INTERVAL '1 day' THEN 'warm_up'
  WHEN start >= a - INTERVAL '4 hours' THEN 'embargo' WHEN "end" >= a - INTERVAL '4 hours' THEN 'purged' WHEN start >= a - INTERVAL '52 hours' THEN 'calibration' ELSE 'fit' END AS role FROM tr, fd, z WHERE start < b""",
)
def v3(spark, sf):
    t = trades(spark, sf).select("id", F.col("start").alias("ts"), F.col("end").alias("label_end"))
    folds = splits.fold_spans(t, TENTHS)
    return policies.fold_roles(t, folds, 86400, 48 * 3600, 4 * 3600)


EPS = f"{T}, {TRADES}, ep AS (SELECT id, symbol || CAST(CAST(start AS DATE) AS VARCHAR) AS episode, start AS ts, \"end\" AS label_end FROM tr)"


@query(
    "v5_inner_parts",
    f"""WITH {EPS}, e AS (SELECT episode, max(ts) AS l, min(ts) AS f FROM ep GROUP BY episode), k AS (SELECT l FROM (SELECT l, row_number() OVER (ORDER BY l) AS k, count(*) OVER () AS n FROM e) WHERE k = greatest(1, floor(n * 0.7)::BIGINT)),
b AS (SELECT min(f) AS b FROM e, k WHERE e.l > k.l) SELECT id, CASE WHEN e.l > k.l THEN 'calibrate' WHEN label_end >= b.b THEN 'purged' ELSE 'fit' END AS part FROM ep JOIN e USING (episode), k, b""",
)
def v5(spark, sf):
    t = trades(spark, sf)
    return policies.inner_parts(t.select("id", F.concat("symbol", F.to_date("start").cast("string")).alias("episode"), F.col("start").alias("ts"), F.col("end").alias("label_end")), 0.7)


@query(
    "b8_admission",
    f"""WITH {LEDGER}, w AS (SELECT symbol, date_trunc('week', ts) AS w, sum(net_return) AS n FROM lg GROUP BY ALL), g AS (SELECT symbol, count(*) AS blocks, quantile_cont(n, 0.5) AS median, avg((n > 0)::INT) AS positive FROM w GROUP BY symbol)
SELECT symbol, blocks, round(median, 5) AS median, round(positive, 6) AS positive, median > 0 AND positive >= 0.5 AND blocks >= 3 AS admitted FROM g""",
)
def b8(spark, sf):
    got = policies.quarter_gate(ledger(spark, sf), 0.5)
    return got.select("symbol", "blocks", rnd("median", 5).alias("median"), rnd("positive").alias("positive"), "admitted")


def _blocks(spark, sf):
    l = ledger(spark, sf).withColumn("episode", F.concat_ws("-", "symbol", F.to_date("ts").cast("string")))
    return policies.episode_sums(l, "net_return")


@query("b2_trial_adjusted")
def b2(spark, sf):
    """The interval of the mean at 5 % over 20 trials; resampling has no SQL, its point is in b1's."""
    got = economics.block_bootstrap(_blocks(spark, sf), "t", "c", alpha=0.05 / 20)
    return got.select(*[rnd(c).alias(c) for c in ("point", "low", "high")])


@query("b3_paired_delta")
def b3(spark, sf):
    """The interval of the summed difference between an arm and the same arm at twice its costs, by whole episodes."""
    l = ledger(spark, sf).withColumns({"episode": F.concat_ws("-", "symbol", F.to_date("ts").cast("string")), "delta": F.when(F.col("exit_reason") == "stop", -0.002).otherwise(0.001)})
    got = economics.paired_bootstrap(policies.episode_sums(l, "delta"), "t")
    return got.select(*[rnd(c).alias(c) for c in ("point", "low", "high")])


@query(
    "b_points",
    f"""WITH {LEDGER}, e AS (SELECT symbol || '-' || CAST(ts::DATE AS VARCHAR) AS episode, sum(net_return) AS t, count(*) AS c, sum(CASE WHEN exit_reason = 'stop' THEN -0.002 ELSE 0.001 END) AS d FROM lg GROUP BY 1)
SELECT round(sum(t) / sum(c), 6) AS mean, round(sum(d), 6) AS delta, count(*) AS episodes FROM e""",
)
def b_points(spark, sf):
    """What the intervals of b1 to b3 are about: the mean and the summed difference over whole episodes, of which no draw leaves any out."""
    l = ledger(spark, sf).withColumns({"episode": F.concat_ws("-", "symbol", F.to_date("ts").cast("string")), "delta": F.when(F.col("exit_reason") == "stop", -0.002).otherwise(0.001)})
    mean = economics.block_bootstrap(policies.episode_sums(l, "net_return"), "t", "c", draws=50)
    e = policies.episode_sums(l, "delta")
    delta = economics.paired_bootstrap(e, "t", draws=50)
    got = mean.select(rnd("point").alias("mean")).join(F.broadcast(delta.select(rnd("point").alias("delta"))), F.lit(True))
    return got.join(F.broadcast(e.agg(F.count(F.lit(1)).alias("episodes"))), F.lit(True))


@query(
    "g6_worst_conditions",
    f"""WITH {VOTES}, r AS (SELECT model, side + 1 = y AS hit, symbol, CAST(conf >= 0.5 AS VARCHAR) AS sure FROM vt), l AS (SELECT model, hit, 'symbol' AS condition, symbol AS value FROM r UNION ALL SELECT model, hit, 'sure', sure FROM r)
SELECT model, condition, value, count(*) AS n, round(avg((NOT hit)::INT), 6) AS error FROM l GROUP BY ALL ORDER BY avg((NOT hit)::INT) DESC, n DESC, model, condition, value LIMIT 6""",
)
def g6(spark, sf):
    v = votes(spark, sf).withColumns({"hit": F.col("side") + 1 == F.col("y"), "sure": F.col("conf") >= 0.5})
    return policies.worst_conditions(v, ["symbol", "sure"], 6).select("model", "condition", "value", "n", rnd("error").alias("error"))


@query(
    "g11_exit_summary",
    f"""WITH {DX}, {exits('dx', 'ex', 6)} SELECT symbol, count(*) AS decisions, count(rg) AS trades, round(avg(rg), 5) AS mean_r, round(stddev_samp(rg) / sqrt(count(rg)), 5) AS standard_error, round(avg((outcome = 'stop')::INT), 6) AS stops, round(avg((outcome = 'target')::INT), 6) AS targets,
  count(DISTINCT CAST(exit_ts AS DATE)) AS days FROM ex GROUP BY symbol""",
)
def g11(spark, sf):
    d = brackets(spark, sf)
    got = labels.exit_labels(d, hourly(spark, sf), "id", 6 * 3600, 3600).join(d.select("id", "symbol"), "id")
    share = lambda o: rnd(F.avg((F.col("outcome") == o).cast("double")))
    return got.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("decisions"), F.count("r_gross").alias("trades"), rnd(F.avg("r_gross"), 5).alias("mean_r"), rnd(F.stddev_samp("r_gross") / F.sqrt(F.count("r_gross")), 5).alias("standard_error"),
        share("stop").alias("stops"), share("target").alias("targets"), F.count_distinct(F.to_date("exit_ts")).alias("days"),
    )


@query(
    "g12_order_metrics",
    f"""WITH {SIG}, {exits('sg', 'ex', 3)}, o AS (SELECT t.t AS threshold, outcome <> 'censored' AS filled, rg FROM ex, (SELECT unnest([0.4, 0.5]) AS t) t WHERE greatest(p0, p2) >= t.t)
SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) AS orders, count_if(filled)::BIGINT AS fills, round(avg(filled::INT), 6) AS fill_rate, round(avg(CASE WHEN filled THEN (rg > 0)::INT END), 6) AS win_rate, round(avg(CASE WHEN filled THEN rg END), 5) AS mean_r FROM o GROUP BY threshold""",
)
def g12(spark, sf):
    s = signals(spark, sf)
    got = labels.exit_labels(s, hourly(spark, sf), "id", 3 * 3600, 3600).join(s.select("id", F.greatest("p0", "p2").alias("score")), "id")
    rows = got.withColumn("threshold", F.explode(F.array(F.lit(0.4), F.lit(0.5)))).where("score >= threshold").select("threshold", (F.col("outcome") != "censored").alias("filled"), F.col("r_gross").alias("r_net"))
    return policies.order_metrics(rows).select("threshold", "orders", "fills", rnd("fill_rate").alias("fill_rate"), rnd("win_rate").alias("win_rate"), rnd("mean_r", 5).alias("mean_r"))


@query(
    "g28_payoff_statistics",
    f"""WITH {LEDGER}, w AS (SELECT symbol, date_trunc('day', ts) AS w, sum(net_return) AS n FROM lg GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY symbol ORDER BY w ROWS 11 PRECEDING) AS r12 FROM w)
SELECT symbol, count(*) AS blocks, round(sum(n), 5) AS total, round(avg((n > 0)::INT), 6) AS positive, round(arg_max(r12, w), 5) AS last_12 FROM r GROUP BY symbol""",
)
def g28(spark, sf):
    d = ledger(spark, sf).groupBy("symbol", F.date_trunc("day", "ts").alias("w")).agg(F.sum("net_return").alias("n"))
    r12 = F.sum("n").over(Window.partitionBy("symbol").orderBy("w").rowsBetween(-11, 0))  # a row a day
    return d.withColumn("r12", r12).groupBy("symbol").agg(F.count(F.lit(1)).alias("blocks"), rnd(F.sum("n"), 5).alias("total"), rnd(F.avg((F.col("n") > 0).cast("double"))).alias("positive"), rnd(F.max_by("r12", "w"), 5).alias("last_12"))


@query(
    "g32_top_against_all",
    f"""WITH {LEDGER}, s AS (SELECT *, (bars_held * 1000 + id % 997)::DOUBLE AS score FROM lg), c AS (SELECT unnest([0.1, 0.25]) AS q, unnest(quantile_cont(score, [0.9, 0.75])) AS cut FROM s)
SELECT CAST(q AS DOUBLE) AS q, count(*) AS n, round(avg(net_return), 6) AS mean, round(avg(net_return) - (SELECT avg(net_return) FROM s), 6) AS over_all FROM s, c WHERE score >= cut GROUP BY q""",
)
def g32(spark, sf):
    l = ledger(spark, sf).withColumn("score", (F.col("bars_held") * 1000 + F.col("id") % 997).cast("double"))
    return economics.top_against_all(l, "score", "net_return", [0.1, 0.25]).select("q", "n", rnd("mean").alias("mean"), rnd("over_all").alias("over_all"))


CTX = f"{ART}, ev AS (SELECT id, ts, source, (n_chars % 200) / 100.0 - 1 AS sent, n_chars % 17 AS impact FROM a), nw AS (SELECT * FROM ev WHERE ts < (SELECT max(ts) FROM ev) AND ts >= (SELECT max(ts) FROM ev) - INTERVAL '48 hours')"


@query(
    "g29_news_context",
    f"""WITH {CTX}, t AS (SELECT * FROM nw QUALIFY row_number() OVER (PARTITION BY source ORDER BY impact DESC, id) <= 2), b AS (SELECT id FROM t ORDER BY impact DESC, id LIMIT 8)
SELECT count(*) AS n, count(DISTINCT source) AS sources, round(avg(sent), 6) AS mean, round(stddev_pop(sent), 6) AS spread, max(impact) AS largest, (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FROM b) AS top FROM nw""",
)
def g29(spark, sf):
    e = articles(spark, sf).select("id", "ts", "source", (F.col("n_chars") % 200 / 100.0 - 1).alias("sent"), (F.col("n_chars") % 17).alias("impact"))
    end = e.agg(F.max("ts")).first()[0]
    got = policies.news_context(e, str(end), 48, 2, 8)
    return got.select("n", "sources", rnd("mean").alias("mean"), rnd("spread").alias("spread"), "largest", "top")


@query(
    "x9_news_rows",
    rf"""WITH {ART}, w AS (SELECT *, '<p class="x">' || text || '</p> see HTTPS://news.example.com/' || id || '?a=1 and' AS raw FROM a), c AS (SELECT *, left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '<[^>]+>', ' ', 'g'), '(?i)https?://[^\s\pZ]+', ' ', 'g'),
  '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '[\s\pZ\x{{85}}]+', ' ', 'g')), 500) AS summary FROM w)
SELECT substr(sha256(source || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') || '|' || summary), 1, 20) AS news_id, summary, least(greatest(n_chars / 1000.0 - 2, -1), 1) AS sentiment, greatest(n_chars - 500, 0) / 1000.0 AS impact FROM c""",
)
def x9(spark, sf):
    """Summaries without tags, addresses and control characters; ids by source, time and summary; sentiment within -1 to 1, impact from 0."""
    from tidemark.functions import text

    raw = F.concat(F.lit('<p class="x">'), "text", F.lit("</p> see HTTPS://news.example.com/"), F.col("id").cast("string"), F.lit("?a=1 and"))
    a = articles(spark, sf).withColumn("summary", text.sanitized(raw, 500))
    clip = F.greatest(F.least(F.col("n_chars") / 1000.0 - 2, F.lit(1.0)), F.lit(-1.0))
    return a.select(text.event_id(F.col("source"), F.col("ts"), F.col("summary")).alias("news_id"), "summary", clip.alias("sentiment"), (F.greatest(F.col("n_chars") - 500, F.lit(0)) / 1000.0).alias("impact"))


@query("x5_cutoff_first", f"WITH {ART}, c AS (SELECT to_timestamp((epoch(min(ts)) + epoch(max(ts))) // 2)::TIMESTAMP AS c FROM a), k AS (SELECT a.* FROM a, c WHERE ts < c) SELECT title, min(id) AS id, count(*) AS n FROM k GROUP BY title")
def x5(spark, sf):
    """Rows after the cutoff are dropped before anything is made of them."""
    a = articles(spark, sf)
    half = a.agg(F.floor((F.unix_timestamp(F.min("ts")) + F.unix_timestamp(F.max("ts"))) / 2)).first()[0]
    return stories.before_cutoff(a, F.timestamp_seconds(F.lit(half))).groupBy("title").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))


@query("x3_title_clusters")
def x3(spark, sf):
    """Greedy clusters by similarity have no SQL; tests compare with a loop over the given articles and over crowded ones."""
    return stories.title_clusters(articles(spark, sf), block=None)


@query("x2_first_seen", f"WITH {ART} SELECT id, ts = min(ts) OVER (PARTITION BY title) AS first_seen, count(*) OVER (PARTITION BY title) AS echoes FROM a")
def x2(spark, sf):
    a = articles(spark, sf)
    return a.join(stories.echo_counts(a, "title").withColumnRenamed("first_seen", "_f"), "title").select("id", (F.col("ts") == F.col("_f")).alias("first_seen"), "echoes")


@query("j10_attached_scores", "SELECT l.doc_id, quality, n_chars FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id")
def j10(spark, sf):
    from tidemark.operators.asof import attached

    return attached(table(spark, sf, "labels").select("doc_id", "quality"), table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", ["n_chars"])


@query("j20_market_context", f"WITH {ONE}, c AS (SELECT ts, avg(close) AS level FROM h WHERE symbol = 'view' GROUP BY ts) SELECT id, round(level, 6) AS level FROM q LEFT JOIN c ON c.ts = q.ts")
def j20(spark, sf):
    c = hourly(spark, sf).where("symbol = 'view'").groupBy("ts").agg(F.avg("close").alias("level"))
    return one(spark, sf).join(c, "ts", "left").select("id", rnd("level").alias("level"))


@query("p1_trainable_rows", f"WITH {H}, r AS (SELECT symbol, ts, ln(close / lag(close, 20) OVER w) AS ret_20, lead(close) OVER w / close - 1 AS f FROM h WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, epoch(ts)::BIGINT AS ts_s, CASE WHEN f > 0.005 THEN 2 WHEN f < -0.005 THEN 0 ELSE 1 END AS label FROM r WHERE ret_20 IS NOT NULL AND f IS NOT NULL")
def p1(spark, sf):
    from tidemark.operators import features

    got = labels.dead_zone(features.returns(hourly(spark, sf)), 50)
    return got.na.drop(subset=["ret_20"]).where("label <> -1").select("symbol", epoch().alias("ts_s"), "label")


@query("t1_stable_order", f"WITH {ONE} SELECT id, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY pred DESC, round(conf, 1) DESC, ts) AS place FROM q")
def t1(spark, sf):
    w = Window.partitionBy("symbol", F.to_date("ts")).orderBy(F.desc("pred"), F.desc(F.round("conf", 1)), "ts")
    return one(spark, sf).select("id", F.row_number().over(w).alias("place"))


@query(
    "e13_residual_bias",
    f"""WITH {SIG}, {exits('sg', 'ex', 3)}, r AS (SELECT symbol, rg - (p2 - p0) * side AS e, greatest(p0, p2) AS w FROM ex WHERE rg IS NOT NULL)
SELECT symbol, count(*) AS n, round(sum(e * w) / sum(w), 5) AS bias, round(quantile_cont(e, 0.01), 5) AS low, round(quantile_cont(e, 0.99), 5) AS high FROM r GROUP BY symbol""",
)
def e13(spark, sf):
    s = signals(spark, sf)
    got = labels.exit_labels(s, hourly(spark, sf), "id", 3 * 3600, 3600).where("r_gross is not null").join(s, "id")
    r = got.select("symbol", (F.col("r_gross") - (F.col("p2") - F.col("p0")) * F.col("side")).alias("e"), F.greatest("p0", "p2").alias("w"))
    return r.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum(F.col("e") * F.col("w")) / F.sum("w"), 5).alias("bias"), rnd(F.percentile("e", 0.01), 5).alias("low"), rnd(F.percentile("e", 0.99), 5).alias("high"))


@query("f14_rotated_labels", f"WITH {PANEL} SELECT id, model, model % 3 + 1 AS given FROM p")
def f14(spark, sf):
    m = F.create_map(*[F.lit(x) for k in (1, 2, 3) for x in (k, k % 3 + 1)])
    return probs(spark, sf).select("id", "model", F.element_at(m, F.col("model")).alias("given"))


@query("m2_cross_validated")
def m2(spark, sf):
    """Fits have no SQL: confusion counts over all blocks."""
    from tidemark.operators import splits

    got = models.cross_validated(splits.blocked(_rows(spark, sf), 3, 0.8, 4), FEATURES, "label")
    return got.select(F.col("label").cast("int").alias("label"), "pred", "n")


@query("e8_stacked")
def e8(spark, sf):
    """Fits have no SQL: a logistic stack of two members on the first part, less an embargo, scored on the rest."""
    m = _meta(spark, sf)
    got = models.stacked(m, ["m1_p0", "m1_p2", "m2_p0", "m2_p2"], "y", 0.6, "4 hours")
    return got.select("id", "pred", F.col("y").cast("int").alias("y"))


@query("e9_refit_stack")
def e9(spark, sf):
    """Fits have no SQL: the stack is fitted anew for each ten days on what came before."""
    from tidemark.operators import splits

    m = _meta(spark, sf)
    w = splits.walk_forward(m, 10, 10).select("train_start", "test_start", "test_end").orderBy("test_start").collect()
    got = models.walk_forward(m, [tuple(r) for r in w], ["m1_p0", "m1_p2", "m2_p0", "m2_p2"], "y", embargo="4 hours")
    return got.select("id", "window", "pred", F.col("y").cast("int").alias("y"))


def _meta(spark, sf):
    p = probs(spark, sf).where("model < 3")
    wide = p.groupBy("symbol", "ts", "id", F.col("y").cast("double").alias("y")).pivot("model", [1, 2]).agg(F.first("p0").alias("p0"), F.first("p2").alias("p2"))
    return wide.select("symbol", "ts", "id", "y", *[F.col(f"{m}_{c}").alias(f"m{m}_{c}") for m in (1, 2) for c in ("p0", "p2")])


@query("m5_win_model")
def m5(spark, sf):
    """Fits have no SQL: the chance to win of each week's signals, from signals whose exit came before the week."""
    s = signals(spark, sf)
    got = labels.exit_labels(s, hourly(spark, sf), "id", 3 * 3600, 3600).where("r_gross is not null").join(s, "id")
    got = got.select("id", "ts", "exit_ts", "p0", "p2", (F.col("r_gross") > 0).cast("double").alias("win"))
    return models.weekly_refit(got, ["p0", "p2"], "win").select("id", rnd("p_win", 4).alias("p_win"))
