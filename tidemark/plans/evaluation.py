"""Queries on labels, gates, ledgers, economics, panels and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import economics, gates, labels, panel, series, splits
from tidemark.plans.base import H, M5, epoch, fine, hourly, query, rnd, table, ticks
from tidemark.plans.market import TRADES, T, trades


@query(
    "slice0_labels",
    f"""WITH {H}, l AS (SELECT symbol, ln(close / lag(close) OVER w) AS r, CASE WHEN lead(close) OVER w IS NULL THEN -1 WHEN lead(close) OVER w / close - 1 > 0.005 THEN 2
  WHEN lead(close) OVER w / close - 1 < -0.005 THEN 0 ELSE 1 END AS label FROM h WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, label, count(*) AS n, round(avg(r), 6) AS mean_return FROM l GROUP BY ALL""",
)
def slice0(spark, sf):
    l = labels.dead_zone(hourly(spark, sf), 50)
    l = series.rolling(l, 2, lambda f: {"r": F.ln(F.col("close") / F.lag("close").over(f.order))})
    return l.groupBy("symbol", "label").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("r")).alias("mean_return"))


@query(
    "l2_session_label",
    f"""WITH {H}, l AS (SELECT *, lead(close) OVER w / close - 1 AS r, lead(ts) OVER w = ts + INTERVAL '1 hour' AS near FROM h WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, epoch(ts)::BIGINT AS ts_s, CASE WHEN NOT coalesce(near, false) THEN -1 WHEN r > 0.005 THEN 2 WHEN r < -0.005 THEN 0 ELSE 1 END AS label FROM l""",
)
def l2(spark, sf):
    return labels.next_in_session(hourly(spark, sf), 50, 3600).select("symbol", epoch().alias("ts_s"), "label")


@query(
    "l3_triple_barrier",
    f"""WITH {H}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM h), p AS (SELECT a.symbol, a.ts, count(b.i) AS k,
  min(CASE WHEN b.low <= a.close * 0.98 THEN b.i END) AS d, min(CASE WHEN b.high >= a.close * 1.02 THEN b.i END) AS u FROM n a LEFT JOIN n b ON a.symbol = b.symbol AND b.i > a.i AND b.i <= a.i + 6 GROUP BY ALL)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, CASE WHEN d IS NULL AND u IS NULL THEN CASE WHEN k < 6 THEN -1 ELSE 1 END WHEN u IS NULL OR d <= u THEN 0 ELSE 2 END AS label FROM p""",
)
def l3(spark, sf):
    return labels.triple_barrier(hourly(spark, sf), 0.02, 0.02, 6).select("symbol", epoch().alias("ts_s"), "label")


DEC = f"""{H}, {M5}, dc AS (SELECT symbol, ts AS bar_ts, ts + INTERVAL '1 hour' AS ts, close AS entry, CASE WHEN close > open THEN 1 ELSE -1 END AS side,
  symbol || '-' || CAST(epoch(ts)::BIGINT AS VARCHAR) AS id FROM h WHERE close <> open)"""
PATH = "pt AS (SELECT dc.*, m5.ts AS mts, m5.high, m5.low, m5.close FROM dc JOIN m5 ON m5.symbol = dc.symbol AND m5.ts >= dc.ts AND m5.ts < dc.ts + INTERVAL '2 hours')"


def decisions(spark, sf):
    h = hourly(spark, sf).where("close <> open")
    return h.select(
        "symbol", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.col("close").alias("entry"), F.when(F.col("close") > F.col("open"), 1).otherwise(-1).alias("side"),
        F.concat_ws("-", "symbol", epoch("ts").cast("string")).alias("id"),
    )


@query(
    "l4_bracket",
    f"""WITH {DEC}, {PATH}, x AS (SELECT id, side, entry, entry * (1 - 0.02 * side) AS stop, entry * (1 + 0.04 * side) AS target, count(*) AS k, arg_max(close, mts) AS lc, max(mts) AS lt,
  min(CASE WHEN CASE WHEN side > 0 THEN low <= entry * (1 - 0.02 * side) ELSE high >= entry * (1 - 0.02 * side) END THEN mts END) AS sl,
  min(CASE WHEN CASE WHEN side > 0 THEN high >= entry * (1 + 0.04 * side) ELSE low <= entry * (1 + 0.04 * side) END THEN mts END) AS tp FROM pt GROUP BY ALL),
o AS (SELECT *, CASE WHEN sl IS NOT NULL AND (tp IS NULL OR sl <= tp) THEN 'stop' WHEN tp IS NOT NULL THEN 'target' ELSE 'timeout' END AS outcome FROM x),
r AS (SELECT *, (CASE outcome WHEN 'stop' THEN stop WHEN 'target' THEN target ELSE lc END - entry) * side / abs(entry - stop) AS rg FROM o)
SELECT id, outcome, epoch(CASE outcome WHEN 'stop' THEN sl WHEN 'target' THEN tp ELSE lt END)::BIGINT AS exit_s, round(rg, 6) AS r_gross, round(rg - entry * 0.001 / abs(entry - stop), 6) AS r_net FROM r""",
)
def l4(spark, sf):
    d = decisions(spark, sf).withColumns({"stop": F.col("entry") * (1 - 0.02 * F.col("side")), "target": F.col("entry") * (1 + 0.04 * F.col("side"))})
    got = labels.bracket(d, fine(spark, sf), "id", 7200, 10)
    return got.select("id", "outcome", epoch("exit_ts").alias("exit_s"), rnd("r_gross").alias("r_gross"), rnd("r_net").alias("r_net"))


@query(
    "l8_excursions",
    f"""WITH {DEC}, {PATH} SELECT id, round((max(high) / entry - 1) * 1e4, 4) AS up_bps, round((min(low) / entry - 1) * 1e4, 4) AS down_bps FROM pt GROUP BY id, entry""",
)
def l8(spark, sf):
    got = labels.excursions(decisions(spark, sf), fine(spark, sf), "id", 7200)
    return got.select("id", rnd("up_bps", 4).alias("up_bps"), rnd("down_bps", 4).alias("down_bps"))


@query(
    "l9_time_to_hit",
    f"""WITH {DEC}, {PATH} SELECT id, count(*) AS bars, round(arg_max(close, mts), 6) AS last_close, epoch(min(CASE WHEN high >= entry * 1.01 THEN mts END))::BIGINT AS up_1,
  epoch(min(CASE WHEN high >= entry * 1.03 THEN mts END))::BIGINT AS up_3, epoch(min(CASE WHEN low <= entry * 0.99 THEN mts END))::BIGINT AS down_1 FROM pt GROUP BY id""",
)
def l9(spark, sf):
    b = {"up_1": F.col("bar_high") >= F.col("entry") * 1.01, "up_3": F.col("bar_high") >= F.col("entry") * 1.03, "down_1": F.col("bar_low") <= F.col("entry") * 0.99}
    got = labels.first_touch(decisions(spark, sf), fine(spark, sf), "id", b, 7200)
    return got.select("id", "bars", rnd("last_close").alias("last_close"), *[epoch(k).alias(k) for k in b])


@query(
    "l19_symmetric_touch",
    f"""WITH {DEC}, {PATH}, x AS (SELECT id, count(*) AS k, min(CASE WHEN high >= entry * 1.02 THEN mts END) AS u, min(CASE WHEN low <= entry * 0.98 THEN mts END) AS d FROM pt GROUP BY id)
SELECT id, CASE WHEN k <> 6 THEN 'censored' WHEN u IS NULL AND d IS NULL THEN 'none' WHEN u = d THEN 'ambiguous' WHEN d IS NULL OR u < d THEN 'up' ELSE 'down' END AS label FROM x""",
)
def l19(spark, sf):
    return labels.symmetric_touch(decisions(spark, sf), fine(spark, sf), "id", 0.02, 7200, 6)


@query(
    "l20_bracket_grid",
    f"""WITH {DEC}, {PATH}, g AS (SELECT unnest(['long', 'short']) AS side), m AS (SELECT unnest([1.0::DOUBLE, 2.0, 3.0]) AS multiple),
x AS (SELECT id, g.side, multiple, min(CASE WHEN CASE WHEN g.side = 'long' THEN low <= entry * (1 - 0.01) ELSE high >= entry * (1 + 0.01) END THEN mts END) AS sl,
  min(CASE WHEN CASE WHEN g.side = 'long' THEN high >= entry * (1 + 0.01 * multiple) ELSE low <= entry * (1 - 0.01 * multiple) END THEN mts END) AS tp FROM pt, g, m GROUP BY ALL)
SELECT id, side, multiple, CASE WHEN sl IS NOT NULL AND (tp IS NULL OR sl <= tp) THEN 'stop' WHEN tp IS NOT NULL THEN 'target' ELSE 'timeout' END AS outcome FROM x""",
)
def l20(spark, sf):
    return labels.bracket_grid(decisions(spark, sf), fine(spark, sf), "id", 0.01, [1.0, 2.0, 3.0], 7200)


#: A panel of three models' probabilities on hourly bars: whole numbers from the bar's time and row count, normalised.
PANEL = f"""{H}, pn AS (SELECT symbol, ts, epoch(ts)::BIGINT AS k, m AS model, n, close FROM h, (SELECT unnest([1, 2, 3]) AS m) WHERE symbol = 'view' OR m < 3),
pw AS (SELECT *, (k // 3600 * 7 * model + n * 3) % 11 + 1 AS a, (k // 3600 * 5 * model + n) % 13 + 1 AS b, (k // 3600 * 3 + model * n) % 7 + 1 AS c FROM pn),
p AS (SELECT symbol, ts, symbol || '-' || k AS id, model, a * 1.0 / (a + b + c) AS p0, b * 1.0 / (a + b + c) AS p1, c * 1.0 / (a + b + c) AS p2, (k // 3600 + n) % 3 AS y FROM pw)"""


def probs(spark, sf):
    h = hourly(spark, sf).withColumn("k", epoch()).withColumn("model", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where("symbol = 'view' or model < 3")
    hr = F.floor(F.col("k") / 3600)
    a, b, c = (hr * 7 * F.col("model") + F.col("n") * 3) % 11 + 1, (hr * 5 * F.col("model") + F.col("n")) % 13 + 1, (hr * 3 + F.col("model") * F.col("n")) % 7 + 1
    t = a + b + c
    return h.select(
        "symbol", F.col("ts"), F.concat_ws("-", "symbol", F.col("k").cast("string")).alias("id"), "model", (a / t).alias("p0"), (b / t).alias("p1"), (c / t).alias("p2"), ((hr + F.col("n")) % 3).alias("y")
    )


ARG = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"
CONF = "greatest(p0, p1, p2)"
RND3 = "round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2"
#: Predictions of model 1 with its class and confidence.
ONE = f"{PANEL}, q AS (SELECT *, {ARG} AS pred, {CONF} AS conf FROM p WHERE model = 1)"


def one(spark, sf):
    return probs(spark, sf).where("model = 1").withColumns({"pred": panel.argmax(), "conf": F.greatest(*panel.P)})


@query("j12_panel_alignment", f"WITH {PANEL} SELECT id, model, y FROM p WHERE id IN (SELECT id FROM p GROUP BY id HAVING count(DISTINCT model) = 3 AND min(y) = max(y))")
def j12(spark, sf):
    return panel.aligned(probs(spark, sf), 3, "id").select("id", "model", "y")


@query(
    "e1_soft_vote",
    f"""WITH {PANEL}, c AS (SELECT *, {ARG} AS cl FROM p), v AS (SELECT id, avg(p0) AS p0, avg(p1) AS p1, avg(p2) AS p2, avg((cl = 0)::INT) AS v0, avg((cl = 2)::INT) AS v2 FROM c GROUP BY id)
SELECT id, {RND3}, {ARG} AS pred, CASE WHEN v2 >= 5 / 9 THEN 2 WHEN v0 >= 5 / 9 THEN 0 ELSE 1 END AS majority FROM v""",
)
def e1(spark, sf):
    got = panel.soft_vote(probs(spark, sf), "id")
    return got.select("id", *[rnd(c).alias(c) for c in panel.P], "pred", "majority")


@query(
    "e2_weighted_mix",
    f"""WITH {PANEL}, l AS (SELECT id, list(w ORDER BY model) AS w, list(w * p0 ORDER BY model) AS a, list(w * p1 ORDER BY model) AS b, list(w * p2 ORDER BY model) AS c
  FROM p JOIN (VALUES (1, 0.5::DOUBLE), (2, 0.3::DOUBLE), (3, 0.0::DOUBLE)) AS x(model, w) USING (model) GROUP BY id),
s AS (SELECT id, nullif(list_reduce(w, lambda x, y: x + y), 0) AS w, list_reduce(a, lambda x, y: x + y) AS a, list_reduce(b, lambda x, y: x + y) AS b, list_reduce(c, lambda x, y: x + y) AS c FROM l),
v AS (SELECT id, a / w AS p0, b / w AS p1, c / w AS p2 FROM s)
SELECT id, round(p0, 12) AS p0, round(p1, 12) AS p1, round(p2, 12) AS p2, CASE WHEN p0 IS NULL OR {CONF} < 0.45 THEN 1 ELSE {ARG} END AS pred FROM v""",
)
def e2(spark, sf):
    w = spark.createDataFrame([(1, 0.5), (2, 0.3)], "model int, w double")
    return panel.weighted_mix(probs(spark, sf), w, 0.45, "id").select("id", *[rnd(c, 12).alias(c) for c in panel.P], "pred")


@query(
    "e7_meta_features",
    f"""WITH {PANEL} SELECT id, """
    + ", ".join(
        f"round(max(CASE WHEN model = {m} THEN {x} END), 6) AS m{m}_{n}"
        for m in (1, 2, 3)
        for n, x in (("p0", "p0"), ("top", CONF), ("margin", f"{CONF} - list_sort([p0, p1, p2])[2]"))
    )
    + " FROM p GROUP BY id",
)
def e7(spark, sf):
    got = panel.meta_features(probs(spark, sf), [1, 2, 3], "id")
    return got.select("id", *[rnd(F.col(f"{m}_{c}")).alias(f"m{m}_{c}") for m in (1, 2, 3) for c in ("p0", "top", "margin")])


@query(
    "g37_snapshot",
    f"""WITH {PANEL}, v AS (SELECT id, sum(w * p0) / sum(w) AS p0, sum(w * p1) / sum(w) AS p1, sum(w * p2) / sum(w) AS p2 FROM p JOIN (VALUES (1, 0.5), (2, 0.3), (3, 0.2)) AS x(model, w) USING (model) GROUP BY id),
e AS (SELECT id, {ARG} AS ensemble, {CONF} AS confidence FROM v) SELECT id, ensemble, round(any_value(confidence), 6) AS confidence, round(avg(({ARG} = ensemble)::INT), 6) AS agreement FROM p JOIN e USING (id) GROUP BY id, ensemble""",
)
def g37(spark, sf):
    w = spark.createDataFrame([(1, 0.5), (2, 0.3), (3, 0.2)], "model int, w double")
    return panel.snapshot(probs(spark, sf), w, "id").select("id", "ensemble", rnd("confidence").alias("confidence"), rnd("agreement").alias("agreement"))


CARDS = f"{PANEL}, cd AS (SELECT model, CAST(date_trunc('week', ts) AS DATE) AS week, avg(p2 - p0) * 10 AS payoff FROM p GROUP BY ALL)"


def cards(spark, sf):
    return probs(spark, sf).groupBy("model", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg((F.avg(F.col("p2") - F.col("p0")) * 10).alias("payoff"))


@query(
    "e4_hedge_weights",
    f"""WITH {CARDS}, g AS (SELECT *, exp(0.8 * coalesce(sum(tanh(payoff)) OVER (PARTITION BY model ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS e FROM cd)
SELECT CAST(week AS VARCHAR) AS week, model, round(e / sum(e) OVER (PARTITION BY week), 6) AS w FROM g""",
)
def e4(spark, sf):
    return panel.hedge_weights(cards(spark, sf), 0.8).select(F.col("week").cast("string").alias("week"), "model", rnd("w").alias("w"))


@query(
    "e5_grid_weights",
    f"""WITH {CARDS}, s AS (SELECT week, model, exp(payoff) AS score FROM cd), u AS (SELECT *, (100 - count(*) OVER w * 5) * score / sum(score) OVER w AS u, 100 - count(*) OVER w * 5 AS tot FROM s WINDOW w AS (PARTITION BY week)),
f AS (SELECT *, floor(round(u, 9)) AS f, round(u, 9) - floor(round(u, 9)) AS r FROM u), k AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY r DESC, model) AS k, tot - sum(f) OVER (PARTITION BY week) AS spare FROM f)
SELECT CAST(week AS VARCHAR) AS week, model, round((5 + f + CASE WHEN k <= spare THEN 1 ELSE 0 END) * 0.01, 6) AS w FROM k""",
)
def e5(spark, sf):
    s = cards(spark, sf).select("week", "model", F.exp("payoff").alias("score"))
    return panel.grid_weights(s).select(F.col("week").cast("string").alias("week"), "model", rnd("w").alias("w"))


@query(
    "e3_sharpe_weights",
    f"""WITH {CARDS}, s AS (SELECT model, greatest(coalesce(avg(payoff) / nullif(stddev_samp(payoff), 0), 0), 0) AS s FROM cd GROUP BY model)
SELECT model, round(CASE WHEN sum(s) OVER () > 0 THEN s / sum(s) OVER () ELSE 1.0 / count(*) OVER () END, 6) AS w FROM s""",
)
def e3(spark, sf):
    return panel.positive_sharpe_weights(cards(spark, sf), net="payoff").select("model", rnd("w").alias("w"))


@query("g24_redundant_models", f"WITH {PANEL} SELECT a.model AS a, b.model AS b, round(corr(a.p2, b.p2), 6) AS corr FROM p a JOIN p b ON a.id = b.id AND a.model < b.model GROUP BY ALL HAVING corr(a.p2, b.p2) >= -1")
def g24(spark, sf):
    return panel.redundant(probs(spark, sf), "p2", -1.0, "id").select("a", "b", rnd("corr").alias("corr"))


@query(
    "e12_temperature",
    f"""WITH {PANEL}, t AS (SELECT unnest([0.5, 0.8, 1.0, 1.5, 2.5]) AS temperature), s AS (SELECT temperature, y, pow(greatest(p0, 1e-12), 1 / temperature) AS a, pow(greatest(p1, 1e-12), 1 / temperature) AS b,
  pow(greatest(p2, 1e-12), 1 / temperature) AS c FROM p, t) SELECT CAST(temperature AS DOUBLE) AS temperature, round(-avg(ln(CASE y WHEN 0 THEN a WHEN 1 THEN b ELSE c END / (a + b + c))), 6) AS log_loss FROM s GROUP BY temperature""",
)
def e12(spark, sf):
    p = probs(spark, sf).withColumn("y", F.col("y").cast("int"))
    return panel.temperature(p, [0.5, 0.8, 1.0, 1.5, 2.5]).select("temperature", rnd("log_loss").alias("log_loss"))


@query(
    "e14_hazards",
    f"""WITH {ONE} SELECT id, round(p2 * p0, 6) AS time_0, round(p2 * (1 - p0) * p1, 6) AS time_1, round(p2 * p1, 6) AS level_0, round(p2 * p1 * p0, 6) AS level_1 FROM q""",
)
def e14(spark, sf):
    got = panel.hazards(one(spark, sf), "p2", ["p0", "p1"], ["p1", "p0"])
    return got.select("id", *[rnd(c).alias(c) for c in ("time_0", "time_1", "level_0", "level_1")])


REPORT = " UNION ALL ".join(
    f"SELECT symbol, {c} AS class, count_if(y = {c} AND pred = {c}) AS t, count_if(y = {c}) AS yy, count_if(pred = {c}) AS pp FROM q GROUP BY symbol" for c in (0, 1, 2)
)
REP = f"rp AS ({REPORT}), rr AS (SELECT symbol, class, coalesce(t / nullif(pp, 0), 0) AS prec, coalesce(t / nullif(yy, 0), 0) AS rec, coalesce(2 * t / nullif(pp + yy, 0), 0) AS f1, yy FROM rp)"


@query("g1_class_metrics", f"WITH {ONE}, {REP} SELECT symbol, round(avg(f1), 6) AS macro_f1, round(avg(CASE WHEN yy > 0 THEN rec END), 6) AS balanced_accuracy, round(sum(rec * yy) / sum(yy), 6) AS accuracy FROM rr GROUP BY symbol")
def g1(spark, sf):
    got = economics.class_metrics(one(spark, sf), [0, 1, 2], "y", "pred", ["symbol"])
    return got.select("symbol", *[rnd(c).alias(c) for c in ("macro_f1", "balanced_accuracy", "accuracy")])


@query("g2_class_report", f"WITH {ONE}, {REP} SELECT symbol, class, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1, yy::BIGINT AS support FROM rr")
def g2(spark, sf):
    got = economics.class_report(one(spark, sf), [0, 1, 2], "y", "pred", ["symbol"])
    return got.select("symbol", "class", *[rnd(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("g3_confusion", f"WITH {ONE} SELECT y, pred, count(*) AS n FROM q GROUP BY ALL")
def g3(spark, sf):
    return economics.confusion(one(spark, sf), "y", "pred")


@query(
    "g4_by_condition",
    f"""WITH {ONE}, u AS (SELECT 'symbol' AS condition, symbol AS value, y, pred FROM q UNION ALL SELECT 'hour', CAST(hour(ts) AS VARCHAR), y, pred FROM q),
n AS (SELECT condition, value, count(*) AS n FROM u GROUP BY ALL HAVING count(*) >= 20), x AS ("""
    + " UNION ALL ".join(f"SELECT condition, value, {c} AS class, count_if(y = {c} AND pred = {c}) AS t, count_if(y = {c}) AS yy, count_if(pred = {c}) AS pp FROM u GROUP BY ALL" for c in (0, 1, 2))
    + """) SELECT condition, value, n, round(avg(coalesce(2 * t / nullif(pp + yy, 0), 0)), 6) AS macro_f1 FROM x JOIN n USING (condition, value) GROUP BY ALL""",
)
def g4(spark, sf):
    q = one(spark, sf).withColumn("hour", F.hour("ts"))
    return economics.by_condition(q, ["symbol", "hour"], [0, 1, 2], "y", "pred", 20).select("condition", "value", "n", rnd("macro_f1").alias("macro_f1"))


@query("g5_disagreement", f"WITH {PANEL}, d AS (SELECT id, symbol, count(DISTINCT {ARG}) > 1 AS dis FROM p GROUP BY ALL) SELECT symbol, round(avg(dis::INT), 6) AS disagreement FROM d GROUP BY symbol")
def g5(spark, sf):
    d = probs(spark, sf).withColumn("c", panel.argmax()).groupBy("id", "symbol").agg((F.count_distinct("c") > 1).cast("int").alias("d"))
    return d.groupBy("symbol").agg(rnd(F.avg("d")).alias("disagreement"))


@query("g7_confident_errors", f"WITH {ONE} SELECT id, y, pred, round(conf, 6) AS conf FROM q WHERE y <> pred ORDER BY conf DESC, id LIMIT 12")
def g7(spark, sf):
    return one(spark, sf).where("y <> pred").orderBy(F.desc("conf"), "id").limit(12).select("id", "y", "pred", rnd("conf").alias("conf"))


@query(
    "g21_reliability",
    f"""WITH {ONE} SELECT symbol, least(floor(conf * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(conf), 6) AS mean_p, round(avg((y = pred)::INT), 6) AS rate FROM q GROUP BY ALL""",
)
def g21(spark, sf):
    q = one(spark, sf).withColumn("hit", F.col("y") == F.col("pred")).withColumn("hit", F.col("hit").cast("int"))
    return economics.reliability(q, "conf", "hit", by=["symbol"]).select("symbol", "bin", "n", rnd("mean_p").alias("mean_p"), rnd("rate").alias("rate"))


@query(
    "g21_calibration",
    f"""WITH {ONE}, b AS (SELECT least(floor(conf * 10), 9) AS bin, conf, (y = pred)::INT AS t FROM q), g AS (SELECT bin, count(*) AS n, sum(conf) AS sp, sum(t) AS sy, sum((conf - t) ** 2) AS br,
  sum(-t * ln(least(greatest(conf, 1e-12), 1 - 1e-12)) - (1 - t) * ln(1 - least(greatest(conf, 1e-12), 1 - 1e-12))) AS ll FROM b GROUP BY bin)
SELECT round(sum(br) / sum(n), 6) AS brier, round(sum(ll) / sum(n), 6) AS log_loss, round(sum(abs(sp - sy)) / sum(n), 6) AS ece FROM g""",
)
def g21b(spark, sf):
    q = one(spark, sf).withColumn("hit", (F.col("y") == F.col("pred")).cast("int"))
    return economics.calibration(q, "conf", "hit").select(*[rnd(c).alias(c) for c in ("brier", "log_loss", "ece")])


NET = f"""{ONE}, nf AS (SELECT q.*, lead(close) OVER (PARTITION BY q.symbol ORDER BY q.ts) / close - 1 AS fwd FROM q JOIN h USING (symbol, ts)),
ps AS (SELECT *, CASE WHEN conf >= 0.45 THEN CASE pred WHEN 2 THEN 1 WHEN 0 THEN -1 ELSE 0 END ELSE 0 END AS pos FROM nf WHERE fwd IS NOT NULL),
nt AS (SELECT *, pos * fwd - abs(pos - lag(pos, 1, 0) OVER (PARTITION BY symbol ORDER BY ts)) * 0.001 AS net FROM ps)"""


def net(spark, sf, tau=0.45):
    h = series.previous(hourly(spark, sf), {"_next": "close"}, ahead=True).select("symbol", "ts", (F.col("_next") / F.col("close") - 1).alias("fwd"))
    q = one(spark, sf).join(h, ["symbol", "ts"]).where("fwd is not null")
    return gates.net_returns(gates.gated_position(q, tau=tau))


@query("y1_positions", f"WITH {NET} SELECT id, pos, round(net, 6) AS net FROM nt")
def y1(spark, sf):
    return net(spark, sf).select("id", "pos", rnd("net").alias("net"))


@query("y2_sizing", f"WITH {ONE} SELECT id, round(CASE WHEN conf >= 0.4 THEN 0.25 + 0.75 * least((conf - 0.4) / 0.4, 1) ELSE 0 END, 6) AS size FROM q")
def y2(spark, sf):
    return gates.sized(one(spark, sf), tau=0.4, cap=0.8).select("id", rnd("size").alias("size"))


@query("y6_side_gates", f"WITH {ONE} SELECT id, CASE WHEN (pred = 2 AND conf >= 0.5) OR (pred = 0 AND conf >= 0.4) THEN pred ELSE 1 END AS gated FROM q")
def y6(spark, sf):
    return gates.side_gates(one(spark, sf), 0.5, 0.4).select("id", "gated")


ECO = """cv AS (SELECT symbol, ts, net, pos, sum(net) OVER (PARTITION BY symbol ORDER BY ts) AS c FROM nt), cp AS (SELECT *, c - max(c) OVER (PARTITION BY symbol ORDER BY ts) AS dd FROM cv)"""


@query(
    "g9_economics",
    f"""WITH {NET}, {ECO} SELECT symbol, round(sum(net), 6) AS net_sum, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(252), 4) AS sharpe,
  round(avg(net) / nullif(sqrt(avg(least(net, 0) ** 2)), 0) * sqrt(252), 4) AS sortino, round(min(dd), 6) AS max_drawdown, count_if(net <> 0)::BIGINT AS trades, count(*) AS rows FROM cp GROUP BY symbol""",
)
def g9(spark, sf):
    got = economics.economics(net(spark, sf))
    return got.select("symbol", rnd("net_sum").alias("net_sum"), rnd("sharpe", 4).alias("sharpe"), rnd("sortino", 4).alias("sortino"), rnd("max_drawdown").alias("max_drawdown"), "trades", "rows")


@query(
    "g13_compounded",
    f"""WITH {NET}, n0 AS (SELECT symbol, ts, net / 20 AS net FROM nt), e AS (SELECT symbol, ts, net, exp(sum(ln(1 + net)) OVER (PARTITION BY symbol ORDER BY ts)) AS e FROM n0), d AS (SELECT *, e / greatest(max(e) OVER (PARTITION BY symbol ORDER BY ts), 1) - 1 AS dd FROM e)
SELECT symbol, round(exp(sum(ln(1 + net))) - 1, 6) AS total, round(min(dd), 6) AS max_drawdown, round(avg(net) / nullif(sqrt(avg(CASE WHEN net < 0 THEN net * net END)), 0), 5) AS sortino FROM d GROUP BY symbol""",
)
def g13(spark, sf):
    got = economics.compounded(net(spark, sf).withColumn("net", F.col("net") / 20))
    return got.select("symbol", rnd("total").alias("total"), rnd("max_drawdown").alias("max_drawdown"), rnd("sortino", 5).alias("sortino"))


@query(
    "y3_threshold_sweep",
    f"""WITH {ONE}, f AS (SELECT q.*, lead(close) OVER (PARTITION BY q.symbol ORDER BY q.ts) / close - 1 AS fwd FROM q JOIN h USING (symbol, ts)), t AS (SELECT unnest([0.0, 0.4, 0.5, 0.6]) AS tau),
ps AS (SELECT *, CASE WHEN conf >= tau THEN CASE pred WHEN 2 THEN 1 WHEN 0 THEN -1 ELSE 0 END ELSE 0 END AS pos FROM f, t WHERE fwd IS NOT NULL),
nt AS (SELECT *, pos * fwd - abs(pos - lag(pos, 1, 0) OVER (PARTITION BY symbol, tau ORDER BY ts)) * 0.001 AS net FROM ps)
SELECT CAST(tau AS DOUBLE) AS tau, round(sum(net), 6) AS net_sum, round(avg(abs(pos)), 6) AS exposure FROM nt GROUP BY tau""",
)
def y3(spark, sf):
    h = series.previous(hourly(spark, sf), {"_next": "close"}, ahead=True).select("symbol", "ts", (F.col("_next") / F.col("close") - 1).alias("fwd"))
    q = one(spark, sf).join(h, ["symbol", "ts"]).where("fwd is not null")

    def apply(df, tau):
        keyed = gates.gated_position(df, tau=tau).withColumn("key", F.concat_ws("|", "symbol", F.col("tau").cast("string")))
        return gates.net_returns(keyed, by="key")

    got = gates.sweep(q, [0.0, 0.4, 0.5, 0.6], apply)
    return got.groupBy("tau").agg(rnd(F.sum("net")).alias("net_sum"), rnd(F.avg(F.abs("pos"))).alias("exposure"))


@query(
    "y4_agreement",
    f"""WITH {PANEL}, v AS (SELECT id, count_if({ARG} = 2) AS u, count_if({ARG} = 0) AS d FROM p GROUP BY id) SELECT id, CASE WHEN u >= 2 AND u > d THEN 2 WHEN d >= 2 AND d > u THEN 0 ELSE 1 END AS signal FROM v""",
)
def y4(spark, sf):
    wide = probs(spark, sf).withColumn("c", panel.argmax()).groupBy("id").pivot("model", [1, 2, 3]).agg(F.first("c"))
    wide = wide.select("id", *[F.coalesce(F.col(f"`{m}`"), F.lit(1)).alias(f"v{m}") for m in (1, 2, 3)])
    return gates.agreement(wide, ["v1", "v2", "v3"], 2).select("id", "signal")


@query(
    "y5_conformal",
    f"""WITH {ONE}, s AS (SELECT round(1 - CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 9) AS s FROM q WHERE symbol = 'click'), k AS (SELECT s, row_number() OVER (ORDER BY s) AS i, count(*) OVER () AS n FROM s),
h0 AS (SELECT min(s) AS qhat FROM k WHERE i >= least(ceil((n + 1) * 0.6), n)), z AS (SELECT id, round(1 - p0, 9) <= qhat AS a, round(1 - p1, 9) <= qhat AS b, round(1 - p2, 9) <= qhat AS c FROM q, h0 WHERE symbol = 'view')
SELECT id, CASE WHEN a::INT + b::INT + c::INT = 1 THEN CASE WHEN a THEN 0 WHEN b THEN 1 ELSE 2 END ELSE -1 END AS signal FROM z""",
)
def y5(spark, sf):
    q = one(spark, sf).withColumns({p: F.round(p, 9) for p in panel.P}).withColumn("y", F.col("y").cast("int"))
    return gates.conformal(q.where("symbol = 'click'"), q.where("symbol = 'view'"), list(panel.P), "y", 0.4).select("id", "signal")


WIN = f"{ONE}, wn AS (SELECT id, symbol || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS win, symbol, ts, p2 AS score, p0 FROM q)"


def windows(spark, sf):
    return one(spark, sf).withColumn("win", F.concat_ws("-", "symbol", F.to_date("ts").cast("string"))).withColumn("score", F.col("p2"))


@query(
    "y8_first_crossing",
    f"""WITH {WIN}, x AS (SELECT *, min(CASE WHEN score >= 0.5 THEN ts END) OVER w AS hit, max(ts) OVER w AS fin FROM wn WINDOW w AS (PARTITION BY win))
SELECT id, CASE WHEN ts > coalesce(hit, fin) THEN NULL WHEN ts < coalesce(hit, fin) THEN 'WAIT' WHEN hit IS NOT NULL THEN 'ENTER' ELSE 'SKIP' END AS action FROM x""",
)
def y8(spark, sf):
    return gates.first_crossing(windows(spark, sf), "win", "score", 0.5).select("id", "action")


@query(
    "y9_cancellable_crossing",
    f"""WITH {WIN}, x AS (SELECT *, min(CASE WHEN score >= 0.5 THEN ts END) OVER w AS hit, min(CASE WHEN p0 >= 0.5 THEN ts END) OVER w AS stp, max(ts) OVER w AS fin FROM wn WINDOW w AS (PARTITION BY win)),
e AS (SELECT *, hit IS NOT NULL AND (stp IS NULL OR hit < stp) AS ok FROM x), l AS (SELECT *, CASE WHEN ok THEN hit ELSE coalesce(stp, fin) END AS lst FROM e)
SELECT id, CASE WHEN ts > lst THEN NULL WHEN ts < lst THEN 'WAIT' WHEN ok THEN 'ENTER' WHEN stp IS NOT NULL THEN 'CANCEL' ELSE 'SKIP' END AS action FROM l""",
)
def y9(spark, sf):
    return gates.first_crossing(windows(spark, sf), "win", "score", 0.5, until=F.col("p0") >= 0.5).select("id", "action")


CROSS = f"{WIN}, cr AS (SELECT * FROM wn QUALIFY score >= 0.4 AND (lag(score) OVER (PARTITION BY symbol ORDER BY ts) IS NULL OR lag(score) OVER (PARTITION BY symbol ORDER BY ts) < 0.4))"


@query(
    "y17_rearmed",
    f"""WITH {CROSS} SELECT id FROM cr QUALIFY lag(ts) OVER (PARTITION BY symbol ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) >= INTERVAL '4 hours'""",
)
def y17(spark, sf):
    return gates.rearmed(windows(spark, sf), "score", 0.4, 4 * 3600).select("id")


@query(
    "y14_cooldown",
    f"""WITH RECURSIVE {CROSS}, g AS (SELECT symbol, id, ts FROM cr QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts) = 1
  UNION ALL SELECT n.symbol, n.id, n.ts FROM g, LATERAL (SELECT symbol, id, ts FROM cr WHERE cr.symbol = g.symbol AND cr.ts >= g.ts + INTERVAL '6 hours' ORDER BY ts LIMIT 1) n)
SELECT cr.id, g.id IS NOT NULL AS taken FROM cr LEFT JOIN g ON g.id = cr.id""",
)
def y14(spark, sf):
    return gates.spaced(gates.upward_crossings(windows(spark, sf), "score", 0.4), "id", 6 * 3600)


@query("y19_bucket_submission", f"WITH {WIN} SELECT id FROM wn WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY symbol, epoch(ts)::BIGINT // 21600 ORDER BY score DESC, id) = 1")
def y19(spark, sf):
    return gates.replay_capacity(windows(spark, sf), "id", "score", 0.3, 21600)


@query("y24_union_signal", f"""WITH {PANEL}, s AS (SELECT id, max(CASE {ARG} WHEN 2 THEN 1 WHEN 0 THEN -1 ELSE 0 END) AS u, min(CASE {ARG} WHEN 2 THEN 1 WHEN 0 THEN -1 ELSE 0 END) AS d FROM p WHERE model < 3 GROUP BY id)
SELECT id, CASE WHEN u > 0 AND d < 0 THEN 0 WHEN u > 0 THEN 1 WHEN d < 0 THEN -1 ELSE 0 END AS union_side FROM s""")
def y24(spark, sf):
    wide = probs(spark, sf).where("model < 3").withColumn("c", panel.argmax() - 1).groupBy("id").pivot("model", [1, 2]).agg(F.first("c"))
    return gates.union_signal(wide.withColumnsRenamed({"1": "a", "2": "b"}), ["a", "b"]).select("id", "union_side")


@query("y37_top_rate", f"WITH {ONE} SELECT id FROM q ORDER BY round(conf, 9) DESC, CAST(('0x' || substr(sha256(id), 1, 13)) AS BIGINT), id LIMIT (SELECT floor(count(*) * 0.1)::BIGINT FROM q)")
def y37(spark, sf):
    return gates.top_rate(one(spark, sf).withColumn("c", F.round("conf", 9)), "c", "id", 0.1).select("id")


@query("p4_predicates", f"WITH {ONE} SELECT id FROM q WHERE symbol IN ('view', 'click') AND conf >= 0.4 AND pred = 2")
def p4(spark, sf):
    tree = {"all": [{"column": "symbol", "op": "in", "value": ["view", "click"]}, {"column": "conf", "op": "gte", "value": 0.4}, {"column": "pred", "op": "eq", "value": 2}]}
    return one(spark, sf).where(gates.predicate(tree, {"symbol", "conf", "pred"})).select("id")


@query(
    "p6_rule_matches",
    f"""WITH {ONE} SELECT id, 'r1' AS rule_id FROM q WHERE symbol = 'view' AND pred = 2 AND ts >= '2024-01-05' AND ts < '2024-01-20' UNION ALL SELECT id, 'r2' FROM q WHERE y = 0 AND ts >= '2024-01-10' AND ts < '2024-01-12'""",
)
def p6(spark, sf):
    rows = [("r1", "symbol", "view", "2024-01-05", "2024-01-20"), ("r1", "pred", "2", "2024-01-05", "2024-01-20"), ("r2", "y", "0", "2024-01-10", "2024-01-12")]
    rules = spark.createDataFrame(rows, "rule_id string, column string, value string, since string, until string")
    rules = rules.withColumns({"since": F.col("since").cast("timestamp"), "until": F.col("until").cast("timestamp")})
    return gates.rule_matches(one(spark, sf), rules, "id")


@query("p11_tiers", f"WITH {ONE} SELECT id, CASE WHEN conf >= 0.6 THEN 'HIGH' WHEN conf >= 0.45 THEN 'NORMAL' ELSE 'LOW' END AS tier FROM q")
def p11(spark, sf):
    return one(spark, sf).select("id", F.when(F.col("conf") >= 0.6, "HIGH").when(F.col("conf") >= 0.45, "NORMAL").otherwise("LOW").alias("tier"))


@query("p12_policy_menu", f"WITH {ONE} SELECT id, conf >= 0.5 AS high, pred <> 1 AS directional, p2 > p0 AND p2 > 0.4 AS strong_up FROM q")
def p12(spark, sf):
    menu = {"high": F.col("conf") >= 0.5, "directional": F.col("pred") != 1, "strong_up": (F.col("p2") > F.col("p0")) & (F.col("p2") > 0.4)}
    return gates.menu(menu, one(spark, sf)).select("id", *menu)


LEDGER = f"{T}, {TRADES}, lg AS (SELECT symbol, id, start AS ts, (price % 7 - 3.4) / 100 AS net_return, (id % 7 + 1)::INT AS bars_held, CASE WHEN price % 7 < 2 THEN 'stop' ELSE 'target' END AS exit_reason FROM tr)"


def ledger(spark, sf):
    t = trades(spark, sf)
    return t.select(
        "symbol", "id", F.col("start").alias("ts"), ((F.col("price") % 7 - 3.4) / 100).alias("net_return"), (F.col("id") % 7 + 1).cast("int").alias("bars_held"),
        F.when(F.col("price") % 7 < 2, "stop").otherwise("target").alias("exit_reason"),
    )


@query(
    "g10_trade_stats",
    f"""WITH {LEDGER} SELECT symbol, count(*) AS trades, round(avg((net_return > 0)::INT), 6) AS win_rate, round(avg(CASE WHEN net_return > 0 THEN net_return END), 6) AS avg_win, round(avg(CASE WHEN net_return <= 0 THEN net_return END), 6) AS avg_loss,
  round(sum(greatest(net_return, 0)) / nullif(-sum(least(net_return, 0)), 0), 5) AS profit_factor, round(avg(net_return) * 1e4, 4) AS expectancy_bps, quantile_cont(bars_held, 0.5) AS median_bars, round(avg((exit_reason = 'stop')::INT), 6) AS stop_share FROM lg GROUP BY symbol""",
)
def g10(spark, sf):
    got = economics.trade_stats(ledger(spark, sf))
    six = ("win_rate", "avg_win", "avg_loss", "stop_share")
    return got.select("symbol", "trades", *[rnd(c).alias(c) for c in six], rnd("profit_factor", 5).alias("profit_factor"), rnd("expectancy_bps", 4).alias("expectancy_bps"), "median_bars")


@query(
    "g16_loss_streaks",
    f"""WITH {LEDGER}, b AS (SELECT *, net_return <= 0 AS bad, coalesce((net_return <= 0) <> (lag(net_return) OVER (PARTITION BY symbol ORDER BY ts) <= 0), true)::INT AS new FROM lg), i AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts) AS run FROM b),
r AS (SELECT symbol, run, count(*) AS n FROM i WHERE bad GROUP BY ALL) SELECT symbol, count(*) AS streaks, max(n) AS longest, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.95), 6) AS p95 FROM r GROUP BY symbol""",
)
def g16(spark, sf):
    got = economics.loss_streaks(ledger(spark, sf), "net_return")
    return got.select("symbol", "streaks", "longest", rnd("mean").alias("mean"), rnd("p95").alias("p95"))


@query(
    "g17_daily_frequency",
    f"""WITH {LEDGER}, d AS (SELECT symbol, unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL '1 day')) AS day FROM lg GROUP BY symbol),
c AS (SELECT symbol, date_trunc('day', ts) AS day, count(*) AS n, sum(net_return) AS net FROM lg GROUP BY ALL)
SELECT symbol, epoch(day)::BIGINT AS day_s, coalesce(n, 0)::BIGINT AS trades, round(coalesce(net, 0), 6) AS net FROM d LEFT JOIN c USING (symbol, day)""",
)
def g17(spark, sf):
    from tidemark.operators.bars import on_grid

    d = ledger(spark, sf).groupBy("symbol", F.date_trunc("day", "ts").alias("ts")).agg(F.count(F.lit(1)).alias("trades"), F.sum("net_return").alias("net"))
    return on_grid(d, "1 day", ["trades", "net"]).select("symbol", epoch().alias("day_s"), "trades", rnd("net").alias("net"))


@query(
    "g18_concentration",
    f"""WITH {LEDGER}, m AS (SELECT symbol, date_trunc('week', ts) AS w, greatest(sum(net_return), 0) AS g FROM lg GROUP BY ALL) SELECT symbol, round(max(g) / nullif(sum(g), 0), 6) AS concentration FROM m GROUP BY symbol""",
)
def g18(spark, sf):
    m = ledger(spark, sf).groupBy("symbol", F.date_trunc("week", "ts")).agg(F.greatest(F.sum("net_return"), F.lit(0.0)).alias("g"))
    return m.groupBy("symbol").agg(rnd(economics.ratio(F.max("g"), F.sum("g"))).alias("concentration"))


@query(
    "g19_breakdowns",
    f"""WITH {LEDGER} SELECT CASE WHEN grouping(symbol) = 1 THEN 'ALL' ELSE symbol END AS symbol, CASE WHEN grouping(exit_reason) = 1 THEN 'ALL' ELSE exit_reason END AS exit_reason, count(*) AS n, round(sum(net_return), 6) AS net FROM lg
GROUP BY GROUPING SETS ((symbol, exit_reason), (symbol), ())""",
)
def g19(spark, sf):
    r = ledger(spark, sf).rollup("symbol", "exit_reason").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("net_return")).alias("net"))
    return r.select(F.coalesce("symbol", F.lit("ALL")).alias("symbol"), F.coalesce("exit_reason", F.lit("ALL")).alias("exit_reason"), "n", "net")


@query("g20_funnel", f"WITH {ONE} SELECT symbol, count(*) AS seen, count_if(pred <> 1)::BIGINT AS directional, count_if(pred <> 1 AND conf >= 0.45)::BIGINT AS gated, count_if(pred <> 1 AND conf >= 0.6)::BIGINT AS strong FROM q GROUP BY symbol")
def g20(spark, sf):
    d, c = F.col("pred") != 1, F.col("conf")
    return one(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("seen"), F.count_if(d).alias("directional"), F.count_if(d & (c >= 0.45)).alias("gated"), F.count_if(d & (c >= 0.6)).alias("strong"))


@query(
    "g22_profile",
    """WITH u AS (SELECT 'value' AS "column", value AS v FROM events UNION ALL SELECT 'user_id', user_id FROM events)
SELECT "column", count(*) AS rows, round(avg((v IS NULL)::INT), 6) AS missing, round(avg(coalesce(NOT isfinite(v), false)::INT), 6) AS non_finite, count(DISTINCT v) AS "distinct" FROM u GROUP BY "column" """,
)
def g22(spark, sf):
    return economics.profile(table(spark, sf, "events"), ["value", "user_id"])


@query(
    "g31_deciles",
    f"""WITH {LEDGER}, d AS (SELECT ntile(10) OVER (ORDER BY bars_held * 1000 + id % 997, id) AS decile, (bars_held * 1000 + id % 997)::DOUBLE AS score, net_return FROM lg)
SELECT decile::INT AS decile, count(*) AS n, round(avg(score), 4) AS mean_score, round(avg(net_return), 6) AS mean_net, round(sum(net_return), 6) AS total_net FROM d GROUP BY decile""",
)
def g31(spark, sf):
    l = ledger(spark, sf).withColumn("score", (F.col("bars_held") * 1000 + F.col("id") % 997).cast("double"))
    got = economics.deciles(l, "score", "net_return", "id")
    return got.select("decile", "n", rnd("mean_score", 4).alias("mean_score"), rnd("mean_net").alias("mean_net"), rnd("total_net").alias("total_net"))


@query("g33_effective_size", f"WITH {LEDGER} SELECT round(sum(bars_held) ** 2 / sum(bars_held * bars_held), 4) AS effective FROM lg")
def g33(spark, sf):
    return splits.effective_size(ledger(spark, sf).withColumn("w", F.col("bars_held").cast("double")), "w").select(rnd("effective", 4).alias("effective"))


@query(
    "b6_diebold_mariano",
    f"""WITH {LEDGER}, m AS (SELECT *, net_return - avg(net_return) OVER (PARTITION BY symbol) AS e FROM lg), g AS (SELECT *, e * lag(e, 1) OVER w AS g1, e * lag(e, 2) OVER w AS g2 FROM m WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, round(avg(net_return), 6) AS mean, round(avg(net_return) / sqrt((sum(e * e) / count(*) + 2 * (2.0 / 3) * sum(g1) / count(*) + 2 * (1.0 / 3) * sum(g2) / count(*)) / count(*)), 4) AS t FROM g GROUP BY symbol""",
)
def b6(spark, sf):
    return economics.diebold_mariano(ledger(spark, sf), "net_return", 2).select("symbol", rnd("mean").alias("mean"), rnd("t", 4).alias("t"))


@query(
    "b7_holm",
    f"""WITH {LEDGER}, p AS (SELECT symbol AS name, avg((net_return > 0)::INT) / 8 AS p FROM lg GROUP BY symbol), s AS (SELECT *, least(1, p * (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1)) AS s FROM p)
SELECT name, round(p, 6) AS p, round(max(s) OVER (ORDER BY p, name), 6) AS p_adjusted FROM s""",
)
def b7(spark, sf):
    p = ledger(spark, sf).groupBy(F.col("symbol").alias("name")).agg((F.avg((F.col("net_return") > 0).cast("double")) / 8).alias("p"))
    return economics.holm(p).select("name", rnd("p").alias("p"), rnd("p_adjusted").alias("p_adjusted"))


@query("b1_bootstrap")
def b1(spark, sf):
    """Bootstrap draws have no SQL; tests compare the interval with theory."""
    b = ledger(spark, sf).groupBy(F.concat_ws("-", "symbol", F.to_date("ts").cast("string")).alias("id")).agg(F.sum("net_return").alias("t"), F.count(F.lit(1)).cast("double").alias("c"))
    return economics.block_bootstrap(b, "t", "c", draws=400)


@query(
    "b4_weekly_deltas",
    f"""WITH {LEDGER}, w AS (SELECT date_trunc('week', ts) AS w, sum(CASE WHEN symbol = 'view' THEN net_return ELSE 0 END) - sum(CASE WHEN symbol = 'click' THEN net_return ELSE 0 END) AS d FROM lg GROUP BY ALL)
SELECT epoch(w)::BIGINT AS week_s, round(d, 6) AS delta FROM w""",
)
def b4(spark, sf):
    d = lambda s: F.sum(F.when(F.col("symbol") == s, F.col("net_return")).otherwise(0.0))
    return ledger(spark, sf).groupBy(F.date_trunc("week", "ts").alias("w")).agg(rnd(d("view") - d("click")).alias("delta")).select(epoch("w").alias("week_s"), "delta")


@query(
    "v1_blocked_splits",
    f"""WITH {H}, n AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r, count(*) OVER (PARTITION BY symbol) AS n FROM h), f AS (SELECT *, n // 5 AS size, least(r // (n // 5), 4) AS fold FROM n),
l AS (SELECT *, CASE WHEN fold = 4 THEN n - size * 4 ELSE size END AS len FROM f)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, fold::INT AS fold, CASE WHEN r - fold * size < floor(len * 0.8) THEN 'train' WHEN r - fold * size < floor(len * 0.8) + 4 THEN 'embargo' ELSE 'test' END AS role FROM l""",
)
def v1(spark, sf):
    return splits.blocked(hourly(spark, sf), 5, 0.8, 4).select("symbol", epoch().alias("ts_s"), "fold", "role")


#: Folds by tenths of the days that a table spans.
TENTHS = [(3, 5), (5, 8), (8, 10)]
EPI = f"{T}, {TRADES}, ep AS (SELECT symbol, CAST(CAST(start AS DATE) AS VARCHAR) AS episode, start AS label_start, \"end\" AS label_end, id FROM tr)"


@query(
    "v2_purged_folds",
    f"""WITH {EPI}, e AS (SELECT symbol, episode, min(label_start) AS a, max(label_end) AS b FROM ep GROUP BY ALL),
sp AS (SELECT date_trunc('day', min(start)) AS a0, CAST(max(start) AS DATE) - CAST(min(start) AS DATE) + 1 AS d FROM tr),
f AS (SELECT fold, CAST(a0 + to_days(CAST(floor(d * lo / 10) AS INTEGER)) AS TIMESTAMP) AS s, CAST(a0 + to_days(CAST(floor(d * hi / 10) AS INTEGER)) AS TIMESTAMP) AS t FROM sp, (VALUES (0, 3, 5), (1, 5, 8), (2, 8, 10)) x(fold, lo, hi))
SELECT fold, symbol, episode, CASE WHEN b < s THEN 'train' WHEN a >= s AND b <= t THEN 'valid' ELSE 'purged' END AS role FROM e, f WHERE b < s OR a < t""",
)
def v2(spark, sf):
    e = trades(spark, sf).select("symbol", F.to_date("start").cast("string").alias("episode"), F.col("start").alias("label_start"), F.col("end").alias("label_end"))
    f = splits.fold_spans(e, TENTHS, "label_start")
    return splits.purged(e, f).select("fold", "symbol", "episode", "role")


@query(
    "v4_walk_forward",
    f"""WITH {H}, e AS (SELECT date_trunc('day', min(ts)) AS a, max(ts) AS b FROM h), s AS (SELECT unnest(generate_series(a + INTERVAL '10 days', b, INTERVAL '7 days')) AS t FROM e)
SELECT (row_number() OVER (ORDER BY t) - 1)::INT AS "window", epoch(t - INTERVAL '10 days')::BIGINT AS train_start, epoch(t)::BIGINT AS test_start, epoch(t + INTERVAL '7 days')::BIGINT AS test_end FROM s""",
)
def v4(spark, sf):
    w = splits.walk_forward(hourly(spark, sf), 10, 7)
    return w.select("window", *[epoch(c).alias(c) for c in ("train_start", "test_start", "test_end")])


@query(
    "v6_forward_chaining",
    f"""WITH {EPI}, e AS (SELECT symbol || episode AS episode, min(label_start) AS a FROM ep GROUP BY ALL) SELECT episode, (ntile(5) OVER (ORDER BY a, episode) - 1)::INT AS block FROM e""",
)
def v6(spark, sf):
    e = trades(spark, sf).select(F.concat("symbol", F.to_date("start").cast("string")).alias("episode"), F.col("start").alias("ts"))
    return splits.chained(e, 4)


@query("v8_class_weights", f"WITH {ONE}, c AS (SELECT y AS label, count(*) AS n FROM q GROUP BY y) SELECT label, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c")
def v8(spark, sf):
    return splits.class_weights(one(spark, sf).withColumnRenamed("y", "label")).select("label", rnd("weight").alias("weight"))


@query(
    "t4_policy_choice",
    f"""WITH {NET}, t AS (SELECT symbol, sum(net) AS s, avg(abs(pos)) AS x FROM nt GROUP BY symbol) SELECT symbol, round(s, 6) AS net, x >= 0.3 AS admissible FROM t ORDER BY (x >= 0.3) DESC, s DESC, symbol LIMIT 1""",
)
def t4(spark, sf):
    g = net(spark, sf).groupBy("symbol").agg(F.sum("net").alias("s"), F.avg(F.abs("pos")).alias("x"))
    return gates.best_policy(g, F.col("x") >= 0.3, [F.desc("s"), F.col("symbol")]).select("symbol", rnd("s").alias("net"), "admissible")


@query("t2_first_match", f"WITH {WIN} SELECT win, arg_min(id, ts) AS id FROM wn WHERE score >= 0.4 GROUP BY win")
def t2(spark, sf):
    return windows(spark, sf).where("score >= 0.4").groupBy("win").agg(F.min_by("id", "ts").alias("id"))


@query("t3_best_duplicate", f"WITH {WIN} SELECT win, id, round(score, 6) AS score FROM wn QUALIFY row_number() OVER (PARTITION BY win ORDER BY score DESC, id) = 1")
def t3(spark, sf):
    best = windows(spark, sf).groupBy("win").agg(F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), F.col("id"))).alias("b"))
    return best.select("win", "b.id", rnd("b.score").alias("score"))


@query("f17_magnitude_class", f"WITH {WIN} SELECT id, CASE WHEN score < 0.1 THEN 0 WHEN score < 0.25 THEN 1 WHEN score < 0.45 THEN 2 ELSE 3 END AS code FROM wn")
def f17(spark, sf):
    s = F.col("score")
    return windows(spark, sf).select("id", F.when(s < 0.1, 0).when(s < 0.25, 1).when(s < 0.45, 2).otherwise(3).alias("code"))


@query(
    "z1_edge_windows",
    f"""WITH {ONE}, b AS (SELECT *, p2 > p0 AS is_on, ts <> lag(ts) OVER w + INTERVAL '1 hour' AS gap, lag(p2 > p0) OVER w AS was FROM q WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
i AS (SELECT *, sum((coalesce(gap, true) OR is_on <> coalesce(was, NOT is_on))::INT) OVER (PARTITION BY symbol ORDER BY ts) AS run FROM b)
SELECT symbol, epoch(min(ts))::BIGINT AS start_s, epoch(max(ts))::BIGINT AS end_s, count(*) AS bars, round(max(p2), 6) AS top FROM i WHERE is_on GROUP BY symbol, run""",
)
def z1(spark, sf):
    from tidemark.operators import opportunity

    got = opportunity.edge_windows(one(spark, sf), F.col("p2") > F.col("p0"), F.expr("INTERVAL 1 HOUR"), {"top": F.max("p2")})
    return got.select("symbol", epoch("start").alias("start_s"), epoch("end").alias("end_s"), "bars", rnd("top").alias("top"))


@query(
    "z2_event_windows",
    f"""WITH RECURSIVE {ONE}, s AS (SELECT symbol, ts FROM q WHERE p2 >= 0.3), g AS (SELECT symbol, min(ts) AS ts FROM s GROUP BY symbol
  UNION ALL SELECT g.symbol, (SELECT min(s.ts) FROM s WHERE s.symbol = g.symbol AND s.ts >= g.ts + INTERVAL '3 hours') FROM g WHERE g.ts IS NOT NULL)
SELECT substr(sha256(symbol || '|' || CAST(epoch(ts)::BIGINT AS VARCHAR)), 1, 20) AS window_id, symbol, epoch(ts)::BIGINT AS start_s FROM g WHERE ts IS NOT NULL""",
)
def z2(spark, sf):
    from tidemark.operators import opportunity

    got = opportunity.event_windows(one(spark, sf).where("p2 >= 0.3"), 3 * 3600)
    return got.select("window_id", "symbol", epoch("start").alias("start_s"))


@query(
    "z3_triggers",
    f"""WITH RECURSIVE {ONE}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM q),
s AS (SELECT symbol, id, i, CASE WHEN p2 >= 0.35 THEN 1 ELSE 0 END AS st, CASE WHEN p2 >= 0.35 THEN 0 ELSE 0 END AS age, false AS fired FROM n WHERE i = 1
  UNION ALL SELECT n.symbol, n.id, n.i, CASE WHEN n.p1 > 0.6 THEN 0 WHEN s.st = 0 THEN CASE WHEN n.p2 >= 0.35 THEN 1 ELSE 0 END WHEN s.age + 1 > 3 THEN 0 WHEN s.st = 1 THEN CASE WHEN n.p0 < 0.2 THEN 2 ELSE 1 END
    WHEN n.p2 >= 0.3 THEN 0 ELSE 2 END, CASE WHEN n.p1 > 0.6 THEN 0 WHEN s.st = 0 THEN 0 WHEN s.age + 1 > 3 THEN 0 WHEN s.st = 1 AND n.p0 < 0.2 THEN 0 WHEN s.st = 2 AND n.p2 >= 0.3 THEN 0 ELSE s.age + 1 END,
    n.p1 <= 0.6 AND s.st = 2 AND s.age + 1 <= 3 AND n.p2 >= 0.3 FROM s JOIN n ON n.symbol = s.symbol AND n.i = s.i + 1)
SELECT id, fired FROM s""",
)
def z3(spark, sf):
    from tidemark.operators import opportunity

    q = one(spark, sf)
    steps = [F.col("p2") >= 0.35, F.col("p0") < 0.2, F.col("p2") >= 0.3]
    return opportunity.triggers(q, steps, reset=F.col("p1") > 0.6, expiry=3).select("id", "fired")
