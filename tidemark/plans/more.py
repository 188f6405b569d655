"""Further queries: paired paths, causal annotations, frontiers, controls, impulse features, stacked arms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import correlation, labels, ledgers
from tidemark.operators.series import rolling, rolling_kernel
from tidemark.plans.base import H, epoch, fine, hourly, last, query, rnd
from tidemark.plans.evaluation import DEC, LEDGER, PANEL, PATH, WIN, decisions, ledger, probs, windows

SIDES = "(SELECT unnest([1, -1]) AS s)"
OUT = f"""x AS (SELECT id, s, entry, arg_max(close, mts) AS lc, min(CASE WHEN CASE WHEN s > 0 THEN low <= entry * (1 - 0.02 * s) ELSE high >= entry * (1 - 0.02 * s) END THEN mts END) AS sl,
  min(CASE WHEN CASE WHEN s > 0 THEN high >= entry * (1 + 0.04 * s) ELSE low <= entry * (1 + 0.04 * s) END THEN mts END) AS tp FROM pt, {SIDES} GROUP BY ALL),
r AS (SELECT id, s, CASE WHEN sl IS NOT NULL AND (tp IS NULL OR sl <= tp) THEN -1 WHEN tp IS NOT NULL THEN 2 ELSE (lc - entry) * s / (entry * 0.02) END AS r FROM x)"""


@query(
    "l10_paired_paths",
    f"""WITH {DEC}, {PATH}, {OUT} SELECT id, round(max(CASE WHEN s = 1 THEN r END), 6) AS long_r, round(max(CASE WHEN s = -1 THEN r END), 6) AS short_r,
  CASE WHEN max(CASE WHEN s = 1 THEN r END) >= max(CASE WHEN s = -1 THEN r END) THEN 1 ELSE -1 END AS best FROM r GROUP BY id""",
)
def l10(spark, sf):
    d, bars = decisions(spark, sf).drop("side"), fine(spark, sf)
    both = d.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("key", F.concat_ws("|", "id", F.col("side").cast("string")))
    both = both.withColumns({"stop": F.col("entry") * (1 - 0.02 * F.col("side")), "target": F.col("entry") * (1 + 0.04 * F.col("side"))})
    out = labels.bracket(both, bars, "key", 7200).select(F.substring_index("key", "|", 1).alias("id"), F.substring_index("key", "|", -1).alias("side"), "r_gross")
    wide = out.groupBy("id").pivot("side", ["1", "-1"]).agg(F.first("r_gross"))
    best = F.when(F.round(F.col("`1`"), 9) >= F.round(F.col("`-1`"), 9), 1).otherwise(-1)
    return wide.select("id", rnd(F.col("`1`")).alias("long_r"), rnd(F.col("`-1`")).alias("short_r"), best.alias("best"))


@query(
    "l12_touched_before",
    f"""WITH {DEC}, {PATH}, e AS (SELECT id, unnest([0, 30, 60]) AS delay FROM dc), t AS (SELECT id, any_value(ts) AS ts, min(CASE WHEN high >= entry * 1.01 THEN mts END) AS u, min(CASE WHEN low <= entry * 0.99 THEN mts END) AS d FROM pt GROUP BY id)
SELECT e.id, delay, coalesce(u < t.ts + delay * INTERVAL '1 minute', false) AS target_before, coalesce(d < t.ts + delay * INTERVAL '1 minute', false) AS stop_before FROM e JOIN t ON t.id = e.id""",
)
def l12(spark, sf):
    d = decisions(spark, sf)
    t = labels.first_touch(d, fine(spark, sf), "id", {"u": F.col("bar_high") >= F.col("entry") * 1.01, "d": F.col("bar_low") <= F.col("entry") * 0.99}, 7200)
    e = d.select("id", "ts", F.explode(F.array(*map(F.lit, (0, 30, 60)))).alias("delay")).join(t.select("id", "u", "d"), "id")
    at = F.col("ts") + F.make_dt_interval(mins=F.col("delay"))
    return e.select("id", "delay", F.coalesce(F.col("u") < at, F.lit(False)).alias("target_before"), F.coalesce(F.col("d") < at, F.lit(False)).alias("stop_before"))


@query("l13_distribution_targets", f"WITH {LEDGER} SELECT id, CASE WHEN net_return > 0.02 THEN 2 WHEN net_return < -0.02 THEN 0 ELSE 1 END AS code, round(greatest(net_return, 0), 6) AS gain, round(least(net_return, 0), 6) AS loss FROM lg")
def l13(spark, sf):
    r = F.col("net_return")
    code = F.when(r > 0.02, 2).when(r < -0.02, 0).otherwise(1)
    return ledger(spark, sf).select("id", code.alias("code"), rnd(F.greatest(r, F.lit(0.0))).alias("gain"), rnd(F.least(r, F.lit(0.0))).alias("loss"))


@query("j18_delay_rows", f"WITH {DEC}, e AS (SELECT id, symbol, ts, unnest(generate_series(0, 5)) AS delay FROM dc) SELECT id, delay::INT AS delay, close FROM e JOIN m5 ON m5.symbol = e.symbol AND m5.ts = e.ts + delay * INTERVAL '5 minutes'")
def j18(spark, sf):
    d = decisions(spark, sf).select("id", "symbol", F.col("ts").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("delay"))
    d = d.withColumn("ts", F.col("t") + F.make_dt_interval(mins=F.col("delay") * 5))
    return d.join(fine(spark, sf).select("symbol", "ts", "close"), ["symbol", "ts"]).select("id", "delay", "close")


@query(
    "j19_stacked_arms",
    f"""WITH {LEDGER}, a AS (SELECT id, net_return FROM lg WHERE bars_held <= 4), b AS (SELECT id, net_return FROM lg WHERE exit_reason = 'target'), k AS (SELECT id FROM a UNION SELECT id FROM b)
SELECT k.id, round(coalesce(a.net_return, 0), 6) AS arm_a, round(coalesce(b.net_return, 0), 6) AS arm_b FROM k LEFT JOIN a ON a.id = k.id LEFT JOIN b ON b.id = k.id""",
)
def j19(spark, sf):
    l = ledger(spark, sf)
    a, b = (l.where(on).select("id", F.col("net_return").alias(n)) for on, n in (("bars_held <= 4", "a"), ("exit_reason = 'target'", "b")))
    k = a.select("id").union(b.select("id")).distinct()
    return k.join(a, "id", "left").join(b, "id", "left").select("id", rnd(F.coalesce("a", F.lit(0.0))).alias("arm_a"), rnd(F.coalesce("b", F.lit(0.0))).alias("arm_b"))


@query(
    "y13_threshold_frontier",
    f"""WITH {WIN}, m AS (SELECT win, max(score) AS top FROM wn GROUP BY win), t AS (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6]) AS threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, count_if(top >= threshold)::BIGINT AS entered, count(*) AS windows FROM m, t GROUP BY threshold""",
)
def y13(spark, sf):
    m = windows(spark, sf).groupBy("win").agg(F.max("score").alias("top"))
    m = m.withColumn("threshold", F.explode(F.array(*map(F.lit, (0.2, 0.3, 0.4, 0.5, 0.6)))))
    return m.groupBy("threshold").agg(F.count_if(F.col("top") >= F.col("threshold")).alias("entered"), F.count(F.lit(1)).alias("windows"))


@query(
    "y16_target_rate",
    f"""WITH {WIN}, m AS (SELECT win, max(score) AS top FROM wn GROUP BY win), t AS (SELECT unnest(generate_series(0, 50)) / 50.0 AS threshold), r AS (SELECT threshold, avg((top >= threshold)::INT) AS rate FROM m, t GROUP BY threshold)
SELECT round(threshold, 6) AS threshold, round(rate, 6) AS rate FROM r ORDER BY abs(rate - 0.3), threshold LIMIT 1""",
)
def y16(spark, sf):
    m = windows(spark, sf).groupBy("win").agg(F.max("score").alias("top"))
    m = m.withColumn("threshold", F.explode(F.transform(F.sequence(F.lit(0), F.lit(50)), lambda x: x / 50.0)))
    r = m.groupBy("threshold").agg(F.avg((F.col("top") >= F.col("threshold")).cast("double")).alias("rate"))
    return r.orderBy(F.abs(F.col("rate") - 0.3), "threshold").limit(1).select(rnd("threshold").alias("threshold"), rnd("rate").alias("rate"))


@query(
    "w19_impulses",
    f"""WITH {H}, r AS (SELECT *, abs(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts))) AS v FROM h), c AS (SELECT *, count(v) OVER p AS k, quantile_cont(v, 0.9) OVER p AS cut FROM r WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, coalesce(k >= 24 AND v > cut, false) AS hit FROM c)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, hit, count_if(hit) OVER {last(12)}::BIGINT AS hits_12, round((epoch(ts) - epoch(max(CASE WHEN hit THEN ts END) OVER {last(48)})) / 60, 4) AS since_min FROM e""",
)
def w19(spark, sf):
    def cut(f):
        p, v = f.before(48), F.col("v")
        return {"hit": F.coalesce((F.count("v").over(p) >= 24) & (v > F.percentile("v", 0.9).over(p)), F.lit(False))}

    def counts(f):
        at = F.max(F.when(F.col("hit"), F.col("ts"))).over(f.over(48))
        return {"hits_12": F.count_if("hit").over(f.over(12)), "since_min": (F.unix_timestamp("ts") - F.unix_timestamp(at)) / 60.0}

    got = rolling(hourly(spark, sf), 98, lambda f: {"v": F.abs(F.ln(F.col("close") / F.lag("close").over(f.order)))}, cut, counts)
    return got.select("symbol", epoch().alias("ts_s"), "hit", "hits_12", rnd("since_min", 4).alias("since_min"))


@query(
    "w29_dynamic_threshold",
    f"""WITH {H}, r AS (SELECT *, abs(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts))) AS v FROM h), z AS (SELECT *, CASE WHEN count(v) OVER {last(96)} >= 24 THEN (v - avg(v) OVER {last(96)}) / nullif(stddev_samp(v) OVER {last(96)}, 0) END AS z FROM r)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, round(z, 5) AS vol_z, round(0.5 + 0.05 * least(greatest(coalesce(z, 0), -2), 2), 6) AS tau FROM z""",
)
def w29(spark, sf):
    def z(f):
        w, v = f.over(96), F.col("v")
        return {"z": F.when(F.count("v").over(w) >= 24, (v - F.avg("v").over(w)) / F.nullif(F.stddev_samp("v").over(w), F.lit(0.0)))}

    got = rolling(hourly(spark, sf), 97, lambda f: {"v": F.abs(F.ln(F.col("close") / F.lag("close").over(f.order)))}, z)
    tau = 0.5 + 0.05 * F.least(F.greatest(F.coalesce("z", F.lit(0.0)), F.lit(-2.0)), F.lit(2.0))
    return got.select("symbol", epoch().alias("ts_s"), rnd("z", 5).alias("vol_z"), rnd(tau).alias("tau"))


@query(
    "w30_level_block",
    f"""WITH {H}, l AS (SELECT symbol, ts, ln(close) AS l FROM h) SELECT symbol, epoch(ts)::BIGINT AS ts_s, round(l, 6) AS log_level, round(l - lag(l, 1) OVER w, 6) AS d1, round(l - lag(l, 4) OVER w, 6) AS d4,
  CASE WHEN count(l) OVER {last(20)} = 20 THEN round(stddev_samp(l) OVER {last(20)}, 6) END AS sd20 FROM l WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
)
def w30(spark, sf):
    h = hourly(spark, sf).withColumn("l", F.ln("close"))
    got = rolling(h, 20, lambda f: {f"d{k}": F.col("l") - F.lag("l", k).over(f.order) for k in (1, 4)} | {"sd20": f.full(F.stddev_samp("l"), "l", 20)})
    return got.select("symbol", epoch().alias("ts_s"), rnd("l").alias("log_level"), *[rnd(c).alias(c) for c in ("d1", "d4", "sd20")])


@query(
    "b5_week_blocks",
    f"""WITH {LEDGER}, w AS (SELECT symbol, date_trunc('week', ts) AS w, sum(net_return) AS net FROM lg GROUP BY ALL), g AS (SELECT symbol, unnest(generate_series(min(w), max(w), INTERVAL '7 days')) AS w FROM w GROUP BY symbol)
SELECT symbol, epoch(w)::BIGINT AS week_s, round(coalesce(net, 0), 6) AS net FROM g LEFT JOIN w USING (symbol, w)""",
)
def b5(spark, sf):
    from tidemark.operators.bars import on_grid

    w = ledger(spark, sf).groupBy("symbol", F.date_trunc("week", "ts").alias("ts")).agg(F.sum("net_return").alias("net"))
    return on_grid(w, "7 days", ["net"]).select("symbol", epoch().alias("week_s"), rnd("net").alias("net"))


@query(
    "y26_reentries",
    f"""WITH {LEDGER}, e AS (SELECT *, symbol || CAST(CAST(ts AS DATE) AS VARCHAR) AS ep, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS k FROM lg), f AS (SELECT ep, ts + bars_held * INTERVAL '20 minutes' AS ex FROM e WHERE k = 1)
SELECT e.id FROM e JOIN f USING (ep) WHERE e.k > 1 AND e.ts > f.ex QUALIFY row_number() OVER (PARTITION BY ep ORDER BY e.ts) = 1""",
)
def y26(spark, sf):
    l = ledger(spark, sf).withColumn("ep", F.concat("symbol", F.to_date("ts").cast("string")))
    l = l.withColumn("k", F.row_number().over(Window.partitionBy("ep").orderBy("ts")))
    first = l.where("k = 1").select("ep", (F.col("ts") + F.make_dt_interval(mins=F.col("bars_held") * 20)).alias("exit"))
    later = l.where("k > 1").join(first, "ep").where("ts > exit")
    return later.groupBy("ep").agg(F.min_by("id", "ts").alias("id")).select("id")


@query(
    "g35_direction_scenarios",
    f"""WITH {DEC}, {PATH}, {OUT}, w AS (SELECT id, max(CASE WHEN s = 1 THEN r END) AS l, max(CASE WHEN s = -1 THEN r END) AS h FROM r GROUP BY id)
SELECT 'random' AS scenario, round(avg((l + h) / 2), 6) AS mean_r FROM w UNION ALL SELECT 'oracle', round(avg(greatest(l, h)), 6) FROM w UNION ALL SELECT 'accuracy_70', round(avg(0.7 * greatest(l, h) + 0.3 * least(l, h)), 6) FROM w""",
)
def g35(spark, sf):
    w = l10(spark, sf).select("long_r", "short_r")
    l, s = F.col("long_r"), F.col("short_r")
    m = {"random": (l + s) / 2, "oracle": F.greatest(l, s), "accuracy_70": 0.7 * F.greatest(l, s) + 0.3 * F.least(l, s)}
    row = w.agg(*[F.avg(c).alias(k) for k, c in m.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("scenario"), rnd(k).alias("mean_r")) for k in m])).alias("x")).select("x.*")


@query(
    "g23_spearman",
    f"""WITH {PANEL}, q AS (SELECT p0, p1, p2 FROM p WHERE model = 1), k AS (SELECT rank() OVER (ORDER BY p0) + (count(*) OVER (PARTITION BY p0) - 1) / 2.0 AS a, rank() OVER (ORDER BY p2) + (count(*) OVER (PARTITION BY p2) - 1) / 2.0 AS b FROM q)
SELECT round(corr(a, b), 5) AS spearman FROM k""",
)
def g23(spark, sf):
    return correlation.spearman(probs(spark, sf).where("model = 1"), ["p0", "p2"]).select(rnd("rho", 5).alias("spearman"))



FEATURES = ["close", "high", "twice", "ret_1", "ret_5", "hl", "volume", "taker", "flow"]
FEAT = f"""{H}, ft AS (SELECT row_number() OVER () AS id, close, high, 2 * close + 1 AS twice, close / lag(close) OVER w - 1 AS ret_1, close / lag(close, 5) OVER w - 1 AS ret_5, (high - low) / close AS hl, volume, taker, 2 * taker / volume - 1 AS flow FROM h WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
lg AS ({" UNION ALL ".join(f"SELECT id, {i} AS i, '{f}' AS f, CAST({f} AS DOUBLE) AS v FROM ft WHERE {f} IS NOT NULL" for i, f in enumerate(FEATURES))}),
pr AS (SELECT x.i, y.i AS j, x.f AS a, y.f AS b, x.v AS u, y.v AS v FROM lg x JOIN lg y ON x.id = y.id AND x.i < y.i),
rk AS (SELECT i, j, a, b, rank() OVER (PARTITION BY i, j ORDER BY u) + (count(*) OVER (PARTITION BY i, j, u) - 1) / 2.0 AS u, rank() OVER (PARTITION BY i, j ORDER BY v) + (count(*) OVER (PARTITION BY i, j, v) - 1) / 2.0 AS v FROM pr),
mx AS (SELECT i, j, a, b, corr(u, v) AS rho, count(*) AS n FROM rk GROUP BY i, j, a, b)"""


def features(spark, sf):
    c = F.col("close")
    lagged = lambda f, k: c / F.lag("close", k).over(f.order) - 1
    rows = rolling(hourly(spark, sf), 5, lambda f: {"ret_1": lagged(f, 1), "ret_5": lagged(f, 5)})
    return rows.withColumns({"twice": 2 * c + 1, "hl": (F.col("high") - F.col("low")) / c, "flow": 2 * F.col("taker") / F.col("volume") - 1})


@query("g23_rank_matrix", f"WITH {FEAT} SELECT a, b, round(rho, 6) AS rho, n FROM mx")
def g23_matrix(spark, sf):
    return correlation.spearman(features(spark, sf), FEATURES).select("a", "b", rnd("rho").alias("rho"), "n")


@query(
    "g23_pruned",
    f"""WITH RECURSIVE {FEAT}, m AS (SELECT map_from_entries(list((i * 100 + j, abs(rho)))) AS m FROM mx WHERE rho IS NOT NULL),
s(k, kept) AS (SELECT 0, CAST([] AS INTEGER[]) UNION ALL SELECT k + 1, CASE WHEN len(list_filter(kept, lambda a: coalesce(m[a * 100 + k], 0) >= 0.95)) > 0 THEN kept ELSE list_append(kept, k) END FROM s, m WHERE k < {len(FEATURES)}),
z AS (SELECT kept FROM s WHERE k = {len(FEATURES)}),
o AS (SELECT mx.*, abs(rho) AS r, list_contains(kept, j) AS stays, row_number() OVER (PARTITION BY j ORDER BY abs(rho) DESC, i) AS best FROM mx, z WHERE list_contains(kept, i) AND rho IS NOT NULL)
SELECT a AS feature_a, b AS feature_b, round(r, 6) AS abs_spearman, CASE WHEN stays THEN 'report_only' ELSE 'drop_second' END AS action FROM o WHERE CASE WHEN stays THEN r >= 0.8 ELSE best = 1 END
UNION ALL SELECT NULL, [{", ".join(f"'{f}'" for f in FEATURES)}][i + 1], NULL, 'keep' FROM (SELECT unnest(kept) AS i FROM z)""",
)
def g23_pruned(spark, sf):
    kept, _, audit = correlation.pruned(correlation.spearman(features(spark, sf), FEATURES), FEATURES)
    rows = [(a, b, round(r, 6), action) for a, b, r, action in audit] + [(None, f, None, "keep") for f in kept]
    return spark.createDataFrame(rows, "feature_a string, feature_b string, abs_spearman double, action string")


@query(
    "g26_outcome_cards",
    f"""WITH {LEDGER}, f AS (SELECT min(ts) AS f, max(ts) AS l FROM lg), d AS (SELECT unnest(generate_series(date_trunc('week', f) + INTERVAL '14 days', l, INTERVAL '7 days')) AS decision, f FROM f),
w AS (SELECT decision, age, decision - age * INTERVAL '7 days' AS a, decision - (age - 1) * INTERVAL '7 days' AS b FROM d, (SELECT unnest([1, 2, 3, 4]) AS age) WHERE decision - age * INTERVAL '7 days' >= f),
r AS (SELECT decision, age, symbol, ts, net_return AS n, sum(net_return) OVER z AS c FROM w JOIN lg ON ts >= a AND ts < b WINDOW z AS (PARTITION BY decision, age, symbol ORDER BY ts, net_return ROWS UNBOUNDED PRECEDING)),
dr AS (SELECT *, greatest(max(c) OVER (PARTITION BY decision, age, symbol ORDER BY ts, n ROWS UNBOUNDED PRECEDING), 0) - c AS dd FROM r)
SELECT epoch(w.decision)::BIGINT AS decision_s, w.age AS age_weeks, m.symbol AS model, round(coalesce(sum(n), 0) * 10000, 4) AS net_bps, count(n) AS trades, round(coalesce(max(dd), 0) * 10000, 4) AS drawdown_bps
FROM w CROSS JOIN (SELECT DISTINCT symbol FROM lg) m LEFT JOIN dr ON dr.decision = w.decision AND dr.age = w.age AND dr.symbol = m.symbol GROUP BY w.decision, w.age, m.symbol""",
)
def g26(spark, sf):
    l = ledger(spark, sf)
    ends = l.agg((F.date_trunc("week", F.min("ts")) + F.expr("INTERVAL 14 DAYS")).alias("a"), F.max("ts").alias("b"))
    decisions = ends.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 7 DAYS"))).alias("decision"))
    got = ledgers.outcome_cards(l, decisions, 4, "symbol", "ts", "net_return")
    return got.select(epoch("decision").alias("decision_s"), "age_weeks", F.col("symbol").alias("model"), rnd("net_bps", 4).alias("net_bps"), "trades", rnd("drawdown_bps", 4).alias("drawdown_bps"))


@query(
    "h6_rolling_kernel",
    f"""WITH {H}, n AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM h)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, round(CASE WHEN i >= 30 THEN regr_slope(close, i) OVER (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING) END, 6) AS slope FROM n""",
)
def h6(spark, sf):
    """A user's kernel: the slope of the last 30 closes, many windows a call."""

    def slope(close: np.ndarray) -> np.ndarray:
        x = np.arange(close.shape[1]) - (close.shape[1] - 1) / 2
        return (close - close.mean(axis=1, keepdims=True)) @ x / (x @ x)

    return rolling_kernel(hourly(spark, sf), ["close"], 30, slope, "slope", chunk=500).select("symbol", epoch().alias("ts_s"), rnd("slope").alias("slope"))
