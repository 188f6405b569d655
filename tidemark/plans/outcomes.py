"""Queries on exits of decisions, limit orders, steps of windows, and trigger sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features, labels, opportunity
from tidemark.plans.base import H, M5, epoch, fine, hourly, last, query, rnd
from tidemark.plans.channels import CH, CMP, RGM, WINDOWS, context, manifest
from tidemark.plans.evaluation import DEC, ONE, decisions, one


def exits(dec: str, name: str, hours: int, gone: str = "false") -> str:
    """SQL of ``labels.exit_labels`` over hourly bars for the decisions ``dec``, as the CTE ``name``."""
    up, at = "d.side > 0", f"{name}_p"
    return f"""{at} AS (SELECT d.*, h.ts AS mts, h.high, h.low, h.close, h.n AS bn, row_number() OVER (PARTITION BY d.id ORDER BY h.ts) - 1 AS k FROM {dec} d LEFT JOIN h ON h.symbol = d.symbol AND h.ts >= d.ts AND h.ts < d.ts + INTERVAL '{hours} hours'),
{name}_a AS (SELECT id, count(mts) AS m, min(CASE WHEN CASE WHEN {up} THEN low <= stop ELSE high >= stop END THEN mts END) AS sl, min(CASE WHEN CASE WHEN {up} THEN high >= target ELSE low <= target END THEN mts END) AS tp,
  min(CASE WHEN {gone} THEN mts END) AS go, arg_min(close, CASE WHEN {gone} THEN mts END) AS gc, min(CASE WHEN mts <> ts + k * INTERVAL '1 hour' THEN ts + k * INTERVAL '1 hour' END) AS miss, arg_max(close, mts) AS lc, max(mts) AS lt FROM {at} d GROUP BY id),
{name}_g AS (SELECT d.*, m, sl, tp, go, gc, lc, lt, coalesce(miss, CASE WHEN m < {hours} THEN ts + m * INTERVAL '1 hour' END) AS gap FROM {dec} d JOIN {name}_a USING (id)),
{name}_s AS (SELECT * REPLACE (CASE WHEN gap IS NULL OR sl < gap THEN sl END AS sl, CASE WHEN gap IS NULL OR tp < gap THEN tp END AS tp, CASE WHEN gap IS NULL OR go < gap THEN go END AS go) FROM {name}_g),
{name}_o AS (SELECT *, least(sl, tp, go) AS f, CASE WHEN sl = least(sl, tp, go) THEN 'stop' WHEN tp = least(sl, tp, go) THEN 'target' WHEN go = least(sl, tp, go) THEN 'regime' WHEN gap IS NOT NULL THEN 'censored' ELSE 'timeout' END AS outcome FROM {name}_s),
{name} AS (SELECT *, coalesce(f, gap, lt) AS exit_ts, (CASE outcome WHEN 'stop' THEN stop WHEN 'target' THEN target WHEN 'regime' THEN gc WHEN 'timeout' THEN lc END - entry) * side / nullif(abs(entry - stop), 0) AS rg FROM {name}_o)"""


DX = f"{DEC}, dx AS (SELECT *, entry * (1 - 0.02 * side) AS stop, entry * (1 + 0.04 * side) AS target FROM dc)"


def brackets(spark, sf):
    d = decisions(spark, sf)
    return d.withColumns({"stop": F.col("entry") * (1 - 0.02 * F.col("side")), "target": F.col("entry") * (1 + 0.04 * F.col("side"))})


@query(
    "l5_regime_exit",
    f"WITH {DX}, {exits('dx', 'ex', 6, 'bn >= 6')} SELECT id, outcome, epoch(exit_ts)::BIGINT AS exit_s, round(rg, 5) AS r_gross, round(rg - entry * 0.001 / abs(entry - stop), 5) AS r_net FROM ex",
)
def l5(spark, sf):
    got = labels.exit_labels(brackets(spark, sf), hourly(spark, sf), "id", 6 * 3600, 3600, F.col("bar_n") >= 6, 10, ("n",))
    return got.select("id", "outcome", epoch("exit_ts").alias("exit_s"), rnd("r_gross", 5).alias("r_gross"), rnd("r_net", 5).alias("r_net"))


STEPS = f"""{WINDOWS}, hb AS (SELECT *, min(low) OVER {last(3)} AS lo, max(high) OVER {last(3)} AS hi, lead(ts) OVER w AS nts, lead(open) OVER w AS entry FROM h WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
sp AS (SELECT window_id || '@' || CAST(epoch(hb.ts)::BIGINT AS VARCHAR) AS id, window_id, wd.symbol, nts AS ts, side, entry, CASE WHEN side > 0 THEN lo * 0.999 ELSE hi * 1.001 END AS stop FROM wd JOIN hb ON hb.symbol = wd.symbol AND hb.ts >= wd.start AND hb.ts < wd."end" WHERE nts = hb.ts + INTERVAL '1 hour'),
st AS (SELECT *, entry + 2 * (entry - stop) AS target, (entry - stop) * side > 0 AS valid FROM sp)"""


def steps(spark, sf):
    return labels.window_steps(manifest(spark, sf), hourly(spark, sf), 3, 0.001, 2.0, 3600)


@query(
    "l6_window_steps",
    f"WITH {STEPS}, {exits('st', 'ex', 4)} SELECT id, window_id, valid, outcome, epoch(exit_ts)::BIGINT AS exit_s, round(rg, 4) AS r_gross FROM ex",
)
def l6(spark, sf):
    s = steps(spark, sf)
    got = labels.exit_labels(s, hourly(spark, sf), "id", 4 * 3600, 3600).join(s.select("id", "window_id", "valid"), "id")
    return got.select("id", "window_id", "valid", "outcome", epoch("exit_ts").alias("exit_s"), rnd("r_gross", 4).alias("r_gross"))


def limits(dec: str) -> str:
    """SQL of ``labels.limit_labels``: 0.5 % better, open for 2 hours, then 4 hours; 2 and 10 basis points."""
    return f"""fl AS (SELECT d.id, min(CASE WHEN CASE WHEN d.side > 0 THEN h.low <= d.entry * (1 - 0.005 * d.side) ELSE h.high >= d.entry * (1 - 0.005 * d.side) END THEN h.ts END) AS fill
  FROM {dec} d JOIN h ON h.symbol = d.symbol AND h.ts >= d.ts AND h.ts < d.ts + INTERVAL '2 hours' GROUP BY d.id),
lo AS (SELECT d.id, d.symbol, d.side, fill + INTERVAL '1 hour' AS ts, d.entry * (1 - 0.005 * d.side) AS entry, d.stop, d.target - d.side * 0.005 * d.entry * (1 - 0.005 * d.side) AS target FROM {dec} d JOIN fl USING (id) WHERE fill IS NOT NULL),
{exits('lo', 'ex', 4)}, lm AS (SELECT d.id, ex.id IS NOT NULL AS filled, coalesce(outcome, 'unfilled') AS outcome, CASE WHEN ex.id IS NULL THEN 0 ELSE rg - ex.entry * (2 + CASE WHEN outcome = 'target' THEN 2 ELSE 10 END) / 1e4 / abs(ex.entry - ex.stop) END AS r_net FROM {dec} d LEFT JOIN ex ON ex.id = d.id)"""


@query("l7_limit_orders", f"WITH {DX}, {limits('dx')} SELECT id, filled, outcome, round(r_net, 4) AS r_net FROM lm")
def l7(spark, sf):
    got = labels.limit_labels(brackets(spark, sf), hourly(spark, sf), "id", 0.005, 7200, 4 * 3600, 3600, 2, 10)
    return got.select("id", "filled", "outcome", rnd("r_net", 4).alias("r_net"))


@query("l17_window_limits", f"WITH {STEPS}, sv AS (SELECT * FROM st WHERE valid), {limits('sv')} SELECT id, filled, outcome, round(r_net, 3) AS r_net FROM lm")
def l17(spark, sf):
    """Every step of every window with a limit order, without limits of a portfolio."""
    got = labels.limit_labels(steps(spark, sf).where("valid"), hourly(spark, sf), "id", 0.005, 7200, 4 * 3600, 3600, 2, 10)
    return got.select("id", "filled", "outcome", rnd("r_net", 3).alias("r_net"))


@query("l18_validity", f"WITH {DX}, {exits('dx', 'ex', 6, 'bn >= 6')} SELECT id, outcome <> 'censored' AS path_ok, outcome IN ('stop', 'target') AND abs(rg) >= 1 AS direction_ok, outcome <> 'censored' AND rg IS NOT NULL AS magnitude_ok FROM ex")
def l18(spark, sf):
    got = labels.exit_labels(brackets(spark, sf), hourly(spark, sf), "id", 6 * 3600, 3600, F.col("bar_n") >= 6, 10, ("n",))
    return labels.validity(got, 1.0).select("id", "path_ok", "direction_ok", "magnitude_ok")


DL = "dl AS (SELECT d.id || '+' || CAST(k AS VARCHAR) AS id, d.symbol, d.side, d.ts + k * INTERVAL '1 hour' AS ts, h.open AS entry, h.open * (1 - 0.02 * d.side) AS stop, h.open * (1 + 0.04 * d.side) AS target FROM e d CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) JOIN h ON h.symbol = d.symbol AND h.ts = d.ts + k * INTERVAL '1 hour')"


def delayed(d, h):
    """Decisions at the open of each of the three hours from ``ts`` on that have a bar."""
    e = d.select("id", "symbol", "side", "ts", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("k"))
    e = e.select(F.concat_ws("+", "id", F.col("k").cast("string")).alias("id"), "symbol", "side", (F.col("ts") + F.make_dt_interval(hours=F.col("k"))).alias("ts"))
    e = e.join(h.select("symbol", "ts", F.col("open").alias("entry")), ["symbol", "ts"])
    return e.withColumns({"stop": F.col("entry") * (1 - 0.02 * F.col("side")), "target": F.col("entry") * (1 + 0.04 * F.col("side"))})


@query("l11_delayed_entries", f"WITH {DEC}, e AS (SELECT * FROM dc), {DL}, {exits('dl', 'ex', 3)} SELECT id, outcome, round(rg, 5) AS r_gross FROM ex")
def l11(spark, sf):
    h = hourly(spark, sf)
    return labels.exit_labels(delayed(decisions(spark, sf), h), h, "id", 3 * 3600, 3600).select("id", "outcome", rnd("r_gross", 5).alias("r_gross"))


SIG = f"{ONE}, sg AS (SELECT q.id, q.symbol, q.ts + INTERVAL '1 hour' AS ts, pred - 1 AS side, close AS entry, close * (1 - 0.02 * (pred - 1)) AS stop, close * (1 + 0.03 * (pred - 1)) AS target, p2, p0 FROM q JOIN h USING (symbol, ts) WHERE pred <> 1)"


def signals(spark, sf):
    q = one(spark, sf).where("pred <> 1").join(hourly(spark, sf).select("symbol", "ts", F.col("close").alias("entry")), ["symbol", "ts"])
    q = q.withColumn("side", (F.col("pred") - 1).cast("int")).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    return q.select("id", "symbol", "ts", "side", "entry", (F.col("entry") * (1 - 0.02 * F.col("side"))).alias("stop"), (F.col("entry") * (1 + 0.03 * F.col("side"))).alias("target"), "p2", "p0")


@query("l14_signal_candidates", f"WITH {SIG}, {exits('sg', 'ex', 3)} SELECT id, side::INT AS side, outcome, epoch(exit_ts)::BIGINT AS exit_s, round(rg, 5) AS r_gross FROM ex")
def l14(spark, sf):
    """First touches of every directional signal, each by itself."""
    s = signals(spark, sf)
    got = labels.exit_labels(s, hourly(spark, sf), "id", 3 * 3600, 3600).join(s.select("id", "side"), "id")
    return got.select("id", "side", "outcome", epoch("exit_ts").alias("exit_s"), rnd("r_gross", 5).alias("r_gross"))


@query(
    "l16_signal_events",
    f"""WITH {SIG}, {exits('sg', 'ex', 3)}, b AS (SELECT symbol, ts + INTERVAL '1 hour' AS ts, high, low FROM h)
SELECT id, round(abs(ex.entry - stop) / ex.entry, 6) AS risk, round(abs(target - ex.entry) / abs(ex.entry - stop), 6) AS reward, round(CASE WHEN side > 0 THEN b.high - ex.entry ELSE ex.entry - b.low END / ex.entry, 6) AS pullback, rg - ex.entry * 0.001 / abs(ex.entry - stop) > 0 AS positive
FROM ex JOIN b USING (symbol, ts)""",
)
def l16(spark, sf):
    """What is known at the decision (risk, reward, pullback from the signal bar's extreme) and whether the net result is positive."""
    s = signals(spark, sf)
    bar = hourly(spark, sf).select("symbol", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), "high", "low")
    got = labels.exit_labels(s, hourly(spark, sf), "id", 3 * 3600, 3600, cost_bps=10).join(s, "id").join(bar, ["symbol", "ts"])
    e = F.col("entry")
    return got.select(
        "id", rnd(F.abs(e - F.col("stop")) / e).alias("risk"), rnd(F.abs(F.col("target") - e) / F.abs(e - F.col("stop"))).alias("reward"),
        rnd(F.when(F.col("side") > 0, F.col("high") - e).otherwise(e - F.col("low")) / e).alias("pullback"), (F.col("r_net") > 0).alias("positive"),
    )


HELD = f"""{DX}, hp AS (SELECT dx.id, dx.entry, stop, target, side, m5.ts, (m5.close - dx.entry) * side / abs(dx.entry - stop) AS r, (CASE WHEN side > 0 THEN m5.high ELSE m5.low END - dx.entry) * side / abs(dx.entry - stop) AS g, (CASE WHEN side > 0 THEN m5.low ELSE m5.high END - dx.entry) * side / abs(dx.entry - stop) AS b
  FROM dx JOIN m5 ON m5.symbol = dx.symbol AND m5.ts >= dx.ts AND m5.ts < dx.ts + INTERVAL '2 hours')"""


@query(
    "w23_held_states",
    f"""WITH {HELD} SELECT id, epoch(ts)::BIGINT AS ts_s, row_number() OVER w AS held, round(r, 5) AS open_r, round(max(g) OVER w, 5) AS best_r, round(min(b) OVER w, 5) AS worst_r, round(r + 1, 5) AS to_stop,
  round((target - entry) * side / abs(entry - stop) - r, 5) AS to_target FROM hp WINDOW w AS (PARTITION BY id ORDER BY ts)""",
)
def w23(spark, sf):
    got = labels.held_states(brackets(spark, sf), fine(spark, sf), "id", 7200)
    return got.select("id", epoch().alias("ts_s"), "held", *[rnd(c, 5).alias(c) for c in ("open_r", "best_r", "worst_r", "to_stop", "to_target")])


def sequence(src: str, name: str, first: str, second: str, reset: str, expiry: int) -> str:
    """SQL of two-step ``opportunity.triggers`` over ``src`` (symbol, ts), as the recursive CTE ``name`` (symbol, ts, fired)."""
    s1, s2, r = (f"coalesce({c}, false)" for c in (first, second, reset))
    return f"""{name}_n AS (SELECT symbol, ts, {s1} AS a, {s2} AS b, {r} AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM {src}),
{name} AS (SELECT symbol, ts, i, (a AND NOT r)::INT AS st, 0 AS age, false AS fired FROM {name}_n WHERE i = 1
  UNION ALL SELECT n.symbol, n.ts, n.i, CASE WHEN n.r THEN 0 WHEN s.st = 0 THEN n.a::INT WHEN s.age + 1 > {expiry} THEN 0 WHEN n.b THEN 0 ELSE 1 END, CASE WHEN n.r OR s.st = 0 OR s.age + 1 > {expiry} OR n.b THEN 0 ELSE s.age + 1 END,
    NOT n.r AND s.st = 1 AND s.age + 1 <= {expiry} AND n.b FROM {name} s JOIN {name}_n n ON n.symbol = s.symbol AND n.i = s.i + 1)"""


FOUR = ", ".join(
    sequence("cp", f"{name}{'u' if side > 0 else 'd'}", a.replace("S", str(side)), b.replace("S", str(side)), f"coalesce(regime <> {side}, true)", 6)
    for side in (1, -1)
    for name, a, b in (("edge", "centre * S <= -0.5", "centre * S > -0.5"), ("mid", "abs(centre) <= 0.2", "centre * S > 0.2"))
)


@query(
    "z4_two_setups",
    f"""WITH RECURSIVE {CH}, {RGM}, {CMP}, {FOUR}, al AS (SELECT symbol, ts, 'edge' AS setup, 1 AS side FROM edgeu WHERE fired UNION ALL SELECT symbol, ts, 'edge', -1 FROM edged WHERE fired UNION ALL SELECT symbol, ts, 'midline', 1 FROM midu WHERE fired UNION ALL SELECT symbol, ts, 'midline', -1 FROM midd WHERE fired),
b AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY setup, -side) = 1)
SELECT cp.symbol, epoch(cp.ts)::BIGINT AS ts_s, setup, side FROM cp LEFT JOIN b ON b.symbol = cp.symbol AND b.ts = cp.ts""",
)
def z4(spark, sf):
    got = opportunity.two_setups(features.compact(context(spark, sf), 4), 6)
    return got.select("symbol", epoch().alias("ts_s"), "setup", "side")


CONF = sequence("q", "cf", "p2 >= 0.4", "p0 < 0.25", "p1 > 0.6", 5)
T2 = f"""{ONE}, {CONF}, ff AS (SELECT symbol, ts FROM cf WHERE fired), tk AS (SELECT symbol, min(ts) AS ts FROM ff GROUP BY symbol
  UNION ALL SELECT tk.symbol, (SELECT min(ff.ts) FROM ff WHERE ff.symbol = tk.symbol AND ff.ts >= tk.ts + INTERVAL '6 hours') FROM tk WHERE tk.ts IS NOT NULL)"""


def confirmed(spark, sf):
    return opportunity.confirmed_windows(one(spark, sf), F.col("p2") >= 0.4, F.col("p0") < 0.25, F.col("p1") > 0.6, 5, 6 * 3600, 4 * 3600)


@query("z5_confirmed_windows", f"WITH RECURSIVE {T2} SELECT symbol, epoch(ts)::BIGINT AS start_s, epoch(ts)::BIGINT + 14400 AS end_s FROM tk WHERE ts IS NOT NULL")
def z5(spark, sf):
    return confirmed(spark, sf).select("symbol", epoch("start").alias("start_s"), epoch("end").alias("end_s"))


@query(
    "l21_confirmed_events",
    f"""WITH RECURSIVE {T2}, e AS (SELECT symbol || '-' || CAST(epoch(ts)::BIGINT AS VARCHAR) AS id, symbol, ts + INTERVAL '1 hour' AS ts, 1 AS side FROM tk WHERE ts IS NOT NULL), {DL}, {exits('dl', 'ex', 3)}
SELECT ex.id, round(ln(entry / h.close), 6) AS gap, h.n AS ticks, outcome, round(rg, 5) AS r_gross FROM ex LEFT JOIN h ON h.symbol = ex.symbol AND h.ts = ex.ts - INTERVAL '1 hour'""",
)
def l21(spark, sf):
    """Events of confirmed windows at each delay: features of the bar before, and their own label."""
    h = hourly(spark, sf)
    c = confirmed(spark, sf).select(F.concat_ws("-", "symbol", epoch("start").cast("string")).alias("id"), "symbol", (F.col("start") + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.lit(1).alias("side"))
    d = delayed(c, h)
    bar = h.select("symbol", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.col("close").alias("before"), F.col("n").alias("ticks"))
    got = labels.exit_labels(d, h, "id", 3 * 3600, 3600).join(d, "id").join(bar, ["symbol", "ts"], "left")
    return got.select("id", rnd(F.ln(F.col("entry") / F.col("before"))).alias("gap"), "ticks", "outcome", rnd("r_gross", 5).alias("r_gross"))


@query(
    "l15_lifecycle",
    f"""WITH RECURSIVE {ONE}, {CONF}, a AS (SELECT symbol, ts, i FROM cf WHERE st = 1 AND age = 0), l AS (SELECT a.symbol, a.ts, q.ts AS at, row_number() OVER (PARTITION BY a.symbol, a.ts ORDER BY q.ts) - 1 AS k, q.p0 < 0.25 AS ok, q.p1 > 0.6 AS off FROM a JOIN q ON q.symbol = a.symbol AND q.ts >= a.ts),
s AS (SELECT symbol, ts, min(CASE WHEN k BETWEEN 1 AND 5 AND ok THEN k END) AS c, min(CASE WHEN k BETWEEN 1 AND 5 AND off THEN k END) AS o FROM l GROUP BY ALL)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, CASE WHEN o IS NOT NULL AND (c IS NULL OR o <= c) THEN 'cancelled' WHEN c IS NOT NULL THEN 'confirmed' ELSE 'expired' END AS fate, coalesce(least(c, o), 6)::BIGINT AS bars FROM s""",
)
def l15(spark, sf):
    got = opportunity.lifecycles(one(spark, sf), F.col("p2") >= 0.4, F.col("p0") < 0.25, F.col("p1") > 0.6, 5)
    return got.select("symbol", epoch().alias("ts_s"), "fate", "bars")


@query(
    "z6_fast_confirmation",
    f"""WITH {H}, {M5}, a AS (SELECT symbol, ts, close, ts + INTERVAL '1 hour' AS f FROM h WHERE close < open), p AS (SELECT a.*, m5.ts AS mts, m5.close AS mc, row_number() OVER (PARTITION BY a.symbol, a.ts ORDER BY m5.ts) - 1 AS k FROM a JOIN m5 ON m5.symbol = a.symbol AND m5.ts >= f AND m5.ts < f + INTERVAL '30 minutes'),
g AS (SELECT symbol, ts, min(CASE WHEN mc >= close * 1.001 THEN mts END) AS c, min(CASE WHEN mts <> f + k * INTERVAL '5 minutes' THEN f + k * INTERVAL '5 minutes' END) AS gap FROM p GROUP BY ALL)
SELECT symbol, epoch(ts)::BIGINT AS armed_s, epoch(c)::BIGINT AS confirmed_s FROM g WHERE c IS NOT NULL AND (gap IS NULL OR c < gap)""",
)
def z6(spark, sf):
    got = opportunity.fast_confirmed(hourly(spark, sf), fine(spark, sf), F.col("close") < F.col("open"), F.col("close"), 3600, 300, 1800, 10)
    return got.select("symbol", epoch("armed_ts").alias("armed_s"), epoch("confirmed_ts").alias("confirmed_s"))


@query("z7_majority_regime", f"WITH {CH} SELECT symbol, epoch(ts)::BIGINT AS ts_s, CASE WHEN slope_4 IS NOT NULL AND slope_6 IS NOT NULL AND slope_12 IS NOT NULL THEN sign(sign(slope_4) + sign(slope_6) + sign(slope_12))::INT END AS majority FROM ch")
def z7(spark, sf):
    got = context(spark, sf)
    return got.select("symbol", epoch().alias("ts_s"), F.signum(F.signum("slope_4") + F.signum("slope_6") + F.signum("slope_12")).cast("int").alias("majority"))


@query("z8_observation_episodes")
def z8(spark, sf):
    """Counts that start anew have no plain SQL; tests compare with a loop."""
    q = one(spark, sf).withColumns({"side": (F.col("pred") - 1).cast("int"), "fold": F.concat_ws("-", "symbol", F.date_trunc("week", "ts").cast("string"))})
    return opportunity.observation_episodes(q, 6, 2, 12).select("id", "episode")
