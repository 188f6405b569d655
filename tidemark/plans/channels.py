"""Queries on channels, their context, frames of features over bars, and windows as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features, gates, opportunity
from tidemark.plans.base import H, M5, epoch, fine, hourly, last, query, rnd

def hour():
    return F.expr("INTERVAL 1 HOUR")


def fits(n: int) -> str:
    """SQL columns of the channel of the last n hours."""
    w = last(n)
    return (
        f"count(l) OVER {w} AS k{n}, max(bad) OVER {w} AS c{n}, regr_slope(l, i) OVER {w} AS b{n}, regr_intercept(l, i) OVER {w} AS a{n}, regr_r2(l, i) OVER {w} AS r{n}, "
        f"regr_syy(l, i) OVER {w} AS y{n}, regr_sxy(l, i) OVER {w} AS x{n}"
    )


def outs(n: int) -> str:
    mid, sd = f"a{n} + b{n} * i", f"2 * sqrt(greatest(y{n} - b{n} * x{n}, 0) / {n - 1})"
    full = lambda c: f"CASE WHEN k{n} = {n} THEN {c} END"
    clean = lambda c: f"CASE WHEN k{n} = {n} AND c{n} = 0 THEN {c} END"
    return (
        f"{clean(f'b{n}')} AS slope_{n}, {clean(f'CASE WHEN y{n} > 0 THEN r{n} END')} AS r2_{n}, {full(mid)} AS mid_{n}, {full(f'{mid} + {sd}')} AS upper_{n}, {full(f'{mid} - {sd}')} AS lower_{n}"
    )


CH = f"""{H}, ci AS (SELECT *, ln(close) AS l, row_number() OVER w - 1 AS i, (coalesce(ts <> lag(ts) OVER w + INTERVAL '1 hour', true) OR n < 1)::INT AS bad FROM h WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
cf AS (SELECT *, {fits(4)}, {fits(6)}, {fits(12)} FROM ci), ch AS (SELECT symbol, ts, close, n, {outs(4)}, {outs(6)}, {outs(12)} FROM cf)"""
RGM = """rg AS (SELECT *, CASE WHEN slope_4 > 0.02 THEN 1 WHEN slope_4 < -0.02 THEN -1 ELSE 0 END AS regime,
  CASE WHEN slope_4 IS NOT NULL AND slope_6 IS NOT NULL AND slope_12 IS NOT NULL THEN CASE WHEN sign(slope_4) = sign(slope_6) AND sign(slope_6) = sign(slope_12) THEN sign(slope_4) ELSE 0 END::INT END AS agreement FROM ch),
rn AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY ts) AS run FROM (SELECT *, coalesce(regime <> lag(regime) OVER (PARTITION BY symbol ORDER BY ts), true)::INT AS nw FROM rg)),
cx AS (SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY ts) AS regime_age FROM rn)"""


def channels(spark, sf):
    return features.channels(hourly(spark, sf), (4, 6, 12), hour(), F.col("n") >= 1)


def context(spark, sf):
    return features.context(hourly(spark, sf), (4, 6, 12), hour(), 0.02, F.col("n") >= 1)


@query(
    "w9_contamination",
    f"WITH {CH} SELECT symbol, epoch(ts)::BIGINT AS ts_s, round(slope_12, 6) AS slope, round(r2_12, 6) AS r2, round(mid_12, 6) AS mid, round(upper_12, 6) AS upper, round(lower_12, 6) AS lower FROM ch",
)
def w9(spark, sf):
    return channels(spark, sf).select("symbol", epoch().alias("ts_s"), *[rnd(f"{c}_12").alias(c) for c in ("slope", "r2", "mid", "upper", "lower")])


@query(
    "w10_context",
    f"WITH {CH}, {RGM} SELECT symbol, epoch(ts)::BIGINT AS ts_s, round(slope_4, 6) AS slope_4, round(slope_6, 6) AS slope_6, round(slope_12, 6) AS slope_12, agreement, regime, regime_age FROM cx",
)
def w10(spark, sf):
    return context(spark, sf).select("symbol", epoch().alias("ts_s"), *[rnd(f"slope_{n}").alias(f"slope_{n}") for n in (4, 6, 12)], "agreement", "regime", "regime_age")


@query(
    "j6_projection",
    f"""WITH {CH}, {M5}, a AS (SELECT symbol, ts + INTERVAL '1 hour' AS av, slope_4, mid_4, upper_4, lower_4 FROM ch),
j AS (SELECT m5.symbol, m5.ts, (epoch(m5.ts) - epoch(av)) / 3600 AS age, slope_4 AS s, mid_4 AS m, upper_4 AS u, lower_4 AS lo FROM m5 ASOF LEFT JOIN a ON a.symbol = m5.symbol AND m5.ts >= a.av)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, CASE WHEN age <= 2 THEN round(exp(m + s * age), 5) END AS mid, CASE WHEN age <= 2 THEN round(exp(u + s * age), 5) END AS upper, CASE WHEN age <= 2 THEN round(exp(lo + s * age), 5) END AS lower FROM j""",
)
def j6(spark, sf):
    got = features.projected(channels(spark, sf), fine(spark, sf), 4, 3600, 120)
    return got.select("symbol", epoch().alias("ts_s"), *[rnd(c, 5).alias(c) for c in ("mid", "upper", "lower")])


RUNS = """rs AS (SELECT *, coalesce(ts <> lag(ts) OVER w + INTERVAL '1 hour', true)::INT AS gap, 2 * taker / volume - 1 AS im, ln(close / lag(close) OVER w) AS r FROM h WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, g ORDER BY ts) AS run_len FROM (SELECT *, sum(gap) OVER (PARTITION BY symbol ORDER BY ts) AS g FROM rs))"""


@query(
    "w11_bar_frame",
    f"""WITH {H}, {RUNS} SELECT symbol, epoch(ts)::BIGINT AS ts_s, CASE WHEN run_len >= 2 THEN round(r, 6) END AS ret, round((high - greatest(open, close)) / nullif(high - low, 0), 6) AS upper_wick, round((least(open, close) - low) / nullif(high - low, 0), 6) AS lower_wick,
  CASE WHEN run_len >= 4 THEN round(ln(volume / quantile_cont(volume, 0.5) OVER {last(4)}), 6) END AS surprise, CASE WHEN run_len >= 3 THEN round(avg(im) OVER {last(3)}, 6) END AS imbalance_mean,
  CASE WHEN run_len >= 2 THEN round(im - lag(im) OVER (PARTITION BY symbol ORDER BY ts), 6) END AS imbalance_delta, CASE WHEN run_len >= 4 THEN round(stddev_samp(r) OVER {last(3)}, 6) END AS vol FROM rk""",
)
def w11(spark, sf):
    got = features.bar_frame(hourly(spark, sf), hour(), 3, 3, 4)
    return got.select("symbol", epoch().alias("ts_s"), *[rnd(c).alias(c) for c in ("ret", "upper_wick", "lower_wick", "surprise", "imbalance_mean", "imbalance_delta", "vol")])


CMP = """cp AS (SELECT symbol, ts, slope_4, agreement, regime, (ln(close) - mid_4) / nullif((upper_4 - lower_4) / 2, 0) AS centre, least(abs(upper_4 - ln(close)), abs(ln(close) - lower_4)) / nullif((upper_4 - lower_4) / 2, 0) AS nearest FROM cx)"""


@query(
    "w28_compact",
    f"WITH {CH}, {RGM}, {CMP} SELECT symbol, epoch(ts)::BIGINT AS ts_s, round(centre, 5) AS centre, round(nearest, 5) AS nearest, round(lag(nearest) OVER (PARTITION BY symbol ORDER BY ts) - nearest, 5) AS approach FROM cp",
)
def w28(spark, sf):
    return features.compact(channels(spark, sf), 4).select("symbol", epoch().alias("ts_s"), *[rnd(c, 5).alias(c) for c in ("centre", "nearest", "approach")])


@query(
    "p2_regime_slices",
    f"WITH {CH}, {RGM}, {CMP} SELECT symbol, epoch(ts)::BIGINT AS ts_s, CASE WHEN centre < 0 THEN 'long' ELSE 'short' END AS slice FROM cp WHERE (regime = 1 AND centre <= -0.25) OR (regime = -1 AND centre >= 0.25)",
)
def p2(spark, sf):
    got = features.compact(context(spark, sf), 4)
    return opportunity.regime_slices(got, 0.25).select("symbol", epoch().alias("ts_s"), "slice")


@query(
    "p3_confluence",
    f"WITH {CH}, {RGM} SELECT symbol, epoch(ts)::BIGINT AS ts_s, CASE WHEN agreement = s THEN s ELSE 0 END AS signal FROM (SELECT *, sign(close - exp(mid_4))::INT AS s FROM cx WHERE agreement IS NOT NULL)",
)
def p3(spark, sf):
    got = context(spark, sf).where("agreement is not null").withColumn("s", F.signum(F.col("close") - F.exp("mid_4")).cast("int"))
    return gates.confluent(got, "s", "agreement").select("symbol", epoch().alias("ts_s"), F.col("s").alias("signal"))


@query(
    "w5_positioning",
    f"""WITH {H}, l AS (SELECT *, ln(volume + 1) AS v FROM h) SELECT symbol, epoch(ts)::BIGINT AS ts_s, round(v - lag(v, 4) OVER w, 6) AS oi_diff_4, round(v - lag(v, 16) OVER w, 6) AS oi_diff_16,
  CASE WHEN count(v) OVER {last(96)} = 96 THEN round((v - avg(v) OVER {last(96)}) / nullif(stddev_samp(v) OVER {last(96)}, 0), 6) END AS oi_z,
  CASE WHEN count(taker) OVER {last(672)} = 672 THEN round((taker - avg(taker) OVER {last(672)}) / nullif(stddev_samp(taker) OVER {last(672)}, 0), 6) END AS ratio_z FROM l WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
)
def w5(spark, sf):
    got = features.positioning_block(hourly(spark, sf), "volume", "taker")
    return got.select("symbol", epoch().alias("ts_s"), *[rnd(c).alias(c) for c in ("oi_diff_4", "oi_diff_16", "oi_z", "ratio_z")])


WINDOWS = f"{H}, wd AS (SELECT symbol || '-' || CAST(epoch(ts)::BIGINT AS VARCHAR) AS window_id, symbol, ts AS start, ts + INTERVAL '6 hours' AS \"end\", CASE WHEN close > open THEN 1 ELSE -1 END AS side FROM h WHERE n >= 4)"


def manifest(spark, sf):
    h = hourly(spark, sf).where("n >= 4")
    return h.select(
        F.concat_ws("-", "symbol", epoch().cast("string")).alias("window_id"), "symbol", F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("end"), F.when(F.col("close") > F.col("open"), 1).otherwise(-1).alias("side")
    )


@query(
    "w26_window_rows",
    f"""WITH {WINDOWS} SELECT window_id, epoch(h.ts)::BIGINT AS ts_s, row_number() OVER w AS place, h.ts >= wd.start AS in_window, round(side * ln(close / first_value(close) OVER w), 6) AS move
FROM wd JOIN h ON h.symbol = wd.symbol AND h.ts >= wd.start - INTERVAL '4 hours' AND h.ts < wd."end" WINDOW w AS (PARTITION BY window_id ORDER BY h.ts)""",
)
def w26(spark, sf):
    got = features.window_rows(manifest(spark, sf), hourly(spark, sf), 14400)
    return got.select("window_id", epoch().alias("ts_s"), "place", "in_window", rnd("move").alias("move"))


DAYS = "dy AS (SELECT symbol, date_trunc('day', ts) AS ts, arg_max(close, ts) AS close FROM h GROUP BY ALL)"


def daily(spark, sf):
    return hourly(spark, sf).groupBy("symbol", F.date_trunc("day", "ts").alias("ts")).agg(F.max_by("close", "ts").alias("close"))


MACRO = f"""{H}, {DAYS}, dm AS (SELECT *, CASE WHEN count(close) OVER {last(5)} = 5 THEN avg(close) OVER {last(5)} END AS m FROM dy),
ds AS (SELECT symbol, CAST(ts AS DATE) + 1 AS day, last_value(CASE WHEN close > m * 1.05 THEN 1 WHEN close < m * 0.95 THEN -1 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS state FROM dm)"""


@query("p13_macro_state", f"WITH {MACRO} SELECT symbol, CAST(day AS VARCHAR) AS day, state FROM ds")
def p13(spark, sf):
    return features.macro_state(daily(spark, sf), 5, 0.05).withColumn("day", F.col("day").cast("string"))


@query("p14_macro_mask", f"WITH {MACRO} SELECT h.symbol, epoch(h.ts)::BIGINT AS ts_s, CASE WHEN state = CASE WHEN close > open THEN 1 ELSE -1 END THEN round(abs(close - open), 6) END AS score FROM h LEFT JOIN ds ON ds.symbol = h.symbol AND ds.day = CAST(h.ts AS DATE)")
def p14(spark, sf):
    h = hourly(spark, sf).withColumns({"side": F.when(F.col("close") > F.col("open"), 1).otherwise(-1), "score": F.abs(F.col("close") - F.col("open")), "day": F.to_date("ts")})
    got = gates.macro_masked(h, features.macro_state(daily(spark, sf), 5, 0.05), "score")
    return got.select("symbol", epoch().alias("ts_s"), rnd("score").alias("score"))
