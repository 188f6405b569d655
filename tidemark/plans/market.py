"""Queries on bars, series, as-of joins and intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof, bars, features, intervals, series
from tidemark.plans.base import H, M5, QUERIES, SQL, T, epoch, fine, hourly, last, query, rnd, table, ticks  # noqa: F401

BAR = ["symbol", "open", "high", "low", "close", "volume"]


@query("k1_bars", f"WITH {H} SELECT symbol, epoch(ts)::BIGINT AS ts_s, open, high, low, close, volume, taker, n FROM h")
def k1(spark, sf):
    return hourly(spark, sf).select(*BAR, "taker", "n", epoch().alias("ts_s"))


@query(
    "k2_resample",
    f"""WITH {M5} SELECT symbol, epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS ts_s, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, ts) AS close, sum(volume) AS volume, count(close) AS minute_count, epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT + 3600 AS available_s,
  count(close) = 12 AS complete_bar FROM m5 GROUP BY symbol, time_bucket(INTERVAL '1 hour', ts)""",
)
def k2(spark, sf):
    got = bars.resample(fine(spark, sf), "1 hour", expected=12)
    return got.select(*BAR, "minute_count", "complete_bar", epoch().alias("ts_s"), epoch("available_at").alias("available_s"))


@query(
    "k3_midpoint",
    f"""WITH {M5}, p AS (SELECT a.symbol, a.ts, (a.open + b.open) / 2 AS o, (a.high + b.high) / 2 AS h, (a.low + b.low) / 2 AS l, (a.close + b.close) / 2 AS c,
  b.close - a.close AS spread FROM m5 a JOIN m5 b ON a.ts = b.ts AND a.symbol = 'view' AND b.symbol = 'click')
SELECT symbol, epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS ts_s, round(arg_min(o, ts), 6) AS open, round(max(greatest(o, h, l, c)), 6) AS high,
  round(min(least(o, h, l, c)), 6) AS low, round(arg_max(c, ts), 6) AS close, round(quantile_cont(spread, 0.5), 6) AS median_spread,
  count_if(spread < 0)::BIGINT AS crossed FROM p GROUP BY symbol, time_bucket(INTERVAL '1 hour', ts)""",
)
def k3(spark, sf):
    m = fine(spark, sf)
    ask = m.where("symbol = 'click'").withColumn("symbol", F.lit("view"))
    mid = bars.midpoint(m.where("symbol = 'view'"), ask)
    got = mid.groupBy("symbol", F.window("ts", "1 hour").alias("w")).agg(
        rnd(F.min_by("open", "ts")).alias("open"), rnd(F.max("high")).alias("high"), rnd(F.min("low")).alias("low"), rnd(F.max_by("close", "ts")).alias("close"),
        rnd(F.percentile("spread", 0.5)).alias("median_spread"), F.count_if(F.col("spread") < 0).alias("crossed"),
    )
    return got.withColumn("ts_s", epoch("w.start")).drop("w")


@query(
    "k5_intrabar",
    f"""WITH {M5}, r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r, 2 * taker / volume - 1 AS imbalance,
  time_bucket(INTERVAL '1 hour', ts) AS w, floor((epoch(ts) - epoch(time_bucket(INTERVAL '1 hour', ts))) / 60) AS mn FROM m5)
SELECT symbol, epoch(w)::BIGINT AS ts_s, round(sqrt(sum(r * r)), 6) AS realized_vol, round(ln(max(high) / min(low)), 6) AS range,
  round(abs(sum(r) / nullif(sum(abs(r)), 0)), 6) AS efficiency, round((arg_max(close, ts) - min(low)) / nullif(max(high) - min(low), 0), 6) AS close_location,
  round(sum(CASE WHEN mn >= 55 THEN r END), 6) AS last5_return, round(avg(imbalance), 6) AS ofi_mean, round(stddev_pop(imbalance), 6) AS ofi_std,
  round(sum(CASE WHEN mn >= 55 THEN volume ELSE 0 END) / nullif(sum(volume), 0), 6) AS late_share FROM r GROUP BY symbol, w""",
)
def k5(spark, sf):
    m = fine(spark, sf).withColumn("imbalance", 2 * F.col("taker") / F.col("volume") - 1)
    got = bars.intrabar(m, "1 hour", 60)
    return got.select("symbol", epoch().alias("ts_s"), *[rnd(c).alias(c) for c in got.columns if c not in ("symbol", "ts")])


@query(
    "k6_completeness",
    f"""WITH {M5}, g AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS w, count(*) AS n FROM m5 GROUP BY ALL)
SELECT symbol, count(*) AS groups, count_if(n = 3)::BIGINT AS complete FROM g GROUP BY symbol""",
)
def k6(spark, sf):
    return bars.completeness(fine(spark, sf), "1 hour", 3)


@query(
    "k7_backfill",
    f"""WITH {H}, d AS (SELECT symbol, CAST(ts AS DATE) AS day, arg_max(close, ts) AS close FROM h WHERE symbol <> 'view' OR ts >= '2024-01-10' GROUP BY ALL),
o AS (SELECT symbol, CAST(ts AS DATE) AS day, arg_min(open, ts) AS close FROM h GROUP BY ALL)
SELECT symbol, CAST(day AS VARCHAR) AS day, close FROM d UNION ALL SELECT symbol, CAST(day AS VARCHAR), close FROM o ANTI JOIN d USING (symbol, day)""",
)
def k7(spark, sf):
    h = hourly(spark, sf)
    older = h.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.min_by("open", "ts").alias("close"))
    newer = h.where("symbol <> 'view' or ts >= timestamp '2024-01-10'")
    return bars.backfill_daily(older, newer).withColumn("day", F.col("day").cast("string"))


@query(
    "k9_calendar",
    f"""WITH {H}, g AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL '1 hour')) AS ts FROM h GROUP BY symbol)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, coalesce(n, 0)::BIGINT AS n FROM g LEFT JOIN h USING (symbol, ts)""",
)
def k9(spark, sf):
    return bars.on_grid(hourly(spark, sf), "1 hour", ["n"]).select("symbol", epoch().alias("ts_s"), "n")


@query(
    "k10_run_lengths",
    f"""WITH {H}, g AS (SELECT symbol, ts, n >= 2 AS ok, coalesce(ts <> lag(ts) OVER w + INTERVAL '1 hour', true) AS gap FROM h WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
i AS (SELECT *, sum(CASE WHEN gap OR NOT ok OR NOT coalesce(lag(ok) OVER w, true) THEN 1 ELSE 0 END) OVER w AS run FROM g0
  WINDOW w AS (PARTITION BY symbol ORDER BY ts)), x AS (SELECT 1)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, gap, CASE WHEN ok THEN row_number() OVER (PARTITION BY symbol, run ORDER BY ts) ELSE 0 END AS run_len FROM i""".replace(
        "FROM g0", "FROM (SELECT *, lag(ok) OVER (PARTITION BY symbol ORDER BY ts) AS pok FROM g)"
    ).replace("coalesce(lag(ok) OVER w, true)", "coalesce(pok, true)").replace(", x AS (SELECT 1)", ""),
)
def k10(spark, sf):
    got = bars.run_lengths(hourly(spark, sf), F.expr("INTERVAL 1 HOUR"), F.col("n") >= 2)
    return got.select("symbol", epoch().alias("ts_s"), "gap", F.col("run_len").cast("long").alias("run_len"))


@query(
    "k11_cadence",
    f"""WITH {H}, d AS (SELECT symbol, (epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)))::BIGINT AS seconds FROM h),
c AS (SELECT symbol, seconds, count(*) AS n FROM d WHERE seconds > 0 GROUP BY ALL)
SELECT symbol, seconds FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, seconds) = 1""",
)
def k11(spark, sf):
    return bars.cadence(hourly(spark, sf))


@query(
    "s8_equal_grid",
    f"""WITH {H} SELECT epoch(ts)::BIGINT AS ts_s, side FROM (SELECT ts, 'a' AS side FROM h WHERE symbol = 'view' AND ts NOT IN (SELECT ts FROM h WHERE symbol = 'click')
  UNION ALL SELECT ts, 'b' FROM h WHERE symbol = 'click' AND ts NOT IN (SELECT ts FROM h WHERE symbol = 'view'))""",
)
def s8(spark, sf):
    h = hourly(spark, sf)
    b = h.where("symbol = 'click'").withColumn("symbol", F.lit("view"))
    return bars.unmatched(h.where("symbol = 'view'"), b).select(epoch().alias("ts_s"), "side")


def _feature(name: str, sql: str, make):
    """Register a feature block over hourly bars: every made column rounded, next to symbol and time."""

    def run(spark, sf):
        h = hourly(spark, sf)
        got = make(h)
        new = [c for c in got.columns if c not in h.columns]
        cols = [rnd(c).alias(c) if dict(got.dtypes)[c] == "double" else F.col(c) for c in new]
        return got.select("symbol", epoch().alias("ts_s"), *cols)

    QUERIES[name] = run
    SQL[name] = f"WITH {H}, " + sql


def full(agg: str, x: str, n: int) -> str:
    """SQL of a full-window aggregate: null unless n values are there."""
    return f"CASE WHEN count({x}) OVER {last(n)} = {n} THEN {agg}({x}) OVER {last(n)} END"


R1 = "r AS (SELECT *, ln(close / lag(close) OVER w) AS r1 FROM h WINDOW w AS (PARTITION BY symbol ORDER BY ts))"

_feature(
    "w1_returns",
    """x AS (SELECT symbol, epoch(ts)::BIGINT AS ts_s, round(ln(close / lag(close, 1) OVER w), 6) AS ret_1, round(ln(close / lag(close, 5) OVER w), 6) AS ret_5,
  round(ln(close / lag(close, 20) OVER w), 6) AS ret_20, round((high - low) / close, 6) AS hl_range, round((close - open) / open, 6) AS co_range,
  hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS weekday FROM h WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT * FROM x""",
    features.returns,
)
_feature(
    "w2_volatility",
    f"""{R1}, v AS (SELECT *, {full("stddev_samp", "r1", 10)} AS s10, {full("stddev_samp", "r1", 20)} AS s20, {full("stddev_samp", "r1", 60)} AS s60,
  {full("avg", "volume", 60)} AS vm, {full("stddev_samp", "volume", 60)} AS vs FROM r)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, round(s10, 6) AS vol_10, round(s20, 6) AS vol_20, round(s60, 6) AS vol_60, round((volume - vm) / nullif(vs, 0), 6) AS volume_z FROM v""",
    features.volatility,
)
_feature(
    "w4_order_flow",
    f"""o AS (SELECT *, 2 * taker / volume - 1 AS im FROM h), z AS (SELECT *, {full("avg", "im", 20)} AS m, {full("stddev_samp", "im", 20)} AS s, {full("avg", "im", 5)} AS m5,
  {full("avg", "n", 60)} AS nm, {full("stddev_samp", "n", 60)} AS ns FROM o)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, round(im, 6) AS imbalance, round((im - m) / nullif(s, 0), 6) AS imbalance_z, round(m5, 6) AS imbalance_mean,
  round((n - nm) / nullif(ns, 0), 6) AS trades_z FROM z""",
    features.order_flow,
)
_feature(
    "w6_stage",
    f"""{R1}, p AS (SELECT *, {full("stddev_samp", "r1", 16)} AS v, {full("sum", "abs(close - pc)", 16)} AS path, lag(close, 16) OVER w AS c16, lag(close, 4) OVER w AS c4
  FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM r) WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, epoch(ts)::BIGINT AS ts_s, round(close / c4 - 1, 6) AS change_4, round(close / c16 - 1, 6) AS change_16, round(abs(close - c16) / nullif(path, 0), 6) AS path_efficiency,
  round(v, 6) AS vol_16, round(close / {full("max", "high", 96)} - 1, 6) AS drawdown_96, round(close / {full("min", "low", 96)} - 1, 6) AS rebound_96 FROM p""",
    features.stage,
)
_feature(
    "w7_percent_rank",
    f"""c AS (SELECT *, list(close) OVER {last(24)} AS l FROM h)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, CASE WHEN len(l) = 24 THEN round((len(list_filter(l, lambda x: x < close)) + (len(list_filter(l, lambda x: x = close)) + 1) / 2.0) / 24, 6) END AS close_rank FROM c""",
    features.percent_rank,
)
_feature(
    "w8_channel",
    f"""n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM h),
f AS (SELECT *, count(close) OVER {last(30)} AS k, regr_slope(close, i) OVER {last(30)} AS b, regr_intercept(close, i) OVER {last(30)} AS a, regr_r2(close, i) OVER {last(30)} AS r2,
  regr_syy(close, i) OVER {last(30)} AS syy, regr_sxy(close, i) OVER {last(30)} AS sxy FROM n)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, CASE WHEN k = 30 THEN round(b, 6) END AS slope, CASE WHEN k = 30 THEN round(a + b * i, 6) END AS mid,
  CASE WHEN k = 30 AND syy > 0 THEN round(r2, 6) END AS r2, CASE WHEN k = 30 THEN round(sqrt(greatest(syy - b * sxy, 0) / 29), 6) END AS residual_sd FROM f""",
    lambda h: features.channel(h, 30),
)
_feature(
    "w12_drawdown",
    f"""{R1}, c AS (SELECT *, sum(coalesce(r1, 0)) OVER (PARTITION BY symbol ORDER BY ts) AS cum FROM r)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, round(cum, 6) AS equity, round(max(cum) OVER (PARTITION BY symbol ORDER BY ts), 6) AS peak,
  round(cum - max(cum) OVER (PARTITION BY symbol ORDER BY ts), 6) AS drawdown FROM c""",
    features.drawdown_curve,
)
_feature(
    "w13_positioning",
    f"""l AS (SELECT *, ln(volume + 1) AS v FROM h), d AS (SELECT *, v - lag(v, 1) OVER w AS d1, v - lag(v, 4) OVER w AS d4, v - lag(v, 16) OVER w AS d16 FROM l WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, epoch(ts)::BIGINT AS ts_s, round(d1, 6) AS oi_diff_1, round(d4, 6) AS oi_diff_4, round(d16, 6) AS oi_diff_16, round(d1 - lag(d1) OVER (PARTITION BY symbol ORDER BY ts), 6) AS oi_accel,
  round((v - {full("avg", "v", 96)}) / nullif({full("stddev_samp", "v", 96)}, 0), 6) AS oi_z FROM d""",
    features.positioning,
)
_feature(
    "w14_structural_stop",
    f"""SELECT0""".replace(
        "SELECT0",
        f"""g AS (SELECT *, coalesce(ts <> lag(ts) OVER w + INTERVAL '1 hour', true) AS gap FROM h WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
i AS (SELECT *, sum(gap::INT) OVER (PARTITION BY symbol ORDER BY ts) AS run FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY ts) AS run_len FROM i)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, CASE WHEN run_len >= 4 THEN round(min(low) OVER {last(4)} * 0.999, 6) END AS long_stop,
  CASE WHEN run_len >= 4 THEN round(max(high) OVER {last(4)} * 1.001, 6) END AS short_stop FROM k""",
    ),
    lambda h: features.structural_stop(h, 4, 0.001),
)
_feature(
    "w15_activity",
    f"""g AS (SELECT *, CASE WHEN ts = lag(ts) OVER w + INTERVAL '1 hour' THEN ln(close / lag(close) OVER w) END AS gr FROM h WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, epoch(ts)::BIGINT AS ts_s, CASE WHEN count(gr) OVER {last(12)} >= 6 AND count(gr) OVER {last(96)} >= 48 THEN
  round(stddev_samp(gr) OVER {last(12)} / nullif(stddev_samp(gr) OVER {last(96)}, 0), 6) END AS activity_ratio FROM g""",
    features.activity,
)
_feature(
    "w16_regime",
    f"""n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM h), f AS (SELECT *, CASE WHEN count(close) OVER {last(12)} = 12 THEN regr_slope(close, i) OVER {last(12)} END AS b FROM n),
s AS (SELECT *, CASE WHEN b > 0.5 THEN 'up' WHEN b < -0.5 THEN 'down' ELSE 'flat' END AS raw FROM f), c AS (SELECT *, coalesce(raw <> lag(raw) OVER (PARTITION BY symbol ORDER BY ts), true) AS new FROM s),
i AS (SELECT *, sum(new::INT) OVER (PARTITION BY symbol ORDER BY ts)::BIGINT AS episode FROM c)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, raw, episode, CASE WHEN row_number() OVER (PARTITION BY symbol, episode ORDER BY ts) >= 2 THEN raw ELSE 'flat' END AS regime FROM i""",
    lambda h: features.regime(h, 12, 0.5, 2),
)
_feature(
    "w17_event_counts",
    """g AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL '1 hour')) AS ts FROM h GROUP BY symbol),
c AS (SELECT symbol, ts, coalesce(n, 0) AS n, coalesce(taker, 0) AS s FROM g LEFT JOIN h USING (symbol, ts)),
x AS (SELECT *, sum(n) OVER a AS n6, sum(n) OVER b AS n24, sum(s) OVER b AS s24 FROM c WINDOW a AS (PARTITION BY symbol ORDER BY ts ROWS 5 PRECEDING), b AS (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING))
SELECT symbol, epoch(ts)::BIGINT AS ts_s, n6::BIGINT AS count_6, n24::BIGINT AS count_24, round(coalesce(s24 / nullif(n24, 0), 0), 6) AS mean_24 FROM x""",
    features.event_counts,
)
_feature(
    "w20_semivariance",
    f"""{R1} SELECT symbol, epoch(ts)::BIGINT AS ts_s, round(sqrt(sum(CASE WHEN r1 < 0 THEN r1 * r1 ELSE 0 END) OVER {last(24)} / 24), 6) AS downside_24,
  round(sqrt(sum(r1 * r1) OVER {last(24)}), 6) AS realized_24, round((close - min(low) OVER {last(24)}) / nullif(max(high) OVER {last(24)} - min(low) OVER {last(24)}, 0), 6) AS donchian_24 FROM r""",
    features.semivariance,
)
_feature(
    "w25_candles",
    f"""p AS (SELECT *, (high - greatest(open, close)) / nullif(high - low, 0) AS uw, (least(open, close) - low) / nullif(high - low, 0) AS lw FROM h)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, count_if(close > open) OVER {last(3)}::BIGINT AS up_3, count_if(close < open) OVER {last(3)}::BIGINT AS down_3,
  round(avg(uw) OVER {last(3)}, 6) AS upper_rejection, round(avg(lw) OVER {last(3)}, 6) AS lower_rejection, round(volume / quantile_cont(volume, 0.5) OVER {last(12)}, 6) AS volume_vs_median FROM p""",
    features.candles,
)
_feature(
    "w31_reversals",
    """p AS (SELECT *, lag(open) OVER w AS po, lag(close) OVER w AS pc FROM h WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, epoch(ts)::BIGINT AS ts_s, coalesce((least(open, close) - low > 2 * abs(close - open) AND high - greatest(open, close) < abs(close - open)) OR (pc < po AND close > open AND close >= po AND open <= pc), false) AS bull,
  coalesce((high - greatest(open, close) > 2 * abs(close - open) AND least(open, close) - low < abs(close - open)) OR (pc > po AND close < open AND close <= po AND open >= pc), false) AS bear FROM p""",
    features.reversals,
)


@query(
    "w3_rsi",
    f"""WITH RECURSIVE {H}, d AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, coalesce(greatest(close - lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0), 0) AS g,
  coalesce(greatest(lag(close) OVER (PARTITION BY symbol ORDER BY ts) - close, 0), 0) AS l FROM h),
e AS (SELECT symbol, ts, i, CAST(g AS DOUBLE) AS eg, CAST(l AS DOUBLE) AS el FROM d WHERE i = 1
  UNION ALL SELECT d.symbol, d.ts, d.i, e.eg * 13 / 14 + d.g / 14, e.el * 13 / 14 + d.l / 14 FROM e JOIN d ON d.symbol = e.symbol AND d.i = e.i + 1)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, round(CASE WHEN el = 0 AND eg = 0 THEN 50 WHEN el = 0 THEN 100 ELSE 100 - 100 / (1 + eg / el) END, 4) AS rsi FROM e""",
)
def w3(spark, sf):
    return features.rsi(hourly(spark, sf), 14).select("symbol", epoch().alias("ts_s"), rnd("rsi", 4).alias("rsi"))


@query(
    "w18_decayed_mean",
    f"""WITH RECURSIVE {H}, d AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, volume AS w, volume * close AS wx FROM h),
e AS (SELECT symbol, ts, i, w AS ew, wx AS ex FROM d WHERE i = 1 UNION ALL SELECT d.symbol, d.ts, d.i, e.ew * 0.9 + d.w * 0.1, e.ex * 0.9 + d.wx * 0.1 FROM e JOIN d ON d.symbol = e.symbol AND d.i = e.i + 1)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, round(CASE WHEN ew > 1e-12 THEN ex / ew ELSE 0 END, 4) AS mean FROM e""",
)
def w18(spark, sf):
    h = hourly(spark, sf).withColumn("wx", F.col("volume") * F.col("close"))
    return features.decayed_mean(h, "wx", "volume", 0.1).select("symbol", epoch().alias("ts_s"), rnd("mean", 4).alias("mean"))


@query(
    "w32_signal_runs",
    f"""WITH {H}, s AS (SELECT *, sign(close - open)::INT AS side FROM h WHERE close <> open), c AS (SELECT *, coalesce(side <> lag(side) OVER (PARTITION BY symbol ORDER BY ts), true)::INT AS new FROM s),
i AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts)::BIGINT AS episode FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, episode ORDER BY ts) AS bar FROM i)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, side, episode, bar, CASE WHEN bar = 1 THEN 'FIRST' WHEN bar = 2 THEN 'SECOND' ELSE 'THIRD_PLUS' END AS bucket FROM k""",
)
def w32(spark, sf):
    s = hourly(spark, sf).where("close <> open").withColumn("side", F.signum(F.col("close") - F.col("open")).cast("int"))
    got = features.signal_runs(s)
    return got.select("symbol", epoch().alias("ts_s"), "side", "episode", F.col("bar").cast("long").alias("bar"), "bucket")


SLOW = """s AS (SELECT 'x' AS k, time_bucket(INTERVAL '3 hours', ts) + INTERVAL '3 hours' AS available_at, avg(value) AS level FROM events WHERE event_type = 'signup' GROUP BY ALL)"""


def slow(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'signup'").withColumn("ts", F.col("ts").cast("timestamp"))
    w = F.window("ts", "3 hours")
    got = e.groupBy(w.alias("w")).agg(F.avg("value").alias("level"))
    return got.select(F.col("w.end").alias("available_at"), "level")


def _per_symbol(h, r):
    return r.crossJoin(h.select("symbol").distinct())  # the slow series for each symbol


@query(
    "j1_asof",
    f"""WITH {H}, {SLOW} SELECT symbol, epoch(h.ts)::BIGINT AS ts_s, round(level, 6) AS level, round((epoch(h.ts) - epoch(available_at)) / 60, 4) AS age_min,
  coalesce((epoch(h.ts) - epoch(available_at)) / 60 > 60, true) AS stale FROM h ASOF LEFT JOIN s ON h.ts >= s.available_at""",
)
def j1(spark, sf):
    h = hourly(spark, sf)
    got = asof.with_age(asof.backward(h, _per_symbol(h, slow(spark, sf)), ["level"]), 60)
    return got.select("symbol", epoch().alias("ts_s"), rnd("level").alias("level"), rnd("age_min", 4).alias("age_min"), "stale")


@query(
    "j8_asof_strict",
    f"""WITH {H}, {SLOW} SELECT symbol, epoch(h.ts)::BIGINT AS ts_s, round(level, 6) AS level FROM h ASOF LEFT JOIN s ON h.ts > s.available_at""",
)
def j8(spark, sf):
    h = hourly(spark, sf)
    got = asof.backward(h, _per_symbol(h, slow(spark, sf)), ["level"], strict=True)
    return got.select("symbol", epoch().alias("ts_s"), rnd("level").alias("level"))


@query(
    "j21_stale_mask",
    f"""WITH {H}, {SLOW} SELECT symbol, epoch(h.ts)::BIGINT AS ts_s, CASE WHEN (epoch(h.ts) - epoch(available_at)) / 60 < 120 THEN round(level, 6) END AS level
FROM h ASOF LEFT JOIN s ON h.ts >= s.available_at""",
)
def j21(spark, sf):
    h = hourly(spark, sf)
    got = asof.mask_stale(asof.with_age(asof.backward(h, _per_symbol(h, slow(spark, sf)), ["level"]), 60), ["level"], 120)
    return got.select("symbol", epoch().alias("ts_s"), rnd("level").alias("level"))


CTX = f"""{H}, {SLOW}, cx AS (SELECT symbol, ts + INTERVAL '1 hour' AS bar_at, close AS last_close, volume AS last_volume FROM h),
dx AS (SELECT symbol, date_trunc('day', ts) + INTERVAL '1 day' AS day_at, arg_max(close, ts) AS day_close FROM h GROUP BY ALL)"""


@query(
    "j5_contexts",
    f"""WITH {CTX} SELECT h.symbol, epoch(h.ts)::BIGINT AS ts_s, epoch(bar_at)::BIGINT AS bar_s, round(last_close, 6) AS last_close, last_volume, epoch(day_at)::BIGINT AS day_s, round(day_close, 6) AS day_close,
  epoch(s.available_at)::BIGINT AS slow_s, round(level, 6) AS level FROM h ASOF LEFT JOIN cx ON cx.symbol = h.symbol AND h.ts >= cx.bar_at ASOF LEFT JOIN dx ON dx.symbol = h.symbol AND h.ts >= dx.day_at
  ASOF LEFT JOIN s ON h.ts > s.available_at""",
)
def j5(spark, sf):
    """The last bar, the day before and a slow series of no symbol, in one pass; the slow one strictly before."""
    h = hourly(spark, sf)
    bars = h.select("symbol", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("available_at"), F.col("close").alias("last_close"), F.col("volume").alias("last_volume"))
    days = h.groupBy("symbol", F.date_trunc("day", "ts").alias("d")).agg(F.max_by("close", "ts").alias("day_close")).withColumn("available_at", F.col("d") + F.expr("INTERVAL 1 DAY"))
    got = asof.contexts(h, {"bar": asof.Context(bars, ["last_close", "last_volume"]), "day": asof.Context(days, ["day_close"]), "slow": asof.Context(slow(spark, sf), ["level"], strict=True, keyed=False)})
    return got.select(
        "symbol", epoch().alias("ts_s"), epoch("bar_at").alias("bar_s"), rnd("last_close").alias("last_close"), "last_volume", epoch("day_at").alias("day_s"), rnd("day_close").alias("day_close"),
        epoch("slow_at").alias("slow_s"), rnd("level").alias("level"),
    )


TRADES = "tr AS (SELECT symbol, event_id AS id, ts AS start, ts + (event_id % 7 + 1) * INTERVAL '20 minutes' AS \"end\", price FROM t)"


def trades(spark, sf):
    t = ticks(spark, sf)
    span = F.make_dt_interval(mins=((F.col("event_id") % 7 + 1) * 20).cast("int"))
    return t.select("symbol", F.col("event_id").alias("id"), F.col("ts").alias("start"), (F.col("ts") + span).alias("end"), "price")


@query(
    "j14_inside_any",
    f"""WITH {H}, {T}, {TRADES}, m AS (SELECT symbol, ts, max("end") AS top FROM (SELECT h.symbol, h.ts, tr."end" FROM h LEFT JOIN tr ON tr.symbol = h.symbol AND tr.start <= h.ts) GROUP BY ALL)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, coalesce(top >= ts, false) AS inside FROM m""",
)
def j14(spark, sf):
    return intervals.inside_any(hourly(spark, sf), trades(spark, sf)).select("symbol", epoch().alias("ts_s"), "inside")


@query(
    "j15_overlap_anti",
    f"""WITH {T}, {TRADES}, a AS (SELECT * FROM tr WHERE price < 250), b AS (SELECT * FROM tr WHERE price >= 250)
SELECT id, symbol FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.symbol = a.symbol AND a.start <= b."end" AND a."end" >= b.start)""",
)
def j15(spark, sf):
    t = trades(spark, sf)
    return intervals.without_overlap(t.where("price < 250"), t.where("price >= 250"), "id").select("id", "symbol")


@query(
    "j16_window_bars",
    f"""WITH {T}, {TRADES}, {M5} SELECT id, tr.symbol, epoch(m5.ts)::BIGINT AS ts_s, close FROM tr JOIN m5 ON m5.symbol = tr.symbol AND m5.ts >= tr.start AND m5.ts < tr."end" """,
)
def j16(spark, sf):
    got = intervals.range_join(trades(spark, sf), fine(spark, sf).select("symbol", "ts", "close"), "start", "end")
    return got.select("id", "symbol", epoch().alias("ts_s"), "close")


@query(
    "j17_trade_marks",
    f"""WITH {T}, {TRADES}, {M5}, m AS (SELECT id, tr.symbol, m5.ts, close, price FROM tr JOIN m5 ON m5.symbol = tr.symbol AND m5.ts >= tr.start AND m5.ts <= tr."end"),
r AS (SELECT symbol, ts, ln(close / coalesce(lag(close) OVER (PARTITION BY id ORDER BY ts), price)) AS r FROM m)
SELECT symbol, epoch(ts)::BIGINT AS ts_s, round(sum(r), 6) AS ret, count(*) AS open_trades FROM r GROUP BY ALL""",
)
def j17(spark, sf):
    return intervals.marked(trades(spark, sf), fine(spark, sf), 300).select("symbol", epoch().alias("ts_s"), rnd("ret").alias("ret"), "open_trades")


@query(
    "y20_non_overlap",
    f"""WITH RECURSIVE {T}, {TRADES}, f AS (SELECT symbol, id, start, "end" FROM tr QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY start, id) = 1),
g AS (SELECT * FROM f UNION ALL SELECT n.symbol, n.id, n.start, n."end" FROM g, LATERAL (SELECT * FROM tr WHERE tr.symbol = g.symbol AND tr.start > g."end" ORDER BY start, id LIMIT 1) n)
SELECT tr.id, g.id IS NOT NULL AS accepted FROM tr LEFT JOIN g ON g.id = tr.id""",
)
def y20(spark, sf):
    return intervals.greedy(trades(spark, sf), "id")


@query(
    "y34_concurrency",
    f"""WITH {T}, {TRADES}, e AS (SELECT symbol, start AS ts, 1 AS d FROM tr UNION ALL SELECT symbol, "end", -1 FROM tr), s AS (SELECT symbol, ts, sum(d) AS d FROM e GROUP BY ALL)
SELECT symbol, epoch_us(ts) AS ts_us, sum(d) OVER (PARTITION BY symbol ORDER BY ts)::BIGINT AS active FROM s""",
)
def y34(spark, sf):
    return intervals.concurrency(trades(spark, sf)).select("symbol", F.unix_micros("ts").alias("ts_us"), "active")


@query(
    "v7_uniqueness",
    f"""WITH {T}, {TRADES}, u AS (SELECT symbol, id, time_bucket(INTERVAL '10 minutes', start) AS a, time_bucket(INTERVAL '10 minutes', "end") AS b FROM tr),
k AS (SELECT u.id, u.symbol, unnest(generate_series(a, b - INTERVAL '10 minutes', INTERVAL '10 minutes')) AS m FROM u), c AS (SELECT symbol, m, count(*) AS n FROM k GROUP BY ALL)
SELECT id, round(avg(1.0 / n), 6) AS uniqueness FROM k JOIN c USING (symbol, m) GROUP BY id""",
)
def v7(spark, sf):
    floor = lambda c: F.timestamp_seconds(F.floor(epoch(c) / 600) * 600).alias(c)
    t = trades(spark, sf).select("symbol", "id", floor("start"), floor("end"))
    return intervals.uniqueness(t, "id").select("id", rnd("uniqueness").alias("uniqueness"))
