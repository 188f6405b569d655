"""Feature blocks over bars: returns, volatility, order flow, channels, regimes, candles, decayed means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import backward, with_age
from tidemark.operators.bars import run_lengths
from tidemark.operators.intervals import range_join
from tidemark.operators.series import calendar, ewm, islands, numbered, previous, rolling, running
from tidemark.sources import scratch


def _ret(f, n=1):
    return F.ln(F.col("close") / F.lag("close", n).over(f.order))


def _z(f, x, n):
    return (F.col(x) - f.full(F.avg(x), x, n)) / F.nullif(f.full(F.stddev_samp(x), x, n), F.lit(0.0))


def returns(bars: DataFrame) -> DataFrame:
    """Log returns over 1, 5 and 20 bars, ranges, hour and weekday (Monday 0)."""
    c = F.col("close")
    plain = {"hl_range": (F.col("high") - F.col("low")) / c, "co_range": (c - F.col("open")) / F.col("open"), "hour": F.hour("ts"), "weekday": F.weekday("ts")}
    return rolling(bars.withColumns(plain), 20, lambda f: {f"ret_{n}": _ret(f, n) for n in (1, 5, 20)})


def volatility(bars: DataFrame) -> DataFrame:
    """Standard deviations of returns over 10, 20 and 60 bars and the volume's z-score, full windows only."""
    got = rolling(
        bars, 61, lambda f: {"_r": _ret(f)},
        lambda f: {f"vol_{n}": f.full(F.stddev_samp("_r"), "_r", n) for n in (10, 20, 60)} | {"volume_z": _z(f, "volume", 60)},
    )
    return got.drop("_r")


def order_flow(bars: DataFrame) -> DataFrame:
    """Taker imbalance, its z-score and short mean, and the z-score of the trade count."""
    x = bars.withColumn("imbalance", 2 * F.col("taker") / F.col("volume") - 1)
    return rolling(
        x, 60, lambda f: {"imbalance_z": _z(f, "imbalance", 20), "imbalance_mean": f.full(F.avg("imbalance"), "imbalance", 5), "trades_z": _z(f, "n", 60)}
    )


def stage(bars: DataFrame) -> DataFrame:
    """Where the market stands: changes, path efficiency, volatility, distance from the 96-bar high and low."""
    def first(f):
        return {"_r": _ret(f), "_step": F.abs(F.col("close") - F.lag("close").over(f.order)), "_c16": F.lag("close", 16).over(f.order), "_c4": F.lag("close", 4).over(f.order)}

    def then(f):
        c = F.col("close")
        return {
            "change_4": c / F.col("_c4") - 1, "change_16": c / F.col("_c16") - 1,
            "path_efficiency": F.abs(c - F.col("_c16")) / F.nullif(f.full(F.sum("_step"), "_step", 16), F.lit(0.0)), "vol_16": f.full(F.stddev_samp("_r"), "_r", 16),
            "drawdown_96": c / f.full(F.max("high"), "high", 96) - 1, "rebound_96": c / f.full(F.min("low"), "low", 96) - 1,
        }

    return rolling(bars, 113, first, then).drop("_r", "_step", "_c16", "_c4")


def percent_rank(bars: DataFrame, n: int = 24) -> DataFrame:
    """Rank of the close among the last n, ties averaged, as a share."""
    def rank(f):
        l, c = F.collect_list("close").over(f.over(n)), F.col("close")
        less = F.size(F.filter(l, lambda x: x < c))
        same = F.size(F.filter(l, lambda x: x == c))
        return {"close_rank": F.when(F.size(l) == n, (less + (same + 1) / 2) / n)}

    return rolling(bars, n, rank)


def channel(bars: DataFrame, n: int = 30) -> DataFrame:
    """Regression line of the last n closes: slope a bar, value at the bar, R squared, residual deviation (n-1)."""
    rows = numbered(bars, name="_i").withColumn("_i", F.col("_i").cast("double"))

    def fit(f):
        w = f.over(n)
        return {"_k": F.count("close").over(w), "_b": F.regr_slope("close", "_i").over(w), "_a": F.regr_intercept("close", "_i").over(w), "_r2": F.regr_r2("close", "_i").over(w), "_syy": F.regr_syy("close", "_i").over(w), "_sxy": F.regr_sxy("close", "_i").over(w)}

    got = rolling(rows, n, fit)
    full = lambda c: F.when(F.col("_k") == n, c)
    return got.withColumns(
        {
            "slope": full(F.col("_b")), "mid": full(F.col("_a") + F.col("_b") * F.col("_i")), "r2": full(F.when(F.col("_syy") > 0, F.col("_r2"))),
            "residual_sd": full(F.sqrt(F.greatest(F.col("_syy") - F.col("_b") * F.col("_sxy"), F.lit(0.0)) / (n - 1))),
        }
    ).drop("_i", "_k", "_b", "_a", "_r2", "_syy", "_sxy")


def drawdown_curve(bars: DataFrame) -> DataFrame:
    """Cumulative return, its peak so far and the distance from it."""
    got = rolling(bars, 2, lambda f: {"_r": F.coalesce(_ret(f), F.lit(0.0))})
    got = running(running(got, {"equity": ("sum", "_r")}), {"peak": ("max", "equity")})
    return got.withColumn("drawdown", F.col("equity") - F.col("peak")).drop("_r")


def positioning(bars: DataFrame, col: str = "volume") -> DataFrame:
    """Log changes of an open-interest-like level over 1, 4 and 16 rows, acceleration and z-score over 96."""
    x = bars.withColumn("_v", F.ln(F.col(col) + 1))
    d = lambda f, k: F.col("_v") - F.lag("_v", k).over(f.order)
    return rolling(
        x, 98, lambda f: {f"oi_diff_{k}": d(f, k) for k in (1, 4, 16)}, lambda f: {"oi_accel": F.col("oi_diff_1") - F.lag("oi_diff_1").over(f.order), "oi_z": _z(f, "_v", 96)}
    ).drop("_v")


def positioning_block(bars: DataFrame, level: str, ratio: str) -> DataFrame:
    """Log changes of a level over 4 and 16 rows, its z-score over 96, and that of a ratio over 672."""
    d = lambda f, k: F.col("_v") - F.lag("_v", k).over(f.order)
    x = bars.withColumn("_v", F.ln(F.col(level) + 1))
    return rolling(x, 672, lambda f: {"oi_diff_4": d(f, 4), "oi_diff_16": d(f, 16), "oi_z": _z(f, "_v", 96), "ratio_z": _z(f, ratio, 672)}).drop("_v")


def structural_stop(bars: DataFrame, n: int = 12, buffer: float = 0.001) -> DataFrame:
    """Lowest low and highest high of the last n bars beyond a buffer, null unless those bars are without a gap."""
    rows = run_lengths(bars, F.expr("INTERVAL 1 HOUR"))
    ok = F.col("run_len") >= n
    got = rolling(
        rows, n, lambda f: {"long_stop": F.when(ok, F.min("low").over(f.over(n)) * (1 - buffer)), "short_stop": F.when(ok, F.max("high").over(f.over(n)) * (1 + buffer))}
    )
    return got.drop("gap", "run_len")


def activity(bars: DataFrame, short: int = 12, long: int = 96) -> DataFrame:
    """Ratio of short to long deviation of returns between neighbouring bars; half of each window has to be there."""
    def r(f):
        near = F.col("ts") == F.lag("ts").over(f.order) + F.expr("INTERVAL 1 HOUR")
        return {"_r": F.when(near, _ret(f))}

    def ratio(f):
        a, b = f.over(short), f.over(long)
        ok = (F.count("_r").over(a) >= short // 2) & (F.count("_r").over(b) >= long // 2)
        return {"activity_ratio": F.when(ok, F.stddev_samp("_r").over(a) / F.nullif(F.stddev_samp("_r").over(b), F.lit(0.0)))}

    return rolling(bars, long + 1, r, ratio).drop("_r")


def regime(bars: DataFrame, n: int, slope: float, persist: int) -> DataFrame:
    """Direction of the channel, its episode, and the direction once it has lasted ``persist`` bars."""
    got = channel(bars, n)
    raw = F.when(F.col("slope") > slope, "up").when(F.col("slope") < -slope, "down").otherwise("flat")
    got = got.withColumn("raw", raw).drop("slope", "mid", "r2", "residual_sd")
    got = previous(got, {"_b": "raw"})
    got = islands(got, F.coalesce(F.col("raw") != F.col("_b"), F.lit(True)), "episode", place="_n")
    return got.withColumn("regime", F.when(F.col("_n") >= persist, F.col("raw")).otherwise("flat")).drop("_b", "_n")


def event_counts(bars: DataFrame) -> DataFrame:
    """Event counts of the last 6 and 24 grid hours and the mean of the last 24, zero where nothing was."""
    g = calendar(bars, "1 hour").join(bars, ["symbol", "ts"], "left").withColumns({"_n": F.coalesce("n", F.lit(0)), "_s": F.coalesce("taker", F.lit(0.0))})
    n24 = lambda f: F.sum("_n").over(f.over(24))
    got = rolling(
        g, 24,
        lambda f: {"count_6": F.sum("_n").over(f.over(6)), "count_24": n24(f), "mean_24": F.coalesce(F.sum("_s").over(f.over(24)) / F.nullif(n24(f), F.lit(0)), F.lit(0.0))},
    )
    return got.drop("_n", "_s")


def semivariance(bars: DataFrame, n: int = 24) -> DataFrame:
    """Downside deviation, realised volatility and place in the high-low range over n bars."""
    def then(f):
        w, r = f.over(n), F.col("_r")
        low, high = F.min("low").over(w), F.max("high").over(w)
        down = F.sum(F.when(r < 0, r * r).otherwise(0.0)).over(w)
        return {f"downside_{n}": F.sqrt(down / n), f"realized_{n}": F.sqrt(F.sum(r * r).over(w)), f"donchian_{n}": (F.col("close") - low) / F.nullif(high - low, F.lit(0.0))}

    return rolling(bars, n + 1, lambda f: {"_r": _ret(f)}, then).drop("_r")


def candles(bars: DataFrame) -> DataFrame:
    """Up and down bars and mean wicks of the last three, volume against the median of twelve."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    size = F.nullif(h - l, F.lit(0.0))
    x = bars.withColumns({"_u": (h - F.greatest(o, c)) / size, "_d": (F.least(o, c) - l) / size})

    def then(f):
        w = f.over(3)
        return {
            "up_3": F.count_if(c > o).over(w), "down_3": F.count_if(c < o).over(w), "upper_rejection": F.avg("_u").over(w), "lower_rejection": F.avg("_d").over(w),
            "volume_vs_median": F.col("volume") / F.percentile("volume", 0.5).over(f.over(12)),
        }

    return rolling(x, 12, then).drop("_u", "_d")


def reversals(bars: DataFrame) -> DataFrame:
    """Hammer or engulfing bars, each side."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    body, up, down = F.abs(c - o), h - F.greatest(o, c), F.least(o, c) - l

    def then(f):
        po, pc = F.lag("open").over(f.order), F.lag("close").over(f.order)
        bull = ((down > 2 * body) & (up < body)) | ((pc < po) & (c > o) & (c >= po) & (o <= pc))
        bear = ((up > 2 * body) & (down < body)) | ((pc > po) & (c < o) & (c <= po) & (o >= pc))
        return {"bull": F.coalesce(bull, F.lit(False)), "bear": F.coalesce(bear, F.lit(False))}

    return rolling(bars, 2, then)


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's index from decayed gains and losses: 100 without loss, 50 without either."""
    d = rolling(bars, 2, lambda f: {"_d": F.coalesce(F.col("close") - F.lag("close").over(f.order), F.lit(0.0))})
    d = d.withColumns({"_g": F.greatest("_d", F.lit(0.0)), "_l": F.greatest(-F.col("_d"), F.lit(0.0))})
    d = ewm(d, {"_eg": "_g", "_el": "_l"}, 1 / n)
    flat = F.when((F.col("_el") == 0) & (F.col("_eg") == 0), 50.0).when(F.col("_el") == 0, 100.0)
    return d.withColumn("rsi", flat.otherwise(100 - 100 / (1 + F.col("_eg") / F.nullif(F.col("_el"), F.lit(0.0))))).drop("_d", "_g", "_l", "_eg", "_el")


def decayed_mean(rows: DataFrame, weighted: str, weight: str, alpha: float, name: str = "mean") -> DataFrame:
    """Decayed sum of weighted values over the decayed weights; 0 where the weights have faded."""
    got = ewm(rows, {"_x": weighted, "_w": weight}, alpha)
    return got.withColumn(name, F.when(F.col("_w") > 1e-12, F.col("_x") / F.col("_w")).otherwise(0.0)).drop("_x", "_w")


def signal_runs(signals: DataFrame, side: str = "side") -> DataFrame:
    """Episode of same-side signals, number in it, and FIRST, SECOND or THIRD_PLUS."""
    got = previous(signals, {"_b": side})
    got = islands(got, F.coalesce(F.col(side) != F.col("_b"), F.lit(True)), "episode", place="bar").drop("_b")
    return got.withColumn("bucket", F.when(F.col("bar") == 1, "FIRST").when(F.col("bar") == 2, "SECOND").otherwise("THIRD_PLUS"))


def channels(bars: DataFrame, windows: tuple[int, ...], step: Column, complete: Column | None = None, width: float = 2.0) -> DataFrame:
    """Regression lines of the log close over several windows, in one pass: for each n ``slope_n`` a bar, ``mid_n`` at the
    bar, ``r2_n`` and the rails ``upper_n`` and ``lower_n``, ``width`` residual deviations away.

    Slope and R squared are null where a bar of the window isn't ``complete`` or doesn't follow the one before by ``step``;
    the line and rails stay.
    """
    rows = bars.withColumns({"_l": F.ln("close"), "_ok": F.lit(True) if complete is None else complete})

    def marked(f):
        far = F.coalesce(F.col("ts") != F.lag("ts").over(f.order) + step, F.lit(True))
        return {"_bad": (~F.col("_ok") | far).cast("int"), "_i": F.col("_row").cast("double")}  # the row's number in its series

    names = {"a": F.regr_intercept, "b": F.regr_slope, "r": F.regr_r2, "y": F.regr_syy, "x": F.regr_sxy}

    def fit(f):
        w = {n: f.over(n) for n in windows}
        got = {f"_{k}_{n}": fn("_l", "_i").over(w[n]) for n in windows for k, fn in names.items()}
        return got | {f"_k_{n}": F.count("_l").over(w[n]) for n in windows} | {f"_c_{n}": F.max("_bad").over(w[n]) for n in windows}

    got, out = rolling(rows, max(windows) + 1, marked, fit), {}
    for n in windows:
        full = lambda c, n=n: F.when(F.col(f"_k_{n}") == n, c)
        clean = lambda c, n=n: F.when((F.col(f"_k_{n}") == n) & (F.col(f"_c_{n}") == 0), c)
        mid = F.col(f"_a_{n}") + F.col(f"_b_{n}") * F.col("_i")
        sd = F.sqrt(F.greatest(F.col(f"_y_{n}") - F.col(f"_b_{n}") * F.col(f"_x_{n}"), F.lit(0.0)) / (n - 1))
        out |= {f"slope_{n}": clean(F.col(f"_b_{n}")), f"r2_{n}": clean(F.when(F.col(f"_y_{n}") > 0, F.col(f"_r_{n}"))), f"mid_{n}": full(mid)}
        out |= {f"upper_{n}": full(mid + width * sd), f"lower_{n}": full(mid - width * sd)}
    return got.withColumns(out).select(*bars.columns, *out)


def context(bars: DataFrame, windows: tuple[int, ...], step: Column, flat: float, complete: Column | None = None) -> DataFrame:
    """Channels of several windows with ``agreement`` (1 or -1 if all slopes have that sign, else 0), the ``regime`` of the
    shortest one's slope beyond ``flat``, and ``regime_age``, its bars so far.
    """
    got = scratch.stage(channels(bars, windows, step, complete), "channels")  # read several times by what follows
    signs = [F.signum(f"slope_{n}") for n in windows]
    same = F.when(F.least(*signs) == F.greatest(*signs), signs[0])
    first = F.col(f"slope_{windows[0]}")
    known = sum((F.col(f"slope_{n}").isNotNull().cast("int") for n in windows), F.lit(0)) == len(windows)
    got = got.withColumns({"agreement": F.when(known, F.coalesce(same, F.lit(0.0))).cast("int"), "regime": F.when(first > flat, 1).when(first < -flat, -1).otherwise(0)})
    got = previous(got, {"_rb": "regime"})
    return islands(got, F.coalesce(F.col("regime") != F.col("_rb"), F.lit(True)), "_run", place="regime_age").drop("_rb", "_run")


def projected(ctx: DataFrame, fine: DataFrame, n: int, step_s: int, limit_min: float) -> DataFrame:
    """``fine`` with ``mid``, ``upper`` and ``lower`` prices: the latest completed bar's channel, carried on by its slope.

    A bar's channel is usable from its end; it is extrapolated by the time since, and null where its slope is (a bar of
    the window is missing) or where it is older than ``limit_min``.
    """
    right = ctx.select("symbol", (F.col("ts") + F.make_dt_interval(secs=F.lit(step_s))).alias("available_at"), *[F.col(f"{c}_{n}").alias(f"_{c}") for c in ("slope", "mid", "upper", "lower")])
    got = with_age(backward(fine, right, ["_slope", "_mid", "_upper", "_lower"]), limit_min)
    ahead = F.col("_slope") * (F.col("age_min") * 60 / step_s)
    price = lambda c: F.when(~F.col("stale"), F.exp(F.col(f"_{c}") + ahead))
    return got.withColumns({c: price(c) for c in ("mid", "upper", "lower")}).drop("_slope", "_mid", "_upper", "_lower", "matched_at")


def bar_frame(bars: DataFrame, step: Column, short: int = 3, long: int = 6, surprise: int = 12) -> DataFrame:
    """Return, wicks, volume surprise, imbalance and volatility of bars, each null until the gap-free run is long enough."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    size = F.nullif(h - l, F.lit(0.0))
    x = run_lengths(bars, step).withColumns({"upper_wick": (h - F.greatest(o, c)) / size, "lower_wick": (F.least(o, c) - l) / size, "_im": 2 * F.col("taker") / F.col("volume") - 1})
    ok = lambda n, v: F.when(F.col("run_len") >= n, v)

    def then(f):
        return {
            "ret": ok(2, F.col("_r")), "surprise": ok(surprise, F.ln(F.col("volume") / F.percentile("volume", 0.5).over(f.over(surprise)))),
            "imbalance_mean": ok(short, F.avg("_im").over(f.over(short))), "imbalance_delta": ok(2, F.col("_im") - F.lag("_im").over(f.order)),
            "vol": ok(long + 1, F.stddev_samp("_r").over(f.over(long))),
        }

    return rolling(x, max(long + 1, surprise, short), lambda f: {"_r": _ret(f)}, then).drop("_im", "_r", "gap", "run_len")


def compact(ctx: DataFrame, n: int) -> DataFrame:
    """Distance from the channel's middle in half-widths, distance to the nearest rail, and how fast that rail comes near."""
    l = F.ln("close")
    half = F.nullif((F.col(f"upper_{n}") - F.col(f"lower_{n}")) / 2, F.lit(0.0))
    got = ctx.withColumns({"centre": (l - F.col(f"mid_{n}")) / half, "nearest": F.least(F.abs(F.col(f"upper_{n}") - l), F.abs(l - F.col(f"lower_{n}"))) / half})
    return previous(got, {"_nb": "nearest"}).withColumn("approach", F.col("_nb") - F.col("nearest")).drop("_nb")


def window_rows(windows: DataFrame, bars: DataFrame, before_s: int, id_col: str = "window_id") -> DataFrame:
    """(window, ts, place, in_window, move): each window's bars and those of ``before_s`` seconds before it, as moves from the
    first of them, signed by the window's ``side``.
    """
    w = windows.withColumn("_from", F.col("start") - F.make_dt_interval(secs=F.lit(before_s)))
    got = range_join(w.select("symbol", id_col, "side", "_from", "start", "end"), bars.select("symbol", "ts", "close"), "_from", "end")
    own = Window.partitionBy(id_col).orderBy("ts")
    return got.select(
        id_col, "ts", F.row_number().over(own).alias("place"), (F.col("ts") >= F.col("start")).alias("in_window"),
        (F.col("side") * F.ln(F.col("close") / F.first("close").over(own))).alias("move"),
    )


def macro_state(daily: DataFrame, n: int, band: float) -> DataFrame:
    """(symbol, day, state): 1 above the ``n``-day mean by ``band``, -1 below it, the state before in between; usable the next
    day. ``daily`` has a row a day (symbol, ts, close).
    """
    got = rolling(daily, n, lambda f: {"_m": f.full(F.avg("close"), "close", n)})
    side = F.when(F.col("close") > F.col("_m") * (1 + band), 1).when(F.col("close") < F.col("_m") * (1 - band), -1)
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    return got.select("symbol", F.date_add("ts", 1).alias("day"), F.last(side, ignorenulls=True).over(w).alias("state"))
