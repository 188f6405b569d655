"""Policies over scored rows and panels: votes, gates by expected value, admissions, schedules around fixed trades, rules."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.gates import nth_smallest, upward_crossings
from tidemark.operators.intervals import greedy, without_overlap
from tidemark.operators.series import rolling
from tidemark.sources.scratch import stage


def base_first(cands: DataFrame, base: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, reason) of candidates around trades that are fixed: base (meets one of those), busy (an earlier candidate is
    still open) or taken.
    """
    free = without_overlap(cands, base, id_col).select("symbol", id_col, "start", "end")
    got = greedy(free, id_col).select(id_col, F.when(F.col("accepted"), "taken").otherwise("busy").alias("reason"))
    return cands.select(id_col).join(got, id_col, "left").select(id_col, F.coalesce("reason", F.lit("base")).alias("reason"))


def side_votes(panel: DataFrame, solo: float, key: str = "id") -> DataFrame:
    """(key, side, route): the side that at least two members take and none opposes (majority), or one alone at confidence
    ``solo`` or more (solo); else 0 and null. ``panel`` has side (-1, 0, 1) and conf for each member.
    """
    n = lambda s: F.count_if(F.col("side") == s)
    best = F.max(F.when(F.col("side") != 0, F.col("conf")))
    got = panel.groupBy(key).agg(n(1).alias("_u"), n(-1).alias("_d"), best.alias("_c"))
    u, d = F.col("_u"), F.col("_d")
    one = F.when((u > 0) & (d == 0), 1).when((d > 0) & (u == 0), -1).otherwise(0)
    route = F.when((one != 0) & (u + d >= 2), "majority").when((one != 0) & (F.col("_c") >= solo), "solo")
    return got.select(key, F.when(route.isNotNull(), one).otherwise(0).alias("side"), route.alias("route"))


def one_bar_trades(bars: DataFrame, step_s: int, fee: float) -> DataFrame:
    """(symbol, ts, side, net) of signals (``side``) held for the next bar, open to close, if it follows at once."""
    got = rolling(bars, 1, lambda f: {"_t": F.lead("ts").over(f.order), "_o": F.lead("open").over(f.order), "_c": F.lead("close").over(f.order)}, ahead=1)
    near = F.unix_timestamp("_t") - F.unix_timestamp("ts") == step_s
    return got.where(near & (F.col("side") != 0)).select("symbol", "ts", "side", (F.col("side") * (F.col("_c") / F.col("_o") - 1) - 2 * fee).alias("net"))


def portfolio(arms: DataFrame, grid: DataFrame, arm: str = "arm", net: str = "net") -> DataFrame:
    """(symbol, ts, total, arms): the arms' returns on every time of ``grid``, zero where none trades."""
    got = arms.groupBy("symbol", "ts").agg(F.sum(net).alias("total"), F.count_distinct(arm).alias("arms"))
    return grid.select("symbol", "ts").join(got, ["symbol", "ts"], "left").select("symbol", "ts", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("arms", F.lit(0)).alias("arms"))


def spaced_best(scored: DataFrame, k: int, spacing_s: int, id_col: str = "id", score: str = "score", key: str = "symbol") -> DataFrame:
    """The ``k`` best rows of those that a greedy choice by score, ties by id, leaves at least ``spacing_s`` apart in a key.

    Rounds: a row that no open row within the spacing beats is taken, and what lies that near to it goes. Rows are looked
    at in time buckets as wide as the spacing with those of the buckets beside, so a task holds three buckets of a key. Where
    scores aren't in order of time few rounds settle all; a score that rises all along needs one for each taken row. Null
    scores come last; ids are unique.
    """
    span = max(1, spacing_s * 1_000_000)
    rows = scored.select(F.col(id_col).alias("_id"), F.col(key).alias("_key"), F.col(score).cast("double").alias("_score"), F.unix_micros("ts").alias("_t"))
    open_, taken = stage(rows.withColumn("_b", F.floor(F.col("_t") / span)), "open"), []
    beside = F.explode(F.array(*[F.col("_b") + i for i in (-1, 0, 1)]))
    near = Window.partitionBy("_key", "_at").orderBy("_t").rangeBetween(1 - span, span - 1)
    while not open_.isEmpty():
        best = F.min(F.struct(F.coalesce(-F.col("_score"), F.lit(float("inf"))), F.col("_id").alias("i"))).over(near)
        seen = open_.withColumn("_at", beside).withColumn("_best", best).where("_at = _b and _best.i = _id")
        won = stage(seen.select(*open_.columns), "won")
        lost = won.select("_key", F.col("_t").alias("_w"), beside.alias("_b"))
        close = F.abs(F.col("_t") - F.col("_w")) < span if spacing_s > 0 else F.lit(False)
        gone = open_.join(lost, ["_key", "_b"]).where(close).select("_id").unionByName(won.select("_id")).distinct()
        open_ = stage(open_.join(gone, "_id", "left_anti"), "open")
        taken.append(won)
    got = reduce(DataFrame.unionByName, taken, rows.limit(0).withColumn("_b", F.lit(0).cast("long")))
    return got.select(F.col("_id").alias(id_col), F.col("_key").alias(key), F.col("_score").alias(score)).orderBy(F.desc(score), id_col).limit(k)  # a report of k rows


def matched_rate(scored: DataFrame, rate: float, by: str = "model", score: str = "score") -> dict:
    """Each member's score that ``rate`` of its rows reach: a threshold a member."""
    n = {r[0]: r[1] for r in scored.groupBy(by).count().collect()}  # members are few
    return {m: -nth_smallest(scored.where(F.col(by) == m).select((-F.col(score)).alias("s")), "s", max(1, int(k * rate))) for m, k in n.items()}


def matched_crossings(scored: DataFrame, rate: float, by: str = "model", score: str = "score") -> DataFrame:
    """Upward crossings of each member's own threshold at an equal ``rate``."""
    cut = F.create_map(*[F.lit(x) for kv in matched_rate(scored, rate, by, score).items() for x in kv])
    own = scored.withColumn("_lift", F.col(score) - F.element_at(cut, F.col(by))).withColumn("_k", F.concat_ws("|", "symbol", F.col(by).cast("string")))
    return upward_crossings(own, "_lift", 0.0, "_k").drop("_k", "_lift")


def lessons_applied(panel: DataFrame, lessons: list[dict], allowed: set[str], probs: tuple[str, ...] = ("p0", "p1", "p2")) -> DataFrame:
    """``panel`` after lessons in order: each scales one class's probability, or forces class 1 (flat), where its condition
    holds; probabilities sum to 1 again at the end.
    """
    got = panel.withColumn("_flat", F.lit(False))
    for lesson in lessons:
        on = F.coalesce(condition(lesson["when"], allowed), F.lit(False))
        if lesson.get("flat"):
            got = got.withColumn("_flat", F.col("_flat") | on)
        else:
            c = probs[lesson["class"]]
            got = got.withColumn(c, F.when(on, F.col(c) * lesson["weight"]).otherwise(F.col(c)))
    total = F.nullif(sum((F.col(c) for c in probs), F.lit(0.0)), F.lit(0.0))
    got = got.withColumns({c: F.col(c) / total for c in probs})
    return got.withColumns({c: F.when(F.col("_flat"), float(k == 1)).otherwise(F.coalesce(c, F.lit(1 / len(probs)))) for k, c in enumerate(probs)}).drop("_flat")


def condition(text: str, allowed: set[str]) -> Column:
    """A condition in words, as in ``p2 > 0.4 AND NOT (n < 2)``, over allowed columns only."""
    plain = re.sub(r"\b(AND|OR|NOT)\b", lambda m: m[0].upper(), text.strip(), flags=re.IGNORECASE)
    for name in re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'", "", plain)):
        if name not in allowed and name not in ("AND", "OR", "NOT"):
            raise ValueError(f"not allowed: {name}")
    if re.search(r"[^\w\s.<>=!()'+\-*/,]", plain):
        raise ValueError(f"not allowed: {text}")
    return F.expr(plain)


def rules_compiled(panel: DataFrame, rules: list[dict], allowed: set[str], tau: float) -> DataFrame:
    """Members' weights by rules in order (multiply or set a model's weight where a condition holds) as ``w``, threshold ``tau``
    or that of the last rule that sets one as ``tau``.
    """
    got = panel.withColumns({"w": F.lit(1.0), "tau": F.lit(tau)})
    for rule in rules:
        on = F.coalesce(condition(rule["when"], allowed), F.lit(False))
        if "tau" in rule:
            got = got.withColumn("tau", F.when(on, F.lit(float(rule["tau"]))).otherwise(F.col("tau")))
        else:
            on = on & (F.col("model") == rule["model"])
            new = F.lit(float(rule["set"])) if "set" in rule else F.col("w") * rule["times"]
            got = got.withColumn("w", F.when(on, new).otherwise(F.col("w")))
    return got


def margin_sides(panel: DataFrame, key: str = "id") -> DataFrame:
    """(key, side): the sign of the weighted margins p2 - p0; where they cancel, the side of the most confident member."""
    m = F.col("w") * (F.col("p2") - F.col("p0"))
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("model", m.alias("m")))), F.lit(0.0), lambda a, x: a + x["m"])
    got = panel.groupBy(key).agg(total.alias("_m"), F.max_by(F.signum(F.col("p2") - F.col("p0")), F.struct(F.greatest("p0", "p2"), -F.col("model"))).alias("_s"))
    return got.select(key, F.when(F.abs("_m") > 1e-12, F.signum("_m")).otherwise(F.col("_s")).cast("int").alias("side"))


def fold_roles(rows: DataFrame, folds: DataFrame, warm_s: int, calibrate_s: int, embargo_s: int, ts: str = "ts", end: str = "label_end") -> DataFrame:
    """(fold, id, role) for every row and fold (fold, valid_start, valid_end: few): warm_up, purged, calibration, embargo, fit,
    test, censored (its label ends after the fold) or, after the fold, none.
    """
    a, b = F.col("valid_start"), F.col("valid_end")
    sec = lambda n: F.make_dt_interval(secs=F.lit(n))
    begin = rows.agg(F.min(ts)).first()[0]
    t, e = F.col(ts), F.col(end)
    role = (
        F.when(t >= b, None).when(t >= a, F.when(e > b, "censored").otherwise("test")).when(t < F.lit(begin) + sec(warm_s), "warm_up").when(t >= a - sec(embargo_s), "embargo")
        .when(e >= a - sec(embargo_s), "purged").when(t >= a - sec(embargo_s + calibrate_s), "calibration").otherwise("fit")
    )
    return rows.crossJoin(F.broadcast(folds)).select("fold", "id", role.alias("role")).where("role is not null")


def inner_parts(rows: DataFrame, share: float, episode: str = "episode", ts: str = "ts", end: str = "label_end") -> DataFrame:
    """(id, part): whole episodes by their last time, the first ``share`` of them fit, the others calibrate; fit rows whose
    label isn't over when calibration begins are purged. The cut is a time found by counting, so no one sorts the episodes.
    """
    e = rows.groupBy(episode).agg(F.max(ts).alias("_last"), F.min(ts).alias("_first"))
    cut = nth_smallest(e.select(F.unix_micros("_last").alias("t")), "t", max(1, int(e.count() * share)))
    late = F.unix_micros("_last") > F.lit(int(cut or 0))
    begin = e.where(late).agg(F.min("_first")).first()[0]
    part = F.when(late, "calibrate").when(F.lit(begin).isNotNull() & (F.col(end) >= F.lit(begin)), "purged").otherwise("fit")
    return rows.join(e, episode).select("id", part.alias("part"))


def episode_sums(rows: DataFrame, net: str, episode: str = "episode") -> DataFrame:
    return rows.groupBy(F.col(episode).alias("id")).agg(F.sum(net).alias("t"), F.count(F.lit(1)).cast("double").alias("c"))


def quarter_gate(ledger: DataFrame, least: float, net: str = "net_return") -> DataFrame:
    """(symbol, blocks, median, positive, admitted): monthly nets of each arm, their median and share above zero, and whether
    it is admitted: median above zero, ``least`` of the months positive, and three months or more.
    """
    per = ledger.groupBy("symbol", F.date_trunc("week", "ts").alias("w")).agg(F.sum(net).alias("n"))
    got = per.groupBy("symbol").agg(F.count(F.lit(1)).alias("blocks"), F.percentile("n", 0.5).alias("median"), F.avg((F.col("n") > 0).cast("double")).alias("positive"))
    return got.withColumn("admitted", (F.col("median") > 0) & (F.col("positive") >= least) & (F.col("blocks") >= 3))


def derangement(names: list[str], seed: int) -> dict[str, str]:
    """Each name to another one, by a seed: names in the order of a hash, rotated by one."""
    import hashlib

    order = sorted(names, key=lambda n: hashlib.sha256(f"{seed}|{n}".encode()).hexdigest())
    return dict(zip(order, order[1:] + order[:1], strict=True))


def worst_conditions(rows: DataFrame, conditions: list[str], k: int, by: str = "model") -> DataFrame:
    """The ``k`` (model, condition, value) with the highest error rates: conditions are unpivoted, counted once."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.col(c).cast("string").alias("value")) for c in conditions]))
    long = rows.select(by, "hit", pairs.alias("x")).select(by, "hit", "x.*")
    got = long.groupBy(by, "condition", "value").agg(F.count(F.lit(1)).alias("n"), F.avg((~F.col("hit")).cast("double")).alias("error"))
    return got.orderBy(F.desc("error"), F.desc("n"), by, "condition", "value").limit(k)


def order_metrics(orders: DataFrame, by: str = "threshold") -> DataFrame:
    """Orders, fills, fill rate, wins and mean net R of filled ones for each threshold."""
    filled = F.col("filled")
    return orders.groupBy(by).agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(filled).alias("fills"), F.avg(filled.cast("double")).alias("fill_rate"),
        F.avg(F.when(filled, (F.col("r_net") > 0).cast("double"))).alias("win_rate"), F.avg(F.when(filled, F.col("r_net"))).alias("mean_r"),
    )


def news_context(events: DataFrame, at: str, hours: int, each: int, overall: int) -> DataFrame:
    """One row: counts, sources, mean, population deviation and largest impact of the ``hours`` before ``at``, and the ids of
    the ``each`` strongest of every source and the ``overall`` strongest of those.
    """
    end = F.lit(at).cast("timestamp")
    rows = events.where((F.col("ts") < end) & (F.col("ts") >= end - F.make_dt_interval(hours=F.lit(hours))))
    top = rows.withColumn("_k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("impact"), "id"))).where(F.col("_k") <= each)
    best = top.orderBy(F.desc("impact"), "id").limit(overall).agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("top"))
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.avg("sent").alias("mean"), F.stddev_pop("sent").alias("spread"), F.max("impact").alias("largest"))
    return s.crossJoin(F.broadcast(best))  # one row each
