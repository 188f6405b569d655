"""Side routes of several models' scores: votes, majority and solo routes, cutoffs under a rate cap, activations."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import previous, ranked

#: Differences between sides of a model that count as none.
EVEN = 1e-12
#: Seconds of a time bucket whose crossings at all cutoffs are found in one task.
BUCKET = 7 * 86_400


def _median(values: list[Column]) -> Column:
    s, n = F.array_sort(F.array(*values)), len(values)
    return s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _checked(name: str) -> Column:
    c = F.col(name).cast("double")
    good = c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= 1)
    return F.when(good, c).otherwise(F.raise_error(F.lit(f"{name} must be a probability")).cast("double"))


def route_scores(rows: DataFrame, models: list[str], solo: str, majority: int = 2) -> DataFrame:
    """``rows`` with columns ``p_long_<model>`` and ``p_short_<model>``, and with what the routes make of them.

    A model prefers the side of its larger probability. ``side`` is what ``majority`` models prefer (0: none) and ``score``
    their support: the median of all models' probabilities of that side plus the median of their edges towards it,
    edges to the other side counted as none. ``route``: unanimous, decisive (with ``solo``), without, or none. The solo
    route (``solo_side``, ``solo_score``) is the side and edge of ``solo`` alone unless every other model prefers the other
    side. A probability that is null or outside 0 to 1 stops the job.
    """
    long, short = ({m: _checked(f"p_{s}_{m}") for m in models} for s in ("long", "short"))
    edge = {m: long[m] - short[m] for m in models}
    prefers = {m: F.when(edge[m] > EVEN, 1).when(edge[m] < -EVEN, -1).otherwise(0) for m in models}
    got = rows.withColumns({f"_e_{m}": edge[m] for m in models} | {f"_p_{m}": prefers[m] for m in models})
    up, down = (_total([(F.col(f"_p_{m}") == s).cast("int") for m in models]) for s in (1, -1))
    got = got.withColumns({"_up": up, "_down": down})
    got = got.withColumn("side", F.when(F.col("_up") >= majority, 1).when(F.col("_down") >= majority, -1).otherwise(0))
    support = _median([F.when(F.col("side") == 1, F.col(f"p_long_{m}")).otherwise(F.col(f"p_short_{m}")).cast("double") for m in models])
    towards = _median([F.greatest(F.col("side") * F.col(f"_e_{m}"), F.lit(0.0)) for m in models])
    votes, own = F.greatest("_up", "_down"), F.col(f"_p_{solo}")
    against = reduce(lambda a, b: a & b, [F.col(f"_p_{m}") == -own for m in models if m != solo])
    alone = (own != 0) & ~against
    route = F.when(F.col("side") == 0, "none").when(votes == len(models), "unanimous").when(own == F.col("side"), "decisive").otherwise("without")
    got = got.withColumns({
        "votes": votes, "score": F.when(F.col("side") != 0, support + towards).otherwise(0.0), "route": route,
        "solo_side": F.when(alone, own).otherwise(0), "solo_score": F.when(alone, F.abs(F.col(f"_e_{solo}"))).otherwise(0.0),
    })
    return got.drop("_up", "_down", *[f"_{k}_{m}" for k in "ep" for m in models])


def net_routes(rows: DataFrame, models: list[str], solo: str, majority: int = 2) -> DataFrame:
    """``rows`` with columns ``net_long_<model>`` and ``net_short_<model>``, and with ``side``, ``votes``, ``net`` and ``route``.

    A model votes for a side whose net is above 0 and above the other side's; the side that ``majority`` models vote for
    counts with the median net of those that do.
    """
    vote = {}
    for m in models:
        a, b = F.col(f"net_long_{m}"), F.col(f"net_short_{m}")
        vote[m] = F.when((a > 0) & (a > b), 1).when((b > 0) & (b > a), -1).otherwise(0)
    got = rows.withColumns({f"_v_{m}": vote[m] for m in models})
    up, down = (_total([(F.col(f"_v_{m}") == s).cast("int") for m in models]) for s in (1, -1))
    got = got.withColumns({"_up": up, "_down": down}).withColumn("side", F.when(F.col("_up") >= majority, 1).when(F.col("_down") >= majority, -1).otherwise(0))
    own = F.array(*[F.when(F.col(f"_v_{m}") == F.col("side"), F.when(F.col("side") == 1, F.col(f"net_long_{m}")).otherwise(F.col(f"net_short_{m}"))) for m in models])
    s = F.array_sort(F.filter(own, lambda x: x.isNotNull()))
    n = F.size("_s")
    got = got.withColumn("_s", s)
    middle = (F.get("_s", F.floor((n - 1) / 2).cast("int")) + F.get("_s", F.floor(n / 2).cast("int"))) / 2
    votes = F.greatest("_up", "_down")
    route = F.when(F.col("side") == 0, "none").when(votes == len(models), "unanimous").when(F.col(f"_v_{solo}") == F.col("side"), "decisive").otherwise("without")
    got = got.withColumns({"votes": F.when(F.col("side") != 0, votes).otherwise(0), "net": F.when(F.col("side") != 0, middle).otherwise(0.0), "route": route})
    return got.drop("_up", "_down", "_s", *[f"_v_{m}" for m in models])


def route_series(scored: DataFrame, id_col: str = "id", key: str = "symbol", ts: str = "ts") -> DataFrame:
    """(key, ts, id, way, side, score, line) of ``route_scores``: for each row the majority and the solo route, long and short; 0
    where the row takes another side.
    """
    both = [("majority", "side", "score"), ("solo", "solo_side", "solo_score")]
    each = [F.struct(F.lit(w).alias("way"), F.lit(s).alias("side"), F.when(F.col(of) == s, F.col(score)).otherwise(0.0).alias("score")) for w, of, score in both for s in (1, -1)]
    got = scored.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(id_col).alias("id"), F.explode(F.array(*each)).alias("r")).select("key", "ts", "id", "r.*")
    return got.withColumn("line", F.concat_ws("|", F.col("key").cast("string"), "way", F.col("side").cast("string")))


def candidate_cutoffs(series: DataFrame, most: int = 257) -> DataFrame:
    """(line, cuts): each line's distinct positive scores, or where there are more than ``most`` as many linearly interpolated
    quantiles of them, ascending, and one above them all; 1.0 alone for a line without a positive score.
    """
    own = series.where("score > 0").select("line", "score").distinct()
    n = own.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))
    own = ranked(own, "score", ["line"]).join(n.select("line", "n"), "line")
    # quantile i of most-1 lies at place i (n-1) / (most-1): a value counts for the quantiles just below and above it
    steps = F.lit(most - 1)
    place = lambda i: i * (F.col("n") - 1) / steps
    first = F.ceil((F.col("rank") - 1) * steps / F.greatest(F.col("n") - 1, F.lit(1)))
    last = F.floor((F.col("rank") + 1) * steps / F.greatest(F.col("n") - 1, F.lit(1)))
    reach = F.sequence(F.greatest(first, F.lit(0)).cast("long"), F.least(last, steps).cast("long"))
    many = own.where(F.col("n") > most).withColumn("i", F.explode(reach)).withColumn("w", 1 - F.abs(place(F.col("i")) - F.col("rank"))).where("w > 0")
    many = many.groupBy("line", "i").agg(F.min(F.struct("rank", "score", "w")).alias("a"), F.max(F.struct("rank", "score")).alias("b"))
    at = F.col("a.score") + (F.col("b.score") - F.col("a.score")) * (1 - F.col("a.w"))
    cuts = own.where(F.col("n") <= most).select("line", "score").unionByName(many.select("line", at.alias("score")))
    cuts = cuts.groupBy("line").agg(F.array_sort(F.collect_set("score")).alias("c")).join(n, "line")
    above = F.array(F.col("top") * (1 + 2.220446049250313e-16))
    lines = series.select("line").distinct().join(cuts, "line", "left")
    return lines.select("line", F.coalesce(F.concat("c", above), F.array(F.lit(1.0))).alias("cuts"))


def crossing_frontier(series: DataFrame, cutoffs: DataFrame, refractory_s: int, bucket_s: int = BUCKET) -> DataFrame:
    """(line, threshold, crossings, days): how often each line crosses each cutoff upwards and is taken, and its observed days.

    A row crosses where it is at or above a cutoff and the one before is below; the first row never does. A crossing is
    taken if the crossing before, taken or not, lies ``refractory_s`` back or more. All cutoffs of a line are counted at
    once: a time bucket's task gives for each its first and last crossing and what is taken of the later ones; the first
    one is judged by the last of the bucket before that has any.
    """
    rows = previous(series.select("line", "ts", "score"), {"_b": "score"}, "line").where(F.col("score") > F.col("_b"))
    rows = rows.withColumn("_t", F.unix_micros("ts")).withColumn("_k", F.floor(F.unix_timestamp("ts") / bucket_s)).join(cutoffs, "line")
    far = refractory_s * 1_000_000

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t")
        cuts, t = np.asarray(pdf["cuts"].iloc[0]), pdf["_t"].to_numpy()
        low, high = (np.searchsorted(cuts, pdf[c].to_numpy(), side="right") for c in ("_b", "score"))  # cutoffs that a row crosses
        size = high - low
        cut = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        order = np.argsort(cut, kind="stable")
        cut, at = cut[order], np.repeat(t, size)[order]
        head = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]]) if len(cut) else np.zeros(0, int)
        taken = np.r_[False, (at[1:] - at[:-1] >= far) & (cut[1:] == cut[:-1])] if len(cut) else np.zeros(0, bool)
        inner = np.add.reduceat(taken, head) if len(head) else np.zeros(0, int)
        end = np.r_[head[1:], len(cut)] - 1 if len(head) else head
        return pd.DataFrame({"line": pdf["line"].iloc[0], "_k": pdf["_k"].iloc[0], "threshold": cuts[cut[head]], "first": at[head], "last": at[end], "n": inner})

    got = rows.groupBy("line", "_k").applyInPandas(run, "line string, _k long, threshold double, first long, last long, n long")
    before = F.lag("last").over(Window.partitionBy("line", "threshold").orderBy("_k"))
    got = got.withColumn("n", F.col("n") + F.coalesce((F.col("first") - before >= far).cast("long"), F.lit(1)))
    got = got.groupBy("line", "threshold").agg(F.sum("n").alias("crossings"))
    days = series.groupBy("line", F.to_date("ts").alias("d")).agg(F.lit(1)).groupBy("line").agg(F.count(F.lit(1)).alias("days"))
    every = cutoffs.select("line", F.explode("cuts").alias("threshold"))
    return every.join(got, ["line", "threshold"], "left").join(days, "line").select("line", "threshold", F.coalesce("crossings", F.lit(0)).alias("crossings"), "days")


def chosen_cutoffs(frontier: DataFrame, caps: Column) -> DataFrame:
    """(line, threshold, crossings, days): the cutoff with most crossings of at most ``caps`` a day, ties to the highest."""
    ok = frontier.where(F.col("crossings") / F.col("days") <= caps + 1e-12)
    return ok.groupBy("line").agg(F.max(F.struct("crossings", "threshold", "days")).alias("r")).select("line", "r.threshold", "r.crossings", "r.days")


def activations(series: DataFrame, cutoffs: DataFrame, refractory_s: int) -> DataFrame:
    """(key, ts, id, way, side, score, accepted) of the lines' taken crossings of their own cutoffs (line, threshold).

    Of crossings at one time of a key the majority's counts, then long. One is accepted if the one before, accepted or
    not, lies ``refractory_s`` back or more.
    """
    far = refractory_s * 1_000_000
    rows = previous(series, {"_b": "score"}, "line").join(cutoffs.select("line", "threshold"), "line")
    rows = rows.where((F.col("score") >= F.col("threshold")) & (F.col("_b") < F.col("threshold"))).withColumn("_t", F.unix_micros("ts"))
    rows = previous(rows, {"_l": "_t"}, "line").where(F.col("_l").isNull() | (F.col("_t") - F.col("_l") >= far))
    first = F.min_by(F.struct("id", "way", "side", "score", "_t"), F.struct(F.when(F.col("way") == "majority", 0).otherwise(1), -F.col("side")))
    rows = rows.groupBy("key", "ts").agg(first.alias("r")).select("key", "ts", "r.*")
    rows = previous(rows, {"_l": "_t"}, "key")
    return rows.select("key", "ts", "id", "way", "side", "score", (F.col("_l").isNull() | (F.col("_t") - F.col("_l") >= far)).alias("accepted"))
