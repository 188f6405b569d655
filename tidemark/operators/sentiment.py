"""Sentiment blocks on a grid of bars: decayed means and pulses of scored stories, tone, releases, direct events, a daily index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import Context, contexts
from tidemark.operators.series import calendar, ewm, rolling
from tidemark.sources.scratch import stage

#: Steps of the grid an hour; half-lives in hours of headlines and of policy events; weight of an impact class.
STEPS, HEADLINES, POLICY = 4, 6.0, 48.0
IMPACT = {0: 1.0, 1: 2.0, 2: 3.0}


@dataclass(frozen=True)
class Events:
    """Rows (``symbol``, ``ts``) whose ``value`` and ``weight`` count where they fall; a null value leaves a row out."""

    rows: DataFrame
    value: Column = None
    weight: Column = None
    where: Column = None

    def cells(self, name: str, at: Column) -> DataFrame:
        value = F.lit(1.0) if self.value is None else self.value.cast("double")
        weight = F.lit(1.0) if self.weight is None else self.weight.cast("double")
        rows = self.rows if self.where is None else self.rows.where(F.coalesce(self.where, F.lit(False)))
        return rows.select("symbol", at.alias("ts"), F.lit(name).alias("name"), value.alias("v"), F.coalesce(weight, F.lit(0.0)).alias("w")).where("v is not null and ts is not null")


def gridded(bars: DataFrame, events: dict[str, Events], minutes: int = 60 // STEPS) -> DataFrame:
    """(symbol, ts, on_bar, and for each name <name>_n, <name>_v, <name>_w, <name>_vw): what falls into each step of a grid without
    gaps from the first bar or event to the last: count, sums of values, of weights and of values times weights.

    All events are summed in one aggregate, bars among them; steps without any hold zeros.
    """
    step = minutes * 60
    at = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / step) * step)
    cells = bars.select("symbol", at.alias("ts"), F.lit("").alias("name"), F.lit(1.0).alias("v"), F.lit(1.0).alias("w"))
    for name, e in events.items():
        cells = cells.unionByName(e.cells(name, at))
    mine = {n: F.col("name") == n for n in events}
    sums = [F.max((F.col("name") == "").cast("int")).alias("on_bar")]
    for n, own in mine.items():
        sums += [F.count_if(own).cast("double").alias(f"{n}_n"), F.sum(F.when(own, F.col("v")).otherwise(0.0)).alias(f"{n}_v")]
        sums += [F.sum(F.when(own, F.col("w")).otherwise(0.0)).alias(f"{n}_w"), F.sum(F.when(own, F.col("v") * F.col("w")).otherwise(0.0)).alias(f"{n}_vw")]
    cells = cells.groupBy("symbol", "ts").agg(*sums)
    filled = calendar(cells, f"{minutes} minutes").join(cells, ["symbol", "ts"], "left")
    return filled.fillna(0, [c for c in cells.columns if c not in ("symbol", "ts")])


def _from_first(grid: DataFrame, halflives: dict[str, float]) -> DataFrame:
    """``grid`` with ``_direct`` (number of direct events) and the sums of each name's first step, that of its first event or of the
    first bar if that is earlier, raised so that its decayed mean begins with them as they are.
    """
    firsts = [F.least(F.min(F.when(F.col(f"{n}_n") > 0, F.col("ts"))), F.min(F.when(F.col("on_bar") == 1, F.col("ts")))).alias(f"_f_{n}") for n in halflives]
    firsts = grid.groupBy("symbol").agg(F.min("ts").alias("_f"), F.sum("direct_n").alias("_direct"), *firsts)
    got = grid.join(firsts, "symbol")
    raised = {}
    for n, hours in halflives.items():
        at = (F.col("ts") == F.col(f"_f_{n}")) & (F.col("ts") > F.col("_f"))
        raised |= {f"{n}_{c}": F.when(at, F.col(f"{n}_{c}") / alpha(hours)).otherwise(F.col(f"{n}_{c}")) for c in ("v", "w", "vw")}
    return got.withColumns(raised).drop("_f", *[f"_f_{n}" for n in halflives])


def alpha(hours: float) -> float:
    """Share of the newest step in an exponential mean of this half-life."""
    return 1 - 0.5 ** (1 / (hours * STEPS))


def arm_weight(scorer: str, asset: str, pattern: str | None) -> tuple[Column, Column]:
    """(kept, weight) of stories by a scorer's own means: words of the title, confidence and echoes; or tag, relevance and impact."""
    if scorer == "classic":
        topic = F.lit(True) if pattern is None else F.lower("title").rlike(pattern)
        return topic, F.least(F.abs("sent"), F.lit(1.0)) * (1 + F.log1p(F.coalesce("echoes", F.lit(1)).cast("double")))
    impact = F.coalesce(*[F.when(F.col("llm_impact") == k, w) for k, w in IMPACT.items()], F.lit(1.0))
    return F.col("llm_asset").isin(asset, "macro"), F.coalesce(F.least(F.greatest("llm_relevance", F.lit(0.0)), F.lit(1.0)), F.lit(0.0)) * impact


def matched_features(
    bars: DataFrame, news: DataFrame, tone: DataFrame, releases: DataFrame, direct: DataFrame, index: DataFrame | None, scorer: str, weighting: str, asset: str,
    pattern: str | None = None, halflife: float = HEADLINES,
) -> DataFrame:
    """(symbol, ts and sentiment columns) of ``bars`` (symbol, ts: starts of quarter hours), for one of two scorers of the same stories.

    ``news`` and ``direct`` hold retained stories with both scores (``sent``, ``llm_sent``), ``title``, ``echoes`` and what the
    second scorer says besides. ``sent_news_decay``: plain, the decayed sum; own, the decayed mean over what the scorer keeps
    by its own weights, 0 without mass. ``sent_news_count_24h`` counts the same stories. ``sent_tone_decay`` and
    ``sent_macro_decay`` are decayed sums of tone and of releases, ``sent_fng_change_7d`` the change of a daily index within
    7 days (0 if unknown, as without ``index``), ``sent_direct_pulse`` the decayed sum of direct events in units of one of
    weight 1. The second scorer's arm also has ``sent_llm_relevance_decay``, ``sent_llm_hi_impact_decay`` (impact 2) and
    ``sent_llm_topic_share_24h``. Values of a bar know what came before its end.
    """
    score = F.col("llm_sent" if scorer == "llm" else "sent")
    kept, weight = arm_weight(scorer, asset, pattern) if weighting == "own" else (F.lit(True), F.lit(1.0))
    events = {
        "news": Events(news, score, weight, kept), "tone": Events(tone, F.col("tone")), "macro": Events(releases), "direct": Events(direct, score, weight, kept),
    }
    if weighting == "own":  # where no direct event is kept all of them count
        events["any"] = Events(direct, score, weight)
    if scorer == "llm":
        topic, own = arm_weight("llm", asset, pattern)
        relevance = F.least(F.greatest("llm_relevance", F.lit(0.0)), F.lit(1.0))
        events |= {"rel": Events(news, relevance, F.lit(1.0), topic), "hi": Events(news, score, own, topic & (F.col("llm_impact") >= 2)), "every": Events(news, score)}
    grid = stage(gridded(bars, events), "grid")  # every step below reads what it is given several times
    grid = stage(_from_first(grid, {n: POLICY if n in ("direct", "any") else halflife for n in events}), "grid")
    slow = ["direct_vw"] + (["any_vw"] if weighting == "own" else [])
    fast = ["news_v", "news_vw", "news_w", "tone_v", "macro_v"] + (["rel_vw", "rel_w", "hi_vw", "hi_w"] if scorer == "llm" else [])
    grid = stage(ewm(grid, {f"e_{c}": c for c in fast}, alpha(halflife)), "grid")
    grid = stage(ewm(grid, {f"e_{c}": c for c in slow}, alpha(POLICY)), "grid")
    day = 24 * STEPS
    counts = ["news_n"] + (["rel_n", "every_n"] if scorer == "llm" else [])
    grid = rolling(grid, day, lambda f: {f"d_{c}": F.sum(c).over(f.over(day)) for c in counts})
    mean = lambda n: F.when(F.col(f"e_{n}_w") > 1e-12, F.col(f"e_{n}_vw") / F.col(f"e_{n}_w")).otherwise(0.0)
    pulse = F.when(F.col("_direct") > 0, F.col("e_direct_vw")).otherwise(F.col("e_any_vw")) if weighting == "own" else F.col("e_direct_vw")
    out = {
        "sent_news_decay": mean("news") if weighting == "own" else F.col("e_news_v"), "sent_news_count_24h": F.col("d_news_n"), "sent_tone_decay": F.col("e_tone_v"),
        "sent_macro_decay": F.col("e_macro_v"), "sent_direct_pulse": pulse / alpha(POLICY),
    }
    if scorer == "llm":
        share = F.when(F.col("d_every_n") > 0, F.col("d_rel_n") / F.col("d_every_n")).otherwise(0.0)
        out |= {"sent_llm_relevance_decay": mean("rel"), "sent_llm_hi_impact_decay": mean("hi"), "sent_llm_topic_share_24h": share}
    got = grid.where("on_bar = 1").select("symbol", "ts", *[c.alias(n) for n, c in out.items()])
    got = stage(got, "blocks")
    return got.withColumn("sent_fng_change_7d", F.lit(0.0)) if index is None else index_change(got, index)


def index_change(bars: DataFrame, index: DataFrame, days: int = 7) -> DataFrame:
    """``bars`` with ``sent_fng_change_7d``: the latest daily value (ts, value) known at a bar's end less that of the bar as many bars
    back as ``days`` have; 0 where either is unknown.
    """
    step = 60 // STEPS * 60
    rows = bars.withColumn("_end", F.timestamp_seconds(F.unix_timestamp("ts") + step))
    rows = contexts(rows, {"index": Context(index.select(F.col("ts").alias("available_at"), F.col("value").cast("double").alias("_value")), ["_value"], keyed=False)}, left_ts="_end")
    rows = stage(rows, "index")
    back = days * 24 * STEPS
    rows = rolling(rows, back + 1, lambda f: {"_before": F.lag("_value", back).over(f.order)})
    return rows.withColumn("sent_fng_change_7d", F.coalesce(F.col("_value") - F.col("_before"), F.lit(0.0))).drop("_end", "index_at", "_value", "_before")
