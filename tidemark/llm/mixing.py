"""Mixing to target weights: raking of token weights to several marginals, then sampling by calibrated probabilities."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pick, slices, stage
from tidemark.llm.terms import unit, word_counts
from tidemark.llm.tokens import tokenizer

#: Topics; hashed content words and the bytes of one at least; languages with a mean of their own at most.
TOPICS, TERMS, CONTENT, LANGS = 8, 1024, 5, 256
#: Rows whose terms are gathered together; steps of a number in sums, which are whole and so the same in any order.
ROWS, STEPS = 2000, float(1 << 24)
#: Cells that one task rakes without a shuffle; more are dealt out.
CELLS = 20_000
#: Sweeps of the raking at most, and the largest relative difference of a marginal at which it ends.
SWEEPS, TOLERANCE = 30, 1e-3
NONE = "(none)"


def content(text: str | None) -> tuple[np.ndarray, int]:
    """Square-rooted counts of a text's hashed content words, and the number of all its words."""
    x, words = word_counts((text or "").lower().encode("utf-8", "surrogatepass"), TERMS, CONTENT)
    return np.sqrt(x).astype(np.float32), words


def packed(x: np.ndarray) -> bytes:
    """The hashed words of a text that occur, two bytes each, then their square-rooted counts, four bytes each."""
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes()


class Terms:
    """Weighted terms of some texts: term and value of each entry, the text it is of, the place of a text's language."""

    def __init__(self, rows: list[bytes], langs: list[str], names: dict[str, int]):
        size = np.array([len(r) // 6 for r in rows], np.int64)
        self.term = np.frombuffer(b"".join(r[: len(r) // 6 * 2] for r in rows), "<u2").astype(np.int64)
        self.value = np.frombuffer(b"".join(r[len(r) // 6 * 2 :] for r in rows), "<f4").astype(np.float64)
        self.text, self.n = np.repeat(np.arange(len(rows)), size), len(rows)
        self.some, self.lang = size > 0, np.array([names.get(k, len(names)) for k in langs], np.int64)

    def sums(self, each: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, each, self.n)

    def weigh(self, idf: np.ndarray) -> Terms:
        """Values times ``idf``, each text at length 1."""
        self.value = self.value * idf[self.term]
        self.value /= np.maximum(np.sqrt(self.sums(self.value**2)), 1e-12)[self.text]
        return self


class Topics:
    """Groups of texts by their content words, across languages: spherical k-means of weighted terms less their language's mean.

    ``every`` runs over all texts: ``every.langs()`` are the languages and their texts, ``every.total(step, size)`` the sums of
    ``step(terms)`` and ``every.best(key)`` the terms of the text with the largest ``key(terms, hashes)``. Sums are of whole
    numbers and draws go by a hash of the terms, so how the texts are dealt doesn't matter.
    """

    def __init__(self, x: np.ndarray | None, langs: list[str] | None, k: int = TOPICS, rounds: int = 25, seed: int = 42, every: Every | None = None):
        every = every or Here([packed(r) for r in x], langs)
        self.names = {lang: i for i, lang in enumerate(sorted(every.langs()))}
        counts = every.total(self.names, lambda t: np.r_[np.bincount(t.term, minlength=TERMS), t.some.sum()], TERMS + 1)
        self.k, self.idf = k, np.log1p(counts[-1] / (1 + counts[:-1]))
        own = len(self.names) + 1  # the last one is for all others
        sums = every.total(self.names, self._by_language, own * (TERMS + 1)).reshape(own, TERMS + 1)
        self.means = sums[:, :TERMS] / np.maximum(sums[:, TERMS:], 1) / STEPS
        self.means[-1] = sums[:, :TERMS].sum(0) / max(1, sums[:, TERMS].sum()) / STEPS
        self.centre = np.zeros((0, TERMS))
        for j in range(k):  # each next one far from those there are
            got = every.best(self.names, lambda t, h: np.where(t.some, np.log(h) / (np.maximum(1 - self.near(t)[0], 0) + 1e-9), -np.inf), seed + j)
            if got is None:
                break
            self.centre = np.vstack([self.centre, self._dense(got)])
        before = -np.inf
        for _ in range(rounds):
            k = len(self.centre)
            got = every.total(self.names, self._by_topic, k * (TERMS + own) + 1) / STEPS
            sums, weight = got[: k * TERMS].reshape(k, TERMS), got[k * TERMS : -1].reshape(k, own)
            sums = sums - weight @ self.means
            self.centre = np.where(weight.any(1)[:, None], unit(sums), self.centre)
            if got[-1] <= before * (1 + 1e-4):
                break
            before = got[-1]

    def _by_language(self, t: Terms) -> np.ndarray:
        own = len(self.names) + 1
        at, steps = t.lang[t.text] * (TERMS + 1) + t.term, np.rint(t.weigh(self.idf).value * STEPS)
        return np.bincount(at, steps, own * (TERMS + 1)) + np.bincount(t.lang[t.some] * (TERMS + 1) + TERMS, minlength=own * (TERMS + 1))

    def _by_topic(self, t: Terms) -> np.ndarray:
        near, own, scale = self.near(t)
        k, langs = len(self.centre), len(self.names) + 1
        scale = np.where(t.some, scale, 0.0)
        sums = np.bincount(own[t.text] * TERMS + t.term, np.rint(t.value * scale[t.text] * STEPS), k * TERMS)
        return np.r_[sums, np.bincount(own * langs + t.lang, np.rint(scale * STEPS), k * langs), np.rint(near[t.some] * STEPS).sum()]

    def near(self, t: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cosine with the nearest centre, its number, and one over the length without the language's mean, of each text."""
        t.weigh(self.idf)
        long = 1 - 2 * t.sums(t.value * self.means[t.lang[t.text], t.term]) + (self.means**2).sum(1)[t.lang]
        scale = np.where(long > 1e-12, 1 / np.sqrt(np.maximum(long, 1e-12)), 0.0)
        best, own = np.full(t.n, -1.0), np.zeros(t.n, np.int64)
        for j, c in enumerate(self.centre):
            s = (t.sums(t.value * c[t.term]) - (self.means @ c)[t.lang]) * scale
            best, own = np.where(s > best, s, best), np.where(s > best, j, own)
        return best, own, scale

    def _dense(self, t: Terms) -> np.ndarray:
        t.weigh(self.idf)
        return unit(np.bincount(t.term, t.value, TERMS) - self.means[t.lang[0]])[None]

    def topics(self, rows: list[bytes], langs: list[str]) -> list[str]:
        """The topic of each packed text; NONE without content words."""
        out = []
        for at in range(0, len(rows), ROWS):
            t = Terms(rows[at : at + ROWS], langs[at : at + ROWS], self.names)
            out += [f"t{k}" if some else NONE for k, some in zip(self.near(t)[1].tolist(), t.some.tolist(), strict=True)]
        return out

    def of(self, x: np.ndarray, langs: list[str]) -> list[str]:
        return self.topics([packed(r) for r in x], langs)


def _hashes(rows: list[bytes], seed: int) -> np.ndarray:
    return np.array([((xxhash.xxh64_intdigest(r, seed) >> 11) + 1) / (1 << 53) for r in rows])


class Every:
    """All texts of ``rows`` (lang, x), in Spark: tasks send sums of whole numbers or their best text, never texts."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select("lang", "x")

    def langs(self) -> list[str]:
        got = self.rows.where(F.length("x") > 0).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
        return [r.lang for r in got.orderBy(F.desc("n"), "lang").limit(LANGS).collect()]

    @staticmethod
    def _parts(batches, names):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                x, langs = b.column("x").slice(at, ROWS).to_pylist(), b.column("lang").slice(at, ROWS).to_pylist()
                yield x, langs, Terms(x, langs, names)

    def total(self, names: dict[str, int], step, size: int) -> np.ndarray:
        parts = self._parts

        def run(batches):
            out = np.zeros(size)
            for _, _, t in parts(batches, names):
                out += step(t)
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out[at].astype(np.int64))], ["cell", "v"])

        got = self.rows.mapInArrow(run, "cell int, v long").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(size)
        out[got["cell"].to_numpy()] = got["v"].to_numpy()
        return out

    def best(self, names: dict[str, int], key, seed: int) -> Terms | None:
        parts = self._parts

        def run(batches):
            found = []
            for x, langs, t in parts(batches, names):
                keys = key(t, _hashes(x, seed))
                at = max(range(len(x)), key=lambda i: (keys[i], x[i], langs[i]))
                found = max(found, [keys[at], x[at], langs[at]])
            if found and found[0] > -np.inf:
                yield pa.RecordBatch.from_pydict({k: pa.array([v]) for k, v in zip(("key", "x", "lang"), found, strict=True)})

        got = self.rows.mapInArrow(run, "key double, x binary, lang string").orderBy(F.desc("key"), F.desc("x"), F.desc("lang")).limit(1).collect()
        return Terms([bytes(got[0].x)], [got[0].lang], names) if got else None


class Here:
    """The same over texts at hand."""

    def __init__(self, rows: list[bytes], langs: list[str]):
        self.rows, self.own = rows, langs

    def langs(self) -> list[str]:
        return [k for k, _ in Counter(k for k, r in zip(self.own, self.rows, strict=True) if r).most_common(LANGS)]

    def total(self, names: dict[str, int], step, size: int) -> np.ndarray:
        return step(Terms(self.rows, self.own, names)).astype(float)

    def best(self, names: dict[str, int], key, seed: int) -> Terms | None:
        keys = key(Terms(self.rows, self.own, names), _hashes(self.rows, seed))
        at = max(range(len(keys)), key=lambda i: (keys[i], self.rows[i], self.own[i]), default=None)
        return None if at is None or keys[at] == -np.inf else Terms([self.rows[at]], [self.own[at]], names)


def describe(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", lang_col="lang", vocabulary: str | None = None) -> DataFrame:
    """(id, source, lang, topic, tokens, tie) of each whole text.

    Tokens are the ids that the tokenizer file ``vocabulary`` gives, or without one the words. The topic is one of TOPICS
    groups of content words, learned from every text (see Topics); without content words it is NONE, as is a null source
    or language. ``tie`` is the number that sampling compares with a probability: a hash of the id, or of the text where there is no id.
    """
    rows = pick(docs, id=id_col, text=text_col, source=source_col, lang=lang_col)
    rows = rows.select("id", "text", *[F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in ("source", "lang")])

    def run(batches):
        own = tokenizer(vocabulary) if vocabulary else None
        for whole in batches:
            for b in slices(whole, "text"):
                texts = b.column("text").to_pylist()
                x, n = zip(*map(content, texts), strict=True)
                tokens = [len(own.ids(t or "")) // 4 for t in texts] if own else n
                seeds = ((str(k) if k is not None else t or "").encode("utf-8", "surrogatepass") for k, t in zip(b.column("id").to_pylist(), texts, strict=True))
                tie = [(xxhash.xxh64_intdigest(k, 11) >> 11) / (1 << 53) for k in seeds]
                yield pa.RecordBatch.from_pydict(
                    {k: b.column(k) for k in ("id", "source", "lang")} | {"tokens": pa.array(tokens, pa.int64()), "tie": pa.array(tie), "x": pa.array(map(packed, x), pa.binary())}
                )
        if own:
            own.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    terms = stage(rows.mapInArrow(run, f"id {kind}, source string, lang string, tokens long, tie double, x binary"), "terms")
    shared = docs.sparkSession.sparkContext.broadcast(Topics(None, None, every=Every(terms)))

    def name(batches):
        for b in batches:
            topic = shared.value.topics(b.column("x").to_pylist(), b.column("lang").to_pylist())
            yield pa.RecordBatch.from_pydict({k: b.column(k) for k in ("id", "source", "lang")} | {"topic": pa.array(topic, pa.string()), "tokens": b.column("tokens"), "tie": b.column("tie")})

    return terms.mapInArrow(name, f"id {kind}, source string, lang string, topic string, tokens long, tie double")


def targets(cells: DataFrame, dim: str, shares: dict[str, float] | None, power: float) -> DataFrame:
    """(dim, goal): the share wanted of each category that has tokens, summing to 1.

    With ``shares`` the named categories get theirs and the others split what is left by their tokens; where nothing is
    left, the others keep the share of the tokens that they have and the named ones give way in proportion. Without,
    shares go with tokens to ``power`` (1: as they are, 0: all alike), but for NONE, which keeps its own.
    """
    seen = cells.groupBy(dim).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    if shares is None:
        grown, none = F.pow(F.col("tokens").cast("double"), F.lit(power)), F.col(dim) == NONE
        total, blank, others = seen.agg(F.sum("tokens"), F.coalesce(F.sum(F.when(none, F.col("tokens"))), F.lit(0)), F.sum(F.when(~none, grown))).first()
        rest = (total or 0) - blank
        want = F.when(none, F.col("tokens").cast("double")).otherwise(grown * (rest / others if others else 1.0))
    else:
        named = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
        both = seen.agg(F.sum("tokens"), F.sum(F.when(~F.col(dim).isin(*shares), F.col("tokens")))).first()
        total, rest = both[0] or 1, both[1] or 1
        left, asked = 1 - sum(shares.values()), sum(shares.values())
        if left < 1e-9 and rest < total:  # of named and others, the others have rest of total
            left = asked * rest / (total - rest)
        want = F.coalesce(F.try_element_at(named, F.col(dim)), F.lit(left) * F.col("tokens") / rest)
    rows = seen.select(dim, want.alias("goal"))
    return rows.crossJoin(rows.agg(F.sum("goal").alias("all"))).select(dim, (F.col("goal") / F.col("all")).alias("goal"))


def gathered(cells: DataFrame, n: int) -> DataFrame:
    """``cells``, of which there are ``n``, in a partition for each CELLS of them: sums and windows over one need no shuffle."""
    return cells.coalesce(n // CELLS + 1)


def rake(cells: DataFrame, goals: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE, keep: float | None = None) -> DataFrame:
    """``cells`` (dims, tokens) with ``weight``: the tokens scaled by dimension after dimension to each marginal's goal.

    Iterative proportional fitting from the observed tokens. Each step needs the sums of a dimension's categories over
    cells, of which there is one for each combination that occurs: windows in one task for at most CELLS, else an
    aggregate and an equi-join; a sweep over all dimensions is written and compared with the
    goals before the next. Weights sum to 1. Cells without tokens get weight 0. With ``keep``, the share of all tokens to
    be sampled, no cell gets more weight than its tokens can give, and the others are raked on. ``gap`` is the largest
    relative difference of a marginal from its goal that the last sweep met; raking ends at ``tolerance``, or where three
    sweeps don't lower it by a twentieth: then the goals can't all be had.
    """
    total, n = cells.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    total = float(total or 1)
    most = F.col("tokens") / F.lit(total * keep) if keep else F.lit(1.0)
    columns = [*cells.columns, "weight", "gap"]
    now = cells.withColumns({"weight": F.col("tokens") / F.lit(total), "gap": F.lit(0.0)})
    for d, goal in goals.items():
        now = now.join(goal.withColumnRenamed("goal", f"_goal_{d}"), d, "left")
    now = gathered(stage(now.select(*columns, *[f"_goal_{d}" for d in goals]), "cells", n), n)
    gap, best, stalled = float("inf"), float("inf"), 0
    for _ in range(sweeps):
        off, step = F.lit(0.0), now
        for d in goals:
            if n <= CELLS:
                step = step.withColumn("_have", F.sum("weight").over(Window.partitionBy(d)))
            else:
                step = step.join(step.groupBy(d).agg(F.sum("weight").alias("_have")), d, "left")
            step = step.withColumn(f"_r_{d}", F.col(f"_goal_{d}") / F.nullif("_have", F.lit(0.0))).drop("_have")
            step = step.withColumn("weight", F.col("weight") * F.coalesce(f"_r_{d}", F.lit(0.0)))
            off = F.greatest(off, F.abs(F.coalesce(F.col(f"_r_{d}"), F.lit(1.0)) - 1))
        step = step.withColumns({"weight": F.least("weight", most), "gap": off})
        now = gathered(stage(step.select(*now.columns), "cells", n), n)
        gap = now.agg(F.max("gap")).first()[0] or 0.0
        stalled = stalled + 1 if gap > 0.95 * best else 0
        best = min(best, gap)
        if gap <= tolerance or stalled == 3:
            break
    return now.select(*columns).withColumn("gap", F.lit(float(gap)))


def probabilities(cells: DataFrame, keep: float) -> DataFrame:
    """``cells`` with ``p``: the chance of a cell's documents, in proportion to weight over tokens and 1 at most.

    The factor is such that ``keep`` of all tokens is expected; what capped cells can't give goes to the others. It is
    found by evaluating 64 factors at once, four times over.
    """
    # A cell with weight reaches 1 at some factor; above the largest of those nothing changes.
    ends = cells.where("weight > 0").agg(F.sum("tokens"), F.max(F.col("tokens") / F.col("weight"))).first()
    if not ends[0]:
        return cells.withColumn("p", F.lit(1.0))
    goal, low, high = keep * ends[0], keep * ends[0] * 0.5, max(ends[1], keep * ends[0]) * 1.01
    for _ in range(4):
        grid = np.geomspace(low, high, 64)
        got = cells.agg(*[F.sum(F.least(F.col("tokens").cast("double"), F.col("weight") * float(x))) for x in grid]).first()
        at = int(np.searchsorted(np.array(got, float), goal))
        low, high = grid[max(0, at - 1)], grid[min(63, at)]
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") * float(high) / F.col("tokens"))).otherwise(1.0)
    return cells.withColumn("p", p)


def mix(
    docs: DataFrame, langs: dict[str, float] | None, keep: float = 0.8, source_power: float = 0.5, topic_power: float = 0.0, lang_power: float = 0.7, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """(id, source, lang, topic, tokens, weight, gap, p, sampled) for every row.

    ``weight`` is the raked share of the row's (source, lang, topic) cell, ``p`` its calibrated probability and
    ``sampled`` whether its hash falls below: the same rows each time, and all rows of an id alike. Rows of cells without
    tokens are kept (p 1, weight 0). An empty table gives an empty result.
    """
    rows = stage(describe(docs, id_col, text_col, vocabulary=vocabulary), "topics")
    dims = ["source", "lang", "topic"]
    cells = stage(rows.groupBy(*dims).agg(F.sum("tokens").alias("tokens")), "cells")
    cells = gathered(cells, cells.count())
    goals = {"source": targets(cells, "source", None, source_power), "lang": targets(cells, "lang", langs, lang_power), "topic": targets(cells, "topic", None, topic_power)}
    chance = stage(probabilities(rake(cells, goals, keep=keep), keep).drop("tokens"), "probabilities")
    return rows.join(chance, dims).select("id", *dims, "tokens", "weight", "gap", "p", (F.col("tie") < F.col("p")).alias("sampled"))


def sampled(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The sampled rows of ``docs``; rows without id stay. Only ids travel to the texts."""
    ids = mix(docs, id_col=id_col, **how).where("sampled and id is not null").select(F.col("id").alias(id_col)).distinct()
    return docs.join(ids, id_col, "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
