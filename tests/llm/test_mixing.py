import numpy as np
import pandas as pd

from tidemark.llm import mixing
from tidemark.llm.common import stage


def test_raking_against_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(f"s{i}", k, f"t{t}", int(rng.integers(1, 1000))) for i in range(5) for k in ("en", "fr") for t in range(3)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    goals = {
        "source": mixing.targets(cells, "source", None, 0.5),
        "lang": mixing.targets(cells, "lang", {"en": 0.3}, 1.0),
        "topic": mixing.targets(cells, "topic", {"t0": 0.5, "gone": 0.1}, 1.0),
    }
    want = {d: g.toPandas().set_index(d)["goal"] for d, g in goals.items()}
    assert abs(want["lang"]["en"] - 0.3) < 1e-9 and all(abs(g.sum() - 1) < 1e-9 for g in want.values())
    got = mixing.rake(cells, goals, tolerance=1e-9, sweeps=30).toPandas()
    df = pd.DataFrame(rows, columns=["source", "lang", "topic", "tokens"]).assign(w=lambda x: x.tokens / x.tokens.sum())
    for _ in range(200):
        for d, g in want.items():
            df["w"] *= df[d].map(g) / df.groupby(d)["w"].transform("sum")
    both = df.merge(got, on=["source", "lang", "topic"])
    assert np.allclose(both.w, both.weight, atol=1e-6)
    p = mixing.probabilities(spark.createDataFrame(got), 0.6).toPandas()
    assert p.p.between(0, 1).all() and abs((p.p * p.tokens).sum() / p.tokens.sum() - 0.6) < 1e-3
    free = p[p.p < 1]
    assert (free.p * free.tokens / free.weight).std() < 1e-3 * (free.p * free.tokens / free.weight).mean()


def test_cells_give_no_more_than_they_have(spark):
    rows = [("a", "en", "t0", 100), ("a", "fr", "t0", 300), ("b", "en", "t0", 500), ("b", "fr", "t0", 100)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    goals = {"source": mixing.targets(cells, "source", {"a": 0.5, "b": 0.5}, 1.0), "lang": mixing.targets(cells, "lang", {"en": 0.5, "fr": 0.5}, 1.0)}
    free = mixing.rake(cells, goals).toPandas()
    assert free.gap.max() <= 1e-3 and free.groupby("source").weight.sum().sub(0.5).abs().max() < 1e-3
    capped = mixing.rake(cells, goals, keep=0.7).toPandas()
    assert (capped.weight * 0.7 * 1000 <= capped.tokens + 1e-6).all() and capped.gap.max() < 0.02
    never = mixing.rake(cells, goals, keep=0.95).toPandas()  # 475 of b's 600 and of en's 600, of 1000: can't be had
    assert never.gap.max() > 0.02 and (never.weight * 0.95 * 1000 <= never.tokens + 1e-6).all()


def test_topics_cross_languages():
    rng = np.random.default_rng(2)
    words = lambda lang, topic: [f"{lang}word{topic}{i}{'xyz'[topic % 3]}" for i in range(40)]
    shared = [[f"name{t}{i}xx" for i in range(30)] for t in range(2)]
    texts, langs, own = [], [], []
    for k in range(400):
        lang, topic = ("en", "fr")[k % 2], k // 2 % 2
        texts.append(" ".join(rng.choice(words(lang, 0) + shared[topic] * 2, 60)))
        langs.append(lang)
        own.append(topic)
    x = np.array([mixing.content(t)[0] for t in texts])
    got = mixing.Topics(x, langs, k=2).of(x, langs)
    same = np.array([(g == "t0") == (t == 0) for g, t in zip(got, own, strict=True)])
    assert max(same.mean(), 1 - same.mean()) > 0.95
    assert mixing.Topics(x, langs).of(np.zeros((1, mixing.TERMS), np.float32), ["en"]) == [mixing.NONE]


def test_sample_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs, langs={"en": 0.4, "fr": 0.3}, keep=0.5).toPandas()
    assert len(got) == docs.count()
    assert abs(got[got.sampled].tokens.sum() / got.tokens.sum() - 0.5) < 0.08
    again = mixing.mix(docs.repartition(5), langs={"en": 0.4, "fr": 0.3}, keep=0.5).toPandas()
    assert set(got[got.sampled].id) == set(again[again.sampled].id)


def test_edge_cases(spark):
    rows = [(1, None, "a", "en"), (2, "", None, None), (None, "word words", "a", "en"), (3, "word " * 100000, "b", "fr"), (3, "word " * 100000, "b", "fr"), (4, "a b", "a", "en")]
    df = spark.createDataFrame([(*r, 1, 1.0) for r in rows], "doc_id long, text string, source string, lang string, tokens int, p double")
    got = mixing.mix(df, langs=None).collect()
    assert len(got) == 6 and all(0 <= r.p <= 1 for r in got) and len({r.sampled for r in got if r.id == 3}) == 1
    left = mixing.sampled(df, langs=None, keep=1.0)
    assert left.columns == df.columns and left.where("doc_id is null").count() == 1
    empty = df.limit(0)
    assert mixing.mix(empty, langs=None).collect() == [] and mixing.sampled(empty, langs=None).collect() == []


def test_topics_come_from_every_text(spark):
    """More texts than a sample of 4,000 would hold; the last tenth has words of its own. However rows are dealt, the same topics."""
    rng = np.random.default_rng(4)
    words = [[f"topic{t}word{i}" for i in range(30)] for t in range(3)]
    rows = [(i, " ".join(rng.choice(words[2 if i >= 5400 else i % 2], 25)), ("en", "fr")[i // 2 % 2], "a") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {n: {r.id: r.topic for r in mixing.describe(df.repartition(n)).collect()} for n in (2, 9)}
    assert got[2] == got[9] and len(got[2]) == 6000
    x = [mixing.packed(mixing.content(t)[0]) for _, t, _, _ in rows]
    learned = mixing.Topics(None, None, every=mixing.Every(spark.createDataFrame([(r[2], b) for r, b in zip(rows, x, strict=True)], "lang string, x binary")))
    here = mixing.Topics(None, None, every=mixing.Here(x, [r[2] for r in rows]))
    assert np.array_equal(learned.idf, here.idf) and np.allclose(learned.centre, here.centre)
    counts = sum(np.frombuffer(b[: len(b) // 6 * 2], "<u2").size for b in x)
    assert round(float((6000 / np.expm1(learned.idf) - 1).sum())) == counts


def test_few_cells_are_raked_without_a_shuffle(spark, monkeypatch):
    """What one task holds isn't dealt out or broadcast in every sweep, which fills the driver; both ways give the same weights."""
    rows = [(f"s{i % 7}", ["en", "fr", "de"][i % 3], f"t{i % 5}", 10 + i * i % 97) for i in range(105)]
    cells = stage(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long"), "t")
    goals = {"source": mixing.targets(cells, "source", None, 0.5), "lang": mixing.targets(cells, "lang", {"en": 0.5, "fr": 0.3}, 1.0), "topic": mixing.targets(cells, "topic", None, 0.0)}
    plans = []
    monkeypatch.setattr(mixing, "stage", lambda df, name, n=None: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stage(df, name, n))
    found = []
    for most in (mixing.CELLS, 50):
        monkeypatch.setattr(mixing, "CELLS", most)
        plans.clear()
        found.append({(r.source, r.lang, r.topic): (r.weight, r.gap) for r in mixing.rake(cells, goals, tolerance=1e-9, keep=0.9).collect()})
        assert len(plans) > 2 and any("Exchange" in p for p in plans[1:]) == (most == 50)
    assert found[0].keys() == found[1].keys() and len(found[0]) == 105
    assert all(abs(a - b) < 1e-9 for k in found[0] for a, b in zip(found[0][k], found[1][k], strict=True))
