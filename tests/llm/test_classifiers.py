import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import langid, quality, queries, terms


def test_language_of_held_out_documents(spark):
    got = queries.op8_language(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs) and both.score.between(0, 1).all()
    held = both[both.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97


def test_language_edge_cases(spark):
    model = langid.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), F.lit(True))
    rows = [(1, None), (2, ""), (3, "12 3!"), (4, "the and of to in is " * 50000), (5, "é"), (None, "the and of"), (1, None)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang_pred string, score double")
    got = langid.identify(df, model).collect()
    assert len(got) == 7 and sum(r.lang_pred == "und" for r in got) == 4
    assert {r.lang_pred for r in got if r.id == 4} == {"en"}
    none = df.limit(0).withColumn("lang", F.lit("en"))
    assert langid.learn(none, F.lit(True)) is None
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"} and langid.identify(none, model).count() == 0


def test_unknown_codes_and_pairs():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.eye(8, dtype=np.float32)[k] + rng.normal(size=(30, 8)).astype(np.float32) * 0.1 for k in range(4)])
    langs = np.repeat(np.array(["en", "de", "zz", "fr"], object), 30)
    model = langid.Hierarchy(x, langs)
    assert set(model.families) == {"germanic", "romance", "other-zz"} and set(model.pairs) == {("de", "en")}
    assert (np.array(model.predict(x)[0]) == langs).mean() > 0.98


def test_votes_of_pairs_by_a_plain_loop():
    rng = np.random.default_rng(4)
    names = ["en", "de", "nl", "sv", "fr", "es", "it", "xx"]
    x = np.concatenate([np.eye(12, dtype=np.float32)[k] + rng.normal(size=(25, 12)).astype(np.float32) * 0.3 for k in range(8)])
    model = langid.Hierarchy(x, np.repeat(np.array(names, object), 25))
    got, sure = model.predict(x)
    one = np.c_[x, np.ones(len(x))]
    for i, row in enumerate(one):
        tops = {f: float(row @ model.top[k]) for k, f in enumerate(model.families)}
        family = max(tops, key=tops.get)
        votes = dict.fromkeys(model.families[family], 0.0)
        margin = {}
        for (a, b), w in model.pairs.items():
            if a in votes:
                m = float(row @ w)
                votes[a] += (m >= 0) + 1e-3 * np.tanh(m)
                votes[b] += (m < 0) - 1e-3 * np.tanh(m)
                margin[a], margin[b] = min(margin.get(a, m), m), min(margin.get(b, -m), -m)
        best = max(votes, key=votes.get)
        assert got[i] == best and 0 <= sure[i] <= 1
        want = 1 / (1 + np.exp(-4 * tops[family]))
        want *= 1 / (1 + np.exp(-4 * margin[best])) if best in margin else 1
        assert abs(sure[i] - want) < 1e-6
    assert len(model.pairs) == 6 + 3


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_quality(spark, sf).toPandas()
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    held = got.merge(labels, on="doc_id").query("held_out")
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and got.score.between(0, 1).all()
    assert (held.predicted == held.quality).mean() > 0.95
    assert (got.predicted == (got.score >= 0.3)).all()


def test_votes_are_exact():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 60)).astype(np.float32)
    model = quality.Neighbours(x, (x[:, 0] > 0).astype(int), np.ones(200), k=7, words=20)
    q = rng.normal(size=(20, 60)).astype(np.float32)
    u = model._unit(q).astype(float)
    for i, s in enumerate(model.score(q)):
        sim = u[i] @ model.vec.T.astype(float)
        near = np.argsort(-sim)[:7]
        w = np.maximum(sim[near], 0) ** 8
        assert abs(s - ((w * model.label[near]).sum() + 1e-3 * model.prior) / (w.sum() + 1e-3)) < 1e-4


def test_words_are_hashed_wherever_they_stand():
    count = lambda data, least=1: terms.word_counts(data, 512, least)
    (one, n), (two, m) = count(b"alpha beta"), count(b"  beta\nalpha\talpha ")
    assert n == one.sum() == 2 and m == two.sum() == 3 and (two >= one).all() and count(b"")[1] == 0
    assert count(b"alpha beta", 5)[0].sum() == 1 and count(b"alpha beta", 5)[1] == 2
    assert (count(b"alpha beta " * 200_000)[0] == one * 200_000).all() and count(b"x" * 3_000_000)[1] <= 3


def test_words_count_in_quality():
    """Texts of one shape that differ in their words alone are told apart."""
    rng = np.random.default_rng(3)
    words = [["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)] for _ in range(2)]
    texts = [" ".join(rng.choice(words[k % 2], 40)) for k in range(400)]
    x, y = np.stack([quality.describe(t) for t in texts]), np.arange(400) % 2
    model = quality.Neighbours(x[:300], y[:300], np.ones(300))
    assert ((model.score(x[300:]) >= 0.5) == y[300:]).mean() > 0.97


def test_quality_edge_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn(docs, labels, lambda i: F.lit(True))
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a"), (3, "word " * 300000)], "doc_id long, text string").withColumn("score", F.lit(1))
    got = {(r.id, round(r.score, 6)) for r in quality.score(df, model).collect()}
    assert len(got) == 4 and len({s for i, s in got if i in (1, 2)}) == 1 and all(0 <= s <= 1 for _, s in got)
    assert quality.learn(docs, labels.limit(0), lambda i: F.lit(True)) is None
    assert {r.score for r in quality.score(df, None).collect()} == {0.5} and quality.score(df.limit(0), model).count() == 0
