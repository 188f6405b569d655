import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import contextmix as cm
from tidemark.llm import queries


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def base(texts, held):
    c = Counter(t for x, h in zip(texts, held, strict=True) if not h for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return [(len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x))) for x in texts]


def test_counts_and_base_against_brute_force_and_gain_on_held_out_texts(spark):
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    held = [zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows]
    want = {r.doc_id: (h, *b) for r, h, b in zip(rows, held, base([r.text for r in rows], held), strict=True)}
    got = queries.op13_lm(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and r.base_score == pytest.approx(w[4], rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out), (sum(r.score for r in out), sum(r.base_score for r in out))


def small(words, codes, tables):
    """One text, a decision at a time, by plain floats; it learns in the operator's steps."""
    w = {(g, k): float(cm.START[g, k]) for g in range(cm.GATES) for k in range(cm.ALL)}
    out, seen, extra, before, at, width = [], Counter(), Counter(), "", 0, 8
    while at < len(words):
        move, shift = Counter(), Counter()
        for word in words[at : at + width]:
            one = cm.Written.of(pa.array([word, before]), codes)
            cost = 0.0
            for i in range(int(one.first[1])):
                x = [float(tables[k][one.slots[k][i]]) / cm.STEP for k in range(cm.INSIDE)]
                across = int(tables[cm.INSIDE][one.slots[cm.INSIDE][i] ^ one.own[1]]) if one.near[i] else 0
                x.append(across / cm.STEP)
                g = 2 * int(tables[cm.ALL][one.slots[cm.INSIDE - 1][i]]) + (across != 0)
                z = min(7.99, max(-7.99, sum(w[g, k] * x[k] for k in range(cm.ALL))))
                cell, bit = int((z + 8) * 2), int(one.bit[i])
                p = 1 / (1 + math.exp(-z - extra[g, cell]))
                cost += math.log(p if bit else 1 - p)
                seen[g] += 1
                shift[g, cell] += bit - p
                for k in range(cm.ALL):
                    move[g, k] += (bit - p) * x[k]
            out.append(cost)
            before = word
        for (g, k), d in move.items():
            w[g, k] += min(0.3, max(-0.3, cm.RATE / math.sqrt(1 + seen[g] / 64) * d))
        for c, d in shift.items():
            extra[c] += min(0.2, max(-0.2, cm.MAP_RATE * d))
        at, width = at + width, min(128, width if at == 0 else 2 * width)
    return out


def test_mixing_of_many_texts_is_that_of_each_alone_and_probabilities_sum_to_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    model = cm.learn(docs, F.lit(True))
    tables = model.tables.value
    texts = pa.array(["le la de " * 30 + "Zzyzx", None, "", *[r.text[:300] for r in docs.limit(4).collect()]])
    t = cm.Words.of(texts)
    got = cm.mixed(t, cm.Written.of(t.distinct, model.codes), tables)
    for i, text in enumerate(texts.to_pylist()):
        want = small([w or "" for w in tokens(text)], model.codes, tables)
        np.testing.assert_allclose(got[t.ends[i] : t.ends[i + 1]], want, rtol=2e-3, atol=2e-3)
    # whatever the decisions' probabilities, those of all bytes after a byte sum to 1
    c, p = model.codes, np.random.default_rng(1).uniform(0.05, 0.95, cm.SLOTS)
    for before in (ord("e"), cm.SPACE, 200):
        pairs = range(256 * before, 256 * before + 256)
        ways = [range(int(c.first[i]), int(c.first[i] + c.size[i])) for i in pairs]
        assert sum(math.prod(p[c.slot[k]] if c.bit[k] else 1 - p[c.slot[k]] for k in way) for way in ways) == pytest.approx(1)
    score = {r.id: r.bits_per_byte for r in cm.score(docs, model).collect()}
    assert 0 < np.mean(list(score.values())) < 3


def test_odd_rows(spark):
    rows = [(1, "a b", 1), (2, None, 1), (3, "", 1), (4, " \n", 1), (None, "a", 1), (None, "a", 1), (1, "a b", 2), (5, "É x\x0by " * 200_000, 1), (6, "q" * 70_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, known int").repartition(3)
    for train in (F.col("doc_id") > 0, F.lit(False)):
        got = cm.score(df, cm.learn(df, F.coalesce(train, F.lit(False)))).collect()
        assert len(got) == len(rows) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
        assert sorted(r.n_tokens for r in got) == [1, 1, 1, 2, 2, 2, 3, 3, 600_001]
        for same in ([r for r in got if r.id == 1], [r for r in got if r.id is None]):
            assert len({(round(r.score, 9), r.n_known) for r in same}) == 1
    none = df.where("doc_id = 99")
    assert cm.score(none, cm.learn(none, F.lit(True))).collect() == []
