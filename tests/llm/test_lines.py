import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import lines


def brute(rows, least=0.8):
    """kept of each (doc, line), by comparing all distinct lines."""
    at, sets = {}, {}
    for d, t in rows:
        for n, x in enumerate((t or "").split("\n")):
            x = x.strip().lower()
            if d is not None and x:
                at.setdefault(x, []).append((d, n))
                sets[x] = {x[i : i + 5] for i in range(len(x) - 4)}
    names = list(sets)
    comp = dict.fromkeys(names)
    same = lambda a, b: a == b or bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])
    for i, a in enumerate(names):
        if comp[a] is None:
            comp[a], todo = i, [a]
            while todo:
                u = todo.pop()
                for v in names:
                    if comp[v] is None and same(u, v):
                        comp[v] = i
                        todo.append(v)
    first = {}
    for x, places in at.items():
        first[comp[x]] = min([first.get(comp[x], (1 << 60, 0)), *places])
    return {p: p == first[comp[x]] for x, places in at.items() for p in places}


def corpus(n=60, seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    base = [" ".join(word() for _ in range(r.randint(8, 30))) for _ in range(40)]
    rows = []
    for d in range(n):
        out = []
        for _ in range(r.randint(1, 6)):
            x = r.choice(base).split()
            for _ in range(r.choice([0, 0, 1, 1, 2, 9])):
                x[r.randrange(len(x))] = word()
            out.append(("  " if r.random() < 0.1 else "") + " ".join(x).capitalize())
        rows.append((d, "\n".join([*out, "Short line.", r.choice(["abc", "abcde", "***", "word %d" % r.randint(0, 9)]), ""])))
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, line int, id string").repartition(3)
    for bucket in (1000, 5):
        got = {(r.doc, r.line): r.kept for r in lines.duplicate_lines(df, bucket=bucket).collect()}
        assert got.keys() == want.keys()
        assert sum(got[k] != want[k] for k in got) <= 0.02 * len(got)  # banding finds 98.5 % at the very threshold, more above


def test_edge_cases(spark):
    assert {(r.doc, r.line) for r in lines.duplicate_lines(spark.createDataFrame([(1, "ab\nlonger line")], "doc_id int, text string"), shortest=3).collect()} == {(1, 1)}
    same = "the very same line of text here"
    long = "x y z " * 100000
    rows = [(1, None), (2, ""), (3, same), (4, same.upper() + "\nand another quite different line"), (4, same.upper() + "\nand another quite different line"), (None, same), (5, long), (6, long), (7, "\n\n" + same)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, kept int")
    got = {(r.doc, r.line): (r.kept, r.first_doc) for r in lines.duplicate_lines(df).collect()}
    assert got == {(3, 0): (True, 3), (4, 0): (False, 3), (4, 1): (True, 4), (5, 0): (True, 5), (6, 0): (False, 5), (7, 2): (False, 3)}
    left = lines.without_duplicate_lines(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in left.collect()) == [(0, same[:5]), (1, ""), (2, ""), (3, same[:5]), (4, "and a"), (4, "and a"), (5, long[:5])]
    empty = df.limit(0)
    assert lines.duplicate_lines(empty).collect() == [] and lines.without_duplicate_lines(empty).collect() == []


def test_band_keys_do_not_depend_on_neighbours():
    some = ["a" * 25, "the quick brown fox jumps over", "é" * 30 + "abcdefgh", "the quick brown fox jumps over it"]
    whole = lines.band_keys(some)
    assert all((lines.band_keys([x]) == whole[i]).all() for i, x in enumerate(some))
    assert (whole[1] == whole[3]).any() and not (whole[0] == whole[1]).any()


def pair(rng, jaccard, n=800):
    """Two random texts of that Jaccard similarity or very little more: characters far from each other are changed."""
    a = list(map(chr, rng.integers(97, 123, n)))
    b = list(a)
    for at in rng.choice(np.arange(5, n - 5, 10), int((n - 4) * (1 - jaccard) / (1 + jaccard) / 5), replace=False):
        b[at] = "#"
    return "".join(a), "".join(b)


def test_recall_of_bands():
    rng = np.random.default_rng(0)
    for at, least in ((0.80, 0.97), (0.82, 0.985), (0.84, 0.99), (0.86, 0.995), (0.88, 0.995), (0.90, 0.995)):
        pairs = [pair(rng, at) for _ in range(500)]
        assert all(lines.near(*p, at) for p in pairs[:20]) and not any(lines.near(*p, at + 0.02) for p in pairs[:20])
        k = lines.band_keys([x for p in pairs for x in p])
        assert (k[::2] == k[1::2]).any(1).mean() >= least


def test_units_hold_every_pair():
    rng = np.random.default_rng(1)
    texts, unit = [], []
    for u, n in enumerate((2, 3, 12, 13, 40, 2, 30)):
        base = pair(rng, 0.9, 250)[0]
        for _ in range(n):
            t = list(base)
            for at in rng.integers(0, len(t), int(rng.integers(0, 9))):
                t[at] = "#"
            texts.append("".join(t))
            unit.append(u)
    unit, side = np.array(unit), np.zeros(len(unit), int)
    for side in (np.zeros(len(unit), int), rng.integers(0, 2, len(unit))):
        got = lines.compare_units(texts, unit, side, 0.8)
        for u in set(unit.tolist()):
            own = np.flatnonzero(unit == u)
            two = len(set(side[own].tolist())) > 1
            want = np.array(own)
            for _ in own:
                for i in range(len(own)):
                    for j in range(len(own)):
                        if (not two or side[own[i]] != side[own[j]]) and lines.near(texts[own[i]], texts[own[j]], 0.8):
                            want[i] = want[j] = min(want[i], want[j])
            assert (got[own] == want).all()


def test_many_copies_of_one_line(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("one line that very many documents hold")).otherwise(F.concat(F.lit("line number "), F.repeat(F.md5(F.col("id").cast("string")), 2))).alias("text"))
    got = lines.duplicate_lines(df)
    assert got.count() == 3000 and got.where("kept").count() == 1001
