import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash


def brute(texts, n=3, most=2):
    fps = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    comp = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if bin(fps[i] ^ fps[j]).count("1") <= most:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    return fps, comp


def test_against_brute_force_with_edge_cases(spark):
    base = "one two three four five six seven eight nine ten " * 20
    texts = [None, "", " \n", "One", "one", base, base + "x", base.upper(), "é É", "a b", base + "y z"] + [
        f"{base} tail {i}" for i in range(12)
    ]
    fps, comp = brute(texts)
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, fp int, path int, component int")
    got = {r.id: (r.fp % (1 << 64), r.component) for r in simhash.simhash_groups(docs).collect()}
    assert got == {i: (f, c) for i, (f, c) in enumerate(zip(fps, comp))}


def test_hot_buckets_are_dealt_anew_and_lose_no_link(spark):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.int64)
    flips = [c ^ (1 << int(a)) ^ (1 << int(b)) for c in centre.tolist() for a, b in rng.integers(0, 40, (60, 2))]
    fps = sorted(set(flips + rng.integers(0, 1 << 63, 100, dtype=np.int64).tolist()))
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = simhash.link_fingerprints(df, 2, bucket=16).collect()
    at = {f: i for i, f in enumerate(fps)}
    whole = simhash.roots(len(fps), np.array([at[e.src] for e in edges]), np.array([at[e.dst] for e in edges]))
    x = np.array(fps).view(np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= 2, 1))
    assert (whole == simhash.roots(len(fps), i, j)).all()
    assert all(bin((e.src ^ e.dst) & (2**64 - 1)).count("1") >= 1 for e in edges)


def test_empty_null_id_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(empty).collect() == []
    rows = spark.createDataFrame([(None, "a b c d"), (2, "a b c d"), (2, "a b c d"), (1, "q r s t u")], "doc_id long, text string")
    got = sorted((r.id or -1, r.component) for r in simhash.simhash_groups(rows).collect())
    assert got == [(-1, None), (1, 1), (2, 2), (2, 2)]
    kept = simhash.one_of_each_group(rows.withColumn("u", F.lit(1)), n=3)
    assert kept.columns == ["doc_id", "text", "u"] and kept.count() == 4


def near_brute(rows, n=5, least=0.8):
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or {tuple(w)}
    comp = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if comp[a] != comp[b]:
                comp[a] = comp[b] = min(comp[a], comp[b])
                changed = True
    return comp, pairs


def test_near_groups_against_brute_force(spark):
    rng, rows = np.random.default_rng(9), []
    for _ in range(100):  # pairs at Jaccard 0.65 to 0.97, most near the threshold
        words = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        rows.append((len(rows), " ".join(words)))
        for k in rng.choice(150, int(rng.integers(1, 5)), replace=False):
            words[k] = f"z{rng.integers(0, 5000)}"
        rows.append((len(rows), " ".join(words)))
    base = [f"b{x}" for x in rng.integers(0, 5000, 60)]
    for _ in range(40):  # one large group of near copies
        words = list(base)
        words[int(rng.integers(60))] = f"y{rng.integers(0, 5000)}"
        rows.append((len(rows), " ".join(words)))
    rows += [(len(rows), "a b"), (len(rows) + 1, "A  b"), (len(rows) + 2, "a b c")]
    want, pairs = near_brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for group in (500, 7):
        got = {r.id: r.component for r in simhash.near_groups(df, most=6, group=group).collect()}
        assert got.keys() == want.keys()
        assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
        assert all(want[i] == want[c] for i, c in got.items())  # nothing below the threshold
    far = [(a, b) for a, b in pairs if a % 2 == 0 and b == a + 1 and a < 200]
    close = {r.id: r.component for r in simhash.simhash_groups(df, most=6, n=5).collect()}
    assert sum(close[a] == close[b] for a, b in far) < 0.8 * len(far)  # fingerprints alone lose many of them


def test_close_fingerprints_alone_do_not_link(spark):
    rng = np.random.default_rng(2)
    common = "five words come again here " * 60  # one repeated run decides all votes, the sets differ
    rows = [(i, common + " ".join(f"q{x}" for x in rng.integers(0, 9999, 20))) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({r.component for r in simhash.simhash_groups(df, most=6, n=5).collect()}) < 6
    assert near_brute(rows)[0] == {r.id: r.component for r in simhash.near_groups(df, most=6).collect()} == {i: i for i in range(6)}
    assert simhash.one_of_each_group(df, most=6, n=5).count() == 6
