import duckdb
import numpy as np
import pytest

from tests.conftest import SF
from tests.test_queries import plain
from tidemark.llm import periodic, queries


def brute(w, least=6, times=4):
    """Maximal runs by looking at every period and place."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def test_catchers_give_the_runs_of_brute_force_however_words_come():
    rng = np.random.default_rng(3)
    for k in range(600):
        n, letters = int(rng.integers(0, 130)), int(rng.integers(1, 4))
        w = rng.integers(0, letters, n)
        for _ in range(int(rng.integers(0, 3))):  # repeat a tail, runs inside of runs too
            if n > 8:
                a = int(rng.integers(0, n - 4))
                p = 1 + int((n - a) / (3 + rng.integers(0, 8)))
                w = np.array([w[i] if i < a else w[a + (i - a) % p] for i in range(n)])
        want = brute(w.tolist())
        for step in (1, 5, 1000) if k % 6 == 0 else (40,):
            c = periodic.Catchers()
            for at in range(0, n, step):
                c.append(w[at : at + step].astype(np.int64))
            assert [tuple(map(int, r)) for r in c.runs()] == want


def test_long_sequences():
    n = 300_000
    for v, want in ((np.zeros(n), [(0, n, 1)]), (np.arange(n) % 1000, [(0, n, 1000)]), (np.arange(n), []), (np.array([bin(i).count("1") % 2 for i in range(1 << 15)]), [])):
        c = periodic.Catchers()
        for at in range(0, len(v), 1 << 14):
            c.append(v[at : at + (1 << 14)].astype(np.int64))
        assert [tuple(map(int, r)) for r in c.runs()] == want
    with pytest.raises(ValueError):
        periodic.Catchers(exponent=3)


def test_texts(spark):
    rows = [
        (1, "a b " * 5, "x"), (2, None, "x"), (3, "", "x"), (4, " \t\n ", "x"), (None, "q q q q q q", "x"), (1, "a b " * 5, "y"), (5, "go " * 5, "x"),
        (6, "\x0bo\x0c" + "x\u00a0y z\r\n" * 300_000, "x"), (7, "one two " + "r s t " * 4 + "u " * 7 + "end", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.word_runs(df).collect()), key=str)
    want = []
    for i, text, _ in rows:
        w = __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = brute(w) if len(w) < 1000 else [(1, 600_000, 2)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(want, key=str)
    assert periodic.word_runs(df.where("doc_id = 99")).collect() == []


def test_query_against_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = queries.op11_periodic(spark, SF).toPandas(), c.execute(queries.OP11).df()
    assert plain(got) == plain(want) and (got.n_runs > 0).any()
