import numpy as np
import pytest

from tidemark.llm import itq


def brute(rows, least):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([v / np.linalg.norm(v) for _, v in ok])
    near = x @ x.T >= least
    comp = [i for i, _ in ok]
    for _ in ok:
        comp = [min(c for c, n in zip(comp, row) if n) for row in near]
    out = {i: (0, i) for i, _ in rows}
    return out | {i: (int(row.sum()) - 1, c) for (i, _), row, c in zip(ok, near, comp)}


@pytest.mark.parametrize("bucket", [4096, 8])
def test_recall_components_and_counts(spark, bucket):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 32))
    for at in range(0, 200, 10):
        v[at : at + 10] = v[at] + rng.normal(size=(10, 32)) * 0.08
    v[300:330] = v[300]
    v[330] = v[300] * 3
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (401, [0.0] * 32), (402, [None] + [1.0] * 31), (403, [float("nan")] * 32)]
    df = spark.createDataFrame([(*r, 9, 9) for r in rows], "vec_id long, embedding array<double>, code int, mult int")
    got = {r.id: (r.n_links, r.component) for r in itq.near_duplicates(df, 0.9, bucket=bucket).collect()}
    want = brute(rows, 0.9)
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in got)  # nothing below the threshold
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert sum(got[i][1] == want[i][1] for i in got) >= 0.98 * len(got)
    assert got[305] == (30, 300) and got[330] == (30, 300) and got[401] == (0, 401)


def test_empty_null_id_and_repeats(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert itq.near_duplicates(df).collect() == []
    v = [1.0, 2.0, -1.0] + [0.5] * 13
    named = spark.createDataFrame([("b", v), ("a", v), ("c", [1.0] * 16)], "vec_id string, embedding array<float>")
    assert sorted((r.id, r.n_links, r.component) for r in itq.near_duplicates(named).collect()) == [("a", 1, "a"), ("b", 1, "a"), ("c", 0, "c")]
    df = spark.createDataFrame([(None, v), (5, v), (5, v), (7, [1.0] * 3)], "vec_id long, embedding array<float>")
    got = sorted((r.id or 0, r.n_links, r.component, r.kept) for r in itq.near_duplicates(df).collect())
    assert got == [(0, 0, None, True), (5, 1, 5, True), (5, 1, 5, True), (7, 0, 7, True)]


@pytest.mark.parametrize("d", [32, 64])
def test_recall_near_the_threshold(spark, d):
    """Partners at fixed cosines from the threshold on, each found but for a few in a hundred."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    n, at = 1500, (0.901, 0.92, 0.94)
    base = unit(rng.normal(size=(n, d)))
    side = rng.normal(size=(n, d))
    side = unit(side - (side * base).sum(1, keepdims=True) * base)
    cos = np.array([at[i % 3] for i in range(n)])[:, None]
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * side]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    comp = {r.id: r.component for r in itq.near_duplicates(df, 0.9).collect()}
    for k, c in enumerate(at):
        found = np.mean([comp[i] == comp[i + n] for i in range(k, n, 3)])
        print(d, c, found)
        assert found >= 0.95
