import numpy as np

from tidemark.llm import topk


def brute(rows, asked, k):
    ok = {i: [int(np.floor(64 * float(x))) for x in v] for i, v in rows if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = {}
    for i in asked:
        if i in ok:
            s = sorted((-sum(a * b for a, b in zip(ok[i], w)), j) for j, w in ok.items() if j != i)
            out[i] = [(j, -t) for t, j in s[:k]]
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(700, 8)) * rng.lognormal(0, 1.2, (700, 1))
    v[100:260] = v[7]  # copies: ties
    v[300:340] = v[300] * rng.uniform(0.9, 1.1, (40, 1))
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]
    rows += [(700, None), (720, [1.0] * 7 + [None]), (740, [1.0] * 7 + [float("nan")]), (760, [float("inf")] * 8), (None, [1.0] * 8), (780, [0.0] * 8)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, score int")
    for k, block, run in ((20, 64, 3), (5, 50, 1)):
        got = {}
        for r in topk.top_k(df, df.where("vec_id % 20 = 0"), k, block=block, run_of=run).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == brute(rows, range(0, 800, 20), k)


def test_few_none_and_large_values(spark):
    df = spark.createDataFrame([(0, [3e6, 1.0]), (20, [2e6, 5.0]), (21, [-1e6, 7.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), 20).collect()
    want = brute([(0, [3e6, 1.0]), (20, [2e6, 5.0]), (21, [-1e6, 7.0])], [0, 20], 20)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == {(q, n + 1, *x) for q, l in want.items() for n, x in enumerate(l)}
    none = df.where("vec_id < 0")
    assert topk.top_k(none, none).collect() == [] and topk.top_k(df, none).collect() == []
