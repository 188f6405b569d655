"""Exact top-k by inner product: vectors grouped by length, groups pruned by local cosine thresholds, products verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pick, stage

#: Vectors in a packed block; buckets that one task walks for one block of queries.
BLOCK, RUN = 2048, 64
#: Local cosine thresholds from here on are pruned by coordinates, below by length alone.
STEEP, FOCUS = 0.6, 3


def usable(vec):
    """A vector that is neither null nor holds null, NaN or infinite components, as a Column."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True))


def scaled(vec, scale: float):
    """Components as integers, floor(scale * x) with x as double."""
    return F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def pack(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """(bucket, n, d, ids, vecs, top): blocks of at most ``block`` rows of (id, v) in order of falling length.

    Rows are dealt by ranges of the squared length, ties by a hash of the id, so that many equal lengths spread.
    """
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = vectors.withColumn("norm", norm).withColumn("tie", F.xxhash64("id"))
    dealt = rows.repartitionByRange(F.desc("norm"), "tie").sortWithinPartitions(F.desc("norm"), "tie")

    def run(batches):
        ids, vecs = [], []
        for b in batches:
            for i in range(0, b.num_rows, block):
                part = b.slice(i, block)
                ids += part.column("id").to_pylist()
                vecs += part.column("v").to_pylist()
                while len(ids) >= block:
                    yield _packed(ids[:block], vecs[:block])
                    del ids[:block], vecs[:block]
        if ids:
            yield _packed(ids, vecs)

    blocks = dealt.select("id", "v").mapInArrow(run, "n int, d int, ids binary, vecs binary, top double")
    return stage(blocks.withColumn("bucket", F.monotonically_increasing_id()), "blocks")


def _packed(ids, vecs) -> pa.RecordBatch:
    d = max(map(len, vecs))
    m = np.zeros((len(vecs), d), np.int64)
    for r, v in zip(m, vecs, strict=True):
        r[: len(v)] = v  # a component that is missing counts as zero
    if m.size and np.abs(m).max() < 1 << 31:
        m = m.astype(np.int32)
    norm = np.sqrt((m.astype(np.float64) ** 2).sum(1))
    return pa.RecordBatch.from_pydict(
        {"n": pa.array([len(ids)], pa.int32()), "d": pa.array([d], pa.int32()), "ids": [np.array(ids, np.int64).tobytes()], "vecs": [m.tobytes()], "top": [float(norm.max(initial=0.0))]}
    )


class Block:
    """A packed block in a task: ids, integer vectors, lengths."""

    def __init__(self, n: int, d: int, ids: bytes, vecs: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        kind = np.int64 if n * d and len(vecs) == 8 * n * d else np.int32
        self.v = np.frombuffer(vecs, kind).reshape(n, d)
        self.norm = np.sqrt((self.v.astype(np.float64) ** 2).sum(1))
        self.as_kind = {}

    def of(self, kind, d: int) -> np.ndarray:
        """Vectors of type ``kind``, with zeros up to ``d`` components."""
        if (kind, d) not in self.as_kind:
            self.as_kind = {(kind, d): np.pad(self.v, ((0, 0), (0, d - self.v.shape[1]))).astype(kind)}
        return self.as_kind[kind, d]


class Best:
    """The k best (score, id) of each query so far: higher scores first, ties to smaller ids."""

    def __init__(self, queries: Block, k: int, least: np.ndarray | None = None):
        n = len(queries.ids)
        self.q, self.k = queries, k
        self.row, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf) if least is None else least.astype(np.float64)

    def look(self, b: Block) -> None:
        """Take a bucket in: its vectors whose products can still count are found, verified and merged."""
        q, d = self.q, max(self.q.v.shape[1], b.v.shape[1])
        top, bound = b.norm.max(initial=0.0), q.norm * b.norm.max(initial=0.0)
        slack = 1e-9 * bound + 1e-9
        live = np.flatnonzero(bound + slack >= self.least)
        if not len(live) or not len(b.ids):
            return
        reach = q.norm.max() * top  # no partial sum is larger: the type's integers are exact up to here
        kind = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64
        x, y = q.of(kind, d), b.of(kind, d)
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(bound[live] > 0, self.least[live] / bound[live], -1.0)
        steep = local >= STEEP
        found = [self._by_length(live[~steep], x, y, b), *(self._by_coordinates(i, t, x, y, b) for i, t in zip(live[steep], local[steep], strict=True))]
        row, at, score = (np.concatenate(z) for z in zip(*found, strict=True))
        other = b.ids[at] != q.ids[row]
        self._merge(row[other], score[other], b.ids[at[other]])

    def _by_length(self, live, x, y, b):
        """Products with the prefix of the bucket that is long enough for some live query."""
        if not len(live):
            return (np.zeros(0, np.int64),) * 3
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(q := self.q.norm[live], self.least[live] / q, -np.inf).min() if len(live) else -np.inf
        n = int(np.searchsorted(-b.norm, -(need - 1e-9 * abs(need) - 1e-9), side="right")) if np.isfinite(need) else len(b.ids)
        if not n:
            return (np.zeros(0, np.int64),) * 3
        s = x[live] @ y[:n].T
        own = b.ids[None, :n] == self.q.ids[live][:, None]
        s = np.where(own, -np.inf, s) if s.dtype.kind == "f" else np.where(own, np.iinfo(np.int64).min, s)
        kth = np.partition(s, n - self.k, axis=1)[:, n - self.k] if n > self.k else s.min(1)
        r, c = np.nonzero((s >= kth[:, None]) & (s >= self.least[live][:, None]) & ~own)
        return live[r], c, s[r, c].astype(np.int64)

    def _by_coordinates(self, i, t, x, y, b):
        """Products with vectors whose largest-weight coordinates lie where a cosine of ``t`` is still possible."""
        t = min(float(t), 1.0) - 1e-9
        unit = x[i].astype(np.float64) / self.q.norm[i]
        ok = self.q.norm[i] * b.norm + 1e-6 >= self.least[i]
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            lean, half = t * unit[f], np.sqrt(max(0.0, (1 - t * t) * (1 - unit[f] ** 2))) + 1e-6
            low, high = -1.0 if t < -unit[f] else lean - half, 1.0 if t < unit[f] else lean + half
            share = y[:, f] / np.where(b.norm > 0, b.norm, 1)
            ok &= (share >= low - 1e-6) & (share <= high + 1e-6)
        c = np.flatnonzero(ok)
        s = (y[c] @ x[i]).astype(np.int64)
        good = s >= self.least[i]
        return np.full(int(good.sum()), i), c[good], s[good]

    def _merge(self, row, score, ids) -> None:
        row, score, ids = np.r_[self.row, row], np.r_[self.score, score], np.r_[self.id, ids]
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        start = np.searchsorted(row, np.arange(len(self.q.ids)))
        place = np.arange(len(row)) - start[row]
        keep = place < self.k
        last = np.flatnonzero(place == self.k - 1)
        self.least[row[last]] = np.maximum(self.least[row[last]], score[last])
        self.row, self.score, self.id = row[keep], score[keep], ids[keep]


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, block: int = BLOCK, run_of: int = RUN
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest integer inner products of each query with all other rows.

    Ties go to smaller ids; a query has fewer rows if there are fewer others. Null vectors, vectors holding null or
    non-finite components and rows without id take no part; a query id that repeats is asked once (the larger vector);
    missing trailing components count as zero. No rows or no queries give an empty result.

    The candidates are packed into buckets of falling length. Each block of queries first meets the bucket of the longest
    vectors (one row, broadcast: at most ``block`` vectors), which gives each query a threshold. Then (block, bucket)
    pairs whose lengths can't reach the smallest threshold of the block are dropped; for the rest a task walks up to
    ``run_of`` buckets in order, tightening thresholds as it goes, and passes on at most ``k`` rows a query.
    """
    ready = lambda df: pick(df, id=id_col, v=vec_col).where(F.col("id").isNotNull() & usable(F.col("v")))
    c = pack(ready(vectors).withColumn("v", scaled(F.col("v"), scale)), block)
    asked = ready(queries).groupBy("id").agg(F.max("v").alias("v")).withColumn("v", scaled(F.col("v"), scale))
    q = pack(asked, block).withColumnsRenamed({"bucket": "qb", "top": "q_top"})

    first = c.orderBy(F.desc("top"), "bucket").limit(1).select(*[F.col(x).alias(f"c_{x}") for x in ("n", "d", "ids", "vecs")])

    def seed(batches):
        for b in batches:
            for r in b.to_pylist():
                best = Best(Block(r["n"], r["d"], r["ids"], r["vecs"]), k)
                best.look(Block(r["c_n"], r["c_d"], r["c_ids"], r["c_vecs"]))
                yield pa.RecordBatch.from_pydict(
                    {"qb": [r["qb"]], "q_top": [r["q_top"]], "n": pa.array([r["n"]], pa.int32()), "d": pa.array([r["d"]], pa.int32()), "ids": [r["ids"]], "vecs": [r["vecs"]], "least": [best.least.tobytes()], "low": [float(best.least.min())]}
                )

    q = q.crossJoin(F.broadcast(first)).mapInArrow(seed, "qb long, q_top double, n int, d int, ids binary, vecs binary, least binary, low double")
    q = stage(q, "queries")
    # Bucket numbers rise as lengths fall: the range partition in the upper bits, the place in it in the lower 33.
    names = c.select("bucket", "top")
    pairs = q.select("qb", "q_top", "low").join(names, F.col("q_top") * F.col("top") * (1 + 1e-9) + 1e-6 >= F.col("low"))
    part, at = F.shiftright("bucket", 33), F.col("bucket").bitwiseAND(F.lit((1 << 33) - 1))
    walks = (part * (1 << 31) + F.floor(at / run_of)).alias("walk")
    pairs = pairs.select("qb", walks, "bucket", F.col("bucket").alias("place"))
    buckets = pairs.join(c, "bucket").select("qb", "walk", "place", "n", "d", "ids", "vecs", F.lit(None).cast("binary").alias("least"))
    heads = pairs.select("qb", "walk").distinct().join(q, "qb").select("qb", "walk", F.lit(-1).cast("long").alias("place"), "n", "d", "ids", "vecs", "least")

    def walk(batches):
        at, best = None, None
        for b in batches:
            for r in b.to_pylist():
                blk = Block(r["n"], r["d"], r["ids"], r["vecs"])
                if (r["qb"], r["walk"]) != at:
                    if best is not None:
                        yield _rows(best)
                    at, best = (r["qb"], r["walk"]), Best(blk, k, np.frombuffer(r["least"], np.float64))
                else:
                    best.look(blk)
        if best is not None:
            yield _rows(best)

    units = buckets.unionByName(heads).repartition("qb", "walk").sortWithinPartitions("qb", "walk", "place")
    found = units.mapInArrow(walk, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rows(best: Best) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"query_id": best.q.ids[best.row], "vec_id": best.id, "score": best.score})
