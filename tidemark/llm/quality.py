"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, slices, stage
from tidemark.llm.langid import counts
from tidemark.llm.terms import unit, word_counts

#: Hashed words and byte-class n-grams, latent dimensions, neighbours that vote, labelled documents of each label at most.
WORDS, DIMS, LATENT, NEIGHBOURS, PER_LABEL = 1024, 1024, 64, 25, 2000
#: Bytes of text described at once.
BLOCK = 1 << 20
#: Byte classes: letters by case, digits as one, other ASCII as itself; of a multi-byte letter the lead byte, as a letter.
CLASS = bytes(97 if chr(b).islower() or b >= 192 else 65 if chr(b).isupper() else 48 if 48 <= b < 58 else b for b in range(256))
TAIL = bytes(range(128, 192))


def describe(text: str) -> np.ndarray:
    """Terms of a whole text: hashed words, hashed n-grams of byte classes, and bins of how far its words repeat, of its
    length and case.
    """
    words = text.split()
    data = text.encode("utf-8", "surrogatepass")
    tf = np.sqrt(word_counts(data.lower(), WORDS)[0])
    data = data.translate(CLASS, TAIL)
    n = max(1, len(words))
    letters = max(1, data.count(b"a") + data.count(b"A"))
    stats = (
        len(set(words)) / n**0.9,
        sum(map(len, words)) / n / 12,
        data.count(b"A") / letters * 2,
        1 - letters / max(1, len(data)),
        len(set(data)) / 40,
        np.log1p(len(words)) / 8,
        (data.count(b"\n") + 1) / n * 4,
    )
    soft = [np.exp(-(((np.linspace(0, 1, 8) - min(v, 1.0)) / 0.12) ** 2)) for v in stats]
    return np.concatenate([unit(tf), unit(np.sqrt(counts(data, DIMS))), np.concatenate(soft) * 0.35]).astype(np.float32)


def described(docs: DataFrame, keep: str) -> DataFrame:
    """(keep.., x) of ``docs`` (keep.., text): the terms of each text as 16-bit floats."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text", BLOCK):
                x = [describe(t or "").astype(np.float16).tobytes() for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(x, pa.binary())], [*names, "x"])

    return docs.mapInArrow(run, f"{keep}, x binary")


def latent(x: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """(terms, k): leading right singular directions, by a randomised range finder with power steps."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, *x.shape))
    q = np.linalg.qr(x.T @ rng.normal(size=(len(x), k + min(16, max(0, min(x.shape) - k)))).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ np.linalg.qr(x @ q)[0])[0]
    u, _, _ = np.linalg.svd((x @ q).T @ (x @ q))
    return (q @ u[:, :k]).astype(np.float32)


class Neighbours:
    """Labelled unit vectors in latent space; a bounded sample, so broadcast whole.

    The first ``words`` terms are weighted by how few of the sample's texts hold them before the latent directions are found.
    """

    def __init__(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, words: int = WORDS):
        self.words = words
        self.idf = np.log1p(len(x) / (1 + (x[:, :words] > 0).sum(0))).astype(np.float32)
        self.mean = self._weighted(x).mean(0)
        self.turn = latent(self._weighted(x) - self.mean, LATENT)
        self.vec, self.label, self.weight = self._unit(x), label.astype(np.float32), weight.astype(np.float32)
        self.k, self.prior = min(k, len(label)), float(np.average(label, weights=weight))

    def _weighted(self, x):
        return np.concatenate([unit(x[:, : self.words] * self.idf), x[:, self.words :]], axis=1)

    def _unit(self, x):
        return unit((self._weighted(x) - self.mean) @ self.turn)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1 among the k nearest by cosine, weighted by similarity and by what each sampled row stands for."""
        s = self._unit(x) @ self.vec.T
        near = np.argpartition(-s, self.k - 1, axis=1)[:, : self.k]
        sim = np.take_along_axis(s, near, 1)
        w = np.maximum(sim, 0) ** 8 * self.weight[near]
        return np.clip(((w * self.label[near]).sum(1) + 1e-3 * self.prior) / (w.sum(1) + 1e-3), 0, 1)


def learn(docs: DataFrame, labels: DataFrame, use, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Neighbours | None:
    """Fit on labelled documents where ``use`` holds: PER_LABEL of each label at most, the first by a hash of the id.

    A label of 1 against any other; null labels, ids and texts are left out, and a repeated label row counts once. Texts
    are joined with the sampled ids only; at most PER_LABEL descriptions of each label come to the driver, cut by Spark.
    None without labelled documents.
    """
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    own = own.select(F.col(id_col).alias("id"), (F.col(label_col) == 1).cast("int").alias("y"))
    own = own.groupBy("id").agg(F.max("y").alias("y")).where(use(F.col("id")))
    n = dict(own.groupBy("y").count().collect())
    if not n:
        return None
    first = lambda rows, k: rows.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(PER_LABEL)
    chosen = first(own, 0).unionByName(first(own, 1))
    # At most 2 * PER_LABEL ids and labels are broadcast, so no text is shuffled.
    texts = pick(docs, id=id_col, text=text_col).where("text is not null").join(F.broadcast(chosen), "id").select("y", F.xxhash64("id").alias("h"), "text")
    rows = stage(described(texts, "y int, h long"), "described")
    few = lambda k: rows.where(F.col("y") == k).orderBy("h", "x").limit(PER_LABEL).toArrow().to_pandas()
    got = pd.concat([few(0), few(1)])
    if not len(got):
        return None
    x = np.stack([np.frombuffer(b, np.float16) for b in got["x"]]).astype(np.float32)
    y = got["y"].to_numpy()
    stands = {k: n[k] / max(1, (y == k).sum()) for k in n}
    return Neighbours(x, y, np.array([stands[k] for k in y.tolist()]))


def score(docs: DataFrame, model: Neighbours | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row; a null text counts as empty, an empty one is scored like any other; 0.5 without model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text", BLOCK):
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    got = np.full(part.num_rows, 0.5)
                    if shared.value is not None:
                        got = shared.value.score(np.stack([describe(t or "") for t in part.column("text").to_pylist()]))
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(got.astype(np.float64))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return pick(docs, id=id_col, text=text_col).mapInArrow(run, f"id {kind}, score double")
