"""Embedding near-duplicates: codes by iterative quantisation, candidates from multi-index Hamming tables, exact rerank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, stage
from tidemark.llm.components import connected_components
from tidemark.llm.topk import usable
from tidemark.llm.unionfind import roots

#: The rotation is fitted on at most so many distinct vectors (the lowest hashes); every vector is indexed.
SAMPLE, ROUNDS = 20_000, 30
#: Bits of a code; bits of a table's key at least and at most, and rows of a bucket wanted: keys grow with the vectors.
BITS, KEY_BITS, KEY_MOST, ROWS = 64, 8, 16, 1024
#: Chance that a pair at the threshold shares no table, were its bits independent: sets the number of tables.
MISSED = 0.003
#: Rows of a bucket that one task compares; larger buckets are cut into blocks.
BUCKET = 4096


def learn_rotation(x: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 42) -> np.ndarray:
    """(d, bits): principal directions of unit vectors times the rotation that brings them closest to a cube's corners.

    Gong and Lazebnik's alternation: codes by sign, then the orthogonal Procrustes rotation towards them. Directions are
    those about the origin, since links are by cosine.
    """
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    basis = np.linalg.svd(x.T @ x)[0][:, : min(bits, d)]
    basis = np.concatenate([basis, *[np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(-(-bits // d))]], axis=1)[:, :bits]
    y = x @ basis
    rot = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(y @ rot >= 0, 1.0, -1.0).T @ y)
        rot = vt.T @ u.T
    return basis @ rot


def shape(count: int, least: float) -> tuple[int, int]:
    """(tables, bits of a key) for ``count`` distinct vectors: two at cosine ``least`` agree on a bit with chance 1 - angle / pi."""
    key_bits = int(np.clip(np.ceil(np.log2(max(count, 1) / ROWS)), KEY_BITS, KEY_MOST))
    hit = (1 - np.arccos(np.clip(least, -1, 1)) / np.pi) ** key_bits
    return (1 if hit >= 1 else int(np.ceil(np.log(MISSED) / np.log1p(-hit)))), key_bits


def key_masks(bits: int, tables: int, key_bits: int, seed: int = 42) -> list[int]:
    """Bit masks of the tables: disjoint substrings of seeded orders of the bits."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < tables:
        order = rng.permutation(bits)
        out += [sum(1 << int(b) for b in order[i : i + key_bits]) for i in range(0, max(bits - key_bits, 0) + 1, key_bits)]
    return out[:tables]


def unit_rows(vecs) -> np.ndarray:
    m = np.array(vecs, dtype=np.float64)
    big = np.abs(m).max(1, keepdims=True)
    m = m / big  # no square overflows or vanishes
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def compare(a: np.ndarray, b: np.ndarray | None, code_a, code_b, masks: np.ndarray, table: int, least: float):
    """Positions (i, j) of rows with cosine >= ``least`` that no earlier table has brought together; i < j if b is None."""
    s = a @ (a if b is None else b).T
    i, j = np.nonzero(s >= least)
    if b is None:
        i, j = i[i < j], j[i < j]
        code_b = code_a
    differ = code_a[i] ^ code_b[j]
    new = np.ones(len(i), bool)
    for m in masks[:table]:
        new &= (differ & m) != 0
    return i[new], j[new]


def link_tables(rows: DataFrame, masks: list[int], least: float, bucket: int = BUCKET) -> DataFrame:
    """(a, b, n): what the buckets tell of class a: a class b it is joined with, and vectors newly linked to it.

    A bucket above ``bucket`` rows is cut into blocks by a hash, and each pair of blocks becomes a unit of its own, so no
    task holds more than two blocks and every pair is still compared. A unit passes on a row for each class with links
    (its links counted, and the root of its component in the unit), never the pairs.
    """
    m64 = np.array(masks, np.uint64)
    few = sum(1 << m.bit_count() for m in masks) <= 1 << 16  # buckets there can be: their sizes are broadcast, vectors shuffled once
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("code").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for t, m in enumerate(masks)]))
    rows = rows.select("rep", "mult", "code", "v", keys.alias("k")).select("rep", "mult", "code", "v", "k.t", "k.key")
    many = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    many = many.withColumn("cut", F.ceil(F.col("size") / bucket).cast("int"))
    rows = rows.join(F.broadcast(many) if few else many, ["t", "key"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("cut")).cast("int"))
    unit = F.explode(F.transform(F.sequence(F.lit(0), F.col("cut") - 1), lambda j: F.struct(F.least("own", j).alias("x"), F.greatest("own", j).alias("y"))))
    rows = rows.withColumn("u", unit).select("t", "key", "u.x", "u.y", "own", "rep", "mult", "code", "v")

    def unit_links(t, own, rep, mult, code, v):
        x, side = unit_rows(v), own != own[0]
        if side.any():
            p, q = np.flatnonzero(~side), np.flatnonzero(side)
            i, j = compare(x[p], x[q], code[p], code[q], m64, t, least)
            i, j = p[i], q[j]
        else:
            i, j = compare(x, None, code, None, m64, t, least)
        if not len(i):
            return None
        n = np.bincount(i, mult[j], len(rep)) + np.bincount(j, mult[i], len(rep))
        root, has = roots(len(rep), i, j), n > 0
        return pa.RecordBatch.from_pydict({"a": rep[has], "b": rep[root[has]], "n": n[has].astype(np.int64)})

    def run(batches):
        held, at = [], None
        for r in _by_unit(batches):
            key = r[0]
            if key != at and held:
                got = _whole(held, unit_links)
                held = []
                if got is not None:
                    yield got
            at = key
            held.append(r)
        if held and (got := _whole(held, unit_links)) is not None:
            yield got

    units = rows.repartition("t", "key", "x", "y").sortWithinPartitions("t", "key", "x", "y", "own")
    return units.mapInArrow(run, "a long, b long, n long")


def _by_unit(batches):
    """((t, key, x, y), batch slice) for each stretch of one unit."""
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in ("t", "key", "x", "y")]
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cut = np.r_[np.flatnonzero(new), b.num_rows]
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield tuple(int(c[s]) for c in cols), b.slice(s, e - s)


def _whole(held, fn):
    t, x, y = held[0][0][0], held[0][0][2], held[0][0][3]
    rows = pa.Table.from_batches([b for _, b in held])
    if rows.num_rows < 2:
        return None
    num = {k: rows.column(k).to_numpy() for k in ("own", "rep", "mult", "code")}
    if x != y and (num["own"] == num["own"][0]).all():
        return None  # one of the two blocks is empty
    flat = rows.column("v").combine_chunks()
    v = flat.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
    return fn(t, num["own"], num["rep"], num["mult"].astype(np.float64), num["code"].view(np.uint64), v)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(
    vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", tables: int | None = None, key_bits: int | None = None, bucket: int = BUCKET
) -> DataFrame:
    """(id, n_links, component, kept): vectors linked by cosine >= ``least``, for every row of ``vectors``.

    Equal vectors form one class with a count, so copies are never compared pair by pair; only a class's 128-bit name and
    the ids travel when the result goes back to the rows. Ids may be of any type that has an order. The rotation is learned from at
    most SAMPLE distinct vectors; all classes get codes and go to every table; what shares a bucket is compared with its
    original components in double precision, and a pair counts in the first table that brings it together. Without
    ``tables`` and ``key_bits`` the number of distinct vectors and ``least`` set them (see ``shape``). Vectors that
    are null, zero, or hold null or non-finite components, vectors of another length than the first sampled one, and rows
    without id link with nothing. A row without id has no component and is kept. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    good = usable(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull()
    rows = pick(vectors, id=id_col, v=vec_col).withColumn("good", F.coalesce(good, F.lit(False)))
    name = [F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")]  # 128 bits tell a class
    classes = rows.where("good").select("id", "v", *name).groupBy("h", "g").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("mult"), F.first("v").alias("v"))
    classes = stage(classes.select("*", F.monotonically_increasing_id().alias("rep")), "classes")
    sample = classes.orderBy("h", "g").limit(SAMPLE).select("v").toArrow()["v"].to_pylist()
    if len(sample):
        d = len(sample[0])
        bits, wanted = BITS, shape(classes.count(), least)
        tables, key_bits = tables or wanted[0], key_bits or wanted[1]
        turn = learn_rotation(unit_rows([x for x in sample if len(x) == d]), bits)

        def code(batches):
            for b in batches:
                if b.num_rows:
                    v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
                    on = (unit_rows(v) @ turn >= 0).astype(np.uint64)
                    c = (on << np.arange(bits, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("mult"), b.column("v"), pa.array(c)], ["rep", "mult", "v", "code"])

        kind = classes.schema["v"].dataType.simpleString()
        coded = classes.where(F.size("v") == d).select("rep", "mult", "v").mapInArrow(code, f"rep long, mult long, v {kind}, code long")
        links = stage(link_tables(stage(coded, "codes"), key_masks(bits, tables, key_bits), least, bucket), "links")
    else:
        links = spark.createDataFrame([], "a long, b long, n long")
    cc = connected_components(links.where("a <> b"), "a", "b")
    counts = links.groupBy("a").agg(F.sum("n").alias("n"))
    of = classes.drop("v").join(counts, F.col("rep") == F.col("a"), "left").join(cc, F.col("rep") == F.col("id"), "left")
    of = of.select("h", "g", "least", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("root"))
    low = of.groupBy("root").agg(F.min("least").alias("component"))
    of = stage(of.join(low, "root").select("h", "g", "n_links", "component"), "found")
    linked = rows.where("good").select("id", *name).join(of, ["h", "g"]).select("id", "n_links", "component")
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))
