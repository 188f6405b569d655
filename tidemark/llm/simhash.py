"""SimHash near-duplicates: fingerprints by XXH64 votes, links by a Gray-order hierarchical index; and groups of texts by
exact Jaccard similarity of word shingles, for which the index and MinHash bands name the candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, pick, stage
from tidemark.llm.components import connected_components
from tidemark.llm.lines import id_filter
from tidemark.llm.unionfind import roots

#: Shingles whose hashes are voted on at once: bounds memory whatever a text's length.
BLOCK = 1 << 17
#: A bucket with more distinct fingerprints is dealt anew by further bits.
BUCKET = 20_000
#: Group pairs looked at together while the index is walked.
FRONTIER = 1 << 19
#: Bands of rows over shingle sets: at Jaccard 0.8 a pair shares a band with probability 0.997, at 0.9 with 0.9999999.
BANDS, ROWS = 20, 6
#: Texts of a group that one task compares; larger groups are cut into blocks, each pair of blocks a unit.
GROUP = 500
#: Bits of the filter that picks candidates' texts by their ids (its size is fixed).
FILTER_BITS = 26

_mix = np.random.default_rng(43)
MULTIPLIERS = _mix.integers(1 << 31, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
FOLD = _mix.integers(1 << 62, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashes(words: list[bytes], n: int, seed: int):
    """XXH64 of all shingles of ``n`` words, BLOCK at a time; fewer words are one shingle, no words none."""
    h64 = xxhash.xxh64_intdigest
    if words and len(words) < n:
        yield np.array([h64(b" ".join(words), seed)], np.uint64)
    for i in range(0, len(words) - n + 1, BLOCK):
        part = words[i : i + BLOCK + n - 1]
        yield np.fromiter((h64(b" ".join(s), seed) for s in zip(*(part[k:] for k in range(n)), strict=False)), np.uint64)


def votes_of(blocks) -> int:
    total, votes = 0, np.zeros(64, np.int64)
    for h in blocks:
        total += len(h)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((votes * 2 > total).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def text_votes(words: list[bytes], n: int, seed: int) -> int:
    """The fingerprint of a word list: bit set if set in over half of the shingles' hashes."""
    return votes_of(hashes(words, n, seed))


def shingle_set(text: str | None, n: int, seed: int) -> tuple[np.ndarray, int]:
    """Sorted distinct hashes of a text's shingles, and its fingerprint."""
    blocks = list(hashes(words_of(text), n, seed))
    return (np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)), votes_of(blocks)


def set_id(own: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set."""
    return signed(xxhash.xxh3_64_intdigest(own.tobytes(), 5))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS): minima of multiplicative hashes over each set (none empty), folded by band."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    h = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    h ^= h >> np.uint32(15)
    first = np.r_[0, np.cumsum([len(x) for x in sets])[:-1]]
    for b in range(BANDS):
        key = np.full(len(sets), b + 1, np.uint64)
        for r in range(ROWS):
            key = (key ^ np.minimum.reduceat(h * MULTIPLIERS[b * ROWS + r], first).astype(np.uint64)) * FOLD[r]
            key ^= key >> np.uint64(31)
        out[:, b] = key
    return out.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): SimHash of each whole text as a signed 64-bit number.

    A-Z is lower-cased, words are runs of bytes other than space and U+0009 to U+000D, shingles are ``n`` words joined by
    a space, repeats included. A text of fewer words is one shingle; one without words (or null) has fingerprint zero.
    """

    def run(cols):
        fp = [text_votes(words_of(t.as_py()), n, seed) for t in cols["text"]]
        return {"id": cols["id"], "fp": pa.array(np.array(fp, np.uint64).view(np.int64))}

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(pick(docs, id=id_col, text=text_col), run, f"id {kind}, fp long")


def gray_rank(fp):
    """The place of ``fp`` in the binary reflected Gray order, as a Column (order as unsigned)."""
    for k in (32, 16, 8, 4, 2, 1):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def hierarchy(fp: np.ndarray, fan: int = 8) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels (mask, pattern) above fingerprints in Gray order: the bits that all below a node share, and their values."""
    ones, zeros = fp, ~fp
    levels = [(np.full(len(fp), ~np.uint64(0)), fp)]
    while len(ones) > 1:
        cut = np.arange(0, len(ones), fan)
        ones, zeros = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
        levels.append((ones | zeros, ones))
    return levels


def near_pairs(fp: np.ndarray, most: int, fan: int = 8) -> np.ndarray:
    """Roots of the positions of ``fp`` (distinct, in Gray order) linked by chains of at most ``most`` differing bits.

    Node pairs are walked from the top; a pair whose shared bits already differ in more than ``most`` places is dropped
    with all below it, and so is a pair of leaf groups that are one component already.
    """
    levels, parent = hierarchy(fp, fan), np.arange(len(fp))
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > FRONTIER:
            half = len(i) // 2
            stack += [(level, i[:half], j[:half]), (level, i[half:], j[half:])]
            continue
        mask, bits = levels[level]
        near = np.bitwise_count((bits[i] ^ bits[j]) & mask[i] & mask[j]) <= most
        i, j = i[near], j[near]
        if not level:
            parent = roots(len(fp), i, j, parent)
            continue
        below = len(levels[level - 1][0])
        a = (i[:, None] * fan + np.repeat(np.arange(fan), fan)).ravel()
        b = (j[:, None] * fan + np.tile(np.arange(fan), fan)).ravel()
        ok = (a <= b if level > 1 else a < b) & (a < below) & (b < below)
        if len(i):
            stack.append((level - 1, a[ok], b[ok]))
    return parent


def parts(mask: int, k: int = 3) -> list[int]:
    """``mask`` cut into ``k`` masks of nearly equal bit counts."""
    at = [b for b in range(64) if mask >> b & 1]
    return [sum(1 << b for b in piece.tolist()) for piece in np.array_split(at, k) if len(piece)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link_buckets(rows: DataFrame, most: int) -> DataFrame:
    """(src, dst): for each bucket (path, val) the forest that joins its near fingerprints; at most one row for each."""

    def run(batches):
        left = None
        for b in _then_none(batches):
            if b is None:
                cur, left = left, None
            else:
                got = [b.column(k).to_numpy(zero_copy_only=False) for k in ("path", "val", "fp")]
                cur = got if left is None else [np.concatenate(x) for x in zip(left, got, strict=True)]
                last = (cur[0] == cur[0][-1]) & (cur[1] == cur[1][-1])
                at = int(np.argmax(last)) if not last.all() else 0  # the last bucket may go on in the next batch
                left, cur = [x[at:] for x in cur], [x[:at] for x in cur]
            if cur is None or not len(cur[0]):
                continue
            path, val, fp = cur
            new = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (val[1:] != val[:-1])])
            end = np.r_[new[1:], len(fp)]
            src, dst = [], []
            for s, e in zip(new[end - new > 1].tolist(), end[end - new > 1].tolist(), strict=True):
                own = fp[s:e]
                root = near_pairs(own.view(np.uint64), most)
                joined = root != np.arange(e - s)
                src.append(own[joined])
                dst.append(own[root[joined]])
            if src:
                yield pa.RecordBatch.from_pydict({"src": np.concatenate(src), "dst": np.concatenate(dst)})

    return rows.select("path", "val", "fp").mapInArrow(run, "src long, dst long")


def _then_none(batches):
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def link_fingerprints(distinct: DataFrame, most: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(src, dst): edges over distinct fingerprints ``fp`` whose components are those of all pairs within ``most`` bits.

    Two fingerprints that differ in at most ``most`` bits agree on one of ``most + 1`` parts of the bits, so each goes to
    one bucket for each part. A bucket of more than ``bucket`` fingerprints is dealt anew by parts of the bits left over,
    until those are too few for it to be large: no bucket is ever skipped. Within a bucket the rows come in Gray order.
    """
    everything, out = (1 << 64) - 1, None
    level = {0: (0, everything)}  # path -> bits fixed, bits left
    rows = distinct.select(F.lit(0).alias("path"), F.lit(0).cast("long").alias("val"), "fp")
    while True:
        nxt, deal = {}, []
        for path, (fixed, left) in level.items():
            for k, m in enumerate(parts(left, most + 1)):
                nxt[path * (most + 1) + k] = (fixed | m, left & ~m)
                deal.append((path, path * (most + 1) + k, signed(fixed | m)))
        step = F.explode(
            F.filter(
                F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(m).cast("long").alias("m")) for a, b, m in deal]),
                lambda x: x["a"] == F.col("path"),
            )
        )
        rows = rows.select("path", "fp", step.alias("d")).select(
            F.col("d.b").alias("path"), F.col("fp").bitwiseAND(F.col("d.m")).alias("val"), "fp"
        )
        level = nxt
        last = max(left.bit_count() for _, left in level.values()) <= int(np.log2(bucket))
        hot = None if last else stage(rows.groupBy("path", "val").count().where(F.col("count") > bucket), "hot")
        again = hot is not None and not hot.isEmpty()
        cold = rows.join(hot, ["path", "val"], "left_anti") if again else rows
        cold = cold.withColumn("rank", gray_rank(F.col("fp")))
        got = link_buckets(cold.repartition("path", "val").sortWithinPartitions("path", "val", "rank"), most)
        out = got if out is None else out.unionByName(got)
        if not again:
            return out
        rows = rows.join(hot.select("path", "val"), ["path", "val"], "left_semi")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2, n: int = 3) -> DataFrame:
    """(id, fp, component): fingerprint of each row, and the smallest id reachable by links of at most ``most`` bits.

    Copies share a fingerprint and are joined through it, never pair by pair. Rows without id keep their fingerprint and
    get no component, and a repeated row gets the same result each time. An empty table gives an empty result.
    """
    fps = stage(fingerprints(docs, id_col, text_col, n), "fingerprints")
    distinct = stage(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
    cc = connected_components(link_fingerprints(distinct, most))
    named = distinct.join(cc.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    low = named.groupBy("root").agg(F.min("rep").alias("least"))
    of = stage(named.join(low, "root").select("fp", "least"), "components")
    out = fps.join(of, "fp", "left")
    return out.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("least")).alias("component"))


def shingled(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(id, h, fp, keys) of ``docs`` (id, text): name of the set of shingles, fingerprint, band keys (null for an empty set)."""

    def run(batches):
        def out(rows):
            keys = iter(band_keys([x for _, x, _ in rows if len(x)]).tolist() if any(len(x) for _, x, _ in rows) else [])
            return pa.RecordBatch.from_pydict(
                {
                    "id": pa.array([i for i, _, _ in rows], kind), "h": pa.array([set_id(x) for _, x, _ in rows], pa.int64()),
                    "fp": pa.array([signed(f) for _, _, f in rows], pa.int64()), "keys": pa.array([next(keys) if len(x) else None for _, x, _ in rows], pa.list_(pa.int64())),
                }
            )

        for b in batches:
            rows, size, kind = [], 0, b.schema.field("id").type
            for i, t in zip(b.column("id"), b.column("text"), strict=True):
                rows.append((i.as_py(), *shingle_set(t.as_py(), n, seed)))
                size += len(rows[-1][1])
                if size > BLOCK:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, h long, fp long, keys array<long>")


def link_sets(sets: list[np.ndarray], side: np.ndarray, least: float) -> np.ndarray:
    """Root of each set's component by Jaccard >= ``least``; if two sides occur, only pairs across them are compared.

    Each set in turn is counted against all others through the sets that hold each of its hashes.
    """
    n, size = len(sets), np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), size)
    of = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders, count = owner[np.argsort(of, kind="stable")], np.bincount(of)
    begin, first = np.r_[0, np.cumsum(count)[:-1]], np.r_[0, np.cumsum(size)]
    across, root = len(set(side.tolist())) > 1, np.arange(n)
    for i in range(n - 1):
        own = of[first[i] : first[i + 1]]
        many = count[own]
        at = np.repeat(begin[own] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        both = np.bincount(holders[at], minlength=n)[i + 1 :]
        j = i + 1 + np.flatnonzero((both / (size[i] + size[i + 1 :] - both) >= least) & ((side[i + 1 :] != side[i]) | (not across)))
        for k in np.unique(root[j]).tolist():
            if k != root[i]:
                a, b = sorted((int(root[i]), k))
                root[root == b] = a
    return root


def verified_links(members: DataFrame, docs: DataFrame, least: float, n: int, seed: int = 42, group: int = GROUP) -> DataFrame:
    """(src, dst): for each group of ``members`` (root, h, id) the forest of its shingle sets at Jaccard >= ``least``.

    ``id`` is a document with the set; its text is shingled again. A group of more than ``group`` sets is cut into blocks
    and each pair of blocks becomes a unit, so that every pair of a group is compared. The sets are those of 64-bit
    hashes.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(id_filter(members.select(F.xxhash64("id").alias("h")), FILTER_BITS))

    def only(batches):
        for b in batches:
            p = b.column("p").to_numpy()
            on = shared.value[p >> 6].view(np.uint64) >> (p & 63).astype(np.uint64) & np.uint64(1)
            yield b.filter(pa.array(on.astype(bool))).select(["id", "text"])

    kind = docs.schema["id"].dataType.simpleString()
    place = F.xxhash64("id").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("p")
    texts = docs.select("id", "text", place).mapInArrow(only, f"id {kind}, text string")
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("cut"))
    rows = members.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("h"), F.col("cut")).cast("int"))
    unit = F.explode(F.transform(F.sequence(F.lit(0), F.col("cut") - 1), lambda j: F.struct(F.least("own", j).alias("a"), F.greatest("own", j).alias("b"))))
    rows = rows.select("id", "h", "root", "own", unit.alias("u")).join(texts, "id").select("root", "u.a", "u.b", "own", "h", "text")

    def links(held):
        found = {}
        for _, _, _, own, h, text in held:
            x = shingle_set(text, n, seed)[0]
            if set_id(x) == h and len(x):  # another text of a repeated id is not the set's
                found[h] = own, x
        side = np.array([own for own, _ in found.values()])
        if len(found) < 2 or (held[0][1] != held[0][2] and (side == side[0]).all()):
            return
        name = np.array(list(found))
        root = link_sets([x for _, x in found.values()], side, least)
        on = root != np.arange(len(root))
        if on.any():
            yield pa.RecordBatch.from_pydict({"src": name[on], "dst": name[root[on]]})

    def run(batches):
        held = []
        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in ("root", "a", "b", "own", "h", "text")), strict=True):
                if held and r[:3] != held[0][:3]:
                    yield from links(held)
                    held = []
                held.append(r)
        if held:
            yield from links(held)

    return rows.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b", "h").mapInArrow(run, "src long, dst long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2, n: int = 5, least: float = 0.8, group: int = GROUP) -> DataFrame:
    """(id, component): each row's smallest id reachable by links of Jaccard >= ``least`` of the texts' sets of ``n`` words.

    Candidates are texts whose fingerprints differ in at most ``most`` bits, or that share a band key; they only make the
    groups in which pairs are compared, and a link is a pair whose sets were compared. Texts of equal sets are one, those
    without words too. Rows without id get no component. An empty table gives an empty result.
    """
    rows = pick(docs, id=id_col, text=text_col)
    found = stage(shingled(rows, n), "shingled")
    sets = stage(found.where("id is not null").groupBy("h").agg(F.min("id").alias("id"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "sets")
    keys = sets.where("keys is not null").select("h", F.explode("keys").alias("key"))
    low = keys.groupBy("key").agg(F.min("h").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    banded = keys.join(low, "key").where("h <> low").select(F.col("h").alias("src"), F.col("low").alias("dst"))
    of = sets.groupBy("fp").agg(F.min("h").alias("low"))
    same = sets.join(of, "fp").where("h <> low").select(F.col("h").alias("src"), F.col("low").alias("dst"))
    close = link_fingerprints(stage(of.select("fp"), "distinct"), most)
    close = close.join(of.select(F.col("fp").alias("src"), F.col("low").alias("a")), "src").join(of.select(F.col("fp").alias("dst"), F.col("low").alias("b")), "dst")
    coarse = banded.unionByName(same).unionByName(close.select(F.col("a").alias("src"), F.col("b").alias("dst"))).distinct()
    coarse = connected_components(coarse).select(F.col("id").alias("h"), F.col("component").alias("root"))
    members = stage(coarse.join(sets.select("h", "id"), "h"), "members")
    fine = connected_components(stage(verified_links(members, rows.where("id is not null"), least, n, group=group), "verified"))
    named = sets.select("h", "id").join(fine.select(F.col("id").alias("h"), "component"), "h", "left")
    named = named.select("h", F.col("id").alias("rep"), F.coalesce("component", "h").alias("root"))
    least_id = named.groupBy("root").agg(F.min("rep").alias("least"))
    of = stage(named.join(least_id, "root").select("h", "least"), "components")
    out = found.select("id", "h").join(of, "h", "left")
    return out.select("id", F.when(F.col("id").isNotNull(), F.col("least")).alias("component"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2, n: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` without rows whose near-duplicate component has a smaller id; rows without id stay.

    Only ids travel: the texts are joined with the ids that go, by a left anti join.
    """
    groups = near_groups(docs, id_col, text_col, most, n, least)
    gone = groups.where("id <> component").select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
