"""Fuzzy line deduplication: MinHash of character shingles, banding, exact Jaccard, distributed union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, slices, stage, stretches, text_bytes
from tidemark.llm.components import connected_components
from tidemark.llm.unionfind import roots

#: Characters of a shingle; lines of fewer characters are compared by equality alone.
SHINGLE = 5
#: Bands of rows: at Jaccard 0.8 a pair shares a band with probability 0.986, at 0.85 with 0.9992, at 0.9 with 0.99999.
BANDS, ROWS = 14, 6
#: Lines, and characters, of a bucket that one task compares; larger buckets are cut into blocks, each pair of blocks a unit.
BUCKET, LENGTH = 1000, 1 << 20
#: Units of at most so many lines are compared together, all pairs at once.
FEW = 12
#: Characters hashed at once; line ids a task remembers; bits of the filter that picks candidates' texts (its size is fixed).
CHUNK, SEEN, FILTER_BITS = 1 << 17, 1 << 17, 26

_mix = np.random.default_rng(42)
MULTIPLIERS = _mix.integers(1 << 31, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
FOLD = _mix.integers(1 << 62, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def normal(line: str) -> str:
    return line.strip().lower()


def line_id(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def id_words(ids: list[bytes]) -> np.ndarray:
    """(ids, 2): the two halves of each id as numbers."""
    return np.frombuffer(b"".join(ids), "<i8").reshape(-1, 2)


def shingles(text: str) -> np.ndarray:
    """64-bit hashes of all runs of SHINGLE characters; position i is the run that starts at character i."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = c[: len(c) - SHINGLE + 1].copy()
    for k in range(1, SHINGLE):
        h *= BASE
        h += c[k : len(c) - SHINGLE + 1 + k]
    h ^= h >> np.uint64(29)
    h *= BASE
    return h


def own_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of every text's shingles, text after text, and how many each has; none spans two texts."""
    n = np.array([len(x) for x in texts])
    inside = np.ones(int(n.sum()) + len(n), bool)
    ends = np.cumsum(n + 1)
    for k in range(SHINGLE):
        inside[ends - 1 - k] = False
    h = (shingles("\n".join(texts) + "\n" * SHINGLE) >> np.uint64(32)).astype(np.uint32)
    return h[inside], n - SHINGLE + 1


def band_keys(lines: list[str]) -> np.ndarray:
    """(lines, BANDS): minima of multiplicative hashes over the shingles of each line, folded by band."""
    out = np.zeros((len(lines), BANDS), np.uint64)
    for at, end in stretches(np.array([len(x) + 1 for x in lines], np.int64), CHUNK):
        h, n = own_shingles(lines[at:end])
        first, each = np.r_[0, np.cumsum(n)[:-1]], np.empty_like(h)
        for b in range(BANDS):
            key = np.full(end - at, b + 1, np.uint64)
            for r in range(ROWS):
                np.multiply(h, MULTIPLIERS[b * ROWS + r], out=each)
                key = (key ^ np.minimum.reduceat(each, first)) * FOLD[r]
                key ^= key >> np.uint64(31)
            out[at:end, b] = key
    return out.view(np.int64)


def lines_of(text: str | None, shortest: int):
    """(number, normal form, id) of the lines of ``text`` with ``shortest`` characters or more."""
    for j, line in enumerate((text or "").split("\n")):
        line = normal(line)
        if len(line) >= shortest:
            yield j, line, line_id(line)


def scan(docs: DataFrame, shortest: int) -> DataFrame:
    """(doc, line, h, g, k0..): every line of ``docs`` (doc, text) and the two halves of its id; band keys where the task
    has not met the line lately, null elsewhere.
    """
    cols = [f"k{b}" for b in range(BANDS)]

    def run(batches):
        seen = set()
        for b in batches:
            for part in slices(b, "text"):
                at, no, ids, fresh, new = [], [], [], [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    for j, line, k in lines_of(t, shortest):
                        at.append(i)
                        no.append(j)
                        ids.append(k)
                        fresh.append(len(line) >= SHINGLE and k not in seen)
                        if fresh[-1]:
                            seen.add(k)
                            new.append(line)
                if len(seen) > SEEN:
                    seen.clear()
                if ids:
                    keys, fresh = np.zeros((len(ids), BANDS), np.int64), np.array(fresh)
                    keys[fresh] = band_keys(new)
                    words = id_words(ids)
                    yield pa.RecordBatch.from_pydict(
                        {"doc": part.column("doc").take(pa.array(at)), "line": pa.array(no, pa.int32()), "h": words[:, 0], "g": words[:, 1]}
                        | {c: pa.array(keys[:, k], mask=~fresh) for k, c in enumerate(cols)}
                    )

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc {kind}, line int, h long, g long, " + ", ".join(f"{c} long" for c in cols))


def shared_keys(rows: DataFrame) -> DataFrame:
    """The distinct rows (key, h) whose key has more than one h.

    Rows come sorted by key and h; one row is held between batches, whatever the size of a bucket.
    """

    def run(batches):
        last, given = None, False
        for b in batches:
            if not b.num_rows:
                continue
            key, h = b.column("key").to_numpy(), b.column("h").to_numpy()
            if last is not None:
                key, h = np.r_[last[0], key], np.r_[last[1], h]
            new = np.r_[True, (key[1:] != key[:-1]) | (h[1:] != h[:-1])]
            key, h = key[new], h[new]
            same = key[1:] == key[:-1]
            keep = np.r_[False, same] | np.r_[same, False]
            held, given = given and last is not None, bool(keep[-1]) or (given and len(key) == 1)
            last = key[-1], h[-1]
            if held:
                keep[0] = False
            if keep.any():
                yield pa.RecordBatch.from_pydict({"key": key[keep], "h": h[keep]})

    return rows.repartition("key").sortWithinPartitions("key", "h").mapInArrow(run, "key long, h long")


def id_filter(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for each value of the lowest ``bits`` bits of h: 8 MB whatever the number of lines."""
    place = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    rows = ids.select(place.alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    got = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out


def texts_of(docs: DataFrame, hs: DataFrame, shortest: int) -> DataFrame:
    """(h, g, text) of the lines named in ``hs``: the filter keeps other lines from being shuffled, the join is exact."""
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(hs))

    def run(batches):
        words, seen, low = shared.value, set(), (1 << FILTER_BITS) - 1
        for b in batches:
            for part in slices(b, "text"):
                got = {}
                for t in part.column("text").to_pylist():
                    for _, line, k in lines_of(t, max(shortest, SHINGLE)):
                        p = int.from_bytes(k[:8], "little") & low
                        if int(words[p >> 6]) >> (p & 63) & 1 and k not in seen:
                            got[k] = line
                seen.update(got)
                if len(seen) > SEEN:
                    seen.clear()
                if got:
                    half = id_words(list(got))
                    yield pa.RecordBatch.from_pydict({"h": half[:, 0], "g": half[:, 1], "text": list(got.values())})

    found = docs.mapInArrow(run, "h long, g long, text string").join(hs, "h", "left_semi")
    return found.groupBy("h", "g").agg(F.first("text").alias("text"))


def shingle_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, starts, sizes): each text's distinct 32-bit shingle hashes below the text's number, sorted."""
    h, n = own_shingles(texts)
    both = np.sort(np.repeat(np.arange(len(texts), dtype=np.uint64), n) << np.uint64(32) | h)
    both = both[np.r_[True, both[1:] != both[:-1]]]
    size = np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(texts))
    return both, np.r_[0, np.cumsum(size)[:-1]], size


def near(a: str, b: str, least: float) -> bool:
    """Whether the Jaccard similarity of two texts' shingle sets is ``least`` or more, from the shingles themselves."""
    x, y = ({t[k : k + SHINGLE] for k in range(len(t) - SHINGLE + 1)} for t in (a, b))
    both = len(x & y)
    return both >= least * (len(x) + len(y) - both)


def near_pairs(texts: list[str], sets: tuple, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs (i, j) have Jaccard >= ``least``.

    Pairs whose set sizes rule it out aren't looked at; of the others the hashes of the smaller set are looked up in the
    larger. Where colliding 32-bit hashes could decide, close to the threshold, the texts themselves are compared.
    """
    rows, start, size = sets
    found = np.zeros(len(i), bool)
    slack = 3 + size[i] * size[j] / (1 << 30)
    at = np.flatnonzero(np.minimum(size[i], size[j]) + slack >= least * np.maximum(size[i], size[j]))
    small, large = np.where(size[i] <= size[j], i, j)[at], np.where(size[i] <= size[j], j, i)[at]
    for s, e in stretches(size[small], 4 * CHUNK):
        n = size[small[s:e]]
        first = np.r_[0, np.cumsum(n)[:-1]]
        take = np.arange(n.sum()) + np.repeat(start[small[s:e]] - first, n)
        want = rows[take] & np.uint64(0xFFFFFFFF) | np.repeat(large[s:e].astype(np.uint64) << np.uint64(32), n)
        both = np.add.reduceat(rows[np.minimum(np.searchsorted(rows, want), len(rows) - 1)] == want, first, dtype=np.int64)
        pair = at[s:e]
        over = both * (1 + least) - least * (size[i[pair]] + size[j[pair]])
        found[pair[over > slack[pair]]] = True
        for k in pair[np.abs(over) <= slack[pair]].tolist():
            found[k] = near(texts[i[k]], texts[j[k]], least)
    return found


def unit_links(texts: list[str], side: np.ndarray, least: float, sets: tuple, first: int, parent: np.ndarray) -> np.ndarray:
    """``parent`` with the lines first.. of one unit joined at Jaccard >= ``least``; if two sides occur, only pairs across.

    Each line in turn is compared, in one vector operation, with the later ones outside its component: no link between
    components is lost.
    """
    n = len(side)
    across = (side != side[0]).any()
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        j = j[(parent[first + j] != parent[first + i]) & ((side[j] != side[i]) | (not across))]
        if len(j):
            on = j[near_pairs(texts, sets, np.full(len(j), first + i), first + j, least)]
            if len(on):
                parent = roots(len(parent), np.full(len(on), first + i), first + on, parent)
    return parent


def compare_units(texts: list[str], unit: np.ndarray, side: np.ndarray, least: float) -> np.ndarray:
    """Root position of each line after linking the lines of each unit (positions where ``unit`` changes begin a new one)."""
    sets, parent = shingle_rows(texts), np.arange(len(texts))
    begin = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    end = np.r_[begin[1:], len(texts)]
    few = end - begin <= FEW
    i, j = [], []
    for d in range(1, FEW):
        at = np.flatnonzero(unit[d:] == unit[:-d])
        i.append(at)
        j.append(at + d)
    i, j = np.concatenate(i), np.concatenate(j)
    small = np.repeat(few, end - begin)
    two = np.repeat(np.logical_or.reduceat(side != np.repeat(side[begin], end - begin), begin), end - begin)
    on = small[i] & (~two[i] | (side[i] != side[j]))
    i, j = i[on], j[on]
    on = near_pairs(texts, sets, i, j, least)
    parent = roots(len(texts), i[on], j[on], parent)
    for s, e in zip(begin[~few].tolist(), end[~few].tolist(), strict=True):
        parent = unit_links(texts, side[s:e], least, sets, s, parent)
    return parent


def links(cand: DataFrame, docs: DataFrame, least: float, bucket: int = BUCKET, shortest: int = 1) -> DataFrame:
    """(h, g, to_h, to_g): verified links between the lines that share a bucket of ``cand`` (key, h), a forest for each unit."""
    texts = stage(texts_of(docs, stage(cand.select("h").distinct(), "named"), shortest), "texts")
    sized = cand.join(texts.select("h", F.length("text").alias("n")), "h")
    sizes = sized.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n").alias("chars"), F.bit_xor(F.xxhash64("h")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "h")).alias("y")
    )
    once = sizes.where("n > 1").groupBy("n", "chars", "x", "y").agg(F.min("key").alias("key"))  # buckets of the same ids are looked at once
    cut = F.greatest(F.ceil(F.col("n") / bucket), F.ceil(F.col("chars") / LENGTH)).cast("int")
    once = stage(once.select("key", cut.alias("cut")), "buckets")  # a plan of its own: the driver holds half the shuffles at once
    rows = cand.join(once, "key").withColumn("own", F.pmod(F.xxhash64("h"), F.col("cut")).cast("int"))
    unit = F.explode(F.transform(F.sequence(F.lit(0), F.col("cut") - 1), lambda j: F.struct(F.least("own", j).alias("a"), F.greatest("own", j).alias("b"))))
    rows = rows.select("key", "own", "h", unit.alias("u")).select("key", "u.a", "u.b", "own", "h").join(texts, "h")

    def found(part):
        if part.num_rows > 1:
            unit, own = changes(part), part.column("own").to_numpy()
            text, h, g = part.column("text").to_pylist(), part.column("h").to_numpy(), part.column("g").to_numpy()
            root = compare_units(text, unit, own, least)
            on = np.flatnonzero(root != np.arange(len(root)))
            if len(on):
                yield pa.RecordBatch.from_pydict({"h": h[on], "g": g[on], "to_h": h[root[on]], "to_g": g[root[on]]})

    def changes(part):
        n = np.zeros(part.num_rows, np.int64)
        for k in ("key", "a", "b"):
            c = part.column(k).to_numpy()
            n[1:] |= c[1:] != c[:-1]
        return np.cumsum(n)

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            part = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            unit = changes(part)
            last = int(np.searchsorted(unit, unit[-1]))
            held, part = part.slice(last), part.slice(0, last)
            if last:
                begin = np.flatnonzero(np.r_[True, np.diff(unit[:last]) > 0])
                end = np.r_[begin[1:], last]
                for s, e in stretches(np.add.reduceat(text_bytes(part, "text"), begin), 4 * CHUNK):
                    yield from found(part.slice(begin[s], end[e - 1] - begin[s]))
        if held is not None:
            yield from found(held)

    units = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "h", "g")
    return units.select("key", "a", "b", "own", "h", "g", "text").mapInArrow(run, "h long, g long, to_h long, to_g long")


def line_components(found: DataFrame) -> DataFrame:
    """(h, g, root_h, root_g) for each line with a link of ``found`` (h, g, to_h, to_g): one line of its component.

    The lines get short numbers first, so that the rounds of the components work on numbers.
    """
    ends = found.select("h", "g").unionByName(found.select(F.col("to_h").alias("h"), F.col("to_g").alias("g"))).distinct()
    nodes = stage(ends.select("h", "g", F.monotonically_increasing_id().alias("v")), "nodes")
    dst = nodes.select(F.col("h").alias("to_h"), F.col("g").alias("to_g"), F.col("v").alias("dst"))
    edges = found.join(nodes.withColumnRenamed("v", "src"), ["h", "g"]).join(dst, ["to_h", "to_g"]).select("src", "dst")
    cc = connected_components(edges)
    root = nodes.select(F.col("h").alias("root_h"), F.col("g").alias("root_g"), F.col("v").alias("component"))
    return nodes.join(cc.withColumnRenamed("id", "v"), "v").join(root, "component").select("h", "g", "root_h", "root_g")


def duplicate_lines(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, shortest: int = 1) -> DataFrame:
    """(doc, line, kept, first_doc, first_line) for every line of ``shortest`` characters or more.

    Lines are compared without outer white space and case. Equal lines are one; different ones of SHINGLE characters or
    more are linked at a Jaccard similarity of ``least`` of their sets of SHINGLE characters. Of each component the line of
    the smallest (doc, line) is kept. Empty lines are left alone and not listed, and so are those of documents without text
    or id. Rows that repeat a document count as that document. An empty table gives an empty result.
    """
    whole = pick(docs, doc=id_col, text=text_col).where("doc is not null and text is not null")
    found = stage(scan(whole, max(1, shortest)), "lines")
    keys = found.where("k0 is not null").select(F.explode(F.array(*[f"k{b}" for b in range(BANDS)])).alias("key"), "h")
    cand = stage(shared_keys(keys), "candidates")
    cc = stage(line_components(stage(links(cand, whole, least, bucket, max(1, shortest)), "links")), "components")
    again = found.select("doc", "line", "h", "g").join(cc, ["h", "g"], "left")
    again = again.select("doc", "line", F.coalesce("root_h", "h").alias("h"), F.coalesce("root_g", "g").alias("g"))
    low = again.groupBy("h", "g").agg(F.min(F.struct("doc", "line")).alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    low = stage(low.select("h", "g", F.col("low.doc").alias("first_doc"), F.col("low.line").alias("first_line")), "repeated")
    out = again.join(low, ["h", "g"], "left")
    first = [F.coalesce("first_doc", "doc").alias("first_doc"), F.coalesce("first_line", "line").alias("first_line")]
    return out.select("doc", "line", *first).select("doc", "line", ((F.col("doc") == F.col("first_doc")) & (F.col("line") == F.col("first_line"))).alias("kept"), "first_doc", "first_line")


def without_duplicate_lines(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one line of each component left, whole documents that held none but copies gone; columns as before.

    Documents that lose no line stay as they are, those without text or id too.
    """
    gone = duplicate_lines(docs, least, id_col, text_col).where("not kept").groupBy(F.col("doc").alias(id_col))
    gone = gone.agg(F.collect_set("line").alias("_lines_gone"))
    both = docs.join(gone, id_col, "left").select(*[F.col(f"`{c}`") for c in docs.columns], "_lines_gone")
    at = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for b in slices(whole, text_col):
                texts, keep = [], []
                for t, drop in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                    if drop is not None and t is not None:
                        out = set(drop)
                        t = "\n".join([x for i, x in enumerate(t.split("\n")) if i not in out])
                        keep.append(bool(t.strip()))
                    else:
                        keep.append(True)
                    texts.append(t)
                cols = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-1]).filter(pa.array(keep))

    return both.mapInArrow(run, docs.schema)
