"""Language-model scores by online logistic context mixing: hashed-context bit predictors, gated weights, adaptive maps."""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, slices, stage

#: Slots of each table of bit counts (a power of two), counted, summed and sent in blocks.
SHIFT, BLOCK = 21, 1 << 13
SLOTS = 1 << SHIFT
#: Contexts of a bit, besides what has been read of its byte: the last 3 and 4 bytes of the word, all its bytes so far, and
#: these with the word before, for the first NEAR bytes.
INSIDE, ALL, NEAR = 3, 4, 3
#: Words that every task knows; the counts of others are joined to the documents that hold them.
HEAD = 1 << 18
#: Texts that a task mixes side by side.
LANES = 64
#: A stretched probability in a table is kept in steps of 1/STEP.
STEP = 16.0
#: Weights that every document starts from, a row for each gate: how often all bytes of the word so far have been met (less
#: than MET[0] times, ...), then whether they have been met after the word before.
START = np.array(
    [
        [0.7, 0.5, 0.3, 0.0], [0.7, 0.5, 0.3, 0.1], [0.5, 0.5, 0.4, 0.0], [0.5, 0.5, 0.4, 0.1],
        [0.3, 0.5, 0.45, 0.0], [0.5, 0.3, 0.2, 0.2], [0.1, 0.5, 0.4, 0.0], [0.35, 0.3, 0.15, 0.5],
    ],
    np.float32,
)
GATES, MET, RATE = 8, np.array([3, 33, 257]), 0.01
#: Cells of an adaptive map of log odds over -8..8, which adds to them what has been learned in a cell, and its rate.
CELLS, MAP_RATE = 32, 0.02
#: Trust in the word list that a document starts with, and observations that this is worth.
TRUST, FAITH = 0.35, 8.0
SPACE = 32


def hashed(x: np.ndarray, seed: int) -> np.ndarray:
    """A slot for each number."""
    z = (x.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(64 - SHIFT)).astype(np.int32)


@dataclass(frozen=True)
class Codes:
    """Prefix codes for bytes after each byte: of the pair 256 * before + byte, ``size`` decisions from ``first`` on, each at a node
    (``slot``: its hash) and with a ``bit``."""

    size: np.ndarray
    first: np.ndarray
    bit: np.ndarray
    slot: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Codes:
        """Huffman's codes for the pairs' ``counts``; each byte counts once more, so every text can be written."""
        sizes, nodes, bits = [], [], []
        for before in range(256):
            ways = huffman(counts[256 * before : 256 * before + 256] + 1)
            sizes += [len(w) for w in ways]
            nodes += [256 * before + node for w in ways for node, _ in w]
            bits += [bit for w in ways for _, bit in w]
        size = np.array(sizes, np.int64)
        return cls(size, np.cumsum(size) - size, np.array(bits, np.int8), hashed(np.array(nodes, np.int64), 99))


def huffman(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """Of each symbol the (node, bit) from the root on."""
    heap = [(float(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    up: dict[int, tuple[int, int]] = {}
    for node in range(len(counts) - 1):
        (n, a), (m, z) = heapq.heappop(heap), heapq.heappop(heap)
        up[a], up[z] = (node, 0), (node, 1)
        heapq.heappush(heap, (n + m, len(counts) + node))
    ways = []
    for i in range(len(counts)):
        way, at = [], i
        while at in up:
            way.append(up[at])
            at = len(counts) + up[at][0]
        ways.append(way[::-1])
    return ways


@dataclass(frozen=True)
class Written:
    """Words as decisions: of word w those from ``first[w]`` to ``first[w+1]``, their bits, whether they are NEAR the word
    before, and the slot of each context; that of the last is still to be mixed with the word before. ``own``: the
    words' slots as such."""

    first: np.ndarray
    bit: np.ndarray
    near: np.ndarray
    slots: list[np.ndarray]
    own: np.ndarray

    @classmethod
    def of(cls, words: pa.Array, codes: Codes, near: bool = False) -> Written:
        """Each word is followed by a space; the empty word stands for the end of a text and is one line feed.

        ``near``: the first NEAR bytes of each word and the last context alone.
        """
        text = np.frombuffer(b"".join((w + b" ") if w else b"\n" for w in words.cast(pa.binary()).to_pylist()), np.uint8).astype(np.int64)
        size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        start = np.cumsum(size) - size
        at = np.arange(len(text)) - np.repeat(start, size)
        # a word's letters so far: running sums of letters times powers by their place in the word
        up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(size.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64)])
        total = np.r_[np.uint64(0), np.cumsum((text + 1).astype(np.uint64) * up[at], dtype=np.uint64)]
        prefix = total[:-1] - np.repeat(total[start], size)
        own = hashed(total[start + size - 1] - total[start], 77)
        contexts = [hashed(prefix, ALL)]
        pair = 256 * np.where(at > 0, np.r_[0, text[:-1]][: len(text)], SPACE) + text
        if near:
            some = at < NEAR
            text, pair, at, contexts = text[some], pair[some], at[some], [contexts[0][some]]
            size = np.minimum(size, NEAR)
            start = np.cumsum(size) - size
        else:
            last, before = np.zeros(len(text), np.int64), []
            for k in range(1, INSIDE + 2):
                last = last | np.where(at >= k, np.r_[np.zeros(k, np.int64), text[:-k]][: len(text)] + 1, 0) << 9 * (k - 1)
                before.append(hashed(last, k))
            contexts = [*before[2:], hashed(prefix, INSIDE), *contexts]
        bits = codes.size[pair]
        byte = np.repeat(np.arange(len(text), dtype=np.int32), bits)
        where = spans(codes.first[pair], bits)
        node = codes.slot[where]
        first = np.r_[0, np.cumsum(np.add.reduceat(bits, start))] if len(start) else np.zeros(1, np.int64)
        return cls(first, codes.bit[where], (at < NEAR)[byte], [c[byte] ^ node for c in contexts], own)


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (size[0] of them), first[1], ..."""
    return np.repeat((first - (np.cumsum(size) - size)).astype(np.int32), size) + np.arange(int(size.sum()), dtype=np.int32)


@dataclass(frozen=True)
class Words:
    """The words of some texts: distinct ones, the number of each, where each text's begin and end."""

    distinct: pa.Array
    code: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        """Lower-cased (A-Z) words between ASCII white space, and an empty one after each text."""
        parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        keep = pc.greater(pc.binary_length(parts.values), 0)
        ends = np.r_[0, np.cumsum(keep.to_numpy(zero_copy_only=False))][parts.offsets.to_numpy()]
        named = parts.values.filter(keep).dictionary_encode()
        distinct = pa.concat_arrays([named.dictionary, pa.array([""], named.dictionary.type)])
        counts = np.diff(ends)
        code = np.full(len(named) + len(counts), len(named.dictionary), np.int64)
        code[np.arange(len(named)) + np.repeat(np.arange(len(counts)), counts)] = named.indices.to_numpy()
        return cls(distinct, code, ends + np.arange(len(ends)))


@dataclass
class Model:
    """Counts (word, c) of all training words with the empty word for ends; N and V; the code; the tables as a broadcast."""

    counts: DataFrame
    tokens: int
    distinct: int
    codes: Codes
    tables: object


def dealt(counts: np.ndarray, table: int):
    """Rows (table, block, part, data) of what is not zero of the counts of a task, two for each slot."""
    blocks, part = counts.reshape(-1, 2 * BLOCK), TaskContext.get().partitionId()
    some = np.flatnonzero(blocks.any(axis=1))
    for at in range(0, len(some), 64):
        s = some[at : at + 64]
        data = [zlib.compress(blocks[k].tobytes(), 1) for k in s]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), table, np.int32)), pa.array(s.astype(np.int32)), pa.array(np.full(len(s), part // 256, np.int32)), pa.array(data, pa.binary())], ["table", "block", "part", "data"])


DEALT = "table int, block int, part int, data binary"


def summed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(2 * BLOCK, np.int64)
    for d in pdf["data"]:
        total += np.frombuffer(zlib.decompress(d), np.int64)
    return pd.DataFrame({"table": [key[0]], "block": [key[1]], "part": [0], "data": [zlib.compress(total.tobytes(), 1)]})


def stretched(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The block's log odds in steps; 0 for what has not been seen."""
    n = np.frombuffer(zlib.decompress(summed(key, pdf)["data"][0]), np.int64).reshape(-1, 2)
    x = np.clip(np.rint(STEP * np.log((n[:, 1] + 0.4) / (n[:, 0] + 0.4))), -127, 127).astype(np.int8)
    met = np.searchsorted(MET, n.sum(axis=1), side="right").astype(np.int8)
    return pd.DataFrame({"table": [key[0]], "block": [key[1]], "x": [x.tobytes()], "met": [met.tobytes() if key[0] == INSIDE - 1 else None]})


def learn(docs: DataFrame, train: Column, text_col: str = "text") -> Model:
    """Count all words of the rows where ``train`` holds, and the decisions of these words in every context.

    Word counts grow with the corpus and stay a table. Each task counts decisions in tables of SLOTS hashed slots for each
    context; those inside a word once for each distinct word, weighted by its count. Tables are summed block by block in
    two levels and come to the driver as SLOTS bytes for each of six contexts and one for the gates, whatever the corpus is like.
    """
    spark = docs.sparkSession
    rows = docs.where(train).select(F.col(f"`{text_col}`").alias("text"))

    def words(batches):
        for b in batches:
            for part in slices(b, "text", 8 << 20):
                w = Words.of(part.column("text"))
                yield pa.RecordBatch.from_arrays([w.distinct, pa.array(np.bincount(w.code, minlength=len(w.distinct)))], ["word", "c"])

    counts = stage(rows.mapInArrow(words, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    tokens, distinct = (x or 0 for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())

    def letters(batches):
        n = np.zeros(1 << 16)
        for b in batches:
            size = pc.binary_length(b.column("word")).to_numpy(zero_copy_only=False) + 1
            text = np.frombuffer(b"".join((w + b" ") if w else b"\n" for w in b.column("word").cast(pa.binary()).to_pylist()), np.uint8).astype(np.int64)
            before = np.r_[SPACE, text[:-1]][: len(text)]
            before[np.cumsum(size) - size] = SPACE
            n += np.bincount(256 * before + text, np.repeat(b.column("c").to_numpy().astype(np.float64), size), 1 << 16)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["b", "n"])

    found = {r.b: r.n for r in counts.mapInArrow(letters, "b long, n double").groupBy("b").agg(F.sum("n").alias("n")).collect()}  # 65,536 rows at most
    codes = Codes.of(np.array([found.get(b, 0.0) for b in range(1 << 16)]))

    def inside(batches):
        n = np.zeros((INSIDE, SLOTS, 2), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 1 << 15):
                part = b.slice(at, 1 << 15)
                w = Written.of(part.column("word"), codes)
                c = np.repeat(part.column("c").to_numpy(), np.diff(w.first))
                for k in range(INSIDE):
                    np.add.at(n[k].reshape(-1), 2 * w.slots[k].astype(np.int64) + w.bit, c)
        for k in range(INSIDE):
            yield from dealt(n[k], k)

    def across(batches):
        n = np.zeros(2 * SLOTS, np.int64)
        for b in batches:
            for part in slices(b, "text", 8 << 20):
                t = Words.of(part.column("text"))
                w = Written.of(t.distinct, codes, near=True)
                size, slot, before = np.diff(w.first), 2 * w.slots[0].astype(np.int64) + w.bit, 2 * previous(t, w)
                for at in range(0, len(t.code), 1 << 15):
                    code = t.code[at : at + (1 << 15)]
                    np.add.at(n, slot[spans(w.first[code], size[code])] ^ np.repeat(before[at : at + (1 << 15)], size[code]), 1)
        yield from dealt(n, INSIDE)

    parts = counts.mapInArrow(inside, DEALT).unionByName(rows.mapInArrow(across, DEALT))
    sums = parts.groupBy("table", "block", "part").applyInPandas(summed, DEALT)
    blocks = sums.groupBy("table", "block").applyInPandas(stretched, "table int, block int, x binary, met binary")
    tables = np.zeros((ALL + 1, SLOTS // BLOCK, BLOCK), np.int8)
    for r in blocks.toLocalIterator():
        tables[r.table, r.block] = np.frombuffer(r.x, np.int8)
        if r.met is not None:
            tables[ALL, r.block] = np.frombuffer(r.met, np.int8)
    return Model(counts, tokens, distinct, codes, spark.sparkContext.broadcast(tables.reshape(ALL + 1, SLOTS)))


def previous(t: Words, w: Written) -> np.ndarray:
    """The slot of the word before each; that of the end at the start of a text."""
    before = np.r_[len(t.distinct) - 1, t.code[:-1]]
    return w.own[before].astype(np.int64)


def with_counts(rows: DataFrame, model: Model) -> tuple[DataFrame, object]:
    """``rows`` (id, text) with ``known``, the counts of their words outside the head by the place where each first stands; and
    the head, a broadcast (word, c).

    The head is the HEAD words of largest count, so no word of the join is in more rows than those are. Rows are told
    apart by a hash of id and text: equal rows share their counts.
    """
    top = model.counts.orderBy(F.desc("c"), "word").limit(HEAD).toArrow()  # bounded
    head = rows.sparkSession.sparkContext.broadcast((top.column("word").combine_chunks().cast(pa.string()), top.column("c").to_numpy()))
    rows = rows.withColumn("k", F.xxhash64("id", "text"))

    def rare(batches):
        for b in batches:
            for part in slices(b, "text", 8 << 20):
                t = Words.of(part.column("text"))
                new = pc.is_null(pc.index_in(t.distinct, value_set=head.value[0])).to_numpy(zero_copy_only=False)
                at = np.flatnonzero(new[t.code])
                doc = np.repeat(np.arange(part.num_rows), np.diff(t.ends))[at]
                at = at[np.unique(doc * len(t.distinct) + t.code[at], return_index=True)[1]]
                doc = np.searchsorted(t.ends, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(doc)), pa.array((at - t.ends[doc]).astype(np.int32)), t.distinct.take(pa.array(t.code[at]))], ["k", "at", "word"])

    pairs = rows.mapInArrow(rare, "k long, at int, word string").join(model.counts, "word")
    known = pairs.groupBy("k").agg(F.collect_set(F.struct("at", "c")).alias("known"))
    return rows.join(known, "k", "left").select("id", "text", "known"), head


def word_lists(t: Words, known: pa.Array, head: tuple[pa.Array, np.ndarray]) -> np.ndarray:
    """The count of each distinct word."""
    at = pc.index_in(t.distinct, value_set=head[0])
    c = np.where(at.is_valid().to_numpy(zero_copy_only=False), np.r_[head[1], 0][pc.fill_null(at, len(head[0])).to_numpy()], 0)
    size = pc.fill_null(pc.list_value_length(known), 0).to_numpy(zero_copy_only=False)
    flat = known.flatten()
    c[t.code[np.repeat(t.ends[:-1], size) + flat.field("at").to_numpy()]] = flat.field("c").to_numpy()
    return c


def mixed(t: Words, w: Written, tables: np.ndarray) -> np.ndarray:
    """Of each token, the natural logarithm of its probability by the mixed bit predictors.

    Every text starts from the same weights and an adaptive map of zeros and learns from what has been coded of it: after
    8, 16, 32, 64, 128, 256, 384, ... tokens. LANES texts are read side by side; none learns from another.
    """
    x = np.zeros((len(w.bit), 8), np.int8)  # what belongs to a decision, together: the inputs; slot, bit, near, gate
    for k in range(INSIDE):
        x[:, k] = tables[k][w.slots[k]]
    gate = tables[ALL][w.slots[INSIDE - 1]].astype(np.int32)
    x.view(np.int32)[:, 1] = w.slots[INSIDE] | w.bit.astype(np.int32) << SHIFT | w.near.astype(np.int32) << SHIFT + 1 | gate << SHIFT + 2
    n, out = np.diff(t.ends), np.zeros(len(t.code))
    order, before = np.argsort(-n, kind="stable"), previous(t, w).astype(np.int32)
    for at in range(0, len(n), LANES):
        _mix(t, w, order[at : at + LANES], n, x.view(np.int64)[:, 0], before, tables[INSIDE], out)
    return out


def _mix(t: Words, w: Written, texts: np.ndarray, n: np.ndarray, packed: np.ndarray, before: np.ndarray, table: np.ndarray, out: np.ndarray) -> None:
    """Fill ``out`` for the tokens of ``texts``, longest first."""
    size, lanes = np.diff(w.first), len(texts)
    weights, seen = np.tile(START.T / np.float32(STEP), lanes), np.zeros(lanes * GATES)
    extra = np.zeros(lanes * GATES * CELLS, np.float32)
    at, width = 0, 8
    while True:
        active = texts[: np.searchsorted(-n[texts], -at, side="left")]
        if not len(active):
            return
        take = np.minimum(width, n[active] - at)
        token = spans(t.ends[active] + at, take)
        code = t.code[token]
        bits = size[code]
        where = spans(w.first[code], bits)
        f = packed[where]
        inputs, more = f.view(np.int8).reshape(-1, 8), f.view(np.int32)[1::2]
        v = [inputs[:, k].astype(np.float32) for k in range(INSIDE)] + [np.zeros(len(f), np.float32)]
        near = np.flatnonzero(more & (2 << SHIFT))
        across = table[(more[near] & (SLOTS - 1)) ^ np.repeat(before[token], bits)[near]]
        v[INSIDE][near] = across
        gate = np.repeat(np.repeat(np.arange(len(active), dtype=np.int32) * GATES, take), bits) + (more >> SHIFT + 2) * 2
        gate[near] += across != 0
        z = v[0] * weights[0].take(gate)
        for k in range(1, ALL):
            z += v[k] * weights[k].take(gate)
        np.clip(z, np.float32(-7.99), np.float32(7.99), out=z)
        cell = gate * CELLS + ((z + 8) * np.float32(CELLS / 16)).astype(np.int32)
        sign = ((more >> SHIFT & 1) * 2 - 1).astype(np.float32)
        good = 1 / (1 + np.exp(-sign * (z + extra[cell])))  # the probability of what came
        out[token] = np.add.reduceat(np.log(good), np.cumsum(bits) - bits)
        error, m = sign * (1 - good), len(active) * GATES
        seen[:m] += np.bincount(gate, minlength=m)
        pace = RATE / np.sqrt(1 + seen[:m] / 64) / STEP
        for k in range(ALL):
            weights[k, :m] += np.clip(pace * np.bincount(gate, error * v[k], m) / STEP, -0.3 / STEP, 0.3 / STEP)
        extra[: m * CELLS] += np.clip(MAP_RATE * np.bincount(cell, error, m * CELLS), -0.2, 0.2)
        at, width = at + width, min(128, width if at == 0 else 2 * width)


def earlier(x: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The sum of ``x`` over the tokens before each in its text."""
    total = np.r_[0.0, np.cumsum(x)]
    return total[:-1] - total[ends[:-1]][doc]


def scored(t: Words, c: np.ndarray, bits: np.ndarray, tokens: int, distinct: int) -> tuple[np.ndarray, ...]:
    """(tokens, known ones, base score, score) of each text.

    A token's probability is a mixture of its share of the training tokens and that by the bit predictors; how much the
    first counts follows, after known and after unknown words, how well both did in the text so far.
    """
    doc, n = np.repeat(np.arange(len(t.ends) - 1), np.diff(t.ends)), np.diff(t.ends)
    count = c[t.code]
    base = np.log10((count + 0.1) / (tokens + 0.1 * (distinct + 1)))
    listed, coded = count / max(tokens, 1), np.exp(bits)
    won = TRUST * listed / np.maximum(TRUST * listed + (1 - TRUST) * coded, 1e-300)
    after = np.r_[True, count[:-1] > 0]
    after[t.ends[:-1][n > 0]] = True
    trust = np.empty(len(count))
    for kind in (True, False):
        on = after == kind
        good, all_ = (earlier(np.where(on, x, 0.0), t.ends, doc) for x in (won, np.ones(len(on))))
        trust[on] = ((FAITH * TRUST + good) / (FAITH + all_))[on]
    score = np.log10(trust * listed + (1 - trust) * np.maximum(coded, 1e-290))
    total = lambda x: np.bincount(doc, x, len(n))
    return n, total(count > 0).astype(np.int64), total(base), total(score)


SCORES = ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row: logarithms to base 10 of its text's probability.

    Tokens are lower-cased (A-Z) words between ASCII white space, then one end. ``base_score`` is that of words drawn
    by their training counts with 0.1 added; ``score`` that of the model, as ``bits_per_byte`` over the words with a space
    each and the end. A null text is empty: an end alone. Rows are independent: equal ones get equal results up to
    rounding; ids may be null or repeat. Without training rows every count is 0.
    """
    rows, head = with_counts(pick(docs, id=id_col, text=text_col), model)
    codes, tables, tokens, distinct = model.codes, model.tables, model.tokens, model.distinct

    def run(batches):
        for b in batches:
            for part in slices(b, "text", 4 << 20):
                t = Words.of(part.column("text"))
                w = Written.of(t.distinct, codes)
                n, known, base, score = scored(t, word_lists(t, part.column("known"), head.value), mixed(t, w, tables.value), tokens, distinct)
                size = np.add.reduceat(pc.binary_length(t.distinct).to_numpy().astype(np.int64)[t.code] + 1, t.ends[:-1])
                yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, (n, known, np.full(len(n), tokens), base, score, -score * np.log2(10) / size))], SCORES)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
