"""Best-fit packing by a configuration linear program over the histogram of lengths."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pick, stage
from tidemark.llm.tokens import tokenizer

#: Rounds of the multiplicative weights, the step of their logarithms, and the noise that breaks ties between patterns.
ROUNDS, STEP, NOISE = 30, 0.05, 0.02
#: Pieces under a SMALL-th of the capacity stay out of the program: they fill what it leaves.
SMALL = 32
#: Shares of each length that rounding may leave to best fit, which needs a mix of lengths to close sequences exactly.
LEFT = (0.1, 0.2, 0.35, 0.5)


def priced(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Pricing, a knapsack by dynamic programming: for each room the last piece of the pattern of largest value (-1: the
    room is the next smaller one's), and the largest room not above it that ends with a piece.
    """
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for c in range(int(size[0]), capacity + 1):
        n = int(fits[c])
        gain = value[:n] + best[c - size[:n]]
        k = int(gain.argmax())
        best[c], last[c] = (gain[k], k) if gain[k] > best[c - 1] else (best[c - 1], -1)
    return last, np.maximum.accumulate(np.where(last >= 0, np.arange(capacity + 1), 0))


def dearest_patterns(last: np.ndarray, used: np.ndarray, size: np.ndarray, capacity: int) -> np.ndarray:
    """(sizes, most pieces): for each size the dearest pattern that holds it, as sorted positions in ``size``, -1 for none."""
    room, held = used[capacity - size], [np.arange(len(size))]
    while (room > 0).any():
        k = np.where(room > 0, last[room], -1)
        held.append(k)
        room = used[np.where(k >= 0, room - size[k], 0)]
    return np.sort(np.array(held).T, 1)


def fractional(size: np.ndarray, need: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP, seed: int = 42) -> dict[tuple, float]:
    """Patterns (positions in ``size``) and how often each is used: the configuration LP by multiplicative weights.

    A size's weight starts at its length. Each round prices patterns once and takes the dearest one around every size, as
    much of it as keeps the round within its part of each size's demand; the weights of sizes that many patterns ask for
    then fall, those of the others rise. The amounts therefore never use a size beyond its demand.
    """
    rng, n = np.random.default_rng(seed), len(size)
    log_w, use = np.log(size.astype(float)), {}
    for _ in range(rounds):
        held = dearest_patterns(*priced(np.exp(log_w + NOISE * rng.random(n)), size, capacity), size, capacity)
        asked = np.bincount(held[held >= 0], minlength=n)
        part = np.append(need / rounds / np.maximum(asked, 1), np.inf)  # the last entry stands for -1
        for key, amount in zip(held.tolist(), part[held].min(1).tolist(), strict=True):
            key = tuple(k for k in key if k >= 0)
            use[key] = use.get(key, 0.0) + amount
        log_w -= step * np.clip(np.log(np.maximum(asked, 1) / (held >= 0).sum(1).mean()), -1, 3)
    return use


def rounded(use: dict[tuple, float], size: np.ndarray, need: np.ndarray, capacity: int, leave: float) -> tuple[list[tuple[int, dict[int, int]]], np.ndarray]:
    """Whole sequences from LP amounts, and what is left of each size.

    Only patterns that fill a sequence whole are taken, largest amounts first: each rounded up as far as pieces are left,
    then once more as often as keeps ``leave`` of each of its sizes.
    """
    left, out = need.astype(np.int64), []
    full = sorted((k for k in use if int(size[list(k)].sum()) == capacity), key=lambda k: -use[k])
    scale = 1 / max(1e-12, sum(use[k] * len(k) for k in use) / max(1, need.sum()))
    for again in (False, True):
        for key in full:
            at, times = np.unique(key, return_counts=True)
            free = left[at] - np.ceil(leave * need[at]).astype(np.int64) if again else left[at]
            n = int((free // times).min())
            n = n if again else min(n, int(np.ceil(use[key] * scale)))
            if n > 0:
                left[at] -= n * times
                out.append((n, dict(zip(size[at].tolist(), times.tolist(), strict=True))))
    return out, left


def plan(counts: np.ndarray, capacity: int) -> tuple[list[tuple[int, dict[int, int]]], int]:
    """(how often, {length: pieces}) of sequences that hold exactly ``counts[length]`` pieces of each length; and how many
    of the sequences are the linear program's.

    What rounding leaves, and small pieces, are packed by best fit on the histogram, longest first, into sequences of
    their own. Of the roundings by LEFT the one with the fewest sequences counts.
    """
    counts = counts.astype(np.int64)
    size = np.flatnonzero(counts)
    size = size[size > max(0, capacity // SMALL - 1)]
    use = fractional(size, counts[size], capacity) if len(size) else {}
    found = None
    for leave in LEFT:
        out, left = rounded(use, size, counts[size], capacity, leave)
        rest = counts.copy()
        rest[size], rest[0] = left, 0
        every = np.flatnonzero(rest)
        both = out + best_fit(every, rest[every], capacity)
        total = sum(n for n, _ in both)
        if found is None or total < found[0]:
            found = total, both, sum(n for n, _ in out)
    return found[1], found[2]


def best_fit(size: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit over a histogram, longest first; bins of equal contents stay together, so the work follows the lengths."""
    bins: dict[int, list[tuple[int, dict[int, int]]]] = {}  # free space -> (how often, contents)
    for i in range(len(size) - 1, -1, -1):
        s, n = int(size[i]), int(left[i])
        for free in sorted(f for f in bins if f >= s):
            group = bins.pop(free)
            while group and n:
                k, held = group.pop()
                fit = free // s
                full = min(k, n // fit)
                if full:
                    bins.setdefault(free - fit * s, []).append((full, held | {s: held.get(s, 0) + fit}))
                    n -= full * fit
                    k -= full
                if k and n and n < fit:
                    bins.setdefault(free - n * s, []).append((1, held | {s: held.get(s, 0) + n}))
                    n, k = 0, k - 1
                if k:
                    bins.setdefault(free, []).append((k, held))
            if group:
                bins.setdefault(free, []).extend(group)
            if not n:
                break
        if n:
            fit = capacity // s
            if n // fit:
                bins.setdefault(capacity - fit * s, []).append((n // fit, {s: fit}))
            if n % fit:
                bins.setdefault(capacity - n % fit * s, []).append((1, {s: n % fit}))
    return [x for group in bins.values() for x in group]


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end: int, id_col: str, text_col: str) -> DataFrame:
    """(part, id, piece, start, length, ids_crc32, nth): each document's pieces, nth of its length in its partition."""

    def run(batches):
        own, part = tokenizer(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        stop = np.array([end], "<u4").tobytes()
        for b in batches:
            out = {k: [] for k in ("at", "piece", "start", "length", "crc", "nth")}
            for at, t in enumerate(b.column("text")):
                ids = own.ids(t.as_py() or "") + stop
                for p, s in enumerate(range(0, len(ids), 4 * capacity)):
                    body = ids[s : s + 4 * capacity]
                    n = len(body) // 4
                    for k, v in zip(out, (at, p, s // 4, n, zlib.crc32(body), seen[n]), strict=True):
                        out[k].append(int(v))
                    seen[n] += 1
            if b.num_rows:
                num = {k: np.array(v, np.int64) for k, v in out.items()}
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": np.full(len(num["at"]), part, np.int32),
                        "id": b.column("id").take(pa.array(num["at"])),
                        "piece": num["piece"].astype(np.int32),
                        "start": num["start"],
                        "length": num["length"],
                        "ids_crc32": num["crc"],
                        "nth": num["nth"],
                    }
                )
        own.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"part int, id {kind}, piece int, start long, length long, ids_crc32 long, nth long"
    return pick(docs, id=id_col, text=text_col).mapInArrow(run, schema)


class Layout:
    """Where the nth piece of a length goes: runs of places of each length, in order, by pattern."""

    def __init__(self, patterns: list[tuple[int, dict[int, int]]], capacity: int):
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        first, used = 0, np.zeros(capacity + 1, np.int64)
        for n, held in patterns:
            offset = 0
            for s, k in held.items():
                runs.setdefault(s, []).append((int(used[s]), first, offset, k))
                used[s] += n * k
                offset += s * k
            first += n
        self.by_length = {s: np.array(r, np.int64).T for s, r in runs.items()}

    def place(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(length[order]) > 0, True])
        for s, e in zip(cut[:-1], cut[1:], strict=True) if len(length) else ():
            rows = order[s:e]
            size = int(length[rows[0]])
            begin, first, off, k = self.by_length[size]
            r = np.searchsorted(begin, nth[rows], side="right") - 1
            at = nth[rows] - begin[r]
            seq[rows] = first[r] + at // k[r]
            offset[rows] = off[r] + at % k[r] * size
        return seq, offset


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): every document's pieces in few sequences.

    A document is its ids and ``end``; a null text is empty. Only documents of more than ``capacity`` ids are cut. Ties
    and repeated rows are separate pieces; an empty table gives an empty result.

    One pass makes the pieces, which keep no text. The driver sees the histogram of lengths alone, ``capacity`` numbers
    whatever the input. A piece's rank in its length is its place in its partition plus the counts of the partitions
    before (a row for each partition and length, joined by a shuffle); the rank tells pattern, sequence and offset. The
    table of patterns is broadcast: at most ROUNDS patterns for each length, whatever the input.
    """
    spark = docs.sparkSession
    rows = stage(pieces(docs, vocabulary, capacity, end, id_col, text_col), "pieces")
    sizes = stage(rows.groupBy("part", "length").agg(F.max("nth").alias("most")), "sizes")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in sizes.groupBy("length").agg(F.sum(F.col("most") + 1)).collect():
        counts[length] = n
    shared = spark.sparkContext.broadcast(Layout(plan(counts, capacity)[0], capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", "length", F.coalesce(F.sum(F.col("most") + 1).over(before), F.lit(0)).alias("base"))
    ranked = rows.join(base.hint("shuffle_merge"), ["part", "length"]).withColumn("nth", F.col("nth") + F.col("base"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                num = {k: b.column(k).to_numpy() for k in ("length", "nth")}
                seq, offset = shared.value.place(num["length"], num["nth"])
                keep = b.select(["id", "piece", "start", "length", "ids_crc32"])
                yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(seq), pa.array(offset)], [*keep.schema.names, "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("id", "piece", "start", "length", "ids_crc32", "nth").mapInArrow(run, schema)
