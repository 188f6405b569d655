"""Runs of repeated words in long texts, caught online by catchers over completed power-of-two blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.common import pick, slices

#: An odd number whose powers weight the words' hashes; products are taken modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def spread(x: np.ndarray) -> np.ndarray:
    """64 mixed bits of each integer; different integers give different results."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Catchers:
    """Maximal runs of a growing sequence of integers: stretches with smallest period q of ``exponent`` periods or more.

    For each level of block length B = 2^l, the block that was completed before the last completed one is on watch: an
    appended word n looks back by p = B..2B-1 words, one p for each level, and the suffix of B words that it ends is
    compared with the block by prefix sums of hashes. Two such catches in a row at the same p are a square (B-long halves
    overlap by a whole period); it is stretched by comparing the words themselves, so a hash can only cost time, and
    grows with later words while it touches the end. Squares inside a stretch that is known have a multiple of its
    period and merge into it. An appended word costs one comparison for each level; a square that holds is
    stretched once.
    """

    def __init__(self, exponent: int = 4, least: int = 6, longest: int | None = None):
        self.exponent, self.least, self.longest = exponent, least, longest
        if exponent < 4:
            raise ValueError("fewer than four periods may hold no two catches in a row")
        self.v, self.total, self.power = np.zeros(0, np.int64), np.zeros(1, np.uint64), np.ones(1, np.uint64)
        self.caught: list[tuple[np.ndarray, np.ndarray]] = []  # of each level, the last catches: (end, period)
        self.known: list[tuple[int, int, int]] = []  # (start, end, period) of stretches that are closed and long enough
        self.open: list[tuple[int, int]] = []  # (start, period) of stretches that touch the end

    def append(self, words: np.ndarray) -> None:
        """Take the next words; integers of 0 or more, equal ones are equal words, negative ones equal nothing if unique."""
        old, n = len(self.v), len(self.v) + len(words)
        if n == old:
            return
        self.v = np.concatenate([self.v, words])
        self.power = np.concatenate([self.power, self.power[-1] * np.multiply.accumulate(np.full(len(words), BASE))])
        self.total = np.concatenate([self.total, self.total[-1] + np.cumsum(spread(words) * self.power[old:n], dtype=np.uint64)])
        self._advance(old)
        size, level = 1, 0
        while 2 * size <= n and (self.longest is None or self.exponent * size <= self.longest):
            self._catch(level, size, old, n)
            size, level = 2 * size, level + 1

    def _advance(self, old: int) -> None:
        """Stretches that touched the old end go on as far as the new words keep their period."""
        still = []
        for start, p in self.open:
            end = self._right(old, p)
            if end == len(self.v):
                still.append((start, p))
            else:
                self._close(start, end, p)
        self.open = still

    def _catch(self, level: int, size: int, old: int, n: int) -> None:
        if level == len(self.caught):
            self.caught.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
        first = max(old, 2 * size - 1)
        if first >= n:
            return
        at = np.arange(first, n)
        back = size + (at + 1) % size  # the distance that belongs to this word and level
        block = at + 1 - back  # the end of the block on watch
        t, p = self.total, self.power
        hit = (t[block] - t[block - size]) * p[back] == t[first + 1 : n + 1] - t[first + 1 - size : n + 1 - size]
        hit &= self.v[first:n] == self.v[block - 1]
        ends, periods = at[hit], back[hit]
        new = self._new(ends, periods, size, old)
        ends, periods = np.r_[self.caught[level][0], ends[new]], np.r_[self.caught[level][1], periods[new]]
        order = np.lexsort((ends, periods))
        ends, periods = ends[order], periods[order]
        follows = np.flatnonzero((periods[1:] == periods[:-1]) & (ends[1:] == ends[:-1] + size))
        alone = np.ones(len(ends), bool)
        if len(follows):
            alone[follows] = alone[follows + 1] = False
            gap = np.diff(follows) > 1
            head, tail = follows[np.r_[True, gap]], follows[np.r_[gap, True]] + 1
            longest = ends[tail] - ends[head] + 3 * size - 2 + periods[head]  # as far as it can go beside blocks that differ
            go = (ends[tail] + size >= n - 1) | (longest >= np.maximum(self.least, self.exponent * periods[head]))
            for h, t in zip(head[go], tail[go], strict=True):
                self._square(int(ends[h]) - size + 1, int(ends[t]), int(periods[h]))
        wait = alone & (ends > n - 1 - 2 * size)  # a catch that may still be followed by another
        self.caught[level] = ends[wait], periods[wait]

    def _new(self, ends: np.ndarray, periods: np.ndarray, size: int, old: int) -> np.ndarray:
        """Catches that lie in no known stretch of their own period or of one below ``size``, which divides theirs."""
        spans = [k for k in self.known if k[1] > old] + [(s, len(self.v), p) for s, p in self.open]
        out, begin = np.ones(len(ends), bool), ends + 1 - size - periods
        for s, e, p in spans:
            if size <= p < 2 * size:
                out &= (periods != p) | (begin < s) | (ends >= e)
        below = sorted((s, e) for s, e, p in spans if p < size)
        if below:
            s, e = np.array(below).T
            out &= np.r_[-1, np.maximum.accumulate(e)][np.searchsorted(s, begin, side="right")] <= ends
        return out

    def _square(self, a: int, b: int, p: int) -> None:
        """Stretch what repeats at distance p over the words a..b as far as it goes, by the words themselves."""
        v = self.v
        bad = np.flatnonzero(v[a : b + 1] != v[a - p : b + 1 - p])
        if len(bad):  # hashes met, words don't: what is right of the last difference
            a += int(bad[-1]) + 1
        end, start = self._right(a, p), a - p
        step = 64
        while start:
            k = min(step, start)
            differ = np.flatnonzero(v[start - k : start] != v[start - k + p : start + p])
            if len(differ):
                start -= k - 1 - int(differ[-1])
                break
            start, step = start - k, 2 * step
        if end == len(v):
            self.open.append((start, p))
        else:
            self._close(start, end, p)

    def _right(self, at: int, p: int) -> int:
        """The first word from ``at`` on that differs from the one p before, or the end."""
        step, n = 64, len(self.v)
        while at < n:
            k = min(step, n - at)
            differ = np.flatnonzero(self.v[at : at + k] != self.v[at - p : at - p + k])
            if len(differ):
                return at + int(differ[0])
            at, step = at + k, 2 * step
        return n

    def _close(self, start: int, end: int, p: int) -> None:
        if end - start >= max(self.least, self.exponent * p):
            self.known.append((start, end, p))

    def runs(self) -> np.ndarray:
        """(start, length, period) of the runs in what has been appended so far, by start and period."""
        found = self.known + [(s, len(self.v), p) for s, p in self.open if len(self.v) - s >= max(self.least, self.exponent * p)]
        least: dict[tuple[int, int], int] = {}
        for s, e, p in found:
            least[s, e] = min(p, least.get((s, e), p))
        return np.array(sorted((s, e - s, p) for (s, e), p in least.items()), np.int64).reshape(-1, 3)


#: Words taken by the catchers at a time.
CHUNK = 1 << 16

SCHEMA = "id {}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: its maximal runs, and its words without repeats within runs.

    Words are what stands between ASCII white space. A run (start, length, period: words, from 0) is a stretch whose
    words equal those ``period`` before, of ``exponent`` periods and ``least`` words or more, with its smallest period,
    that can't be extended; runs come by start, then period. ``collapsed`` joins by one space the words that no run
    contains after its first period. Whole texts are read; many short ones, or one long, go through one set of catchers
    with a word of its own after each text. Rows are independent: equal ids or texts are answered each; a null or empty
    text has no words, no runs and an empty ``collapsed``.
    """
    rows = pick(docs, id=id_col, text=text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                yield pa.RecordBatch.from_arrays([part.column("id"), *caught(part.column("text"), least, exponent)], ["id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, SCHEMA.format(rows.schema["id"].dataType.simpleString()))


def caught(texts: pa.Array, least: int, exponent: int) -> list[pa.Array]:
    """Number of words, runs and collapsed text of each text."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, offsets = parts.values, parts.offsets.to_numpy()
    words = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty part
    ends = np.r_[0, np.cumsum(words.to_numpy(zero_copy_only=False))][offsets]
    flat, counts = flat.filter(words), np.diff(ends)
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    own = np.repeat(np.arange(len(counts)), counts)
    stream = np.empty(len(codes) + len(counts), np.int64)
    stream[np.arange(len(codes)) + own] = codes
    stream[ends[1:] + np.arange(len(counts))] = -1 - np.arange(len(counts))  # equals nothing
    catchers = Catchers(exponent, least, int(counts.max(initial=0)))
    for at in range(0, len(stream), CHUNK):
        catchers.append(stream[at : at + CHUNK])
    start, length, period = catchers.runs().T
    doc = np.searchsorted(ends[:-1] + np.arange(len(counts)), start, side="right") - 1
    start = start - doc  # a word's number among all words of the batch
    inside = np.zeros(len(codes) + 1, np.int64)
    np.add.at(inside, start + period, 1)
    np.add.at(inside, start + length, -1)
    keep = np.cumsum(inside)[:-1] == 0
    left = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(keep)][ends].astype(np.int32)), flat.filter(pa.array(keep)))
    spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - ends[doc], length, period)], ["start", "length", "period"])
    cuts = np.searchsorted(doc, np.arange(len(counts) + 1)).astype(np.int32)
    return [pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(cuts), spans), pc.binary_join(left, " ")]
