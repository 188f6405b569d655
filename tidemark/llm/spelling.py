"""Spelling variants: words one inserted, deleted or replaced letter apart, by pairs of trie nodes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage

#: Numbers that a task hands out: its partition times this, plus a count.
OWN = 1 << 40
#: What a pair stands for: the word cut at a place; the word without its letter at a place, where that is the first of
#: equal letters in a row; the same at a later one.
CUT, WITHOUT, AGAIN = 0, 1, 2


def common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low + 1 < high:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def numbered_nodes(words: DataFrame, key) -> tuple[DataFrame, dict[int, int]]:
    """(word, n, key, part, place, nodes) and renames: the numbers of the trie nodes on the path of each distinct ``key``.

    ``nodes[d]`` is the number of the node of the first d letters, 0 the root. Keys are sorted over range partitions; each
    task walks down its sorted keys with the path of the last one and numbers what is new, so it holds one path. The
    path into a partition's first key may have begun in partitions before; those few numbers get a rename, worked out
    on the driver from the first and last path of each partition.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        last, path, fresh, row = "", [0], part * OWN, 0
        for batch in batches:
            flat, ends = [], [0]
            for k in batch.column("key").to_pylist():
                d = common(last, k)
                del path[d + 1 :]
                path.extend(range(fresh + 1, fresh + 1 + len(k) - d))
                fresh += len(k) - d
                flat.extend(path)
                ends.append(len(flat))
                last = k
            places = pa.array(np.arange(row, row + batch.num_rows) + part * OWN)
            row += batch.num_rows
            nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), places, nodes], [*batch.schema.names, "part", "place", "nodes"])

    rows = words.select("word", "n", key.alias("key")).repartitionByRange("key").sortWithinPartitions("key")
    got = stage(rows.mapInArrow(run, "word string, n long, key string, part int, place long, nodes array<long>"), "nodes")
    edge = F.struct("key", "nodes")
    renames: dict[int, int] = {}
    before, path = "", [0]
    for r in got.groupBy("part").agg(F.min_by(edge, "place").alias("a"), F.max_by(edge, "place").alias("z")).orderBy("part").toLocalIterator():
        for d in range(1, common(before, r.a.key) + 1):
            renames[r.a.nodes[d]] = path[d]
        before, path = r.z.key, [renames.get(x, x) for x in r.z.nodes]
    return got, renames


def renamed(x: np.ndarray, renames: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    old, new = renames
    if not len(old):
        return x
    at = np.minimum(np.searchsorted(old, x), len(old) - 1)
    return np.where(old[at] == x, new[at], x)


def pairs(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, n, place) with ``place`` in code-point order, and the dictionary (a, b, kind, n, place) of node pairs.

    For each place of each word: the node of what stands before it and, in the trie of reversed words, the node of what
    stands after it, with the letter at the place left out or, for CUT, with nothing left out.
    """
    front, of_front = numbered_nodes(words, F.col("word"))
    back, of_back = numbered_nodes(words, F.reverse("word"))
    both = front.select("word", "n", "place", F.col("nodes").alias("front")).join(back.select("word", F.col("nodes").alias("back")), "word")
    maps = [tuple(np.array(sorted(m.items()), np.int64).reshape(-1, 2).T) for m in (of_front, of_back)]

    def run(batches):
        for b in batches:
            size = np.diff(b.column("front").offsets.to_numpy())  # letters and one
            first = np.r_[0, np.cumsum(size)]
            a, z = (renamed(pa.ListArray.flatten(b.column(c)).to_numpy(), m) for c, m in zip(("front", "back"), maps, strict=True))
            own = np.repeat(np.arange(len(size)), size)
            at = np.arange(first[-1]) - first[own]
            mirror = first[own] + size[own] - 1 - at  # the node of all letters from the place on
            letter = at < size[own] - 1
            text = np.frombuffer("".join(w + "\0" for w in b.column("word").to_pylist()).encode("utf-32-le"), np.uint32)
            again = (at > 0) & (text == np.r_[np.uint32(0), text[:-1]])
            n, place = b.column("n").to_numpy()[own], b.column("place").to_numpy()[own]
            kind = np.where(again, AGAIN, WITHOUT).astype(np.int8)
            whole = np.full(len(own), CUT, np.int8)
            out = [np.r_[x, y[letter]] for x, y in ((a, a), (z[mirror], z[np.maximum(mirror - 1, 0)]), (whole, kind), (n, n), (place, place))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["a", "b", "kind", "n", "place"])

    return front.select("word", "n", "place"), both.mapInArrow(run, "a long, b long, kind byte, n long, place long")


def neighbours(dictionary: DataFrame) -> DataFrame:
    """(place, n_near, near_n, near): how many words lie one edit off each word that has any, and which of them comes first
    by ``n``, then by place.

    Words that share a pair without their letter differ in that letter only: no more of them than there are letters. A
    word cut there is those words less a letter. Equal letters in a row are left out once.
    """
    got = dictionary.groupBy("a", "b").agg(F.collect_list(F.struct("kind", "n", "place")).alias("all")).where(F.size("all") > 1)
    got = got.select("all", F.explode("all").alias("x"))
    x = F.col("x")
    met = F.filter("all", lambda y: F.when(x.kind == CUT, y.kind == WITHOUT).otherwise(((y.kind != CUT) & (y.place != x.place)) | ((y.kind == CUT) & (x.kind == WITHOUT))))
    best = F.array_max(F.transform("met", lambda y: F.struct(y.n.alias("n"), (-y.place).alias("p"))))
    got = got.select(x.place.alias("place"), met.alias("met")).select("place", F.size("met").cast("long").alias("k"), best.alias("best"))
    got = got.where("k > 0").groupBy("place").agg(F.sum("k").alias("n_near"), F.max("best").alias("best"))
    return got.select("place", "n_near", F.col("best.n").alias("near_n"), (-F.col("best.p")).alias("near"))


def followed(links: DataFrame) -> DataFrame:
    """(place, root): where ``links`` (place, form) lead in the end; each round doubles the way, and none goes in a circle."""
    now = stage(links.select("place", F.col("form").alias("root"), F.lit(False).alias("moved")), "roots")
    while True:
        further = now.select(F.col("place").alias("root"), F.col("root").alias("next"))
        step = now.join(further, "root", "left").select("place", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        now = stage(step, "roots")
        if now.where("moved").isEmpty():
            return now.select("place", "root")


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n) of distinct words, null ones left out.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point; ``n_near`` counts them. A
    word's form is its near word of largest n (ties: first in code-point order) if that is ``times`` its own n or more;
    ``root`` follows forms to the last and is the word itself where it has none. Words of any length, an empty table and
    the empty word (near every word of one letter) take part like others.
    """
    if times < 2:
        raise ValueError("forms might go in circles")
    v = stage(words.where("word is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    named, dictionary = pairs(v)
    got = stage(named.join(neighbours(dictionary), "place", "left").withColumn("form", F.when(F.col("near_n") >= times * F.col("n"), F.col("near"))), "near")
    links = followed(got.where("form is not null").select("place", "form"))
    ends = got.where("form is not null").select("place", F.col("form").alias("to"), F.col("near_n").alias("form_n")).join(links, "place")
    names = named.select(F.col("place").alias("to"), F.col("word").alias("form"))
    ends = ends.join(names, "to").join(names.select(F.col("to").alias("root"), F.col("form").alias("root_word")), "root").select("place", "form", "root_word", "form_n")
    return got.select("place", "word", "n", "n_near").join(ends, "place", "left").select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"
    )
