import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.test_queries import plain
from tidemark.llm import queries, spelling


def edits(w, letters):
    for i in range(len(w) + 1):
        for c in letters:
            yield w[:i] + c + w[i:]
        if i < len(w):
            yield w[:i] + w[i + 1 :]
            for c in letters:
                yield w[:i] + c + w[i + 1 :]


def brute(words, times=2):
    letters, out = {c for w in words for c in w}, []
    near = {w: {x for x in edits(w, letters) if x in words and x != w} for w in words}
    best = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: b if b is not None and words[b] >= times * words[w] else None for w, b in best.items()}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


@pytest.mark.parametrize("letters", ["ab", "abcdé\U0001f600z"])
def test_against_brute_force(spark, letters):
    rng = np.random.default_rng(len(letters))
    words = {}
    for _ in range(700):
        w = "".join(rng.choice(list(letters), int(rng.integers(0, 9))))
        words[w] = int(2 ** rng.integers(0, 9))
    for w in ("x" * 5000, "x" * 4999, "x" * 2500 + "y" + "x" * 2499, "ｘ" * 40 + "a", "ｘ" * 40):  # long words, wide letters
        words[w] = int(rng.integers(1, 99))
    df = spark.createDataFrame([(w, n, 7) for w, n in words.items()] + [(None, 5, 7)], "word string, n long, place int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many partitions: paths go on over their ends
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = spelling.variants(df)
        assert sorted(map(tuple, got.collect())) == brute(words)
        nodes, renames = spelling.numbered_nodes(df.where("word is not null"), F.col("word"))
        by_prefix = {}
        for r in nodes.collect():
            for d, x in enumerate(r.nodes):
                by_prefix.setdefault(r.key[:d], set()).add(renames.get(x, x))
        numbers = [x for s in by_prefix.values() for x in s]
        assert all(len(s) == 1 for s in by_prefix.values()) and len(set(numbers)) == len(numbers) and renames
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_few_words(spark):
    df = spark.createDataFrame([("hello", 9), ("helo", 2), ("hellp", 4), ("elo", 1), ("other", 3)], "word string, n long")
    want = [("elo", "helo", "hello", 1, 1, 2), ("hello", None, "hello", 9, 2, None), ("hellp", "hello", "hello", 4, 1, 9), ("helo", "hello", "hello", 2, 2, 9), ("other", None, "other", 3, 0, None)]
    assert sorted(map(tuple, spelling.variants(df).collect())) == want
    assert spelling.variants(df.where("n > 99")).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(df, times=1)


def test_query_against_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert plain(queries.op12_spelling(spark, SF).toPandas()) == plain(c.execute(queries.OP12).df())


def test_words_of_texts(spark):
    rows = [(1, "Hello hello HELLO É÷×Éé ÉÉÉÉÉ", 0), (2, None, 0), (None, "hello", 0), (1, "Hello hello HELLO É÷×Éé ÉÉÉÉÉ", 0), (3, "", 0)]
    got = {r.word: r.n for r in queries.spelled(spark.createDataFrame(rows, "doc_id long, text string, run int")).collect()}
    assert got["hello"] >= 6 and "É÷×Éé" not in got or got["É÷×Éé"] >= 3
