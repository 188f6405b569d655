"""Relevance rules against their SQL where words touch letters outside ASCII."""

import duckdb

from tidemark.functions import text
from tidemark.plans.base import SQL
from tidemark.plans.text import relevant_sql

ODD = [
    "éfed", "fedé", "иoil price", "oil prİce", "OİL prİces", "third\x0brate", "third rate", "mortérate", "at a über rate", "at a rateé", "he fedä us", "whe fed us", "ÿhe fed us",
    "raté", "oiĺ gas", "the Key rate", "steve\x0bjobs", "steve jobs", "interest rates", "trade\n war", "debt_", "_debt", "debt2", "١oil gas", "oil‍gas", None, "", "İntel", "İNTEL", "intelé", "éamd", "ciscó",
]


def test_words_end_where_the_sql_ends_them(spark):
    rows = list(enumerate(ODD))
    got = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: (r.a, r.b) for r in got.select("id", text.relevant(got.t).alias("a"), text.technology(got.t).alias("b")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE x (id INT, t VARCHAR)")
    con.executemany("INSERT INTO x VALUES (?, ?)", rows)
    want = con.execute(f"SELECT id, {relevant_sql('t')}, regexp_matches(lower(t), '{text.TECH}') FROM x").fetchall()
    assert got == {i: (a, b) for i, a, b in want}
    assert {a for a, _ in got.values()} == {True, False} and "regexp_matches" in SQL["p8_tech_subset"]
