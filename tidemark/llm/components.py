"""Connected components of a graph that only Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage

def with_least(rows: DataFrame, most: int) -> DataFrame:
    """(u, v, m): the rows (u, v) of a written table, ``most`` at most, each with the smallest v of its u.

    Minima come from a partial aggregate and are written, so that both sides of the join are plain shuffles: where one
    vertex has very many rows, adaptive execution splits them over tasks.
    """
    low = stage(rows.groupBy("u").agg(F.min("v").alias("m")), "least", most)
    return rows.join(low, "u")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every vertex that has an edge; component is the smallest id reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each round points all neighbours of a vertex to
    the smallest one. Rounds are written to the shared folder. Null ends and loops are dropped; no edges give an empty table.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    e = stage(e.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "cc")
    now, before = state(e), None
    while now != before:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = with_least(stage(large, "cc", 2 * now[0]), 2 * now[0])
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        e = stage(small.select(ends.alias("e")).select("e.u", "e.v").where("u <> v").distinct(), "cc", 4 * now[0])
        before, now = now, state(e)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def state(e: DataFrame) -> tuple:
    """Number and order-free hash of the rows (u, v)."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
