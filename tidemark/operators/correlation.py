"""Rank correlations of many columns at once, and the columns that near-duplicates leave, in a given order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import stage

#: Bands of a column between approximate quantiles; a task orders the distinct values of one.
BANDS = 64


def average_ranks(long: DataFrame, by: list[str], value: str = "v", bands: int = BANDS) -> DataFrame:
    """``long`` with ``r``, the average rank (from 1) of ``value`` within ``by``, and ``n``, the rows there.

    Distinct values are counted first, so a frequent value is one row; they are ordered within bands and shifted by the
    counts of the bands below.
    """
    cuts = long.groupBy(*by).agg(F.percentile_approx(value, [i / bands for i in range(1, bands)], 20 * bands).alias("_cuts"), F.count(F.lit(1)).alias("n"))
    own = long.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_k")).join(cuts, by)
    own = own.withColumn("_band", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sums = own.groupBy(*by, "_band").agg(F.sum("_k").alias("_in"))
    before = Window.partitionBy(*by).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_band", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_below"))
    inside = F.coalesce(F.sum("_k").over(Window.partitionBy(*by, "_band").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.withColumn("_own", inside).join(sums, [*by, "_band"])
    own = own.select(*by, value, (F.col("_below") + F.col("_own") + (F.col("_k") + 1) / 2).alias("r"), "n")
    return long.join(own, [*by, value])


def null_groups(rows: DataFrame, features: list[str]) -> list[list[str]]:
    """Columns grouped by the rows in which they are null (NaN and infinities count as null), told by counts and sums of row hashes."""
    h = F.xxhash64(*[f"`{c}`" for c in features]).cast("decimal(38,0)")
    gone = lambda c: F.col(f"`{c}`").isNull()
    got = rows.agg(*[F.struct(F.count_if(gone(c)).alias("n"), F.sum(F.when(gone(c), h)).alias("h")).alias(f"c{i}") for i, c in enumerate(features)]).first()
    groups: dict[tuple, list[str]] = {}
    for i, c in enumerate(features):
        groups.setdefault((got[i].n, got[i].h), []).append(c)
    return list(groups.values())


def spearman(rows: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, rho, n): the rank correlation of each two features, a before b in ``features``, over the rows where both have a
    finite value.

    Ranks are average ranks among just those rows. Columns that are null in the same rows share their ranks, so there is
    one ranking a column for each pair of such groups. Ranks are brought together by row and multiplied in tasks: one
    matrix of partial sums a task. ``rho`` is null where a column is constant or no row has both.
    """
    place = {c: i for i, c in enumerate(features)}
    value = lambda c: F.when(F.abs(F.col(f"`{c}`").cast("double")) < float("inf"), F.col(f"`{c}`").cast("double"))
    rows = stage(rows.select(*[value(c).alias(f"x{place[c]}") for c in features]), "features")
    rows = rows.withColumn("rid", F.monotonically_increasing_id())  # of a written table: the same whenever it is read
    groups = [[int(c[1:]) for c in g] for g in null_groups(rows, [f"x{i}" for i in range(len(features))])]
    sets = [(i, j) for i in range(len(groups)) for j in range(i, len(groups))]
    parts = []
    for s, (i, j) in enumerate(sets):
        cells = [F.struct(F.lit(c).alias("f"), F.col(f"x{c}").alias("v")) for c in sorted({*groups[i], *groups[j]})]
        whole = F.col(f"x{groups[i][0]}").isNotNull() & F.col(f"x{groups[j][0]}").isNotNull()
        parts.append(F.when(whole, F.struct(F.lit(s).alias("s"), F.array(*cells).alias("cells"))))
    long = rows.select("rid", F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("p")).select("rid", "p.s", F.explode("p.cells").alias("c"))
    ranked = average_ranks(long.select("rid", "s", "c.f", "c.v"), ["s", "f"])
    vectors = ranked.groupBy("s", "rid").agg(F.collect_list(F.struct("f", (F.col("r") / F.col("n") - (F.col("n") + 1) / (2 * F.col("n"))).alias("r"))).alias("x"), F.max("n").alias("n"))
    size = len(features)

    def products(batches):
        sums: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for b in batches:
            s, lists = b.column("s").to_numpy(), b.column("x")
            own = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            for k in np.unique(s).tolist():
                mine = s[own] == k
                x = np.zeros((int((s == k).sum()), size))
                x[np.unique(own[mine], return_inverse=True)[1], flat.field("f").to_numpy()[mine]] = flat.field("r").to_numpy()[mine]
                sums[k] = sums.get(k, 0) + x.T @ x
                count[k] = count.get(k, 0) + len(x)
        for k, m in sums.items():
            i, j = np.nonzero(np.triu(np.ones((size, size))))
            yield pa.RecordBatch.from_pydict({"s": np.full(len(i), k, np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "xy": m[i, j], "n": np.full(len(i), count[k])})

    grams = vectors.mapInArrow(products, "s int, i int, j int, xy double, n long").groupBy("s", "i", "j").agg(F.sum("xy").alias("xy"), F.sum("n").alias("n"))
    squares = grams.where("i = j")
    member = {c: k for k, g in enumerate(groups) for c in g}
    of = {(i, j): s for s, (i, j) in enumerate(sets)}
    want = [(of[tuple(sorted((member[i], member[j])))], i, j, features[i], features[j]) for i in range(size) for j in range(i + 1, size)]
    want = rows.sparkSession.createDataFrame(want, "s int, i int, j int, a string, b string")
    got = want.join(grams, ["s", "i", "j"], "left")
    for side in ("i", "j"):
        got = got.join(squares.select("s", F.col("i").alias(side), F.col("xy").alias(f"_{side}")), ["s", side], "left")
    flat = F.least("_i", "_j") <= 1e-18 * F.col("n")
    rho = F.when(~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("xy") / F.sqrt(F.col("_i") * F.col("_j")))))
    return got.select("a", "b", rho.alias("rho"), F.coalesce("n", F.lit(0)).alias("n"))


def pruned(matrix: DataFrame, features: list[str], drop: float = 0.95, report: float = 0.8) -> tuple[list[str], list[str], list[tuple[str, str, float, str]]]:
    """(kept, dropped, audit) of ``features`` in their order by the absolute rank correlations of ``matrix`` (a, b, rho).

    A feature goes if one that is kept correlates with ``drop`` or more; the audit names the strongest such one, the first
    of equals. Of a feature that stays the audit names the kept ones at ``report`` or more. The matrix has a row for each two
    features and is read by the driver.
    """
    if not 0 <= report < drop <= 1:
        raise ValueError("thresholds must satisfy 0 <= report < drop <= 1")
    rho = {(r.a, r.b): abs(r.rho) for r in matrix.where("rho is not null").collect()}
    kept, gone, audit = [], [], []
    for f in features:
        near = [(k, rho.get((k, f), rho.get((f, k), 0.0))) for k in kept]
        worst = max((x for x in near if x[1] >= drop), key=lambda x: x[1], default=None)
        if worst:
            gone.append(f)
            audit.append((worst[0], f, worst[1], "drop_second"))
        else:
            audit += [(k, f, c, "report_only") for k, c in near if c >= report]
            kept.append(f)
    return kept, gone, audit
