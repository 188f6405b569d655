"""Queries on side routes: cutoffs under a rate cap, activations, expected-net votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import routes
from tidemark.plans.base import H, epoch, hourly, query, rnd

MODELS, SOLO = ["a", "b", "c"], "a"
#: Activations a day that a line of each way may have, and seconds after any crossing without another.
CAPS, REFRACTORY = {"majority": 1.5, "solo": 0.75}, 3 * 3600

MIX = f"""{H}, hk AS (SELECT symbol, ts, epoch(ts)::BIGINT AS k, n FROM h),
pm AS (SELECT symbol, ts, symbol || '-' || k AS id, m, (k // 3600 * 7 * m + n * 3) % 11 + 1 AS a, (k // 3600 * 5 * m + n) % 13 + 1 AS b, (k // 3600 * 3 + m * n) % 7 + 1 AS c FROM hk, (SELECT unnest([1, 2, 3]) AS m)),
q AS (SELECT symbol, ts, id, m, CAST(c AS DOUBLE) / (a + b + c) AS l, CAST(a AS DOUBLE) / (a + b + c) AS s, CAST(b AS DOUBLE) / (a + b + c) AS w FROM pm)"""
SCORED = f"""{MIX}, e AS (SELECT *, l - s AS e, CASE WHEN l - s > 1e-12 THEN 1 WHEN l - s < -1e-12 THEN -1 ELSE 0 END AS v FROM q),
g AS (SELECT symbol, ts, id, CASE WHEN sum((v = 1)::INT) >= 2 THEN 1 WHEN sum((v = -1)::INT) >= 2 THEN -1 ELSE 0 END AS side, greatest(sum((v = 1)::INT), sum((v = -1)::INT)) AS votes,
  max(CASE WHEN m = 1 THEN v END) AS own, max(CASE WHEN m = 1 THEN abs(e) END) AS oe FROM e GROUP BY ALL),
sc AS (SELECT g.symbol, g.ts, g.id, side, votes, own, oe, median(CASE WHEN side = 1 THEN l ELSE s END) + median(greatest(side * e, 0.0)) AS score, sum((m <> 1 AND v = -own)::INT) = 2 AS against
  FROM g JOIN e ON e.id = g.id GROUP BY ALL),
ln AS (SELECT symbol, ts, id, way, side2 AS side, symbol || '|' || way || '|' || side2 AS line, CASE WHEN way = 'majority' THEN CASE WHEN side = side2 THEN score ELSE 0.0 END
  ELSE CASE WHEN own = side2 AND NOT against THEN oe ELSE 0.0 END END AS score FROM sc, (SELECT unnest(['majority', 'solo']) AS way), (SELECT unnest([1, -1]) AS side2)),
lb AS (SELECT *, lag(score) OVER (PARTITION BY line ORDER BY ts) AS b FROM ln),
dv AS (SELECT DISTINCT line, score FROM ln WHERE score > 0), dn AS (SELECT line, count(*) AS n, max(score) AS top FROM dv GROUP BY line),
ct AS (SELECT line, score AS c FROM dv JOIN dn USING (line) WHERE n <= 257 UNION SELECT line, unnest(quantile_cont(score, [{", ".join(str(i / 256) for i in range(257))}])) FROM dv JOIN dn USING (line) WHERE n > 257 GROUP BY line
  UNION ALL SELECT line, top * (1 + 2.220446049250313e-16) FROM dn UNION ALL SELECT line, 1.0 FROM (SELECT DISTINCT line FROM ln) WHERE line NOT IN (SELECT line FROM dn)),
cx AS (SELECT lb.line, ct.c, ts, lag(ts) OVER (PARTITION BY lb.line, ct.c ORDER BY ts) AS p FROM lb JOIN ct ON ct.line = lb.line AND lb.b < ct.c AND lb.score >= ct.c),
ck AS (SELECT line, c, count(*) AS k FROM cx WHERE p IS NULL OR ts - p >= INTERVAL '3 hours' GROUP BY ALL),
dy AS (SELECT line, count(DISTINCT ts::DATE) AS days FROM ln GROUP BY line),
fr AS (SELECT ct.line, ct.c, coalesce(k, 0) AS k, days FROM ct JOIN dy ON dy.line = ct.line LEFT JOIN ck ON ck.line = ct.line AND ck.c = ct.c),
ch AS (SELECT line, arg_max(c, (k, c)) AS c, max(k) AS k, any_value(days) AS days FROM fr WHERE k * 1.0 / days <= CASE WHEN line LIKE '%|majority|%' THEN {CAPS["majority"]} ELSE {CAPS["solo"]} END + 1e-12 GROUP BY line)"""


def mixes(spark, sf):
    """Three models' probabilities of long and short for each hour of each symbol."""
    h = hourly(spark, sf).withColumn("k", epoch())
    hr = F.floor(F.col("k") / 3600)
    got = h.select("symbol", "ts", F.concat_ws("-", "symbol", F.col("k").cast("string")).alias("id"), "n", hr.alias("hr"))
    for m, name in enumerate(MODELS, 1):
        a, b, c = (F.col("hr") * 7 * m + F.col("n") * 3) % 11 + 1, (F.col("hr") * 5 * m + F.col("n")) % 13 + 1, (F.col("hr") * 3 + m * F.col("n")) % 7 + 1
        got = got.withColumns({f"p_long_{name}": c / (a + b + c), f"p_short_{name}": a / (a + b + c), f"wait_{name}": b / (a + b + c)})
    return got.drop("n", "hr")


def chosen(spark, sf):
    scored = routes.route_scores(mixes(spark, sf), MODELS, SOLO)
    series = routes.route_series(scored)
    cap = F.when(F.col("line").contains("|majority|"), CAPS["majority"]).otherwise(CAPS["solo"])
    return scored, series, routes.chosen_cutoffs(routes.crossing_frontier(series, routes.candidate_cutoffs(series), REFRACTORY), cap)


@query("y23_route_cutoffs", f"WITH {SCORED} SELECT line, round(c, 9) AS threshold, k AS crossings, days FROM ch")
def y23_cutoffs(spark, sf):
    return chosen(spark, sf)[2].select("line", rnd("threshold", 9).alias("threshold"), "crossings", "days")


@query(
    "y23_route_activations",
    f"""WITH {SCORED}, x AS (SELECT lb.*, lag(ts) OVER (PARTITION BY lb.line ORDER BY ts) AS p FROM lb JOIN ch ON ch.line = lb.line WHERE lb.score >= ch.c AND b < ch.c),
o AS (SELECT symbol, ts, arg_min(struct_pack(id, way, side, score), (CASE WHEN way = 'majority' THEN 0 ELSE 1 END, -side)) AS r FROM x WHERE p IS NULL OR ts - p >= INTERVAL '3 hours' GROUP BY symbol, ts),
y AS (SELECT r.*, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM o)
SELECT y.id, way, y.side, round(y.score, 6) AS score, p IS NULL OR y.ts - p >= INTERVAL '3 hours' AS accepted,
  CASE WHEN way = 'solo' THEN 'solo' WHEN votes = 3 THEN 'unanimous' WHEN own = sc.side THEN 'decisive' ELSE 'without' END AS route FROM y JOIN sc ON sc.id = y.id""",
)
def y23_activations(spark, sf):
    scored, series, cuts = chosen(spark, sf)
    got = routes.activations(series, cuts, REFRACTORY).join(scored.select("id", "route"), "id")
    return got.select("id", "way", "side", rnd("score").alias("score"), "accepted", F.when(F.col("way") == "solo", "solo").otherwise(F.col("route")).alias("route"))


@query(
    "y23_expected_net",
    f"""WITH {MIX}, v AS (SELECT *, l - w AS nl, s - w AS ns, CASE WHEN l - w > 0 AND l - w > s - w THEN 1 WHEN s - w > 0 AND s - w > l - w THEN -1 ELSE 0 END AS v FROM q),
g AS (SELECT symbol, ts, id, CASE WHEN sum((v = 1)::INT) >= 2 THEN 1 WHEN sum((v = -1)::INT) >= 2 THEN -1 ELSE 0 END AS side, max(CASE WHEN m = 1 THEN v END) AS own FROM v GROUP BY ALL),
n AS (SELECT g.symbol, g.ts, g.id, side, own, count(*) AS votes, median(CASE WHEN side = 1 THEN nl ELSE ns END) AS net FROM g JOIN v ON v.id = g.id AND v.v = g.side WHERE side <> 0 GROUP BY ALL),
f AS (SELECT g.symbol, g.ts, g.id, s2, (side = s2)::INT AS on_, lag((side = s2)::INT) OVER (PARTITION BY symbol, s2 ORDER BY ts) AS b FROM g, (SELECT unnest([1, -1]) AS s2)),
x AS (SELECT *, lag(ts) OVER (PARTITION BY symbol, s2 ORDER BY ts) AS p FROM f WHERE on_ = 1 AND b = 0),
o AS (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS pp FROM x WHERE p IS NULL OR ts - p >= INTERVAL '3 hours')
SELECT o.id, n.side, n.votes, round(n.net, 6) AS net, CASE WHEN n.votes = 3 THEN 'unanimous' WHEN own = n.side THEN 'decisive' ELSE 'without' END AS route, pp IS NULL OR o.ts - pp >= INTERVAL '3 hours' AS accepted
FROM o JOIN n ON n.id = o.id""",
)
def y23_net(spark, sf):
    rows = mixes(spark, sf)
    rows = rows.withColumns({f"net_{s}_{m}": F.col(f"p_{s}_{m}") - F.col(f"wait_{m}") for m in MODELS for s in ("long", "short")})
    scored = routes.net_routes(rows, MODELS, SOLO)
    on = F.explode(F.array(*[F.struct(F.lit("net").alias("way"), F.lit(s).alias("side"), (F.col("side") == s).cast("double").alias("score")) for s in (1, -1)]))
    series = scored.select(F.col("symbol").alias("key"), "ts", "id", on.alias("r")).select("key", "ts", "id", "r.*").withColumn("line", F.concat_ws("|", "key", F.col("side").cast("string")))
    got = routes.activations(series, series.select("line").distinct().withColumn("threshold", F.lit(0.5)), REFRACTORY)
    return got.select("id", "accepted").join(scored, "id").select("id", "side", F.col("votes").cast("long").alias("votes"), rnd("net").alias("net"), "route", "accepted")
