"""Queries that fit models or run streams: no SQL; tests hold them against held-out accuracy or the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features, labels, models, splits
from tidemark.plans.base import epoch, hourly, query, rnd


def _rows(spark, sf):
    h = features.returns(hourly(spark, sf))
    y = labels.dead_zone(h, 50)
    return y.where("label >= 0").withColumn("label", F.col("label").cast("double"))


FEATURES = ["ret_1", "ret_5", "hl_range", "co_range"]


@query("m3_walk_forward")
def m3(spark, sf):
    rows = _rows(spark, sf).cache()
    w = splits.walk_forward(rows, 10, 10).select("train_start", "test_start", "test_end").orderBy("test_start").collect()
    got = models.walk_forward(rows, [tuple(r) for r in w], FEATURES, "label", embargo="4 hours")
    return got.select("symbol", epoch().alias("ts_s"), "window", "pred", F.col("label").cast("int").alias("label"))


@query("m4_out_of_fold")
def m4(spark, sf):
    rows = splits.blocked(_rows(spark, sf), 3, 0.8, 4).cache()
    got = models.out_of_fold(rows, FEATURES, "label", family="tree", folds=[0, 1, 2])
    return got.select("symbol", epoch().alias("ts_s"), "fold", "pred", rnd(F.element_at("probs", 1)).alias("p0"))


@query("e11_platt")
def e11(spark, sf):
    from tidemark.plans.evaluation import one

    q = one(spark, sf).withColumn("hit", (F.col("y") == F.col("pred")).cast("int"))
    got = models.platt(q.where("symbol <> 'view'"), q.where("symbol = 'view'"), "conf", "hit", "calibrated")
    return got.select("id", rnd("calibrated", 4).alias("calibrated"))


@query("e10_isotonic")
def e10(spark, sf):
    from tidemark.plans.evaluation import one

    q = one(spark, sf)
    got = models.isotonic_panel(q.where("symbol <> 'view'"), q.where("symbol = 'view'"), ["p0", "p1", "p2"], "y")
    return got.select("id", *[rnd(p, 4).alias(p) for p in ("p0", "p1", "p2")])
