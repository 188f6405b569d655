"""Model fits as Spark jobs: families, folds, walk-forward predictions, calibration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.panel import logit
from tidemark.sources.scratch import stage

#: Name -> classifier; those for two classes are wrapped one against the rest where there are more.
FAMILIES: dict[str, Callable[[str, str], Estimator]] = {
    "logistic": lambda y, w: LogisticRegression(labelCol=y, weightCol=w, regParam=1e-3, maxIter=50),
    "tree": lambda y, w: DecisionTreeClassifier(labelCol=y, weightCol=w, maxDepth=6, seed=7),
    "forest": lambda y, w: RandomForestClassifier(labelCol=y, weightCol=w, numTrees=50, maxDepth=8, seed=7),
    "svm": lambda y, w: OneVsRest(classifier=LinearSVC(maxIter=50, regParam=1e-3), labelCol=y, weightCol=w),
    "boosted": lambda y, w: OneVsRest(classifier=GBTClassifier(maxIter=30, maxDepth=4, seed=7), labelCol=y, weightCol=w),
}


def perceptron(layers: list[int], label: str) -> Estimator:
    return MultilayerPerceptronClassifier(labelCol=label, layers=layers, seed=7, maxIter=100)


def fit(df: DataFrame, features: list[str], label: str, family: str = "logistic", weight: str | None = None):
    """A fitted pipeline of assembling, scaling and the family's classifier; rows with nulls are left out."""
    rows = df.na.drop(subset=[*features, label]).withColumn("_w", F.col(weight) if weight else F.lit(1.0))
    stages = [VectorAssembler(inputCols=features, outputCol="_x"), StandardScaler(inputCol="_x", outputCol="features"), FAMILIES[family](label, "_w")]
    return Pipeline(stages=stages).fit(rows)


def predict(model, df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` without rows that lack a feature, with ``pred`` and, where the model has them, ``probs``."""
    got = model.transform(df.na.drop(subset=features))
    cols = [F.col(c) for c in df.columns] + [F.col("prediction").cast("int").alias("pred")]
    return got.select(*cols, *([vector_to_array("probability").alias("probs")] if "probability" in got.columns else []))


def walk_forward(df: DataFrame, windows: list[tuple], features: list[str], label: str, ts: str = "ts", family: str = "logistic", embargo: str = "0 seconds") -> DataFrame:
    """Out-of-sample predictions: for each (train_start, test_start, test_end) a fit on the rows before, less the embargo.

    The windows are few; each fit and each prediction is a job over rows filtered by time.
    """
    df, out = stage(df, "windows"), None
    for k, (a, b, c) in enumerate(windows):
        t = F.col(ts)
        train = df.where((t >= F.lit(a)) & (t < F.lit(b) - F.expr(f"INTERVAL {embargo}")))
        test = predict(fit(train, features, label, family), df.where((t >= F.lit(b)) & (t < F.lit(c))), features).withColumn("window", F.lit(k))
        out = test if out is None else out.unionByName(test)
    return out


def out_of_fold(df: DataFrame, features: list[str], label: str, fold: str = "fold", family: str = "logistic", folds: list[int] | None = None) -> DataFrame:
    """Predictions for each fold by a fit on the others."""
    out = None
    for k in folds or [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]:
        got = predict(fit(df.where(F.col(fold) != k), features, label, family), df.where(F.col(fold) == k), features)
        out = got if out is None else out.unionByName(got)
    return out


def cross_validated(df: DataFrame, features: list[str], label: str, fold: str = "fold", role: str = "role", family: str = "logistic") -> DataFrame:
    """(label, pred, n): confusion counts over all folds, each fitted on its own train rows and scored on its test rows."""
    df, out = stage(df, "folds"), None
    for k in [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]:  # folds are few
        own = df.where(F.col(fold) == k)
        got = predict(fit(own.where(F.col(role) == "train"), features, label, family), own.where(F.col(role) == "test"), features).select(label, "pred")
        out = got if out is None else out.unionByName(got)
    return out.groupBy(label, "pred").agg(F.count(F.lit(1)).alias("n"))


def stacked(df: DataFrame, features: list[str], label: str, share: float, embargo: str, ts: str = "ts", family: str = "logistic") -> DataFrame:
    """The later rows with ``pred`` by a fit on the first ``share`` of the time span, less the embargo."""
    a, b = df.agg(F.unix_timestamp(F.min(ts)), F.unix_timestamp(F.max(ts))).first()
    cut = F.timestamp_seconds(F.lit(int(a + (b - a) * share)))
    return predict(fit(df.where(F.col(ts) < cut - F.expr(f"INTERVAL {embargo}")), features, label, family), df.where(F.col(ts) >= cut), features)


def weekly_refit(df: DataFrame, features: list[str], label: str, ts: str = "ts", end: str = "exit_ts") -> DataFrame:
    """Each week's rows with ``p_win`` by a logistic fit on rows whose ``end`` came before the week; the first week has none."""
    df, out = stage(df, "weekly"), None  # each week's fit reads the rows, not what they come from
    for (week,) in df.select(F.date_trunc("week", ts).alias("w")).distinct().orderBy("w").collect():  # weeks are few
        train = df.where(F.col(end) < F.lit(week))
        if train.select(label).distinct().count() < 2:
            continue
        model = fit(train, features, label)
        got = predict(model, df.where(F.date_trunc("week", ts) == F.lit(week)), features).withColumn("p_win", F.element_at("probs", 2))
        out = got if out is None else out.unionByName(got)
    return out if out is not None else df.limit(0).withColumn("p_win", F.lit(None).cast("double"))


def isotonic(train: DataFrame, df: DataFrame, prob: str, label: str, name: str) -> DataFrame:
    """``df`` with ``name``: the probability calibrated by isotonic regression on ``train``."""
    rows = train.select(F.col(prob).alias("_p"), F.col(label).cast("double").alias("_y"))
    model = IsotonicRegression(featuresCol="_p", labelCol="_y", predictionCol=name).fit(rows)
    return model.transform(df.withColumn("_p", F.col(prob))).drop("_p")


def platt(train: DataFrame, df: DataFrame, prob: str, label: str, name: str) -> DataFrame:
    """``df`` with ``name``: a logistic fit on the logit of the probability."""
    slope, intercept = sigmoid_fit(train.select(logit(F.col(prob)).alias("_z"), F.col(label).cast("double").alias("_y")))
    return df.withColumn(name, 1 / (1 + F.exp(-(F.lit(slope) * logit(F.col(prob)) + F.lit(intercept)))))


def sigmoid_fit(rows: DataFrame) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of ``_y`` on ``_z``."""
    model = LogisticRegression(labelCol="_y", regParam=0.0).fit(VectorAssembler(inputCols=["_z"], outputCol="features").transform(rows))
    return float(model.coefficients[0]), float(model.intercept)


def isotonic_panel(train: DataFrame, df: DataFrame, probs: list[str], label: str) -> DataFrame:
    """One-against-rest isotonic calibration of class probabilities, each row scaled to sum 1 again."""
    got = df
    for k, p in enumerate(probs):
        got = isotonic(train.withColumn("_one", (F.col(label) == k).cast("double")), got, p, "_one", f"_c{k}")
    total = F.nullif(sum((F.col(f"_c{k}") for k in range(len(probs))), F.lit(0.0)), F.lit(0.0))
    return got.withColumns({p: F.coalesce(F.col(f"_c{k}") / total, F.lit(1 / len(probs))) for k, p in enumerate(probs)}).drop(*[f"_c{k}" for k in range(len(probs))])
