"""Pointwise re-ranking by gradient-boosted trees.

This is the binary objective, not LambdaRank: Spark has no listwise learner. Queries without a relevant item in their
pool are left out of the fit; cross-fitting predicts each half of the queries with a model of the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import keep

TREES = 150


def _assembled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep").transform(rows)


def fit(rows: DataFrame, features: Sequence[str], trees: int = TREES, depth: int = 4, step: float = 0.1, seed: int = 42) -> Model:
    """Fit on ``rows`` (query_id, item_id, label, features)."""
    useful = rows.where("label = 1").select("query_id").distinct()
    train = rows.join(useful, "query_id", "left_semi").withColumn("__y", F.col("label").cast("double"))
    # the fit reads its rows once a tree level, and bins and sums depend on their order: one order makes reruns agree
    train = keep(train.repartition(F.col("query_id")).sortWithinPartitions("query_id", "item_id"))
    return GBTClassifier(featuresCol="__x", labelCol="__y", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed).fit(_assembled(train, features))


def predict(model: Model, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """``rows`` with ``prediction``, the model's probability of label 1."""
    out = model.transform(_assembled(rows, features))
    return out.withColumn("prediction", vector_to_array("probability")[1]).drop("__x", "rawPrediction", "probability")


def cross_fit(rows: DataFrame, folds: DataFrame, features: Sequence[str], **how) -> tuple[DataFrame, list[Model]]:
    """Predictions of each half (``folds``: query_id, half) by a model of the other, and both models."""
    r = rows.join(folds.select("query_id", "half"), "query_id")
    out, models = None, []
    for mine, other in (("A", "B"), ("B", "A")):
        m = fit(r.where(F.col("half") == other), features, **how)
        p = predict(m, r.where(F.col("half") == mine), features)
        out, models = (p if out is None else out.union(p)), [*models, m]
    return out.drop("half"), models


def transfer(train_rows: DataFrame, other_rows: DataFrame, features: Sequence[str], **how) -> DataFrame:
    """Predictions of one variant's rows by a model of another's."""
    return predict(fit(train_rows, features, **how), other_rows, features)


def importance(models: Sequence[Model], features: Sequence[str]) -> list[tuple[str, float]]:
    """(feature, mean share of gain), largest first."""
    mean = {f: sum(float(m.featureImportances[i]) for m in models) / len(models) for i, f in enumerate(features)}
    return sorted(mean.items(), key=lambda x: (-x[1], x[0]))
