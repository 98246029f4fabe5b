"""Classifiers and regressors, importances, and gradient descent with the weights on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasPredictionCol
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontime.functions.scalar import sigmoid
from ontime.session import stored


def logistic(label: str = "DEP_DEL15", reg: float = 0.0, threshold: float = 0.5, rounds: int = 10, **more) -> LogisticRegression:
    return LogisticRegression(labelCol=label, featuresCol="features", regParam=reg, threshold=threshold, maxIter=rounds, **more)


def forest(label: str = "DEP_DEL15", depth: int = 5, trees: int = 20, seed: int = 1, **more) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=label, featuresCol="features", maxDepth=depth, numTrees=trees, seed=seed, **more)


def boosted(label: str = "DEP_DEL15", depth: int = 4, rounds: int = 20, step: float = 0.1, seed: int = 1, regression: bool = False, **more):
    """Spark's boosted trees, for classes or (regression) for numbers. more: any of their parameters by name.
    Penalties on leaf weights have no counterpart there: see trees.fit_boosted."""
    kind = GBTRegressor if regression else GBTClassifier
    settings = {"labelCol": label, "featuresCol": "features", "maxDepth": depth, "maxIter": rounds, "stepSize": step, "seed": seed} | more
    return kind(**settings)


class _Rule(HasInputCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    factor = Param(Params._dummy(), "factor", "multiple of the mean above which a row counts as positive", TypeConverters.toFloat)


class MeanRule(Estimator, _Rule):
    """A baseline without features: positive where a column is above `factor` times its mean among the
    training rows with a positive label. Models that can't beat it have learned nothing."""

    def __init__(self, column: str = "value", label: str = "DEP_DEL15", factor: float = 1.0):
        super().__init__()
        self._setDefault(factor=1.0, predictionCol="prediction")
        self._set(inputCol=column, labelCol=label, factor=factor)

    def _fit(self, df: DataFrame) -> MeanRuleModel:
        mean = df.where(F.col(self.getLabelCol()) == 1).agg(F.avg(self.getInputCol())).first()[0]
        return self._copyValues(MeanRuleModel()._set(limit=self.getOrDefault("factor") * (mean or 0.0)))


class MeanRuleModel(Model, _Rule):
    limit = Param(Params._dummy(), "limit", "what a row has to exceed", TypeConverters.toFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        above = F.coalesce(F.col(self.getInputCol()) > F.lit(self.getOrDefault("limit")), F.lit(False))
        return df.withColumn(self.getPredictionCol(), above.cast("double"))


def fit_predict(estimator, train: DataFrame, test: DataFrame) -> tuple[Model, DataFrame]:
    model = estimator.fit(train)
    return model, model.transform(test)


def feature_names(df: DataFrame, vector: str = "features") -> list[str]:
    """Names of a vector's elements from its metadata, in order."""
    attrs = df.schema[vector].metadata.get("ml_attr", {}).get("attrs", {})
    found = sorted((a["idx"], a.get("name", str(a["idx"]))) for group in attrs.values() for a in group)
    return [name for _, name in found]


def ranked(spark: SparkSession, names: Iterable[str], values: Iterable[float]) -> DataFrame:
    """feature, importance: the largest, whatever its sign, first; equal ones by name."""
    df = spark.createDataFrame([(n, float(v)) for n, v in zip(names, values, strict=True)], "feature string, importance double")
    return df.orderBy(F.desc(F.abs("importance")), "feature")


def importances(spark: SparkSession, model, names: list[str]) -> DataFrame:
    """feature, importance (or coefficient), most important first."""
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    return ranked(spark, names, [values[i] for i in range(len(names))])


@dataclass
class LogisticFit:
    """Weights of a logistic regression (the constant last), their standard errors, and the steps that led there."""

    features: list[str]
    weights: list[float]
    errors: list[float]
    history: list[tuple[float, list[float]]]  # log loss before each step, weights after it

    def score(self) -> Column:
        return sigmoid(_linear(self.features, self.weights))

    def transform(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Adds probability and prediction (null where a feature is null)."""
        return df.withColumn("probability", self.score()).withColumn("prediction", (F.col("probability") >= threshold).cast("int"))

    def table(self, spark: SparkSession) -> DataFrame:
        """feature, weight, error (null without curvature): a row per feature and one for the constant."""
        rows = zip([*self.features, "constant"], self.weights, self.errors, strict=True)
        return spark.createDataFrame([(c, float(w), None if math.isnan(e) else float(e)) for c, w, e in rows], "feature string, weight double, error double")


def _linear(features: list[str], weights: list[float]) -> Column:
    return reduce(lambda z, x: z + F.lit(float(x[0])) * F.col(x[1]), zip(weights, features, strict=False), F.lit(float(weights[-1])))


def newton_logistic(df: DataFrame, features: list[str], label: str = "DEP_DEL15", ridge: float = 0.0, rounds: int = 25, tolerance: float = 1e-10, weight: str | None = None) -> LogisticFit:
    """Logistic regression by Newton steps on the summed log loss plus ridge / 2 times the squared weights (not the constant's).

    Each step is one aggregation: gradient and Gram matrix of the weighted features, whose size is the square of
    the number of features whatever the table's; the driver solves for the step. Halved where it would raise
    the loss, ended when no weight moves by more than tolerance. Rows with a null label or feature are left out. A
    direction without curvature (a constant feature, no ridge) gets the least step that solves the rest.
    """
    names = [*features, "constant"]
    n = len(names)
    used = reduce(lambda a, c: a & F.col(c).isNotNull(), [*features, *([weight] if weight else [])], F.col(label).isNotNull())
    rows = stored(df.where(used).select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w")))
    x = [*[F.col(c) for c in features], F.lit(1.0)]
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    penalty = np.array([ridge] * (n - 1) + [0.0])

    def look(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = _linear(features, w.tolist())
        p = sigmoid(z)
        r, v = F.col("_w") * (F.col("_y") - p), F.col("_w") * p * (1 - p)
        loss = F.col("_w") * (F.greatest(z, F.lit(0.0)) - z * F.col("_y") + F.log1p(F.exp(-F.abs(z))))
        row = [t or 0.0 for t in rows.agg(F.sum(loss), *[F.sum(r * c) for c in x], *[F.sum(v * x[i] * x[j]) for i, j in pairs]).first()]
        gram = np.zeros((n, n))
        for (i, j), t in zip(pairs, row[n + 1 :], strict=True):
            gram[i, j] = gram[j, i] = t
        return row[0] + float(penalty @ (w * w)) / 2, np.array(row[1 : n + 1]) - penalty * w, gram + np.diag(penalty)

    w, history = np.zeros(n), []
    loss, gradient, gram = look(w)
    for _ in range(rounds):
        step = np.linalg.pinv(gram) @ gradient
        for _ in range(30):
            found = look(w + step)
            if found[0] <= loss + 1e-9 * abs(loss):
                break
            step = step / 2
        w = w + step
        history.append((loss, w.tolist()))
        loss, gradient, gram = found
        if np.abs(step).max() <= tolerance:
            break
    spread = np.diag(np.linalg.pinv(gram))
    free = np.diag(gram) > 0
    errors = [math.sqrt(s) if f and s >= 0 else math.nan for s, f in zip(spread, free, strict=True)]
    return LogisticFit(features, w.tolist(), errors, history)


def gradient_step(df: DataFrame, features: list[str], label: str, weights: list[float], rate: float, kind: str = "logistic",
                  penalty: str | None = None, strength: float = 0.0) -> tuple[list[float], float]:
    """(new weights, loss before the step); weights: one for each feature, then the constant.

    One aggregation gives all components of the gradient. kind: 'logistic' (log loss) or 'linear'
    (squared loss). penalty: 'ridge', 'lasso' or none; the constant isn't penalised.
    """
    z = F.lit(weights[-1])
    for w, c in zip(weights, features, strict=False):
        z = z + F.lit(w) * F.col(c)
    y = F.col(label).cast("double")
    if kind == "logistic":
        p = sigmoid(z)
        residual, loss = p - y, -(y * F.log(p + 1e-5) + (1 - y) * F.log(1 - p + 1e-5))
    else:
        residual, loss = 2 * (z - y), (z - y) * (z - y)
    row = df.agg(*[F.avg(residual * F.col(c)) for c in features], F.avg(residual), F.avg(loss)).first()
    gradient = list(row[: len(features) + 1])
    for i, w in enumerate(weights[:-1]):
        if penalty == "ridge":
            gradient[i] += 2 * strength * w
        elif penalty == "lasso":
            gradient[i] += strength * (w > 0) - strength * (w < 0)
    return [w - rate * g for w, g in zip(weights, gradient, strict=True)], float(row[-1])


def gradient_descent(df: DataFrame, features: list[str], label: str, rounds: int = 20, rate: float = 0.1, **step) -> DataFrame:
    """step, loss and the weights before each step, and after the last. The columns in use are stored
    once; each round reads those."""
    df = stored(df.select(*features, label))
    weights, history = [0.0] * (len(features) + 1), []
    for i in range(rounds):
        new, loss = gradient_step(df, features, label, weights, rate, **step)
        history.append((i, loss, *weights))
        weights = new
    history.append((rounds, None, *weights))
    names = ", ".join(f"w_{c} double" for c in [*features, "constant"])
    return df.sparkSession.createDataFrame(history, f"step int, loss double, {names}")
