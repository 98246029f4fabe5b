"""Validation over time: rolling folds, grids, cross-validation."""

from __future__ import annotations

import copy
import importlib
import json
import random
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator, RegressionEvaluator
from pyspark.ml.param import Param
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontime.functions.scalar import uniform
from ontime.operators import features as W
from ontime.operators.clean import plain_columns
from ontime.operators.metrics import confusion
from ontime.session import hold, release


@dataclass(frozen=True)
class Fold:
    """Half-open ranges of month numbers (12 * year + month - 1)."""

    number: int
    train: tuple[int, int]
    valid: tuple[int, int]

    def part(self, df: DataFrame, role: str, month: Column) -> DataFrame:
        low, past = self.train if role == "train" else self.valid
        return df.where((month >= low) & (month < past))


def month_number(year: Column, month: Column) -> Column:
    return year.cast("int") * 12 + month.cast("int") - 1


def rolling_folds(start: int, train: int = 9, valid: int = 3, step: int = 9, n: int = 5) -> list[Fold]:
    """n folds, each `train` months followed by `valid` months, `step` months apart."""
    return [Fold(i + 1, (s, s + train), (s + train, s + train + valid)) for i in range(n) for s in [start + i * step]]


def label_folds(df: DataFrame, folds: list[Fold], month: Column) -> DataFrame:
    """Each row once for every fold and role it belongs to: columns fold, role."""
    roles = [
        F.when((month >= low) & (month < past), F.struct(F.lit(f.number).alias("fold"), F.lit(role).alias("role")))
        for f in folds
        for role, (low, past) in (("train", f.train), ("valid", f.valid))
    ]
    rows = df.withColumn("_f", F.explode(F.array_compact(F.array(*roles))))
    return rows.select(*df.columns, "_f.fold", "_f.role")


def grid(values: dict) -> list[dict]:
    """All combinations of the values of each parameter."""
    return [dict(zip(values, combination, strict=True)) for combination in product(*values.values())]


class Grid:
    """Builds parameter maps: fixed values by base_on, lists of values by add, all combinations by build."""

    def __init__(self):
        self._values: dict[Param, list] = {}

    def add(self, param: Param, values: Iterable) -> Grid:
        if not isinstance(param, Param):
            raise TypeError(f"not a parameter: {param!r}")
        self._values[param] = list(values)
        return self

    def base_on(self, fixed: dict | Iterable[tuple]) -> Grid:
        for param, value in dict(fixed).items():
            self.add(param, [value])
        return self

    def build(self) -> list[dict]:
        return [{p: p.typeConverter(v) for p, v in m.items()} for m in grid(self._values)]


@dataclass
class RandomGrid:
    """Parameter maps drawn from functions of a random.Random; equal seeds give equal maps."""

    n: int
    seed: int | None = None
    draws: dict = field(default_factory=dict)

    def add(self, param, draw: Callable[[random.Random], object]) -> RandomGrid:
        self.draws[param] = draw
        return self

    def build(self) -> list[dict]:
        out = []
        for i in range(self.n):
            rng = random.Random(None if self.seed is None else self.seed + i)
            out.append({p: draw(rng) for p, draw in self.draws.items()})
        return out


def boosted_grid(estimator, n: int, seed: int | None = None) -> list[dict]:
    """Random maps for boosted trees."""
    return (
        RandomGrid(n, seed)
        .add(estimator.maxDepth, lambda r: r.choice([3, 4, 6]))
        .add(estimator.maxIter, lambda r: r.choice([20, 50, 70]))
        .add(estimator.stepSize, lambda r: r.choice([0.1, 0.15]))
        .build()
    )


def skip_folds(n: int, seed: int | None = None) -> list[int]:
    """Two folds to leave out."""
    return random.Random(seed).sample(range(n), 2)


def resample(df: DataFrame, label: str, mode: str | None, seed: int = 1, key: list[str] | None = None) -> DataFrame:
    """mode: 'over', 'under' (by a hash of key) or none; for training rows only."""
    if mode == "over":
        return W.oversample(df, label)
    if mode == "under":
        return W.undersample(df, label, seed, key=key)
    if mode not in (None, "none"):
        raise ValueError(f"no such sampling: {mode}")
    return df


class TimeFoldValidator(Estimator):
    """Cross-validation over given folds: every map is fitted on each fold's training part and
    scored on its validation part; the best by the mean is refitted on the last fold's training part.

    metric: precision, recall or f_beta; or give an evaluator of Spark's, or any function of the
    scored rows that returns a number, with larger_is_better. prepare(train, other) -> (train, other)
    fits encoders on the training part only. sampling: 'over' or 'under', by a hash of `key`.
    keep_models: the models of all folds and maps stay in the result (sub_models[fold][map]).
    folds and time, a column of month numbers, may be given here, for use inside a Pipeline, or to fit.

    One fold after the other is prepared and held in the shared folder, its maps are fitted side by side.
    """

    def __init__(self, estimator: Estimator, maps: list[dict], label: str, metric: str = "f_beta", larger_is_better: bool = True, parallelism: int = 4,
                 sampling: str | None = None, prepare: Callable | None = None, evaluator: Evaluator | Callable | None = None, keep_models: bool = False,
                 folds: list[Fold] | None = None, time: Column | None = None, key: list[str] | None = None):
        super().__init__()
        self.estimator, self.maps, self.label, self.metric = estimator, maps, label, metric
        self.parallelism, self.sampling, self.prepare, self.evaluator = parallelism, sampling, prepare, evaluator
        self.larger_is_better = evaluator.isLargerBetter() if isinstance(evaluator, Evaluator) else larger_is_better
        self.keep_models, self.folds, self.time, self.key = keep_models, folds, time, key

    def copy(self, extra: dict | None = None) -> TimeFoldValidator:
        """The same with other settings of the estimator."""
        other = copy.copy(self)
        other.estimator = self.estimator.copy(extra)
        return other

    def fit(self, df: DataFrame, folds: list[Fold] | dict | None = None, time: Column | None = None) -> TimeFoldModel:
        """folds may also be a parameter map, as for any estimator of Spark's: settings of the estimator for this fit."""
        if isinstance(folds, dict):
            return self.copy(folds).fit(df, None, time)
        folds, time = folds or self.folds, self.time if time is None else time
        rows, models, held = [], {}, []
        try:
            for f in folds:
                release(*held)
                held = []
                train, valid = f.part(df, "train", time), f.part(df, "valid", time)
                if self.prepare:
                    train, valid = self.prepare(train, valid)
                for part in (train, valid):
                    held.append(hold(part))
                train = resample(held[0], self.label, self.sampling, key=self.key)

                def one(i, f=f, train=train, valid=held[1]):
                    model = self.estimator.fit(train, self.maps[i])
                    return model, (f.number, i, *self._judge(model.transform(valid)))

                with ThreadPoolExecutor(self.parallelism) as pool:
                    found = list(pool.map(inheritable_thread_target(one), range(len(self.maps))))
                rows += [row for _, row in found]
                if self.keep_models:
                    models[f.number] = [model for model, _ in found]
            mean = [sum(r[-1] for r in rows if r[1] == i) / len(folds) for i in range(len(self.maps))]
            best = (max if self.larger_is_better else min)(range(len(mean)), key=mean.__getitem__)
            model = self.estimator.fit(train, self.maps[best])
        finally:  # also when a fit fails
            release(*held)
        return TimeFoldModel(model, best, mean, rows, models, [{p.name: v for p, v in m.items()} for m in self.maps])

    def _fit(self, df: DataFrame) -> TimeFoldModel:
        return self.fit(df)

    def _judge(self, scored: DataFrame) -> tuple[float, ...]:
        """precision, recall, f_beta (nothing where the evaluator isn't about classes) and the score."""
        if self.evaluator is None:
            row = confusion(scored, label=self.label).first()
            three = tuple(float(row[m]) for m in ("precision", "recall", "f_beta"))
            return (*three, three[("precision", "recall", "f_beta").index(self.metric)])
        judge = self.evaluator.evaluate if isinstance(self.evaluator, Evaluator) else self.evaluator
        return (None, None, None, float(judge(scored)))


class TimeFoldModel(Model):
    """The best model, and how each map did on each fold."""

    def __init__(self, best_model: Model, best: int, mean_metrics: list[float], rows: list[tuple], sub_models: dict[int, list[Model]], settings: list[dict]):
        super().__init__()
        self.best_model, self.best, self.mean_metrics, self.rows, self.sub_models, self.settings = best_model, best, mean_metrics, rows, sub_models, settings

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.best_model.transform(df)

    def metrics(self, spark: SparkSession) -> DataFrame:
        """fold, map, precision, recall, f_beta, score."""
        return spark.createDataFrame(self.rows, "fold int, map int, precision double, recall double, f_beta double, score double")

    def save(self, spark: SparkSession, path: str) -> None:
        """The best model, those of the folds that were kept, the metrics, and a line of JSON with the
        rest; models are read again by the class that is named there."""
        kept = {f"sub/{fold}/{i}": m for fold, models in self.sub_models.items() for i, m in enumerate(models)}
        for name, model in {"model": self.best_model, **kept}.items():
            model.write().overwrite().save(f"{path}/{name}")
        self.metrics(spark).write.mode("overwrite").parquet(f"{path}/metrics")
        kind = type(self.best_model)
        about = {"class": f"{kind.__module__}:{kind.__qualname__}", "best": self.best, "mean_metrics": self.mean_metrics, "settings": self.settings,
                 "sub": {fold: len(models) for fold, models in self.sub_models.items()}}
        spark.createDataFrame([(json.dumps(about),)], "value string").write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TimeFoldModel:
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        module, _, name = about["class"].partition(":")
        kind = getattr(importlib.import_module(module), name)
        sub = {int(fold): [kind.load(f"{path}/sub/{fold}/{i}") for i in range(n)] for fold, n in about["sub"].items()}
        rows = [tuple(r) for r in spark.read.parquet(f"{path}/metrics").orderBy("fold", "map").collect()]
        return cls(kind.load(f"{path}/model"), about["best"], about["mean_metrics"], rows, sub, about["settings"])


def evaluate_holdout(estimator, train: DataFrame, test: DataFrame, label: str, sampling: str | None = None, prepare: Callable | None = None) -> tuple[Model, DataFrame]:
    """(model, scored test rows), everything fitted on the training rows."""
    if prepare:
        train, test = prepare(train, test)
    held = hold(train)
    try:
        model = estimator.fit(resample(held, label, sampling))
    finally:
        release(held)
    return model, model.transform(test)


def judge_of(label: str, metric: str) -> Evaluator:
    if metric in ("rmse", "mae", "r2", "mse"):
        return RegressionEvaluator(labelCol=label, metricName=metric)
    return BinaryClassificationEvaluator(labelCol=label, metricName=metric)


def kfold(estimator, maps: list[dict], df: DataFrame, label: str, metric: str = "rmse", folds: int = 3, seed: int = 1,
          prepare: Callable | None = None, key: list[str] | None = None, evaluator: Evaluator | Callable | None = None):
    """Plain k-fold cross-validation: (best model, mean metric of each map). Rows are dealt by a hash of
    their key, so it suits data without an order in time; encoders are fitted fold by fold."""
    judge = evaluator or judge_of(label, metric)
    deal = F.floor(uniform(seed, *[F.col(c) for c in key or plain_columns(df)]) * folds).cast("int")
    dealt = df.withColumn("_fold", deal)
    totals = [0.0] * len(maps)
    for n in range(folds):
        train, valid = dealt.where(F.col("_fold") != n).drop("_fold"), dealt.where(F.col("_fold") == n).drop("_fold")
        if prepare:
            train, valid = prepare(train, valid)
        held = []
        try:
            for part in (train, valid):
                held.append(hold(part))
            for i, m in enumerate(maps):
                scored = estimator.fit(held[0], m).transform(held[1])
                totals[i] += float(judge.evaluate(scored) if isinstance(judge, Evaluator) else judge(scored)) / folds
        finally:
            release(*held)
    up = judge.isLargerBetter() if isinstance(judge, Evaluator) else True
    best = (max if up else min)(range(len(maps)), key=totals.__getitem__)
    whole = hold(prepare(df, df)[0] if prepare else df)
    try:
        return estimator.fit(whole, maps[best]), totals
    finally:
        release(whole)
