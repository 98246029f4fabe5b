"""Quality of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f_beta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    b = beta * beta
    return F.coalesce(F.try_divide((1 + b) * precision * recall, b * precision + recall), F.lit(0.0))


def confusion(df: DataFrame, prediction: str = "prediction", label: str = "DEP_DEL15", beta: float = 0.5, by: list[str] = ()) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f_beta in one pass; without positives they are 0."""
    p, y = F.col(prediction) == 1, F.col(label) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn")
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    out = counts.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})
    return out.withColumn("f_beta", f_beta(F.col("precision"), F.col("recall"), beta))


def error_group(prediction: Column, label: Column) -> Column:
    return F.when((prediction == 1) & (label == 1), "TP").when((prediction == 1) & (label != 1), "FP").when((prediction == 0) & (label != 0), "FN").otherwise("TN")


def error_groups(df: DataFrame, columns: list[str], prediction: str = "prediction", label: str = "DEP_DEL15") -> DataFrame:
    """Mean of each column among true and false positives and negatives."""
    group = error_group(F.col(prediction), F.col(label)).alias("pred_group")
    return df.groupBy(group).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in columns])


def train_share(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: rows of each and train / (train + test)."""
    both = train.agg(F.count("*").alias("n_train")).crossJoin(test.agg(F.count("*").alias("n_test")))
    return both.withColumn("share", F.try_divide("n_train", F.col("n_train") + F.col("n_test")))


def mean_metrics(per_fold: DataFrame, metrics: list[str], by: list[str] = ()) -> DataFrame:
    return per_fold.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def savings(metrics: DataFrame, delayed_per_year: float, cost_per_flight: float) -> DataFrame:
    """Flights flagged, flagged rightly, and money saved in a year from recall and precision."""
    right = F.col("recall") * F.lit(delayed_per_year)
    return metrics.withColumns({"correct": right, "detected": F.try_divide(right, F.col("precision")), "savings": right * F.lit(cost_per_flight)})
