"""Votes of several models."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outputs(df: DataFrame, keys: list[str], name: str, prediction: str = "prediction", probability: str = "probability", keep: list[str] = ()) -> DataFrame:
    """keys, keep, NAME_pred, NAME_p0, NAME_p1 of a model's scored rows."""
    vector = dict(df.dtypes)[probability] == "vector"
    p = vector_to_array(F.col(probability)) if vector else F.col(probability)
    return df.select(*keys, *keep, F.col(prediction).alias(f"{name}_pred"), F.get(p, F.lit(0)).alias(f"{name}_p0"), F.get(p, F.lit(1)).alias(f"{name}_p1"))


def join_outputs(models: list[DataFrame], keys: list[str]) -> DataFrame:
    """Left joins from the first; rows with a null key find no partner."""
    return reduce(lambda a, b: a.join(b, keys, "left"), models)


def hard_vote(predictions: list[Column]) -> Column:
    """1 where more than half of the models say so."""
    return F.when(reduce(lambda a, b: a + b, predictions) / F.lit(len(predictions)) > 0.5, 1).otherwise(0)


def soft_vote(p0: list[Column], p1: list[Column]) -> Column:
    """The class with the larger sum of probabilities; equal sums go to class 1."""
    total = lambda ps: reduce(lambda a, b: a + b, ps)
    return F.when(total(p0) > total(p1), 0).otherwise(1)


def attach(features: DataFrame, votes: DataFrame, keys: list[str]) -> DataFrame:
    """Votes joined back to the rows' features; votes without features keep nulls."""
    return votes.join(features, keys, "left")
