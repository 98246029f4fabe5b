"""Looking at plans."""

from __future__ import annotations

from pyspark.sql import DataFrame


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def uses_python(df: DataFrame) -> bool:
    """Whether rows leave the JVM."""
    return any(n in physical(df) for n in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas"))


def exchanges(df: DataFrame) -> int:
    return physical(df).count("Exchange hashpartitioning")
