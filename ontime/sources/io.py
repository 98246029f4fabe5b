"""Readers and writers."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontime import columns as C


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Rows of all tables by column name; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_periods(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """One table from the Parquet folders of several periods, whose columns may differ."""
    frames = [spark.read.parquet(p) for p in ([paths] if isinstance(paths, str) else paths)]
    df = union_all(frames)
    return df.select(*columns) if columns else df


def read_between(spark: SparkSession, path: str, column: str = "DATE", start=None, until=None) -> DataFrame:
    """Parquet rows with start <= column < until; either end may be open. The bounds are pushed
    down to the scan."""
    df = spark.read.parquet(path)
    kind = dict(df.dtypes)[column]
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast(kind))
    if until is not None:
        df = df.where(F.col(column) < F.lit(until).cast(kind))
    return df


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*C.STATION_COLUMNS)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; the schema is inferred only where none is given."""
    if schema:
        return spark.read.csv(path, header=True, schema=schema)
    return spark.read.csv(path, header=True, inferSchema=True)


def read_airport_codes(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Airports that have an IATA code (the text 'null' counts as none), all columns as text."""
    df = spark.read.csv(path, header=True)
    return with_code(df).select(*(columns or C.AIRPORT_COLUMNS))


def with_code(df: DataFrame, column: str = "iata_code") -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != "null"))


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    """A calendar for features.holidays: Year, Month, Day as text, Importance; days without a date are left out."""
    parts = [F.col(c).cast("string").alias(c) for c in ("Year", "Month", "Day")]
    days = spark.read.parquet(path).select(*parts, F.col("Importance").cast("int").alias("Importance"))
    return days.na.drop(subset=["Year", "Month", "Day"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_lines(df: DataFrame, path: str, column: str = "value", mode: str = "errorifexists") -> None:
    df.select(F.col(column).cast("string")).write.mode(mode).text(path)


def stage(df: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """Write a stage's result and read it again: later stages start from the files."""
    write_parquet(df, path, "overwrite", by)
    return df.sparkSession.read.parquet(path)


def write_folds(folds: DataFrame, path: str) -> DataFrame:
    """All folds in one table, a folder for each fold and role."""
    return stage(folds, path, ["fold", "role"])


def read_fold(spark: SparkSession, path: str, fold: int, role: str) -> DataFrame:
    """One part of a fold; only its folder is read."""
    return spark.read.parquet(path).where((F.col("fold") == fold) & (F.col("role") == role)).drop("fold", "role")


def overview(df: DataFrame, date: str | None = None) -> DataFrame:
    """One row: number of rows, with separators too, and the latest date."""
    aggs = [F.count("*").alias("n"), F.format_number(F.count("*"), 0).alias("n_text")]
    if date:
        aggs.append(F.max(date).alias("latest"))
    return df.agg(*aggs)
