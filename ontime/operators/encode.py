"""Encoders: fitted on one table, applied to any."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.feature import Bucketizer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontime import columns as C
from ontime.functions import scalar as S
from ontime.operators.timejoin import dimension
from ontime.session import stored


@dataclass
class TargetMeanEncoder:
    """Mean label of each category, from training rows; unseen and null categories get the mean of all."""

    column: str
    label: str

    def fit(self, train: DataFrame) -> TargetMeanModel:
        y = F.avg(F.col(self.label).cast("double"))
        return TargetMeanModel(self.column, train.groupBy(self.column).agg(y.alias("_mean")), train.agg(y.alias("_all")))


@dataclass
class TargetMeanModel:
    column: str
    means: DataFrame
    overall: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        means = dimension(self.means.where(F.col(self.column).isNotNull()))
        out = df.join(means, self.column, "left").crossJoin(F.broadcast(self.overall))
        new = F.coalesce("_mean", "_all").alias(f"{self.column}_mean_encoding")
        return out.select(*[out[c] for c in df.columns], new)


@dataclass
class OutOfFoldEncoder:
    """Mean label of a category among rows of other folds, drawn towards the mean of all of those.

    A row's own fold, and so its own label, is never in its value: sums by category and fold are taken once,
    and each fold's own part is subtracted from its category's. prior: how many rows the overall mean counts
    for. Folds follow a hash of key, so reruns agree. Null categories are one category; a category that only
    one fold has gets the overall mean there, and so do unseen ones. Rows without a label are encoded too.
    """

    column: str
    label: str
    key: list[str]
    folds: int = 5
    prior: float = 10.0
    seed: int = 1

    def _fold(self) -> Column:
        return F.floor(S.uniform(self.seed, *[F.col(k) for k in self.key]) * self.folds).cast("int")

    def fit(self, train: DataFrame) -> OutOfFoldModel:
        y = F.col(self.label).cast("double")
        sums = train.groupBy(F.col(self.column).alias("_c"), self._fold().alias("_f")).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
        return OutOfFoldModel(self, stored(sums))


@dataclass
class OutOfFoldModel:
    encoder: OutOfFoldEncoder
    sums: DataFrame  # _c, _f, _s, _n: a row per category and fold

    def _shrunk(self, s: Column, n: Column, all_s: Column, all_n: Column) -> Column:
        prior = F.lit(float(self.encoder.prior))
        mean = F.try_divide(all_s, all_n)
        return F.coalesce(F.try_divide(F.coalesce(s, F.lit(0.0)) + prior * mean, F.coalesce(n, F.lit(0)) + prior), mean)

    def _totals(self, by: list[str]) -> DataFrame:
        return self.sums.groupBy(*by).agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("_as"), F.coalesce(F.sum("_n"), F.lit(0)).alias("_an"))

    def _joined(self, df: DataFrame, table: DataFrame, same: Column, value: str) -> DataFrame:
        out = df.join(dimension(table), same, "left")
        return out.select(*[df[c] for c in df.columns if c not in ("_fold",)], F.col(value).alias(f"{self.encoder.column}_mean_encoding"))

    def transform_train(self, train: DataFrame) -> DataFrame:
        """Training rows: means of the other folds."""
        e = self.encoder
        by_category = self._totals(["_c"])
        folds = self.sums.select("_f").distinct()
        inside = self._totals(["_f"]).select("_f", F.col("_as").alias("_fs"), F.col("_an").alias("_fn"))
        whole = self._totals([]).select(F.col("_as").alias("_ws"), F.col("_an").alias("_wn"))
        overall = folds.join(inside, "_f").crossJoin(F.broadcast(whole)).select("_f", (F.col("_ws") - F.col("_fs")).alias("_os"), (F.col("_wn") - F.col("_fn")).alias("_on"))
        own = self.sums.join(by_category.withColumnRenamed("_c", "_k"), F.col("_c").eqNullSafe(F.col("_k"))).join(F.broadcast(overall), "_f")  # a row per fold
        s, n = F.col("_as") - F.coalesce("_s", F.lit(0.0)), F.col("_an") - F.col("_n")
        values = own.select(F.col("_c"), "_f", self._shrunk(s, n, F.col("_os"), F.col("_on")).alias("_value"))
        rows = train.withColumn("_fold", e._fold())
        return self._joined(rows, values, F.col(e.column).eqNullSafe(F.col("_c")) & (F.col("_fold") == F.col("_f")), "_value")

    def transform(self, df: DataFrame) -> DataFrame:
        """Other rows: means of all training rows."""
        e = self.encoder
        whole = self._totals([]).select(F.col("_as").alias("_ws"), F.col("_an").alias("_wn"))
        values = self._totals(["_c"]).withColumn("_seen", F.lit(True))
        out = df.join(dimension(values), F.col(e.column).eqNullSafe(F.col("_c")), "left").crossJoin(F.broadcast(whole))
        value = self._shrunk(F.when(F.col("_seen"), F.col("_as")), F.when(F.col("_seen"), F.col("_an")), F.col("_ws"), F.col("_wn"))
        return out.select(*[df[c] for c in df.columns], value.alias(f"{e.column}_mean_encoding"))


def count_encode(df: DataFrame, column: str) -> DataFrame:
    """X_COUNT: how often the row's category occurs. Counted first, so no task gets a whole category."""
    counts = dimension(df.groupBy(column).agg(F.count("*").alias(f"{column}_COUNT")).withColumnRenamed(column, "_c"))
    return df.join(counts, F.col(column).eqNullSafe(F.col("_c")), "left").drop("_c")


def frequency_index(train: DataFrame, column: str, ascending: bool = False) -> DataFrame:
    """column, index: 0 for the most frequent value (or the least), equal counts in order of value."""
    counts = train.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    w = Window.orderBy(F.asc("_n") if ascending else F.desc("_n"), F.asc(column))
    return counts.select(column, (F.row_number().over(w) - 1).cast("int").alias("index"))


def apply_index(df: DataFrame, index: DataFrame, column: str) -> DataFrame:
    """X_Index; unseen values get the number after the last."""
    n = index.agg(F.count("*").cast("int").alias("_unseen"))
    out = df.join(dimension(index), column, "left").crossJoin(F.broadcast(n))
    return out.select(*[out[c] for c in df.columns], F.coalesce("index", "_unseen").alias(f"{column}_Index"))


def one_hot(df: DataFrame, column: str, values: list, drop_last: bool = False) -> DataFrame:
    """A 0/1 column for each value; others have zeros throughout."""
    used = values[:-1] if drop_last else values
    return df.withColumns({f"{column}_{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in used})


def one_hot_pipeline(column: str, drop_last: bool = True) -> Pipeline:
    """Index and encode as a vector X_classVec, unseen values kept."""
    index = StringIndexer(inputCol=column, outputCol=f"{column}_Index", handleInvalid="keep")
    return Pipeline(stages=[index, OneHotEncoder(inputCols=[f"{column}_Index"], outputCols=[f"{column}_classVec"], handleInvalid="keep", dropLast=drop_last)])


def vector_columns(df: DataFrame, vector: str, names: list[str]) -> DataFrame:
    """A column for each element of a vector."""
    return df.withColumn("_a", vector_to_array(vector)).withColumns({n: F.get("_a", F.lit(i)) for i, n in enumerate(names)}).drop("_a")


def bucketise(df: DataFrame, column: str = "CRS_DEP_TIME", splits: list[float] | None = None, name: str = "CRS_DEP_BUCKET") -> DataFrame:
    """Number of the part of the range, [a, b) but for the last, which has both ends; values outside
    and nulls get the number after the last."""
    splits = C.DAY_PARTS if splits is None else splits
    out = F.lit(None).cast("int")
    for i in range(len(splits) - 2, -1, -1):
        top = F.col(column) <= splits[i + 1] if i == len(splits) - 2 else F.col(column) < splits[i + 1]
        out = F.when((F.col(column) >= splits[i]) & top, i).otherwise(out)
    return df.withColumn(name, F.coalesce(out, F.lit(len(splits) - 1)))


def standardise(df: DataFrame, train: DataFrame, columns: list[str], with_mean: bool = False) -> DataFrame:
    """X_scaled: divided by the training deviation, centred if asked; constant columns give 0."""
    stats = train.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    centre = lambda c: F.col(c) - F.col(f"_m_{c}") if with_mean else F.col(c)
    new = {f"{c}_scaled": F.when(F.col(f"_s_{c}") == 0, F.lit(0.0)).otherwise(centre(c) / F.col(f"_s_{c}")) for c in columns}
    return out.withColumns(new).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def log_columns(df: DataFrame, columns: list[str], shift: float = 1e-6) -> DataFrame:
    return df.withColumns({f"{c}_log": F.log(F.col(c) + F.lit(shift)) for c in columns})


def _bucket_stage(numeric: list[str]) -> tuple[list, list[str]]:
    if "CRS_DEP_TIME" not in numeric:
        return [], list(numeric)
    stage = Bucketizer(splits=[float(x) for x in C.DAY_PARTS], inputCol="CRS_DEP_TIME", outputCol="CRS_DEP_BUCKET", handleInvalid="keep")
    return [stage], [*[c for c in numeric if c != "CRS_DEP_TIME"], "CRS_DEP_BUCKET"]


def regression_pipeline(categorical: list[str], numeric: list[str], with_mean: bool = False) -> Pipeline:
    """Buckets of the departure clock, one-hot categories, one scaled vector `features`."""
    stages, numbers = _bucket_stage(numeric)
    for c in categorical:
        stages += one_hot_pipeline(c).getStages()
    stages.append(VectorAssembler(inputCols=[f"{c}_classVec" for c in categorical] + numbers, outputCol="vectorized_features", handleInvalid="keep"))
    stages.append(StandardScaler(inputCol="vectorized_features", outputCol="features", withMean=with_mean))
    return Pipeline(stages=stages)


def tree_pipeline(numeric: list[str]) -> Pipeline:
    """Buckets of the departure clock and one vector `features`."""
    stages, numbers = _bucket_stage(numeric)
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=numbers, outputCol="features", handleInvalid="keep")])
