"""Features from earlier rows, from groups and from lookup tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontime.functions import scalar as S
from ontime.operators import history as H
from ontime.operators.clean import plain_columns
from ontime.operators.timejoin import dimension


def previous_flag(df: DataFrame, key: str = "TAIL_NUM", ts: str = "TIMESTAMP_UTC", label: str = "DEP_DEL15", name: str = "PREV_DEP_DEL15",
                  least_hours: int = 2, most_hours: int = 12, tie: list[str] = (), block_hours: float = H.BLOCK_HOURS) -> DataFrame:
    """The label of the key's previous row, if that lies least_hours <= gap < most_hours back; else 0.

    Only the immediately previous row counts. A usable row without a label gives null. Rows without a key or
    a time have no previous row, and so 0; they are dealt out evenly. A key's history is cut into blocks of
    block_hours, whose last most_hours are seen by the next one too: a task holds a block of a key at a time.
    """
    spread = H.overlapping(df, ts, most_hours, block_hours)
    unknown = F.col(key).isNull() | F.col(ts).isNull()
    spread = spread.withColumn("_salt", F.when(unknown, F.xxhash64(*plain_columns(df))))
    w = Window.partitionBy(key, "_block", "_salt").orderBy(ts, *tie)
    before, label_before = F.lag(ts).over(w), F.lag(label).over(w)
    hours = lambda n: F.make_interval(hours=F.lit(n))
    usable = ~unknown & (F.col(ts) - hours(least_hours) >= before) & (F.col(ts) - hours(most_hours) < before)
    kind = dict(df.dtypes)[label]
    flag = F.when(usable, label_before).otherwise(F.lit(0).cast(kind))
    return spread.withColumn(name, flag).where(~F.col("_carried")).select(*[c for c in df.columns if c != name], name)


def rolling_share(df: DataFrame, keys: list[str], ts: str = "TIMESTAMP_UTC", label: str = "DEP_DEL15", name: str = "AIRLINE_AIRPORT_STATUS",
                  first: int = -20, last: int = -5, tie: list[str] = (), least_hours: int | None = None, block_hours: float = H.BLOCK_HOURS) -> DataFrame:
    """Mean label of the key's rows from `first` to `last` (negative: before this one).

    least_hours: take the rows by time instead: `-first` hours back up to least_hours back, so no
    outcome younger than that gets in; a row without a time then has none. A key's history is cut into blocks
    of block_hours (see history), so that a hub's rows are spread over tasks.
    """
    if least_hours is None:
        return H.rolling_mean(df, keys, ts, label, name, first, last, list(tie), block_hours)
    spread = H.overlapping(df, ts, -first, block_hours)
    w = Window.partitionBy(*keys, "_block").orderBy(H.micros(ts))
    if dict(df.dtypes)[label] in ("tinyint", "smallint", "int", "bigint"):
        # sums up to the newer end less those before the older one: a row's work doesn't grow with the span's rows
        upto = lambda f, end: f.over(w.rangeBetween(Window.unboundedPreceding, end))
        past = lambda f: upto(f, -least_hours * H.HOUR) - F.coalesce(upto(f, first * H.HOUR - 1), F.lit(0))
        share = F.try_divide(past(F.sum(F.col(label).cast("decimal(20,0)" if dict(df.dtypes)[label] == "bigint" else "bigint"))).cast("double"), past(F.count(label)))
    else:  # differences of running sums would round numbers that aren't whole
        share = F.avg(label).over(w.rangeBetween(first * H.HOUR, -least_hours * H.HOUR))
    mean = F.when(F.col(ts).isNotNull(), share)
    return spread.withColumn(name, mean).where(~F.col("_carried")).select(*[c for c in df.columns if c != name], name)


def _fill(df: DataFrame, columns: list[str], keys: list[str], suffix: str, value, fallback=None) -> DataFrame:
    """Aggregated first and joined, so no task gets all rows of a common key; null keys are a group."""
    return _filled(df, {suffix: columns}, keys, {suffix: value}, fallback)


def _filled(df: DataFrame, columns: dict[str, list[str]], keys: list[str], value: dict, fallback=None) -> DataFrame:
    """_fill for several suffixes, each with its columns and value, by one aggregation."""
    groups = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*[value[s](c).alias(f"_{c}") for s in columns for c in columns[s]])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = df.join(groups, reduce(lambda a, b: a & b, same), "left")
    kinds = dict(df.dtypes)
    last = lambda c: [] if fallback is None else [F.lit(fallback).cast(kinds[c])]
    new = [F.coalesce(F.col(c), F.col(f"_{c}"), *last(c)).alias(f"{c}_{suffix}") for suffix in columns for c in columns[suffix]]
    return joined.select(*[c for c in df.columns if not any(c in some for some in columns.values())], *new)


def fill_group_mean(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """X_mean instead of X: nulls get their group's mean."""
    return _fill(df, columns, keys, "mean", F.avg)


def fill_group_median(df: DataFrame, columns: list[str], keys: list[str], accuracy: int = 10_000) -> DataFrame:
    """X_median instead of X: nulls get their group's (approximate, lower) median."""
    return _fill(df, columns, keys, "median", lambda c: F.percentile_approx(c, 0.5, accuracy))


def fill_group_mean_median(df: DataFrame, means: list[str], medians: list[str], keys: list[str], accuracy: int = 10_000) -> DataFrame:
    """fill_group_mean and then fill_group_median, of other columns, in one pass over the table."""
    return _filled(df, {"mean": means, "median": medians}, keys, {"mean": F.avg, "median": lambda c: F.percentile_approx(c, 0.5, accuracy)})


def fill_group_mode(df: DataFrame, columns: list[str], keys: list[str], fallback) -> DataFrame:
    """X_mode instead of X: nulls get their group's most frequent value (the smallest of equals),
    or the fallback where the group has none."""
    return _fill(df, columns, keys, "mode", lambda c: F.mode(F.col(c), True), fallback)


def fill_from_train(df: DataFrame, train: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """X_mean instead of X, with means of the training rows: nothing of df's own rows leaks in."""
    means = train.groupBy(*keys).agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    joined = df.join(means, keys, "left")
    new = [F.coalesce(F.col(c), F.col(f"_{c}")).alias(f"{c}_mean") for c in columns]
    return joined.select(*[c for c in df.columns if c not in columns], *new)


def holidays(df: DataFrame, calendar: DataFrame, date: str = "FL_DATE") -> DataFrame:
    """is_holiday, and holiday_imp: importance 0, 1, 2 as 1, 2, 3, other days 0.

    calendar: Year, Month, Day as text or numbers, Importance. A day listed twice counts once,
    with its greatest importance.
    """
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    days = calendar.select(F.concat_ws("-", F.col("Year").cast("string"), two("Month"), two("Day")).alias("_day"), "Importance")
    days = dimension(days.groupBy("_day").agg(F.max("Importance").alias("_importance")))
    joined = df.join(days, F.date_format(F.col(date).cast("date"), "yyyy-MM-dd") == F.col("_day"), "left")
    importance = F.when(F.col("_importance").between(0, 2), F.col("_importance") + 1).otherwise(0).cast("int")
    return joined.withColumns({"is_holiday": F.coalesce(F.col("_importance") >= 0, F.lit(False)).cast("int"), "holiday_imp": importance}).drop("_day", "_importance")


def lookup(df: DataFrame, table: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Left join with a lookup table; its key columns are dropped."""
    t = dimension(table)
    for i, (_, b) in enumerate(on):
        t = t.withColumnRenamed(b, f"_k{i}")
    cond = F.col(on[0][0]) == F.col("_k0")
    for i, (a, _) in enumerate(on[1:], 1):
        cond = cond & (F.col(a) == F.col(f"_k{i}"))
    return df.join(t, cond, "left").drop(*[f"_k{i}" for i in range(len(on))])


def interactions(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Products of all pairs as a_b, and their names."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.withColumns({f"{a}_{b}": F.col(a) * F.col(b) for a, b in pairs}), [f"{a}_{b}" for a, b in pairs]


def oversample(df: DataFrame, label: str, minority=1) -> DataFrame:
    """Each row of the minority int(majority / minority) times; the others once."""
    n = df.agg(F.count_if(F.col(label) == minority).alias("_few"), F.count_if(F.col(label) != minority).alias("_many"))
    times = F.when(F.col(label) == minority, F.greatest(F.lit(1), F.floor(F.try_divide("_many", "_few")))).otherwise(1)
    return df.crossJoin(F.broadcast(n)).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long")))).drop("_i", "_few", "_many")


def undersample(df: DataFrame, label: str, seed: int, minority=1, key: list[str] | None = None) -> DataFrame:
    """All of the minority, and of the rest about as many, chosen by a hash of key (see clean.sample)."""
    few, many = df.agg(F.count_if(F.col(label) == minority), F.count_if(F.col(label) != minority)).first()
    chosen = S.uniform(seed, *[F.col(c) for c in key or plain_columns(df)]) < F.lit(few / max(many, 1))
    return df.where((F.col(label) == minority) | ((F.col(label) != minority) & chosen))


def class_weights(df: DataFrame, label: str, name: str = "classWeights") -> DataFrame:
    """Positives weigh the share of negatives, negatives the rest."""
    ratio = df.agg((F.count_if(F.col(label) == 0) / F.count("*")).alias("_ratio"))
    return df.crossJoin(F.broadcast(ratio)).withColumn(name, F.when(F.col(label) == 1, F.col("_ratio")).otherwise(1 - F.col("_ratio"))).drop("_ratio")
