"""Aggregation of readings, and descriptive aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontime.functions import scalar as S
from ontime.operators import timejoin as J


def idw_weight(distance: Column, minutes: Column) -> Column:
    """Inverse distance times inverse time; a zero counts as weight one."""
    part = lambda x: F.when(x == 0, F.lit(1.0)).otherwise(F.try_divide(F.lit(1.0), x.cast("double")))
    return part(distance) * part(minutes)


def weighted_mean(value: Column, weight: Column, digits: int | None = 2) -> Column:
    """Weighted mean over the values that are there; null if none is. Sums, so it combines map-side."""
    mean = F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))
    return mean if digits is None else F.round(mean, digits)


def mode_of(value: Column) -> Column:
    """The most frequent value, nulls and empty texts aside; the smallest of equals."""
    return F.mode(F.when(value.cast("string") != "", value), True)


def collapse_readings(joined: DataFrame, key: list[str], averaged: list[str], modes: list[str], distance: str = "distance_to_neighbor",
                      departure: str = "TIMESTAMP_UTC", observed: str = "DATE_UTC", carry: list[str] = (), digits: int | None = 2) -> DataFrame:
    """One row for each key: weighted means and modes of its readings.

    carry: columns that are the same in all rows of a key.
    """
    w = idw_weight(F.col(distance), S.minutes_between(F.col(departure), F.col(observed)))
    df = joined.withColumn("_w", w)
    aggs = [F.any_value(c).alias(c) for c in carry]
    aggs += [weighted_mean(F.col(c), F.col("_w"), digits).alias(c) for c in averaged]
    aggs += [mode_of(F.col(c)).alias(c) for c in modes]
    return df.groupBy(*key).agg(*aggs)


def collapse_windows(left: DataFrame, right: DataFrame, on: tuple[str, str], departure: str, observed: str, start: str, end: str, averaged: list[str], modes: list[str],
                     distance: str = "distance_to_neighbor", longest_hours: float | None = None, digits: int | None = 2) -> DataFrame:
    """What collapse_readings makes of an interval join of left and right, per distinct (place, departure, start, end) of
    left, without the join's rows: on[0], departure, start, end, averaged, modes; spans without readings have no row.

    Departures of one place and time share a span. Readings of one place, distance and time weigh the same, so they meet
    spans as sums and counts; for modes as counts of each value. Pairs are narrow and are summed in the task that joins them;
    as their number follows no table's bytes, buckets are dealt to all of spark.sql.shuffle.partitions tasks.
    """
    place, there = on
    span = [place, departure, start, end]
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = left.select(*span).where(F.col(start).isNotNull() & F.col(end).isNotNull()).distinct()
    join = lambda cells: J.interval_join(spans, cells.withColumnRenamed(there, "_there"), [(place, "_there")], observed, start, end, "inner", longest_hours, wide=1, parts=parts)
    sums = [f(F.col(c)).alias(f"_{n}_{c}") for c in averaged for n, f in (("s", F.sum), ("n", F.count))]
    met = join(right.groupBy(there, distance, observed).agg(F.count("*").alias("_rows"), *sums))
    met = met.withColumn("_w", idw_weight(F.col(distance), S.minutes_between(F.col(departure), F.col(observed))))
    mean = lambda c: F.try_divide(F.sum(F.col(f"_s_{c}") * F.col("_w")), F.sum(F.when(F.col(f"_n_{c}") > 0, F.col(f"_n_{c}") * F.col("_w"))))
    means = met.groupBy(*span).agg(*[(mean(c) if digits is None else F.round(mean(c), digits)).alias(c) for c in averaged])
    if not modes:
        return means
    # a row for each value there is: the column's number, and the value under its own type
    kinds = dict(right.dtypes)
    value = lambda c, i: F.struct(F.lit(i).alias("_f"), *[(F.col(m) if m == c else F.lit(None).cast(kinds[m])).alias(m) for m in modes])
    there_is = lambda c, i: F.when(F.col(c).cast("string") != "", value(c, i))
    each = right.select(there, observed, F.explode(F.array_compact(F.array(*[there_is(c, i) for i, c in enumerate(modes)]))).alias("_x"))
    cells = each.groupBy(there, observed, *[f"_x.{c}" for c in ("_f", *modes)]).agg(F.count("*").alias("_n"))
    counts = join(cells).groupBy(*span, "_f", *modes).agg(F.sum("_n").alias("_n"))
    first = lambda c, i: F.min_by(F.col(c), F.when(F.col("_f") == i, F.struct(-F.col("_n"), F.col(c))))
    found = counts.groupBy(*span).agg(*[first(c, i).alias(c) for i, c in enumerate(modes)])
    return means.join(found, span, "left")


def class_stats(df: DataFrame, label: str, columns: list[str], scale: dict[str, float] | None = None) -> DataFrame:
    """Mean and sample deviation of each column per class; a column may be scaled."""
    value = lambda c: F.col(c) * F.lit((scale or {}).get(c, 1.0))
    aggs = [f(value(c)).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return df.groupBy(label).agg(*aggs)


def category_share(df: DataFrame, label: str, category: str) -> DataFrame:
    """label, category, n, share: how a class spreads over categories."""
    counts = df.groupBy(label, category).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(label)))


def share_pivot(df: DataFrame, label: str, category: str, values: list) -> DataFrame:
    """A row per class, a column per category with its share."""
    return category_share(df, label, category).groupBy(label).pivot(category, values).agg(F.first("share"))


def top_categories(df: DataFrame, label: str, category: str, k: int = 5) -> DataFrame:
    """The k most frequent categories of each class; equal counts in order of category."""
    w = Window.partitionBy(label).orderBy(F.desc("n"), F.asc(category))
    counts = df.groupBy(label, category).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def correlations(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """a, b, r for each pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.round(F.corr(a, b), digits).alias(f"{a}|{b}") for a, b in pairs])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.a", "x.b", "x.r")


def correlated(df: DataFrame, columns: list[str], limit: float = 0.95) -> DataFrame:
    """Columns to leave out: the later one of each pair with |r| above the limit."""
    return correlations(df, columns, 10).where(F.abs("r") > limit).select(F.col("b").alias("column")).distinct()


def null_audit(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """column, n_null, share of its null rows whose target is null too; one pass."""
    aggs = []
    for c in columns:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"{c}|n"))
        aggs.append(F.count_if(F.col(c).isNull() & F.col(target).isNull()).alias(f"{c}|t"))
    row = df.agg(*aggs)
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"{c}|n").alias("n_null"), F.try_divide(f"{c}|t", f"{c}|n").alias("target_null_share"))
        for c in columns
    ]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def distinct_audit(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """column, n_values, n_distinct; one pass."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    row = df.agg(*[x for c in columns for x in (F.count(c).alias(f"{c}|n"), count(c).alias(f"{c}|d"))])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"{c}|n").alias("n_values"), F.col(f"{c}|d").alias("n_distinct")) for c in columns]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def quantile(df: DataFrame, column: str, p: float, accuracy: int = 10_000, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.percentile_approx(column, p, accuracy).alias("quantile"))


def mean_by_rank(df: DataFrame, rank: str, value: str) -> DataFrame:
    """Mean for each rank, all ranks in one job."""
    return df.groupBy(rank).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def share_by(df: DataFrame, by: list[Column | str], label: str) -> DataFrame:
    """n and share of label by any dimension."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("share"))


def monthly_spread(df: DataFrame, year: Column, month: Column, label: str) -> DataFrame:
    """month, spread: deviation over the years of that month's share of label."""
    shares = df.groupBy(year.alias("year"), month.alias("month")).agg(F.avg(F.col(label).cast("double")).alias("share"))
    return shares.groupBy("month").agg(F.stddev_samp("share").alias("spread"), F.count("*").alias("n_years"))


def day_part(hour: Column) -> Column:
    """0 to 4: night, morning, noon, afternoon, evening."""
    return F.when(hour < 6, 0).when(hour < 10, 1).when(hour < 14, 2).when(hour < 18, 3).otherwise(4)


def summary(df: DataFrame, columns: list[str] | None = None, accuracy: int = 10_000) -> DataFrame:
    """One row per numeric column: column, count, nulls, mean, stddev, min, q25, q50, q75, max; all in one pass over df."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    columns = columns or [c for c, kind in df.dtypes if kind in numeric or kind.startswith("decimal")]
    x = lambda c: F.col(c).cast("double")
    stats = lambda c: F.struct(
        F.lit(c).alias("column"), F.count(c).alias("count"), F.count_if(F.col(c).isNull()).alias("nulls"), F.avg(x(c)).alias("mean"), F.stddev(x(c)).alias("stddev"), F.min(x(c)).alias("min"),
        *[F.get(F.percentile_approx(x(c), [0.25, 0.5, 0.75], accuracy), F.lit(i)).alias(q) for i, q in enumerate(("q25", "q50", "q75"))], F.max(x(c)).alias("max"),
    )
    return df.agg(*[stats(c).alias(f"_{i}") for i, c in enumerate(columns)]).select(F.inline(F.array(*[f"_{i}" for i in range(len(columns))])))
