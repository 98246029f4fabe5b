"""A key's history in blocks of time, so that no task needs all rows of a key.

What a row needs of earlier rows is either bounded in time, then rows near the end of a block also go to
the next one, or bounded in number, then the last rows of every block are its summary: a scan over the
summaries of a key gives each block the rows before its first. Rows of a block then look at their own
block and at what was carried over its border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hours of a block. A key's rows within them meet in one task.
BLOCK_HOURS = 168
HOUR = 3_600_000_000


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def block(ts: str, hours: float) -> Column:
    return F.floor(micros(ts) / F.lit(int(hours * HOUR)))


def overlapping(df: DataFrame, ts: str, back_hours: float, hours: float = BLOCK_HOURS) -> DataFrame:
    """Adds _block and _carried: each row is in its block, and once more, as carried, in the next one if it
    lies in the last back_hours of its own. Blocks are not shorter than that."""
    hours = max(hours, back_hours)
    width = int(hours * HOUR)
    b = block(ts, hours)
    late = micros(ts) - b * width >= width - int(back_hours * HOUR)
    place = lambda n, carried: F.struct(n.alias("b"), F.lit(carried).alias("c"))
    places = F.when(late, F.array(place(b, False), place(b + 1, True))).otherwise(F.array(place(b, False)))
    spread = df.withColumn("_place", F.explode(places))
    return spread.select(*df.columns, F.col("_place.b").alias("_block"), F.col("_place.c").alias("_carried"))


def tails(df: DataFrame, keys: list[str], ts: str, value: str, depth: int, tie: list[str], hours: float) -> DataFrame:
    """keys, _block, _before: for every block of a key the values of the `depth` rows before it, newest first.

    Only the last rows of each block leave the task that reads them; a key has as many summaries as blocks.
    """
    cell = [*keys, "_block"]
    newest = Window.partitionBy(*cell).orderBy(*[F.desc(c) for c in (ts, *tie)])
    last = df.select(*keys, block(ts, hours).alias("_block"), *dict.fromkeys([ts, *tie]), F.col(value).alias("_v"))
    last = last.withColumn("_j", F.row_number().over(newest)).where(F.col("_j") <= depth)
    # every summary has a row at least, so as many of them as rows are wanted hold enough
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(-depth, -1)
    summaries = last.groupBy(*cell).agg(F.collect_list(F.struct("_j", F.struct(F.col("_v").alias("v")).alias("_w"))).alias("_rows"))
    ordered = F.transform(F.array_sort("_rows"), lambda x: x["_w"])  # values may be null, so each is in a struct
    carried = F.slice(F.flatten(F.reverse(F.collect_list(ordered).over(before))), 1, depth)
    return summaries.select(*cell, carried.alias("_before"))


def carried_mean(index: Column, sums: Column, count: Column, before: Column, first: int, last: int) -> Column:
    """Mean over the rows from `first` to `last` of a row: sums and count of those in its block, and the rest of
    what was carried (newest first), of which row `index` of the block (from 1) sees its own part."""
    begin = F.greatest(F.lit(1), F.lit(1 - last) - index)
    length = F.lit(1 - first) - index - begin + 1
    part = F.when(length > 0, F.slice(F.coalesce(before, F.array().cast("array<struct<v:double>>")), begin, length))
    more = F.coalesce(F.aggregate(part, F.lit(0.0), lambda acc, x: acc + F.coalesce(x["v"], F.lit(0.0))), F.lit(0.0))
    n = F.coalesce(F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc + x["v"].isNotNull().cast("long")), F.lit(0).cast("long"))
    return F.try_divide(F.coalesce(sums, F.lit(0.0)) + more, count + n)


def rolling_mean(df: DataFrame, keys: list[str], ts: str, value: str, name: str, first: int, last: int, tie: list[str] = (), hours: float = BLOCK_HOURS) -> DataFrame:
    """Adds the mean of `value` over the key's rows from `first` to `last` (negative: before this one).

    tie: columns that order rows with equal times; without them their order is left open.
    """
    if not first <= last <= 0:
        raise ValueError("rows are counted backwards: first <= last <= 0")
    tie = list(tie)
    df_ = df.withColumn("_v", F.col(value).cast("double"))
    before = tails(df_, keys, ts, "_v", -first, tie, hours)
    rows = df_.withColumns({"_block": block(ts, hours), "_row": F.lit(True)})
    both = rows.unionByName(before.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    cell = [*keys, "_block"]
    ordered = Window.partitionBy(*cell).orderBy("_row", ts, *tie)  # what was carried comes first
    frame = ordered.rowsBetween(first, last)
    seen = both.select(
        *df.columns, "_row", (F.row_number().over(ordered) - 1).alias("_i"), F.sum("_v").over(frame).alias("_s"), F.count("_v").over(frame).alias("_n"),
        F.first("_before", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("_seen"),
    ).where("_row")
    return seen.select(*df.columns, carried_mean(F.col("_i"), F.col("_s"), F.col("_n"), F.col("_seen"), first, last).alias(name))
