"""Joins in time: windows before departures, stations near airports, readings inside windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontime.functions import scalar as S
from ontime.session import stored

#: Bytes, as its plan knows them, up to which a dimension is broadcast.
SMALL_BYTES = 10 << 20
#: Pairs of an airport and a station up to which they are broadcast.
FEW = 100_000


def dimension(df: DataFrame) -> DataFrame:
    """The table marked for broadcast if its plan says that it is small, else as it is: for others
    adaptive execution decides by the size that it finds."""
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES
    return F.broadcast(df) if small else df


def window_bounds(df: DataFrame, ts: str = "TIMESTAMP_UTC", start: int = 6, end: int = 2,
                  names: tuple[str, str] = ("WEATHER_WINDOW_START", "WEATHER_WINDOW_END")) -> DataFrame:
    """The span from `start` to `end` hours before ts. Less than two hours ahead can't be known."""
    if end < 2:
        raise ValueError("the window must end two hours before the time at the latest")
    return df.withColumns({names[0]: S.hours_before(F.col(ts), start), names[1]: S.hours_before(F.col(ts), end)})


def departure_times(flights: DataFrame, zones: DataFrame, start: int = 6, end: int = 2, date: str = "FL_DATE",
                    hhmm: str = "CRS_DEP_TIME", airport: str = "ORIGIN", next_day_at_24: bool = True) -> DataFrame:
    """Flights with a date and a clock: local and UTC time of departure, and the span before it.

    zones: iata_code, tz (one row per airport).
    """
    f = flights.where(F.col(hhmm).isNotNull() & F.col(date).isNotNull())
    f = f.withColumn("TIMESTAMP", S.local_timestamp(F.col(date), F.col(hhmm), next_day_at_24)).withColumn(hhmm, S.clock(F.col(hhmm)))
    f = local_to_utc(f, zones, airport, "TIMESTAMP", "TIMESTAMP_UTC")
    return window_bounds(f, "TIMESTAMP_UTC", start, end)


def local_to_utc(df: DataFrame, zones: DataFrame, airport: str, local: str, utc: str) -> DataFrame:
    """Adds `utc`; null where the airport has no zone."""
    z = dimension(zones.select(F.col("iata_code").alias("_code"), F.col("tz").alias("_tz")))
    return df.join(z, F.col(airport) == F.col("_code"), "left").withColumn(utc, S.to_utc(F.col(local), F.col("_tz"))).drop("_code", "_tz")


def nearest(df: DataFrame, by: str = "station_id", distance: str = "distance_to_neighbor", n: int = 5, rank: str = "dist_to_airport_rank") -> DataFrame:
    """The n nearest for each key by rank(): equal distances may give more than n."""
    w = Window.partitionBy(by).orderBy(distance)
    return df.withColumn(rank, F.rank().over(w)).where(F.col(rank) <= n)


def airport_readings(airports: DataFrame, stations: DataFrame, readings: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Readings of the stations near each airport, with DATE_UTC.

    Readings are in UTC already, unless zones says where the airports are.
    """
    near = stored(airports.join(stations, F.col("ident") == F.col("neighbor_call"), "left"))
    # its plan doesn't know how few they are, and adaptive execution may take the readings for the smaller side
    near = F.broadcast(near) if near.count() <= FEW else near.hint("merge")
    out = readings.join(near, F.col("STATION") == F.col("neighbor_id")).where("DATE IS NOT NULL")
    if zones is None:
        return out.withColumn("DATE_UTC", F.col("DATE"))
    return local_to_utc(out, zones, "iata_code", "DATE", "DATE_UTC")


#: Buckets are so many times as wide as the longest interval of their level; levels end at these quantiles of the
#: lengths, if the next one is STEP times as long at least.
WIDE, STEP, ENDS = 4, 8, (0.9, 0.99, 0.999)


def interval_levels(left: DataFrame, start: str, end: str) -> list[int]:
    """Longest interval of each level, in microseconds, shortest first: by a quantile sketch of the lengths and the
    longest there is. One aggregation, four levels at most."""
    length = _micros(end) - _micros(start)
    row = left.where(length >= 0).agg(F.percentile_approx(length, list(ENDS), 10_000).alias("q"), F.max(length).alias("m")).first()
    if row["m"] is None:
        return [1]
    levels = [max(int(row["m"]), 1)]
    for q in reversed(row["q"]):
        if max(int(q), 1) * STEP <= levels[0]:
            levels.insert(0, max(int(q), 1))
    return levels


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def interval_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], point: str, start: str, end: str,
                  how: str = "left", longest_hours: float | None = None, buckets: bool = True, wide: float = WIDE, parts: int | None = None) -> DataFrame:
    """Rows of right whose `point` lies in [start, end] of left and whose keys are equal. how: inner or left.

    Time is cut into buckets, which join the keys of the hash, so a key with very many rows is spread over its
    buckets and a row meets those nearby. Intervals may be of any length: few long ones have coarser buckets on
    levels of their own. A left row is in one bucket, that of its end on the level of its length, which keeps an
    outer join a single join; a right row is on each level in its own bucket, and in the next one if an interval
    that ends there may reach back to it (one in WIDE of them).

    longest_hours: a promise that no interval is longer, which saves measuring them; one that is raises an error.
    wide: a bucket's width in longest intervals: narrower ones cost more copies of right rows and fewer misses.
    parts: tasks that the buckets are dealt to; where few rows make very many pairs adaptive execution, which looks at
    the rows' bytes, would join all of them in as few tasks as there are cores.
    buckets=False tests the range on each match of the keys.
    """
    if how not in ("inner", "left"):
        raise ValueError("an interval join is inner or left")
    cond = F.col(point).between(F.col(start), F.col(end))
    for a, b in on:
        cond = cond & (F.col(a) == F.col(b))
    if not buckets:
        return left.join(right, cond, how)
    levels = interval_levels(left, start, end) if longest_hours is None else [max(1, int(longest_hours * 3_600_000_000))]
    length, at = _micros(end) - _micros(start), _micros(point)
    bucket = lambda x, n: F.floor(x / F.lit(wide * n))
    place = lambda level, b: F.struct(F.lit(level).alias("level"), b.alias("bucket"))
    ends = F.raise_error(F.lit(f"an interval is longer than {longest_hours} hours")).cast("struct<level:int,bucket:bigint>")
    for level in range(len(levels) - 1, -1, -1):
        mine = place(level, bucket(_micros(end), levels[level]))
        ends = F.when(length > levels[level], ends).otherwise(mine)
    on_level = lambda level: lambda b: place(level, b)
    near = F.concat(*[F.transform(F.sequence(bucket(at, n), bucket(at + n, n)), on_level(i)) for i, n in enumerate(levels)])
    x = left.withColumn("_end", ends).select(*left.columns, F.col("_end.level").alias("_level"), F.col("_end.bucket").alias("_bucket"))
    y = right.withColumn("_near", F.explode(near)).select(*right.columns, F.col("_near.level").alias("_on"), F.col("_near.bucket").alias("_in"))
    if parts:
        x = x.repartition(parts, *[a for a, _ in on], "_level", "_bucket")
        y = y.repartition(parts, *[b for _, b in on], "_on", "_in")
    return x.join(y, cond & (F.col("_level") == F.col("_on")) & (F.col("_bucket") == F.col("_in")), how).drop("_level", "_bucket", "_on", "_in")


def unmapped(df: DataFrame, known: DataFrame, on: str, known_on: str) -> DataFrame:
    """Distinct keys of df that `known` lacks."""
    return df.select(on).where(F.col(on).isNotNull()).distinct().join(known.select(F.col(known_on).alias(on)), on, "left_anti")


def drop_unmapped(df: DataFrame, missing: DataFrame, on: str) -> DataFrame:
    """Rows whose key isn't among the missing ones; null keys stay."""
    return df.join(missing.select(on), on, "left_anti")
