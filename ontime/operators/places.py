"""The nearest places by great-circle distance, from coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontime.session import stored

EARTH_KM = 6371.0088
#: Cells of each level are so many times as wide as those of the one before.
WIDER = 4
#: Levels on which a left row looks around itself, before it comes down to its places from the whole earth.
RINGS = 2
#: Places of a cell above which they are dealt out to several arrays.
CHUNK = 1024


def _on_sphere(df: DataFrame, key: str, lat: str, lon: str, name: str) -> DataFrame:
    """name, _x, _y, _z on the unit sphere, of the rows that have a key and coordinates on earth."""
    la, lo = F.radians(F.col(lat).cast("double")), F.radians(F.col(lon).cast("double"))
    rows = df.where(F.col(key).isNotNull() & F.col(lat).cast("double").between(-90, 90) & F.col(lon).cast("double").between(-180, 360))
    return rows.select(F.col(key).alias(name), (F.cos(la) * F.cos(lo)).alias("_x"), (F.cos(la) * F.sin(lo)).alias("_y"), F.sin(la).alias("_z"))


def _cell(c: str, side: float, shift: Column | int = 0) -> Column:
    return F.floor(F.col(c) / F.lit(side)) + shift


def great_circle_km(chord2: Column) -> Column:
    """Kilometres on the sphere between points of the unit sphere whose chord has this square."""
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.sqrt(chord2) / 2, F.lit(1.0)))


def chunks(right: DataFrame, side: float) -> DataFrame:
    """_cx, _cy, _cz, _places: for each cell of that side the places in it and in the 26 around it, as arrays; a
    crowded cell's come in arrays of their own, of about CHUNK places."""
    cell = [_cell(f"_{c}", side).alias(f"_c{c}") for c in "xyz"]
    there = right.select(F.struct("right_id", *[F.col(f"_{c}").alias(f"_r{c}") for c in "xyz"]).alias("_place"), *cell)
    crowds = there.groupBy("_cx", "_cy", "_cz").agg(F.count("*").alias("_n"))
    there = there.join(crowds, ["_cx", "_cy", "_cz"])
    own = F.when(F.col("_n") > CHUNK, F.struct("_cx", "_cy", "_cz", F.pmod(F.xxhash64("_place.right_id"), F.ceil(F.col("_n") / CHUNK)).alias("i")))
    there = there.select("_place", own.alias("_own"), "_cx", "_cy", "_cz")
    for c in "xyz":
        there = there.withColumn("_s", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(f"_c{c}", F.col(f"_c{c}") + F.col("_s")).drop("_s")
    return there.groupBy("_cx", "_cy", "_cz", "_own").agg(F.collect_list("_place").alias("_places"))


def candidates(left: DataFrame, right: DataFrame, side: float, k: int | None = None) -> DataFrame:
    """left_id, right_id, _d (square of the chord): of each array of places in the 27 cells of that side around a left
    row the k nearest (or all), equal ones in order of right_id. No more rows than that leave the join."""
    mine = left.select("left_id", "_x", "_y", "_z", *[_cell(f"_{c}", side).alias(f"_c{c}") for c in "xyz"])
    met = mine.join(chunks(right, side).hint("merge"), ["_cx", "_cy", "_cz"])
    chord2 = lambda p: sum(((F.col(f"_{c}") - p[f"_r{c}"]) ** 2 for c in "xyz"), F.lit(0.0))
    ordered = F.array_sort(F.transform("_places", lambda p: F.struct(chord2(p).alias("_d"), p["right_id"].alias("right_id"))))
    return met.select("left_id", F.explode(F.slice(ordered, 1, k) if k else ordered).alias("_p")).select("left_id", "_p.right_id", "_p._d")


def descend(left: DataFrame, right: DataFrame, k: int, side: float) -> DataFrame:
    """left_id, right_id, _d of the places in the cells of that side that can hold one of the k nearest.

    From cells that hold the earth down to those of `side`, by counts of places: a cell goes on while it is no farther
    than the far ends of cells that together hold k. So a row far from a crowd meets the crowd's near edge alone.
    """
    steps = 0
    while side * WIDER**steps < 2:
        steps += 1
    places = right.select("right_id", *[F.col(f"_{c}").alias(f"_r{c}") for c in "xyz"], *[_cell(f"_{c}", side).alias(f"_c{c}") for c in "xyz"])
    counts = stored(places.groupBy("_cx", "_cy", "_cz").agg(F.count("*").alias("_n")))
    by, slack = Window.partitionBy("left_id"), 1e-12
    open_cells = left
    for step in range(steps, -1, -1):
        wide = side * WIDER**step
        level = counts.groupBy(*[F.floor(F.col(f"_c{c}") / F.lit(WIDER**step)).alias(f"_k{c}") for c in "xyz"]).agg(F.sum("_n").alias("_n"))
        if step == steps:  # eight cells at most
            met = open_cells.crossJoin(F.broadcast(level))
        else:
            met = open_cells.join(level.withColumns({f"_p{c}": F.floor(F.col(f"_k{c}") / F.lit(WIDER)) for c in "xyz"}), ["_px", "_py", "_pz"])
        low, high = F.lit(0.0), F.lit(0.0)
        for c in "xyz":
            begin, end = F.col(f"_k{c}") * F.lit(wide) - F.col(f"_{c}"), (F.col(f"_k{c}") + 1) * F.lit(wide) - F.col(f"_{c}")
            low += F.pow(F.greatest(F.lit(0.0), begin, -end), F.lit(2))
            high += F.pow(F.greatest(F.abs(begin), F.abs(end)), F.lit(2))
        met = met.withColumns({"_low": low, "_high": high})
        met = met.withColumn("_sum", F.sum("_n").over(by.orderBy("_high", "_kx", "_ky", "_kz").rowsBetween(Window.unboundedPreceding, 0)))
        met = met.withColumn("_reach", F.min(F.when(F.col("_sum") >= k, F.col("_high"))).over(by))
        kept = met.where(F.col("_reach").isNull() | (F.col("_low") <= F.col("_reach") + slack))
        open_cells = stored(kept.select("left_id", "_x", "_y", "_z", *[F.col(f"_k{c}").alias(f"_p{c}") for c in "xyz"]))
    chord2 = sum(((F.col(f"_{c}") - F.col(f"_r{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    near = open_cells.join(places.withColumnsRenamed({f"_c{c}": f"_p{c}" for c in "xyz"}), ["_px", "_py", "_pz"])
    return near.select("left_id", "right_id", chord2.alias("_d"))


def nearest_places(left: DataFrame, right: DataFrame, k: int = 5, left_on: tuple[str, str, str] = ("ident", "lat", "lon"),
                   right_on: tuple[str, str, str] = ("station_id", "lat", "lon"), start_km: float | None = None) -> DataFrame:
    """left_id, right_id, distance_km, rank: the k nearest right rows of each left row.

    left_on, right_on: key, latitude and longitude in degrees; keys are unique. Places are cut into cubic cells of
    the unit sphere, where neither poles nor the date line are borders. A left row meets the right ones of its own cell
    and the 26 around it, so it knows all places within a cell's side; if its k-th is that near it is done, else it
    looks around once more in cells WIDER times as wide. Those that are still not done come down to their places from
    the whole earth (descend).

    start_km: side of the first cells; by default that at which a cell would hold some k places if they lay evenly.
    Places are copied to the cells around them, so a left row is in one cell and stays single; crowded cells are split by
    adaptive execution. Only the k best of each left row and array of places leave the join (candidates).

    Cases: equal distances in order of right_id; a left row has fewer than k where right has fewer; rows without key
    or coordinates, or with impossible ones, are left out on both sides; an empty table on either side gives no rows.
    """
    a = _on_sphere(left, *left_on, "left_id")
    b = stored(_on_sphere(right, *right_on, "right_id"))
    n = b.count()
    side = start_km / EARTH_KM if start_km else math.sqrt(4 * math.pi * k / max(n, 1))
    w = Window.partitionBy("left_id").orderBy("_d", "right_id")
    first = lambda met: met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    parts, waiting = [], a
    for ring in range(RINGS):
        wide = side * WIDER**ring
        near = stored(first(candidates(waiting, b, wide, k)))
        done = near.where((F.col("rank") == k) & (F.col("_d") <= wide * wide)).select("left_id")
        parts.append(near.join(done, "left_id", "left_semi"))
        waiting = stored(waiting.join(done, "left_id", "left_anti"))
        if waiting.isEmpty():
            break
    else:
        parts.append(first(descend(waiting, b, k, side)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("left_id", "right_id", great_circle_km(F.col("_d")).alias("distance_km"), "rank")
