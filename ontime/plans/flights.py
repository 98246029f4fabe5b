"""The chains from raw tables to a model's rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontime import columns as C
from ontime.operators import aggregate as A
from ontime.operators import clean as P
from ontime.operators import features as W
from ontime.operators import timejoin as J
from ontime.operators.encode import TargetMeanEncoder
from ontime.session import stored
from ontime.sources import io


def clean_flights(df: DataFrame) -> DataFrame:
    """Wanted columns, ids as text, one row per departure, delay causes filled, known delays only."""
    df = P.cast_all(df.select(*C.FLIGHT_COLUMNS), C.FLIGHT_TEXT_COLUMNS)
    return P.drop_missing(P.fill(P.drop_duplicates(df, C.FLIGHT_KEYS), C.DELAY_CAUSES, 0), ["DEP_DELAY"])


def load_flights(spark, paths, report: bool = False):
    """Cleaned flights of one or more periods; with report also the table of dropped duplicates."""
    raw = io.read_periods(spark, paths)
    cleaned = clean_flights(raw)
    return (cleaned, P.duplicate_report(raw, C.FLIGHT_KEYS)) if report else cleaned


def clean_weather(df: DataFrame, calm_speed: int = 0) -> DataFrame:
    """Packed fields split and typed, bad and missing values null, one row per report, repeats averaged."""
    df = P.split_packed(df.select(*C.WEATHER_COLUMNS, *C.packed_columns()))
    df = P.flag_quality(P.drop_missing(df, ["STATION"]))
    df = P.null_codes(P.calm_wind(df, calm_speed=calm_speed))
    return P.average_repeated(P.drop_duplicates(df, C.WEATHER_KEYS))


def load_weather(spark, path: str, start=None, until=None) -> DataFrame:
    return clean_weather(io.read_between(spark, path, "DATE", start, until))


def airport_codes(flights: DataFrame, codes: DataFrame) -> DataFrame:
    """Distinct origins with their codes; null where there is none."""
    origins = flights.select("ORIGIN").distinct()
    known = J.dimension(io.with_code(codes))
    return origins.join(known, origins["ORIGIN"] == known["iata_code"], "left")


def join_weather(flights: DataFrame, weather: DataFrame, stations: DataFrame, codes: DataFrame, zones: DataFrame,
                 start: int = 6, end: int = 2, nearest: int = 3) -> DataFrame:
    """Each flight with every report of its airport's nearest stations inside its window."""
    timed, readings = timed_and_readings(flights, weather, stations, codes, zones, start, end, nearest)
    return J.interval_join(timed, readings, [("ORIGIN", "iata_code")], "DATE_UTC", "WEATHER_WINDOW_START", "WEATHER_WINDOW_END", "left", start - end)


def timed_and_readings(flights: DataFrame, weather: DataFrame, stations: DataFrame, codes: DataFrame, zones: DataFrame, start: int, end: int, nearest: int) -> tuple[DataFrame, DataFrame]:
    """Flights of known airports with their windows, and the reports of each airport's nearest stations."""
    airports = airport_codes(flights, codes)
    mapped = stored(airports.where("ident IS NOT NULL").join(stations.select("neighbor_call").distinct(), airports["ident"] == stations["neighbor_call"], "left_semi"))
    missing = J.unmapped(flights, mapped, "ORIGIN", "ORIGIN")
    timed = J.departure_times(J.drop_unmapped(flights, missing, "ORIGIN"), zones, start, end)
    near = J.nearest(stations, n=nearest)
    return timed, J.airport_readings(mapped.drop("ORIGIN"), near, weather)


def collapse(joined: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row per flight: readings averaged by distance and time, conditions by mode."""
    key = key or FLIGHT
    return A.collapse_readings(joined, key, C.AVERAGED_READINGS, C.MODE_READINGS, carry=_carried(joined, key))


#: Columns that name a flight and its time.
FLIGHT = [*C.FLIGHT_KEYS, "TAIL_NUM", "OP_CARRIER_FL_NUM", "TIMESTAMP_UTC"]


def _carried(df: DataFrame, key: list[str]) -> list[str]:
    return [c for c in [*C.FLIGHT_COLUMNS, "TIMESTAMP", "WEATHER_WINDOW_START", "WEATHER_WINDOW_END"] if c in df.columns and c not in key]


def flights_with_weather(flights: DataFrame, weather: DataFrame, stations: DataFrame, codes: DataFrame, zones: DataFrame,
                         start: int = 6, end: int = 2, nearest: int = 3) -> DataFrame:
    """collapse(join_weather(...)) for tables where many flights share an airport's minute, or many reports a
    station's time: the weather of each airport and time is found once, from sums, and stored; flights look it up."""
    timed, readings = timed_and_readings(flights, weather, stations, codes, zones, start, end, nearest)
    rows = timed.groupBy(*FLIGHT).agg(*[F.any_value(c).alias(c) for c in _carried(timed, FLIGHT)])
    there = A.collapse_windows(timed, readings, ("ORIGIN", "iata_code"), "TIMESTAMP_UTC", "DATE_UTC", "WEATHER_WINDOW_START", "WEATHER_WINDOW_END",
                               C.AVERAGED_READINGS, C.MODE_READINGS, longest_hours=start - end)
    there = stored(there.drop("WEATHER_WINDOW_START", "WEATHER_WINDOW_END")).hint("shuffle_hash")
    return rows.join(there, ["ORIGIN", "TIMESTAMP_UTC"], "left").select(*rows.columns, *C.AVERAGED_READINGS, *C.MODE_READINGS)


def shape_features(df: DataFrame) -> DataFrame:
    """Nulls filled by zero, group mean and group median; clocks and depths as numbers; one weather
    condition; codes as text."""
    df = P.fill(df, C.ZERO_WHEN_MISSING, 0)
    df = W.fill_group_mean_median(df, C.MEAN_WHEN_MISSING, C.MEDIAN_WHEN_MISSING, C.GROUP_OF_FLIGHT)
    df = P.to_integers(df, ["CRS_DEP_TIME", "AL_SnowAccumDepth"])
    df = P.merge_first(df, [f"AW{i}_PresentWeatherCond" for i in range(1, 5)], "weather_condition")
    left = ["weather_condition", "WND_DirectionAngle_median", "AA_RainDepth", "AJ1_SnowDepth_mean", "AL_SnowAccumDuration_mean", "WND_Speed_mean", "VIS_Horizontal_median"]
    return P.cast_all(P.fill(df, left, 0), ["weather_condition", "MONTH", "DAY_OF_MONTH", "DAY_OF_WEEK"])


def drop_features(df: DataFrame) -> DataFrame:
    """Without leaking, date, redundant, constant and nearly empty columns."""
    return df.drop(*C.LEAKING, *C.DATE_COLUMNS, *C.REDUNDANT, *C.CONSTANT, *C.NEARLY_EMPTY)


def preprocess(label: str, encode: list[str], fills: dict[str, object] | None = None, integers: list[str] = (), route: bool = True, drop: list[str] = ()) -> Callable:
    """A function (train, other) -> both prepared: fills, route key, target means from the training
    rows, casts, drops."""

    def plain(df: DataFrame) -> DataFrame:
        for c, v in (fills or {}).items():
            df = P.fill(df, [c], v)
        if route and {"ORIGIN", "DEST"} <= set(df.columns):
            df = P.key_of(df, ["ORIGIN", "DEST"], "ORIGIN_DEST")
        return P.to_integers(df, list(integers)) if integers else df

    def run(train: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
        train, other = plain(train), plain(other)
        for c in encode:
            model = TargetMeanEncoder(c, label).fit(train)
            train, other = model.transform(train), model.transform(other)
        return train.drop(*drop), other.drop(*drop)

    return run
