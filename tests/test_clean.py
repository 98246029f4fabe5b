"""Cleaning, packed fields, clocks."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ontime import columns as C
from ontime.functions import scalar as S
from ontime.operators import clean as P
from ontime.plans import flights
from ontime.plans.inspect import uses_python
from ontime.sources import io


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


@pytest.mark.parametrize(
    ("packed", "value", "quality"),
    [("+0123,1", 123, 1), ("+9999,9", None, 1), ("+0050,3", None, 0), ("+0050", 50, None), ("x,1", None, 1), (None, None, None)],
)
def test_packed_temperature(spark, packed, value, quality):
    df = P.split_packed(spark.createDataFrame([(packed,)], "TMP string"), {"TMP": C.PACKED_FIELDS["TMP"]})
    df = P.null_codes(P.flag_quality(df, quality={"TMP_Quality": ["TMP_Value"]}), {"TMP_Value": 9999})
    assert one(df) == {"TMP_Value": value, "TMP_Quality": quality}


@pytest.mark.parametrize(("values", "mean"), [((1, 3, None, None), 2), ((None,) * 4, None), ((0, 0, None, None), None), ((1, 2, 2, 2), 1)])
def test_repeated_mean(spark, values, mean):
    df = spark.createDataFrame([values], "a int, b int, c int, d int")
    assert one(P.average_repeated(df, {"m": list("abcd")})) == {"m": mean}


@pytest.mark.parametrize(("hhmm", "clock"), [(5, "00:05"), (905, "09:05"), (2359, "23:59"), (2400, "00:00"), (None, None)])
def test_clock(spark, hhmm, clock):
    assert one(spark.createDataFrame([(hhmm,)], "t int").select(S.clock(F.col("t")).alias("c")))["c"] == clock


def test_24_is_next_day_unless_told(spark):
    df = spark.createDataFrame([("2015-01-31", 2400)], "d string, t int")
    row = one(df.select(S.local_timestamp(F.col("d"), F.col("t")).alias("a"), S.local_timestamp(F.col("d"), F.col("t"), False).alias("b")))
    assert row == {"a": datetime(2015, 2, 1), "b": datetime(2015, 1, 31)}


def test_utc_follows_daylight_saving(spark):
    df = spark.createDataFrame([("2015-01-01 12:00:00",), ("2015-07-01 12:00:00",)], "t string")
    rows = df.select(S.to_utc(F.col("t").cast("timestamp"), F.lit("America/New_York")).alias("u")).collect()
    assert [r["u"].hour for r in rows] == [17, 16]


def test_calm_wind_comes_before_missing_codes(spark):
    df = spark.createDataFrame([("9", 0), ("9", 9999), ("N", 0), (None, 0)], "WND_Type string, WND_Speed int")
    out = P.null_codes(P.calm_wind(df), {"WND_Type": "9", "WND_Speed": 9999})
    assert [tuple(r) for r in out.collect()] == [("C", 0), (None, None), ("N", 0), (None, 0)]


def test_fill_reaches_text_columns_too(spark):
    df = spark.createDataFrame([(None, None, 1.5)], "a string, b int, c double")
    assert one(P.fill(df, ["a", "b", "c"], 0)) == {"a": "0", "b": 0, "c": 1.5}


def test_dedup_keeps_the_first_and_reports(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "d"), (None, "e")], "k int, v string")
    assert sorted((r["k"] is None, r["k"], r["v"]) for r in P.drop_duplicates(df, ["k"], ["v"]).collect()) == [(False, 1, "a"), (False, 2, "c"), (True, None, "d")]
    assert one(P.duplicate_report(df, ["k"])) == {"before": 5, "after": 3, "dropped": 2, "percent": 66.67}
    assert one(P.duplicate_report(df.limit(0), ["k"]))["percent"] is None


def test_columns_without_information_go(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "x"), (3, 1, "x")], "a int, b int, c string")
    assert P.drop_constant(df).columns == ["a"]
    assert P.drop_nearly_empty(df, 0.5).columns == ["a", "c"]


def test_casts_merges_keys(spark):
    df = spark.createDataFrame([("09:05", 7, None, "w2", "A", None)], "t string, n long, w1 string, w2 string, o string, d string")
    out = P.key_of(P.merge_first(P.to_integers(df, ["t", "n"]), ["w1", "w2"], "w"), ["o", "d"], "route")
    assert one(out) == {"t": 905, "n": 7, "o": "A", "d": None, "w": "w2", "route": None}


def test_calendar_split_and_hubs(spark):
    df = spark.createDataFrame([(1, 5), (6, 15), (6, 16), (7, 1)], "m int, d int")
    train, test = P.split_by_month(df, "m", 6, "d", 15)
    assert (train.count(), test.count()) == (2, 2)
    hubs = spark.createDataFrame([("AA", "DFW"), ("AA", "JFK"), (None, "DFW")], "OP_UNIQUE_CARRIER string, ORIGIN string")
    assert [r["is_hub"] for r in P.hub_flags(hubs, {"AA": ["DFW"]}).collect()] == [1, 0, 0]


def raw_flight(**more):
    base = dict.fromkeys(C.FLIGHT_COLUMNS)
    return base | {"FL_DATE": "2015-03-01", "CRS_DEP_TIME": 905, "DEST_AIRPORT_ID": 1, "ORIGIN_AIRPORT_ID": 2, "DEP_DELAY": 3.0, "ORIGIN": "AAA", "DEST": "BBB"} | more


def schema_of_flights():
    numbers = {"CRS_DEP_TIME": "int", "DEST_AIRPORT_ID": "int", "ORIGIN_AIRPORT_ID": "int", "DEP_DELAY": "double", "NAS_DELAY": "double", "SECURITY_DELAY": "double", "CARRIER_DELAY": "double", "DEP_DEL15": "double", "YEAR": "int", "MONTH": "int", "DAY_OF_MONTH": "int"}
    return ", ".join(f"{c} {numbers.get(c, 'string')}" for c in C.FLIGHT_COLUMNS)


def test_flight_chain(spark):
    rows = [raw_flight(), raw_flight(), raw_flight(CRS_DEP_TIME=1000, DEP_DELAY=None), raw_flight(CRS_DEP_TIME=1100, NAS_DELAY=4.0)]
    out = flights.clean_flights(spark.createDataFrame([tuple(r[c] for c in C.FLIGHT_COLUMNS) for r in rows], schema_of_flights()))
    got = sorted((r["CRS_DEP_TIME"], r["NAS_DELAY"], r["DEST_AIRPORT_ID"]) for r in out.collect())
    assert got == [(905, 0.0, "1"), (1100, 4.0, "1")]
    assert not uses_python(out)


def test_weather_chain(spark):
    base = dict.fromkeys(C.WEATHER_COLUMNS) | dict.fromkeys(C.packed_columns())
    base |= {"STATION": "s1", "DATE": "2015-03-01 01:00", "TMP": "+0123,1", "WND": "999,1,9,0000,1", "AA1": "01,0010,9,1", "AA2": "01,0020,9,3", "AW1": "61,1"}
    rows = [base, base, base | {"STATION": None}]
    out = flights.clean_weather(spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} string" for c in base)))
    row = one(out)
    assert (row["TMP_Value"], row["WND_Type"], row["WND_DirectionAngle"], row["AA_RainDepth"], row["AW1_PresentWeatherCond"]) == (123, "C", None, 10, 61)
    assert "AA1_RainDepth" not in row and not uses_python(out)


def test_sources(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    io.write_parquet(spark.createDataFrame([(1, "x")], "k int, only_a string"), a)
    io.write_parquet(spark.createDataFrame([(2, 5)], "k int, only_b int"), b)
    rows = io.read_periods(spark, [a, b]).collect()
    assert sorted(map(tuple, rows)) == [(1, "x", None), (2, None, 5)]
    codes = tmp_path / "codes.csv"
    codes.write_text("ident,elevation_ft,iata_code,coordinates,name\nKAAA,1,AAA,c,n\nKBBB,1,null,c,n\nKCCC,1,,c,n\n")
    assert [r["ident"] for r in io.read_airport_codes(spark, str(codes)).collect()] == ["KAAA"]
    assert dict(io.read_csv(spark, str(codes)).dtypes)["elevation_ft"] == "int"
    io.write_lines(spark.createDataFrame([("l1",), ("l2",)], "value string"), str(tmp_path / "t"))
    assert io.read_lines(spark, str(tmp_path / "t")).count() == 2
    folds = spark.createDataFrame([(1, "train", 7), (1, "valid", 8), (2, "train", 9)], "fold int, role string, v int")
    io.write_folds(folds, str(tmp_path / "f"))
    assert [r["v"] for r in io.read_fold(spark, str(tmp_path / "f"), 1, "valid").collect()] == [8]
    times = spark.createDataFrame([("2018-12-31",), ("2019-01-01",)], "DATE string")
    io.write_parquet(times.select(F.col("DATE").cast("timestamp").alias("DATE")), str(tmp_path / "w"))
    assert io.read_between(spark, str(tmp_path / "w"), until="2019-01-01").count() == 1
    plan = io.read_between(spark, str(tmp_path / "w"), until="2019-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(DATE" in plan
