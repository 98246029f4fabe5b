"""Time joins, aggregation, features, encoders."""

import math
import random
import re
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ontime import columns as C
from ontime.operators import aggregate as A
from ontime.operators import clean as P
from ontime.operators import encode as T
from ontime.operators import features as W
from ontime.operators import graph as G
from ontime.operators import timejoin as J
from ontime.plans import flights
from ontime.plans.inspect import uses_python
from tests.test_clean import raw_flight, schema_of_flights

NOON = datetime(2015, 3, 1, 12)


def test_window_and_its_limit(spark):
    row = J.window_bounds(spark.createDataFrame([(NOON,)], "TIMESTAMP_UTC timestamp")).first()
    assert (row["WEATHER_WINDOW_START"].hour, row["WEATHER_WINDOW_END"].hour) == (6, 10)
    with pytest.raises(ValueError):
        J.window_bounds(spark.createDataFrame([(NOON,)], "TIMESTAMP_UTC timestamp"), end=1)


def test_rank_ties_may_exceed_n(spark):
    df = spark.createDataFrame([("s", d) for d in (0, 5, 5, 9)], "station_id string, distance_to_neighbor int")
    assert sorted(r["dist_to_airport_rank"] for r in J.nearest(df, n=2).collect()) == [1, 2, 2]


def flights_and_readings(spark):
    f = J.window_bounds(spark.createDataFrame([(1, "A", NOON), (2, "B", NOON), (3, None, NOON), (1, "A", NOON)], "id int, k string, TIMESTAMP_UTC timestamp"))
    times = [timedelta(hours=h) for h in (1, 2, 4, 6, 7)]
    r = spark.createDataFrame([("A", NOON - t, i) for i, t in enumerate(times)], "rk string, DATE_UTC timestamp, v int")
    return f, r


@pytest.mark.parametrize("longest", [None, 4, 5.5, 100])
def test_interval_join_includes_both_ends(spark, longest):
    f, r = flights_and_readings(spark)
    j = J.interval_join(f, r, [("k", "rk")], "DATE_UTC", "WEATHER_WINDOW_START", "WEATHER_WINDOW_END", "left", longest)
    assert j.columns == f.columns + r.columns
    got = sorted((x["id"], -1 if x["v"] is None else x["v"]) for x in j.collect())
    assert got == sorted(2 * [(1, 1), (1, 2), (1, 3)] + [(2, -1), (3, -1)])


def test_intervals_of_any_kind(spark):
    """Random intervals, null and empty ones among them, against all pairs."""
    rng = random.Random(6)
    at = lambda: NOON + timedelta(minutes=rng.randrange(3000))
    left = []
    for i in range(120):
        a = at()
        b = a + timedelta(minutes=rng.choice([0, 5, 239, 240, -30]))
        left.append((i, rng.choice("ABC"), None if i % 17 == 0 else a, None if i % 19 == 0 else b))
    right = [(rng.choice("ABD"), None if i % 23 == 0 else at(), i) for i in range(150)]
    x = spark.createDataFrame(left, "id int, k string, s timestamp, e timestamp")
    y = spark.createDataFrame(right, "rk string, p timestamp, v int")
    want = sorted((i, v) for i, k, s, e in left for rk, p, v in right if s and e and p and k == rk and s <= p <= e)
    for how in ("inner", "left"):
        got = [(r["id"], r["v"]) for r in J.interval_join(x, y, [("k", "rk")], "p", "s", "e", how, 4).collect()]
        none = [(i, None) for i, *_ in left if i not in {i for i, _ in want}] if how == "left" else []
        assert sorted(got, key=str) == sorted(want + none, key=str)
        every = [(r["id"], r["v"]) for r in J.interval_join(x, y, [("k", "rk")], "p", "s", "e", how, buckets=False).collect()]
        assert sorted(every, key=str) == sorted(want + none, key=str)
    with pytest.raises(Exception, match="longer than"):
        J.interval_join(x, y, [("k", "rk")], "p", "s", "e", "left", 3).collect()
    with pytest.raises(ValueError, match="inner or left"):
        J.interval_join(x, y, [("k", "rk")], "p", "s", "e", "outer")


def test_intervals_of_any_length(spark):
    """Points, minutes, weeks and years in one table; nobody says how long they are."""
    rng = random.Random(16)
    at = lambda: NOON + timedelta(minutes=rng.randrange(60_000))
    left = [(i, rng.choice("AB"), a := at(), a + timedelta(minutes=rng.choice([0] * 9 + [5] * 20 + [20_000, 500_000]))) for i in range(150)]
    right = [(rng.choice("AB"), at(), i) for i in range(200)] + [("A", left[0][3], 1000), ("B", left[1][2], 1001)]
    x, y = spark.createDataFrame(left, "id int, k string, s timestamp, e timestamp"), spark.createDataFrame(right, "rk string, p timestamp, v int")
    assert J.interval_levels(x, "s", "e") == [5 * 60_000_000, 500_000 * 60_000_000]
    assert J.interval_levels(x.where("e < s + INTERVAL 1 HOUR"), "s", "e") == [5 * 60_000_000] and J.interval_levels(x.limit(0), "s", "e") == [1]
    want = {(i, v) for i, k, s, e in left for rk, p, v in right if k == rk and s <= p <= e}
    joined = J.interval_join(x, y, [("k", "rk")], "p", "s", "e")
    got = [(r["id"], r["v"]) for r in joined.collect()]
    assert sorted(got, key=str) == sorted([*want, *[(i, None) for i, *_ in left if i not in {i for i, _ in want}]], key=str)
    assert "_level" in joined._jdf.queryExecution().optimizedPlan().toString()
    none = J.interval_join(x.limit(0), y, [("k", "rk")], "p", "s", "e")
    assert none.count() == 0 and none.columns == x.columns + y.columns


@pytest.mark.parametrize(("first", "last", "hours"), [(-20, -5, 1), (-3, 0, 7), (-1, -1, 2), (-5, -2, 10_000)])
def test_blocks_of_a_history(spark, first, last, hours):
    """A key with ten times the others' rows, null keys, times and values; blocks with fewer rows than are looked back on."""
    rng = random.Random(first)
    rows = [(i, rng.choice(["hub"] * 10 + ["x", None]), NOON + timedelta(minutes=rng.randrange(6000)) if i % 29 else None, rng.choice([0, 1, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, k string, t timestamp, y int")
    got = {r["i"]: r["m"] for r in W.rolling_share(df, ["k"], "t", "y", "m", first, last, tie=["i"], block_hours=hours).collect()}
    for key in ("hub", "x", None):
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is not None, r[2] or NOON, r[0]))
        for n, r in enumerate(mine):
            seen = [x[3] for x in mine[max(0, n + first) : max(0, n + last + 1)] if x[3] is not None]
            assert got[r[0]] == (pytest.approx(sum(seen) / len(seen)) if seen else None), r
    flags = {r["i"]: r["f"] for r in W.previous_flag(df, "k", "t", "y", "f", 0, 3, tie=["i"], block_hours=hours).collect()}
    timed = {r["i"]: r["m"] for r in W.rolling_share(df, ["k"], "t", "y", "m", -4, tie=["i"], least_hours=1, block_hours=hours).collect()}
    assert len(flags) == len(timed) == len(rows)
    for key in ("hub", "x", None):
        mine = sorted((r for r in rows if r[1] == key and r[2]), key=lambda r: (r[2], r[0]))
        for n, r in enumerate(mine):
            near = n > 0 and key is not None and r[2] - mine[n - 1][2] < timedelta(hours=3)
            assert flags[r[0]] == (mine[n - 1][3] if near else 0), r
            seen = [x[3] for x in mine if x[3] is not None and timedelta(hours=1) <= r[2] - x[2] <= timedelta(hours=4)]
            assert timed[r[0]] == (pytest.approx(sum(seen) / len(seen)) if seen else None), r
    assert all(flags[r[0]] == 0 and timed[r[0]] is None for r in rows if r[2] is None)


def test_a_hub_is_spread_over_tasks(spark):
    """The rows of one key, by the task that its window runs in."""
    df = spark.range(40_000).select(F.lit("hub").alias("k"), (F.timestamp_seconds(F.col("id") * 600)).alias("t"), (F.col("id") % 2).alias("y"), "id").repartition(3)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for out in (W.previous_flag(df, "k", "t", "y", "f"), W.rolling_share(df, ["k"], "t", "y", "f")):
            sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("f")).collect()]
            assert len(sizes) == 4 and max(sizes) < 30_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


@pytest.mark.parametrize(
    ("rows", "want"),
    [([(10, 2.0, 120), (20, 1.0, 240)], 15.0), ([(10, 0.0, 60), (30, 1.0, 60)], 20.0), ([(None, 1.0, 60), (7, 9.0, 0)], 7.0), ([(None, 1.0, 60)], None)],
)
def test_weighted_mean(spark, rows, want):
    df = spark.createDataFrame([(1, v, d, NOON, NOON - timedelta(minutes=m)) for v, d, m in rows], "k int, v int, distance_to_neighbor double, TIMESTAMP_UTC timestamp, DATE_UTC timestamp")
    assert A.collapse_readings(df, ["k"], ["v"], []).first()["v"] == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-50, 50), st.one_of(st.just(0.0), st.floats(0.01, 100)), st.integers(0, 600)), min_size=1, max_size=8))
def test_weighted_mean_lies_between(spark, rows):
    df = spark.createDataFrame([(v, d, float(m)) for v, d, m in rows], "v int, d double, m double")
    got = df.agg(A.weighted_mean(F.col("v"), A.idw_weight(F.col("d"), F.col("m")), None).alias("x")).first()["x"]
    values = [v for v, _, _ in rows]
    assert min(values) - 1e-6 <= got <= max(values) + 1e-6


@pytest.mark.parametrize(("values", "want"), [(("10", "10", "61", None), "10"), (("10", "61"), "10"), ((None,), None), (("", "", "5"), "5"), (("0", "0", "5"), "0")])
def test_mode(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert df.agg(A.mode_of(F.col("v")).alias("m")).first()["m"] == want


def test_previous_flag_bounds(spark):
    gaps = [timedelta(hours=1, minutes=59), timedelta(hours=2), timedelta(hours=11, minutes=59), timedelta(hours=12)]
    for gap, want in zip(gaps, (0, 1, 1, 0), strict=True):
        df = spark.createDataFrame([("t", NOON, 1), ("t", NOON + gap, 0)], "TAIL_NUM string, TIMESTAMP_UTC timestamp, DEP_DEL15 int")
        out = W.previous_flag(df)
        assert [r["PREV_DEP_DEL15"] for r in out.orderBy("TIMESTAMP_UTC").collect()] == [0, want]
        assert not uses_python(out)


def test_rolling_share_leaves_the_last_rows_out(spark):
    df = spark.createDataFrame([("a", NOON + timedelta(hours=i), i % 2) for i in range(8)], "k string, TIMESTAMP_UTC timestamp, DEP_DEL15 int")
    got = [r[3] for r in W.rolling_share(df, ["k"]).orderBy("TIMESTAMP_UTC").collect()]
    assert got == [None] * 5 + [0.0, 0.5, 1 / 3]
    timed = [r[3] for r in W.rolling_share(df, ["k"], least_hours=2).orderBy("TIMESTAMP_UTC").collect()]
    assert timed[:4] == [None, None, 0.0, 0.5]


def test_group_fills(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", None, None), ("a", 3, "x"), ("b", None, None)], "k string, v int, c string")
    assert sorted((r["k"], r["v_mean"] is None, r["v_mean"] or 0) for r in W.fill_group_mean(df, ["v"], ["k"]).collect()) == [("a", False, 1.0), ("a", False, 2.0), ("a", False, 3.0), ("b", True, 0)]
    assert {r["v_median"] for r in W.fill_group_median(df, ["v"], ["k"]).collect()} == {1, 3, None}
    assert sorted(r["c_mode"] for r in W.fill_group_mode(df, ["c"], ["k"], "00").collect()) == ["00", "x", "x", "x"]


def test_holidays(spark):
    days = spark.createDataFrame([("2015", "1", "1", 0), ("2015", "7", "4", 1), ("2015", "11", "26", 2)], "Year string, Month string, Day string, Importance int")
    df = spark.createDataFrame([("2015-01-01",), ("2015-07-04",), ("2015-11-26",), ("2015-01-26",)], "FL_DATE string")
    got = {r["FL_DATE"]: (r["is_holiday"], r["holiday_imp"]) for r in W.holidays(df, days).collect()}
    assert got == {"2015-01-01": (1, 1), "2015-07-04": (1, 2), "2015-11-26": (1, 3), "2015-01-26": (0, 0)}


def test_sampling_sizes(spark):
    df = spark.createDataFrame([(0,)] * 10 + [(1,)] * 3, "y int")
    over = W.oversample(df, "y")
    assert {r["y"]: r["count"] for r in over.groupBy("y").count().collect()} == {0: 10, 1: 9}
    under = W.undersample(df, "y", seed=1)
    assert under.where("y = 1").count() == 3
    assert W.undersample(df.where("y = 1"), "y", seed=1).count() == 3
    assert W.oversample(df.where("y = 0"), "y").count() == 10
    weights = {r["y"]: r["classWeights"] for r in W.class_weights(df, "y").distinct().collect()}
    assert math.isclose(weights[1], 10 / 13) and math.isclose(weights[0], 3 / 13)


def test_choices_follow_the_key(spark):
    """Chosen rows are the same however rows are dealt out."""
    df = spark.range(2000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"), F.lit(None).cast("string").alias("n"))
    for choose in (lambda d: W.undersample(d, "y", 3), lambda d: P.sample(d, 0.3, 3), lambda d: P.sample(d, 0.3, 3, ["id"]), lambda d: G.random_rows(d, 50, 3, ["id"])):
        one, two = (sorted(r["id"] for r in choose(d).collect()) for d in (df.repartition(7), df.coalesce(1)))
        assert one == two and len(one) < 1000
    under = W.undersample(df, "y", 3, key=["id"])
    assert under.where("y = 1").count() == 200 and 150 < under.where("y = 0").count() < 250


def test_interactions(spark):
    df, names = W.interactions(spark.createDataFrame([(0.0, 1.0), (2.0, 3.0)], "a double, b double"), ["a", "b"])
    assert names == ["a_b"] and [r["a_b"] for r in df.collect()] == [0.0, 6.0]


def test_target_means_come_from_training_rows(spark):
    train = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), (None, 0)], "c string, y int")
    model = T.TargetMeanEncoder("c", "y").fit(train)
    other = spark.createDataFrame([("a",), ("b",), ("new",), (None,)], "c string")
    assert sorted(r["c_mean_encoding"] for r in model.transform(other).collect()) == [0.5, 0.5, 0.5, 1.0]


def test_encoders(spark):
    df = spark.createDataFrame([("b", 1.0), ("b", 2.0), ("a", 3.0), (None, 4.0)], "c string, v double")
    assert sorted(map(tuple, T.frequency_index(df, "c").collect())) == [("a", 1), ("b", 0)]
    assert sorted(r["c_Index"] for r in T.apply_index(df, T.frequency_index(df, "c"), "c").collect()) == [0, 0, 1, 2]
    assert sorted(r["c_COUNT"] for r in T.count_encode(df, "c").collect()) == [1, 1, 2, 2]
    assert sum(r["c_a"] + r["c_b"] for r in T.one_hot(df, "c", ["a", "b"]).collect()) == 3
    wide = T.vector_columns(T.one_hot_pipeline("c", False).fit(df.where("c IS NOT NULL")).transform(df), "c_classVec", ["b", "a", "other"])
    assert wide.agg(F.sum("b"), F.sum("a")).first()[:2] == (2.0, 1.0)
    assert [r["s"] for r in T.bucketise(spark.createDataFrame([(0,), (900,), (2359,), (2400,), (None,)], "t int"), "t", name="s").collect()] == [0, 1, 4, 5, 5]
    assert T.standardise(df.select(F.lit(5.0).alias("k")), df.select(F.lit(5.0).alias("k")), ["k"]).first()["k_scaled"] == 0.0


def test_from_raw_tables_to_features(spark):
    """The whole chain, on a handful of rows."""
    rows = [raw_flight(CRS_DEP_TIME=1200, TAIL_NUM="t1", OP_CARRIER_FL_NUM="7", MONTH=3, DEP_DEL15=1.0), raw_flight(CRS_DEP_TIME=1300, ORIGIN="ZZZ")]
    f = flights.clean_flights(spark.createDataFrame([tuple(r[c] for c in C.FLIGHT_COLUMNS) for r in rows], schema_of_flights()))
    base = dict.fromkeys(C.WEATHER_COLUMNS) | dict.fromkeys(C.packed_columns())
    reports = [base | {"STATION": "s1", "DATE": f"2015-03-01 0{h}:00:00", "TMP": f"+00{h}0,1", "AW2": "61,1"} for h in (7, 8, 9)]
    w = spark.createDataFrame([tuple(r.values()) for r in reports], ", ".join(f"{c} string" for c in base))
    w = flights.clean_weather(w).withColumn("DATE", F.col("DATE").cast("timestamp"))
    stations = spark.createDataFrame([("x", 1.0, 1.0, "s1", "n", "st", "KAAA", 2.0)], "station_id string, lat double, lon double, neighbor_id string, neighbor_name string, neighbor_state string, neighbor_call string, distance_to_neighbor double")
    codes = spark.createDataFrame([("KAAA", "1", "AAA", "c")], ", ".join(f"{c} string" for c in C.AIRPORT_COLUMNS))
    zones = spark.createDataFrame([("AAA", "UTC")], "iata_code string, tz string")
    joined = flights.join_weather(f, w, stations, codes, zones)
    assert joined.count() == 3 and {r["ORIGIN"] for r in joined.collect()} == {"AAA"}
    flat = flights.collapse(joined)
    assert not uses_python(flat)
    shaped = flights.shape_features(flat)
    row = shaped.first()
    assert shaped.count() == 1 and row["weather_condition"] == "61" and row["CRS_DEP_TIME"] == 1200 and row["AL_SnowAccumDepth"] == 0
    assert math.isclose(row["TMP_Value"], round((70 / 300 + 80 / 240 + 90 / 180) / (1 / 300 + 1 / 240 + 1 / 180), 2))
    assert not {"DEP_DELAY", "ORIGIN_WAC"} & set(flights.drop_features(shaped).columns)


def test_windows_collapse_without_their_pairs(spark, monkeypatch):
    """Means and modes of an interval join from sums: many left rows share a place and time, many readings a station's time."""
    rng = random.Random(6)
    f = [(i, rng.choice(["A", "B", "C", None]), NOON + timedelta(minutes=30 * rng.randrange(6)) if rng.random() < 0.9 else None) for i in range(400)]
    f = J.window_bounds(spark.createDataFrame(f, "id int, place string, t timestamp"), "t", 6, 2, ("s", "e"))
    pick = lambda values: rng.choice([None, *values])
    r = [(rng.choice(["A", "B"]), NOON - timedelta(minutes=30 * rng.randrange(16)), float(pick([0, 2, 7]) or 0), pick([1, 2, 30]), pick([0.5, 4.25]), pick([9, 10, 11]), pick(["", "x", "y"])) for _ in range(600)]
    r = spark.createDataFrame(r, "code string, seen timestamp, far double, v int, u double, m int, k string")
    joined = J.interval_join(f, r, [("place", "code")], "seen", "s", "e", "left", 4)
    want = {x["id"]: x for x in A.collapse_readings(joined, ["id"], ["v", "u"], ["m", "k"], "far", "t", "seen").collect()}
    sizes, join = [], J.interval_join

    def counted(*args, **more):
        out = join(*args, **more)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(J, "interval_join", counted)
    there = A.collapse_windows(f, r, ("place", "code"), "t", "seen", "s", "e", ["v", "u"], ["m", "k"], "far", 4)
    got = f.join(there.drop("s", "e"), ["place", "t"], "left").collect()
    assert len(got) == 400 and [(x["v"], x["u"], x["m"], x["k"]) for x in got] == [tuple(want[x["id"]][c] for c in ("v", "u", "m", "k")) for x in got]
    assert len({x["m"] for x in got}) > 2 and 20 * sum(sizes) < joined.count()


def test_chain_equals_its_pairs(spark):
    from ontime import queries
    from ontime.sources import io

    path = queries.raw_tables(spark, "/root/testdata/sf0.001")
    f, w = flights.load_flights(spark, [path["first"], path["second"]]), flights.load_weather(spark, path["weather"])
    tables = (f, w, io.read_stations(spark, path["stations"]), io.read_airport_codes(spark, path["codes"]), io.read_csv(spark, path["zones"], "iata_code string, tz string"))
    one, two = flights.collapse(flights.join_weather(*tables)), flights.flights_with_weather(*tables)
    assert sorted(one.columns) == sorted(two.columns)
    plain = lambda df: sorted(str(tuple(r)) for r in df.select(sorted(one.columns)).collect())
    assert plain(one) == plain(two)
    shaped = flights.shape_features(two)
    apart = W.fill_group_median(W.fill_group_mean(two, ["WND_Speed"], C.GROUP_OF_FLIGHT), ["DEW_Value"], C.GROUP_OF_FLIGHT)
    assert {(r["DISTANCE"], r["WND_Speed_mean"] or 0) for r in apart.collect()} == {(r["DISTANCE"], r["WND_Speed_mean"]) for r in shaped.collect()}


def test_windows_meet_in_all_tasks(spark):
    """Few rows make many pairs: their bytes must not decide how many tasks join them. Few stations are what is broadcast."""
    t = lambda column: F.expr(f"TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, 0, {column})")
    f = spark.range(300).select(F.lit("A").alias("place"), t("id").alias("t"))
    r = spark.range(300).select(F.lit("A").alias("code"), t("id").alias("seen"), F.lit(1.0).alias("far"), F.col("id").alias("v"), (F.col("id") % 2).alias("m"))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        there = A.collapse_windows(J.window_bounds(f, "t", 6, 2, ("s", "e")), r, ("place", "code"), "t", "seen", "s", "e", ["v"], ["m"], "far", 4)
        assert there.count() == 298
        plan = there._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"RepartitionByExpression \[.*\], 9", plan)) == 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    airports = spark.range(5).selectExpr("concat('K', id) AS ident", "concat('A', id) AS iata_code").groupBy("ident").agg(F.first("iata_code").alias("iata_code"))
    stations = spark.range(20).selectExpr("concat('K', id % 5) AS neighbor_call", "id AS neighbor_id", "1D AS distance_to_neighbor")
    readings = spark.range(1000).selectExpr("id % 30 AS STATION", "TIMESTAMP '2024-01-01' AS DATE").groupBy("STATION", "DATE").count()
    out = J.airport_readings(airports, stations, readings)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 20 and "rightHint=(strategy=broadcast)" in plan


def test_shares_by_time_come_from_running_sums(spark):
    """Whole labels: no frame slides over the span's rows, and what it gives equals the sliding mean of the same numbers."""
    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), NOON + timedelta(minutes=rng.randrange(4000)) if i % 9 else None, rng.choice([None, 0, 1, 7])) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, k string, t timestamp, y int")
    share = lambda kind: W.rolling_share(df.withColumn("y", F.col("y").cast(kind)), ["k"], "t", "y", "m", -9, least_hours=2, block_hours=20)
    want = {r["i"]: r["m"] for r in share("double").collect()}
    for kind in ("int", "bigint"):
        out = share(kind)
        assert {r["i"]: r["m"] for r in out.collect()} == pytest.approx(want) and "(RangeFrame, -" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert "(RangeFrame, -" in share("double")._jdf.queryExecution().optimizedPlan().toString() and sum(m is None for m in want.values()) > 55
