"""Bucketed tables, sketches per period, ranks to convergence, nearest places."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ontime import queries
from ontime.operators import graph as G
from ontime.operators import places, sketches
from ontime.session import shared_folder
from ontime.sources import bucketed

DATA = "/root/testdata/sf0.001"


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_scratch_folder_for_a_process(spark):
    assert spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark) == shared_folder(spark)


# --- bucketed


@pytest.mark.parametrize("name", ["bucketed_join", "bucketed_votes"])
def test_joins_of_buckets_have_no_exchange(spark, name):
    plan = final_plan(queries.QUERIES[name](spark, DATA))
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "SelectedBucketsCount: 8 out of 8" in plan


def test_a_bucket_is_one_file_and_groups_need_no_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("k"), "id").repartition(7)
    b = bucketed.write_bucketed(df, ["k"], 4, "some_buckets")
    assert len(b.inputFiles()) == 4
    g = b.groupBy("k").agg(F.count("*").alias("n"))
    assert {r["n"] for r in g.collect()} == {20} and "Exchange" not in final_plan(g)
    with pytest.raises(AnalysisException):  # from the table that it would take the place of
        bucketed.write_bucketed(b.where("k < 3"), ["k"], 4, "some_buckets")
    again = bucketed.write_bucketed(df.where("k < 3"), ["k"], 4, "some_buckets")
    assert again.count() == 60
    bucketed.drop_bucketed(spark, "some_buckets")
    assert not spark.catalog.tableExists("some_buckets")


def test_buckets_with_null_keys_and_without_rows(spark):
    df = spark.createDataFrame([(None, 1), (1, 2), (1, 3)], "k long, v int")
    a, none = bucketed.write_bucketed(df, ["k"], 3), bucketed.write_bucketed(df.where("v > 9").withColumnRenamed("v", "w"), ["k"], 3)
    assert a.count() == 3 and none.count() == 0
    assert bucketed.co_join(a, none, ["k"], "left").count() == 3 and bucketed.co_join(a, a.withColumnRenamed("v", "w"), ["k"]).count() == 4
    with pytest.raises(ValueError):
        bucketed.write_bucketed(df, ["k"], 3, "x; y")


# --- sketches


def test_merged_sketches_keep_the_stated_errors(spark):
    """40 periods of 5000 rows with k = 256: every sketch is far above its size, merged or not."""
    df = spark.range(200_000).select(
        (F.col("id") % 40).alias("p"), (F.pow(F.rand(7), F.lit(3)) * 1e6).alias("x"), F.when(F.col("id") % 4 > 0, F.col("id") % 3000).cast("double").alias("y")
    )
    kept = sketches.by_period(df, "p", ["x", "y"], k=256).cache()
    assert kept.count() == 80 and kept.agg(F.max(F.length("kll"))).first()[0] < 20_000
    for lo, hi in ((0, 40), (5, 17)):
        span = sketches.merged(kept.where(F.col("period").between(lo, hi - 1)))
        got = {r["column"]: r for r in sketches.audit(span, quantiles={"a": 0.01, "b": 0.5, "c": 0.9}).collect()}
        real = df.where(F.col("p").between(lo, hi - 1)).toPandas()
        for c in ("x", "y"):
            v = np.sort(real[c].dropna().to_numpy())
            assert (got[c]["rows"], got[c]["n_null"]) == (len(real), len(real) - len(v))
            assert (got[c]["least"], got[c]["most"]) == (v[0], v[-1])
            assert math.isclose(got[c]["n_distinct"], len(set(v)), rel_tol=0.05)
            for name, p in (("a", 0.01), ("b", 0.5), ("c", 0.9)):
                below, upto = np.searchsorted(v, got[c][name], "left") / len(v), np.searchsorted(v, got[c][name], "right") / len(v)
                assert below - sketches.rank_error(256) <= p <= upto + sketches.rank_error(256)
    gaps = sketches.rank_gap(df, sketches.merged(kept).select("column", sketches.quantile(0.5).alias("value")), "x", 0.5)
    assert gaps.first()["gap"] <= sketches.rank_error(256)


def test_sketches_of_nothing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, None, 5.0), (1, nan, 7.0), (None, None, nan)], "p int, a double, b double")
    kept = sketches.by_period(df, "p", ["a", "b"])
    got = {r["column"]: r for r in sketches.audit(sketches.merged(kept)).collect()}
    assert (got["a"]["rows"], got["a"]["n_null"], got["a"]["n_distinct"], got["a"]["q50"], got["a"]["least"]) == (3, 3, 0, None, None)
    assert (got["b"]["n_null"], got["b"]["n_distinct"], got["b"]["q50"], got["b"]["most"]) == (1, 2, 5.0, 7.0)
    filled = sketches.fill_median(df, sketches.merged(kept), ["a", "b"])
    assert sorted(r["b"] for r in filled.collect()) == [5.0, 5.0, 7.0] and {r["a"] for r in filled.collect()} == {None}
    assert filled.columns == df.columns
    assert sketches.by_period(df.where("p > 5"), "p", ["a"]).count() == 0


# --- ranks


def random_edges(spark, seed, n=200, m=900):
    rng = random.Random(seed)
    return spark.createDataFrame([(int(rng.paretovariate(0.8)) % n, rng.randrange(n)) for _ in range(m)] + [(n + 1, n + 2)], "src long, dst long")


@pytest.mark.parametrize("alpha", [0.15, 0.5])
def test_converged_ranks_equal_those_of_fixed_rounds(spark, alpha):
    edges = random_edges(spark, 3)
    got, rounds = G.pagerank_converged(edges, alpha, 1e-10)
    got = {r["id"]: r["rank"] for r in got.collect()}
    w = np.zeros((203, 203))
    for r in edges.collect():
        w[r["src"], r["dst"]] += 1
    ids = sorted({x for r in edges.collect() for x in r})
    w = w[np.ix_(ids, ids)]
    total, n = w.sum(1), len(ids)
    w[total > 0] /= total[total > 0][:, None]
    rank, needed = np.full(n, 1 / n), 0
    while True:
        new = alpha / n + (1 - alpha) * (rank[total == 0].sum() / n + rank @ w)
        moved, rank, needed = abs(new - rank).sum(), new, needed + 1
        if moved < 1e-13:
            break
    assert sorted(got) == ids and math.isclose(sum(got.values()), 1.0, rel_tol=1e-12)
    assert sum(abs(got[i] - r) for i, r in zip(ids, rank)) < 1e-10
    assert rounds < needed


def test_ranks_without_edges_and_with_too_few_rounds(spark):
    none = spark.createDataFrame([], "src long, dst long")
    ranks, rounds = G.pagerank_converged(none)
    assert ranks.count() == 0 and rounds == 0
    lone, _ = G.pagerank_converged(spark.createDataFrame([(1, None), (2, None), (None, 2)], "src long, dst long"))
    assert {r["id"]: r["rank"] for r in lone.collect()} == {1: 0.5, 2: 0.5}
    with pytest.raises(RuntimeError):
        G.pagerank_converged(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "src long, dst long"), most=3)
    with pytest.raises(ValueError):
        G.pagerank_converged(none, alpha=0.0)


# --- places


def chord(a, b):
    p = lambda x: np.array([math.cos(x[0]) * math.cos(x[1]), math.cos(x[0]) * math.sin(x[1]), math.sin(x[0])])
    return float(((p([math.radians(v) for v in a]) - p([math.radians(v) for v in b])) ** 2).sum())


@pytest.mark.parametrize("start_km", [None, 100.0, 9000.0])
def test_nearest_places_equal_brute_force(spark, start_km):
    """A crowd, poles, both sides of the date line, longitudes of 0 to 360, a left row far from all, repeated places."""
    rng = random.Random(5)
    right = [(i, 48 + rng.random(), 2 + rng.random()) for i in range(150)] + [(200 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(40)]
    right += [(300, 90.0, 0.0), (301, -90.0, 10.0), (302, 0.0, 179.9), (303, 0.0, 180.1), (304, 48.5, 2.5), (305, 48.5, 2.5)]
    left = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(40)]
    left += [(100, 48.5, 2.5), (101, 89.9, 120.0), (102, -89.9, -60.0), (103, 0.0, -180.0), (104, 0.0, 180.0), (105, -47.0, -123.4)]
    schema = "id long, lat double, lon double"
    gone = [(900, None, 1.0), (901, 91.0, 0.0), (None, 1.0, 1.0), (902, float("nan"), 0.0)]
    a, b = spark.createDataFrame(left + gone, schema), spark.createDataFrame(right + gone, schema)
    on = ("id", "lat", "lon")
    got = {}
    for r in places.nearest_places(a, b, 4, on, on, start_km).collect():
        got.setdefault(r["left_id"], {})[r["rank"]] = (r["right_id"], r["distance_km"])
    assert set(got) == {x[0] for x in left}
    for i, *at in left:
        want = sorted((round(chord(at, r[1:]), 13), r[0]) for r in right)[:4]
        assert sorted(got[i]) == [1, 2, 3, 4]
        assert [round(got[i][k][1], 3) for k in (1, 2, 3, 4)] == pytest.approx([2 * places.EARTH_KM * math.asin(min(1, math.sqrt(c) / 2)) for c, _ in want], abs=0.01)
        if all(x[0] != y[0] for x, y in zip(want, want[1:])):
            assert [got[i][k][0] for k in (1, 2, 3, 4)] == [x[1] for x in want]
    assert [got[100][k][0] for k in (1, 2)] == [304, 305]


def test_fewer_places_than_asked_for(spark):
    schema = "id long, lat double, lon double"
    a, b = spark.createDataFrame([(1, 10.0, 10.0), (2, -80.0, 0.0)], schema), spark.createDataFrame([(7, 10.0, 10.5)], schema)
    on = ("id", "lat", "lon")
    assert places.nearest_places(a, b, 3, on, on).count() == 2
    assert places.nearest_places(a, b.where("id > 9"), 3, on, on).count() == 0
    assert places.nearest_places(a.where("id > 9"), b, 3, on, on).count() == 0


def test_places_meet_by_cell(spark):
    schema = "id long, lat double, lon double"
    df = spark.createDataFrame([(i, i / 3 - 80, i / 2 - 170) for i in range(400)], schema)
    a, b = places._on_sphere(df, "id", "lat", "lon", "left_id"), places._on_sphere(df, "id", "lat", "lon", "right_id")
    met = places.candidates(a, b, 0.02)
    plan = final_plan(met)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "_cx" in plan
    assert 400 <= met.count() < 4000


def test_a_far_row_meets_the_edge_of_a_crowd_alone(spark):
    rng = random.Random(9)
    schema = "id long, lat double, lon double"
    crowd = spark.createDataFrame([(i, rng.uniform(40, 55), rng.uniform(0, 25)) for i in range(5000)], schema)
    far = spark.createDataFrame([(1, -40.0, -130.0), (2, 0.0, 10.0)], schema)
    a, b = places._on_sphere(far, "id", "lat", "lon", "left_id"), places._on_sphere(crowd, "id", "lat", "lon", "right_id")
    met = places.descend(a, b, 3, 50 / places.EARTH_KM)
    assert 6 <= met.count() < 1500
    on, at = ("id", "lat", "lon"), {r["id"]: (r["lat"], r["lon"]) for r in crowd.collect()}
    got = [(r["left_id"], r["right_id"]) for r in places.nearest_places(far, crowd, 3, on, on, 50.0).orderBy("left_id", "rank").collect()]
    want = [(i, j) for i, p in ((1, (-40.0, -130.0)), (2, (0.0, 10.0))) for j in sorted(at, key=lambda j: chord(p, at[j]))[:3]]
    assert got == want


def test_few_candidates_leave_a_crowd(spark, monkeypatch):
    """All places of a crowd are looked at, in arrays of a bounded length, and the nearest of each array alone go on."""
    monkeypatch.setattr(places, "CHUNK", 100)
    rng = random.Random(4)
    at = {i: (rng.uniform(50, 50.1), rng.uniform(8, 8.1)) for i in range(1500)}
    df = spark.createDataFrame([(i, *p) for i, p in at.items()], "id long, lat double, lon double")
    a, b = places._on_sphere(df.where("id < 20"), "id", "lat", "lon", "left_id"), places._on_sphere(df, "id", "lat", "lon", "right_id")
    arrays = places.chunks(b, 0.5).selectExpr("size(_places) AS n").agg(F.max("n"), F.sum("n")).first()
    assert arrays[0] < 200 and arrays[1] == 27 * 1500
    assert places.candidates(a, b, 0.5).count() == 20 * 1500 and places.candidates(a, b, 0.5, 3).count() == 20 * 15 * 3
    on = ("id", "lat", "lon")
    got = [(r["left_id"], r["right_id"]) for r in places.nearest_places(df.where("id < 20"), df, 3, on, on, 3000.0).orderBy("left_id", "rank").collect()]
    assert got == [(i, j) for i in range(20) for j in sorted(at, key=lambda j: chord(at[i], at[j]))[:3]]


def test_buckets_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(bucketed, "BUCKET_ROWS", 100)
    few, many = spark.range(800), spark.range(1601)
    assert [bucketed.buckets_for(t) for t in (spark.range(0), few, many)] == [8, 8, 32] and bucketed.buckets_for(few, many) == 32
    plan = final_plan(queries.bucketed_join(spark, "/root/testdata/sf0.001"))
    assert "SelectedBucketsCount: 64 out of 64" in plan and "Exchange" not in plan
