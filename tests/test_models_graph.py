"""Metrics, votes, folds, models, graphs."""

import math

import pytest
from pyspark.sql import functions as F

from ontime.operators import encode as T
from ontime.operators import ensemble as V
from ontime.operators import graph as G
from ontime.operators import metrics as M
from ontime.operators import models
from ontime.operators import validate as K


def test_metrics(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] + [(0, 1)] * 2 + [(0, 0)]
    m = M.confusion(spark.createDataFrame(rows, "prediction int, y int"), label="y").first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (3, 1, 2, 1)
    assert math.isclose(m["precision"], 0.75) and math.isclose(m["recall"], 0.6) and math.isclose(m["f_beta"], 0.7143, abs_tol=1e-4)
    none = M.confusion(spark.createDataFrame([(0, 0)], "prediction int, y int"), label="y").first()
    assert (none["precision"], none["recall"], none["f_beta"]) == (0.0, 0.0, 0.0)
    groups = M.error_groups(spark.createDataFrame(rows, "prediction int, y int"), [], label="y")
    assert {r["pred_group"]: r["n"] for r in groups.collect()} == {"TP": 3, "FP": 1, "FN": 2, "TN": 1}


def test_votes(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 0, 0)], "a int, b int, c int")
    assert [r[0] for r in df.select(V.hard_vote([F.col(c) for c in "abc"])).collect()] == [1, 0]
    p = spark.createDataFrame([(0.5, 0.5), (0.9, 0.1)], "p0 double, p1 double")
    assert [r[0] for r in p.select(V.soft_vote([F.col("p0")] * 3, [F.col("p1")] * 3)).collect()] == [1, 0]


def test_folds_follow_each_other():
    folds = K.rolling_folds(12 * 2015)
    assert len(folds) == 5 and folds[0].train == (12 * 2015, 12 * 2015 + 9) and folds[-1].valid[1] == 12 * 2019
    assert all(f.train[1] == f.valid[0] for f in folds)


def test_grids():
    assert len(K.grid({"a": [1, 2], "b": [3, 4, 5]})) == 6
    draw = lambda seed: K.RandomGrid(3, seed).add("a", lambda r: r.random()).build()
    assert draw(0) == draw(0) != draw(1)
    assert len(set(K.skip_folds(5, 1))) == 2


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, float(i % 10), float(i % 7), int(i % 10 > 5), "ab"[i % 2]) for i in range(200)]
    return spark.createDataFrame(rows, "m int, x double, z double, y int, c string")


def test_cross_validation_and_models(spark, points, tmp_path):
    def prepare(train, other):
        pipe = T.regression_pipeline(["c"], ["x", "z"]).fit(train)
        return pipe.transform(train), pipe.transform(other)

    lr = models.logistic("y", rounds=10)
    cv = K.TimeFoldValidator(lr, K.grid({lr.regParam: [0.0, 5.0]}), "y", sampling="over", prepare=prepare)
    model = cv.fit(points, K.rolling_folds(0, 60, 20, 60, 2), F.col("m"))
    assert model.best == 0 and model.metrics(spark).count() == 4 and not model.sub_models
    model.save(spark, str(tmp_path / "cv"))
    again = K.TimeFoldModel.load(spark, str(tmp_path / "cv"))
    assert again.best_model.coefficients == model.best_model.coefficients and again.settings == [{"regParam": 0.0}, {"regParam": 5.0}]
    fitted, scored = K.evaluate_holdout(models.forest("y", 3, 5), points.where("m < 150"), points.where("m >= 150"), "y", prepare=prepare)
    assert M.confusion(scored, label="y").first()["f_beta"] > 0.9
    names = models.feature_names(scored, "vectorized_features")
    assert models.importances(spark, fitted, names).first()["feature"] == "x"


def test_tuner_takes_any_evaluator(spark, points, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator

    df = T.tree_pipeline(["x", "z"]).fit(points).transform(points)
    folds, lr = K.rolling_folds(0, 60, 20, 60, 2), models.logistic("y", rounds=10)
    area = BinaryClassificationEvaluator(labelCol="y")
    cv = K.TimeFoldValidator(lr, K.Grid().base_on({lr.threshold: 0.5}).add(lr.regParam, [0.0, 0.1]).build(), "y", evaluator=area, keep_models=True)
    model = cv.fit(df, folds, F.col("m"))
    assert set(model.sub_models) == {1, 2} and all(len(m) == 2 for m in model.sub_models.values())
    for r in model.metrics(spark).collect():
        valid = df.where(f"m >= {folds[r['fold'] - 1].valid[0]} AND m < {folds[r['fold'] - 1].valid[1]}")
        assert r["score"] == pytest.approx(area.evaluate(model.sub_models[r["fold"]][r["map"]].transform(valid))) and r["f_beta"] is None
    model.save(spark, str(tmp_path / "t"))
    again = K.TimeFoldModel.load(spark, str(tmp_path / "t"))
    assert again.best == model.best and again.rows == sorted(model.rows) and again.sub_models[2][1].coefficients == model.sub_models[2][1].coefficients
    # a smaller error is better, and the tuner is an estimator
    trees = models.boosted("z", depth=2, rounds=2, regression=True, minInstancesPerNode=3)
    error = K.TimeFoldValidator(trees, K.grid({trees.maxDepth: [1, 4]}), "z", evaluator=RegressionEvaluator(labelCol="z"), folds=folds, time=F.col("m"))
    fitted = Pipeline(stages=[error]).fit(df)
    best = fitted.stages[0]
    assert not error.larger_is_better and best.mean_metrics[best.best] == min(best.mean_metrics) and "prediction" in fitted.transform(df).columns


def test_grid_builder():
    lr = models.logistic("y")
    maps = K.Grid().base_on({lr.labelCol: "l"}).base_on([(lr.predictionCol, "p")]).add(lr.regParam, [1, 2.0]).add(lr.maxIter, [1, 5]).build()
    assert len(maps) == 4 and all(m[lr.labelCol] == "l" and m[lr.predictionCol] == "p" and isinstance(m[lr.regParam], float) for m in maps)
    assert {(m[lr.regParam], m[lr.maxIter]) for m in maps} == {(1.0, 1), (1.0, 5), (2.0, 1), (2.0, 5)}
    with pytest.raises(TypeError):
        K.Grid().add("regParam", [1])


def test_plain_folds(points):
    from pyspark.ml.regression import RandomForestRegressor

    df = T.tree_pipeline(["x", "z"]).fit(points).transform(points)
    rf = RandomForestRegressor(labelCol="y", numTrees=3, seed=1)
    _, means = K.kfold(rf, K.grid({rf.maxDepth: [1, 4]}), df, "y", "rmse", 2)
    assert len(means) == 2 and means[1] <= means[0]


def test_clock_buckets_reach_the_features(spark):
    df = spark.createDataFrame([(905.0, 1.0), (1300.0, 2.0)], "CRS_DEP_TIME double, v double")
    wanted = ["CRS_DEP_TIME", "v"]
    out = T.tree_pipeline(wanted).fit(df).transform(df)
    assert wanted == ["CRS_DEP_TIME", "v"] and [list(r["features"]) for r in out.collect()] == [[1.0, 1.0], [2.0, 2.0]]


def test_gradient_descent_lowers_the_loss(points):
    history = models.gradient_descent(points, ["x"], "y", rounds=15, rate=0.05).orderBy("step").collect()
    losses = [r["loss"] for r in history if r["loss"] is not None]
    assert losses[0] == pytest.approx(math.log(2), abs=1e-4) and losses[-1] < losses[0]
    (w, _), _ = models.gradient_step(points, ["x"], "y", [2.0, 0.0], 0.1, "linear", "lasso", 1.0)
    (v, _), _ = models.gradient_step(points, ["x"], "y", [2.0, 0.0], 0.1, "linear")
    assert w == pytest.approx(v - 0.1)


def edges(spark, text):
    return spark.createDataFrame([tuple(e) for e in text.split()], "src string, dst string")


def test_pagerank_of_a_small_graph(spark):
    e = edges(spark, "AB AD BC BE CD DE EA EB EC")
    got = {r["id"]: r["rank"] for r in G.pagerank(e, alpha=0.0, rounds=60).collect()}
    want = {"A": 0.10526316, "B": 0.15789474, "C": 0.18421053, "D": 0.23684211, "E": 0.31578947}
    assert all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in want)


def test_pagerank_keeps_its_mass(spark):
    e = edges(spark, "AB AC AD BD BE CA CE DB")
    ranks = G.pagerank(e, rounds=12)
    assert math.isclose(ranks.agg(F.sum("rank")).first()[0], 1.0, abs_tol=1e-9)
    assert [r["id"] for r in G.dangling(e).collect()] == ["E"]
    assert G.degree_stats(e).first().asDict() == {"n_nodes": 5, "n_with_targets": 4, "n_dangling": 1, "mean_degree": 2.0}


def test_graph_texts(spark):
    lines = spark.createDataFrame([("1\t{'2': 3, '4': 1}",), ("5\t{}",)], "value string")
    assert sorted((r["src"], r["dst"] or "", r["n"] or 0) for r in G.edges_of_text(lines).collect()) == [("1", "2", 3), ("1", "4", 1), ("5", "", 0)]
    titles = spark.createDataFrame([("A title\t7\t1\t2",), ("bad",)], "value string")
    assert [tuple(r) for r in G.title_index(titles).collect()] == [("A title", "7", 1, 2), ("bad", None, None, None)]
    assert {r["src"]: r["targets"] for r in G.adjacency(edges(spark, "AB AC BA")).collect()} == {"A": ["B", "C"], "B": ["A"]}


def test_flight_graph(spark):
    f = spark.createDataFrame([("A", "B", "x", 1), ("A", "B", "x", 0), ("B", "A", "y", 1)], "ORIGIN string, DEST string, OP_UNIQUE_CARRIER string, PREV_DEP_DEL15 int")
    v, e = G.flight_graph(f)
    assert v.count() == 2 and {r["id"]: r["inDegree"] for r in G.in_degrees(e).collect()} == {"B": 2, "A": 1}
    assert {r["src"]: r["avg_prev_delay_carrier"] for r in G.route_delay(e).collect()} == {"A": 0.5, "B": 1.0}


def test_dangling_nodes_by_one_aggregation(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", None), (None, "f"), ("a", "c")], "src string, dst string")
    out = G.dangling(e)
    assert sorted(r["id"] for r in out.collect()) == ["c", "d", "f"]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
