"""Fitted models against numpy, out-of-fold means against plain Python, and the incremental load's plan."""

import hashlib
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontime.operators import clean as P
from ontime.operators import encode as T
from ontime.operators import models, trees
from ontime.operators import validate as K
from ontime.plans.inspect import uses_python
from ontime.session import shared_folder

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    out = []
    for i in range(900):
        a, b, c = rng.gauss(0, 1), rng.choice([0.0, 1.0, 2.0, 3.0]), None if i % 31 == 0 else rng.random()
        z = 1.5 * a - (b > 1) * 2 + (c or 0) * (a > 0) * 3
        out.append((i, a, b, c, int(rng.random() < 1 / (1 + math.exp(-z))) if i % 47 else None))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int").repartition(3).cache()


def unit(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def bins_of(rows, edges):
    return np.array([[0 if r[1 + k] is None else sum(r[1 + k] > e for e in edges[c]) for k, c in enumerate(FEATURES)] for r in rows])


def plain_tree(x, a, h, depth, gain, value, allowed, least, n=1):
    """{node: (feature, bin)} and {node: value}, grown by trying every cut of every feature."""
    best = None
    if n < 2**depth:
        for f in allowed(n):
            for cut in range(int(x[:, f].max(initial=0))):
                left = x[:, f] <= cut
                hl, hr = h[left].sum(), h[~left].sum()
                if hl < least or hr < least or hl <= 0 or hr <= 0:
                    continue
                g = round(gain((a[left].sum(), hl), (a[~left].sum(), hr)), 10)
                if g > 0 and (best is None or g > best[0]):
                    best = g, f, cut
    if best is None:
        return {}, {n: value(a.sum(), h.sum())}
    _, f, cut = best
    left = x[:, f] <= cut
    splits, leaves = {n: (FEATURES[f], cut)}, {}
    for side, child in ((left, 2 * n), (~left, 2 * n + 1)):
        s, v = plain_tree(x[side], a[side], h[side], depth, gain, value, allowed, least, child)
        splits |= s
        leaves |= v
    return splits, leaves


def leaf_of(x, splits):
    n = 1
    while n in splits:
        f, cut = splits[n]
        n = 2 * n if x[FEATURES.index(f)] <= cut else 2 * n + 1
    return n


def test_boosted_trees_equal_numpy(spark, df, rows):
    rate, gamma, alpha, lam, weight, share, depth, rounds = 0.4, 0.05, 0.3, 2.0, 1.7, 0.7, 4, 5
    fit = trees.fit_boosted(df, FEATURES, "y", rounds, depth, rate, gamma, alpha, lam, weight, 1.0, share, bins=8, seed=5)
    x, y = bins_of(rows, fit.edges), np.array([math.nan if r[4] is None else r[4] for r in rows])
    known, margin = ~np.isnan(y), np.zeros(len(rows))
    soft = lambda g: math.copysign(max(abs(g) - alpha, 0), g)
    part = lambda g, h: soft(g) ** 2 / (h + lam)
    for k in range(rounds):
        p, w = 1 / (1 + np.exp(-margin)), np.where(y == 1, weight, 1.0)
        a, h = w * (p - y), w * p * (1 - p)
        allowed = sorted(sorted(range(3), key=lambda i: unit(5, "tree", k, FEATURES[i]))[:2])
        gain = lambda left, right: (part(*left) + part(*right) - part(left[0] + right[0], left[1] + right[1])) / 2 - gamma
        splits, leaves = plain_tree(x[known], a[known], h[known], depth, gain, lambda g, s: -rate * soft(g) / (s + lam), lambda n: allowed, 1.0)
        assert {n: (s.feature, s.bin) for n, s in fit.trees[k].splits.items()} == splits
        assert fit.trees[k].leaves == pytest.approx(leaves)
        margin += [leaves[leaf_of(v, splits)] for v in x]
    out = fit.transform(df)
    assert not uses_python(out)
    got = {r["id"]: r["probability"] for r in out.collect()}
    assert [got[r[0]] for r in rows] == pytest.approx(list(1 / (1 + np.exp(-margin))))
    assert sum(s[1] for s in fit.importance(spark).collect()) == pytest.approx(1)
    assert fit.table(spark).count() == sum(len(t.splits) + len(t.leaves) for t in fit.trees)


def test_boosted_numbers_fall_in_error(df, rows):
    """Squares: each round fits what is left, and more rounds fit better."""
    known = df.where("c IS NOT NULL")
    errors = []
    for rounds in (1, 4, 12):
        fit = trees.fit_boosted(known, ["a", "b"], "c", rounds, 3, 0.5, squares=True, bins=8)
        errors.append(fit.transform(known, "p").agg(F.avg((F.col("p") - F.col("c")) ** 2)).first()[0])
    c = np.array([r[3] for r in rows if r[3] is not None])
    assert errors[0] > errors[1] > errors[2] and errors[2] < c.var()


def test_forest_equals_numpy(df, rows):
    n, depth, some, least = 4, 4, 2, 3.0
    fit = trees.fit_forest(df, FEATURES, "y", ["id"], n, depth, bins=8, some=some, least=least, seed=3)
    again = trees.fit_forest(df.repartition(7), FEATURES, "y", ["id"], n, depth, edges=fit.edges, some=some, least=least, seed=3)
    assert [t.splits for t in again.trees] == [t.splits for t in fit.trees]
    x, y = bins_of(rows, fit.edges), np.array([math.nan if r[4] is None else r[4] for r in rows])
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    gini = lambda s: 2 * s[0] / s[1] * (1 - s[0] / s[1])
    total = np.zeros(len(rows))
    for t in range(n):
        w = np.array([sum(unit(3, r[0], t) >= b for b in below) for r in rows], dtype=float)
        use = (w > 0) & ~np.isnan(y)

        def gain(left, right):
            whole = left[0] + right[0], left[1] + right[1]
            return gini(whole) - left[1] / whole[1] * gini(left) - right[1] / whole[1] * gini(right)

        allowed = lambda node, t=t: sorted(sorted(range(3), key=lambda i: unit(3, t, node, FEATURES[i]))[:some])
        splits, leaves = plain_tree(x[use], (w * y)[use], w[use], depth, gain, lambda a, h: a / h, allowed, least)
        assert {k: (s.feature, s.bin) for k, s in fit.trees[t].splits.items()} == splits
        total += [leaves[leaf_of(v, splits)] for v in x]
    got = {r["id"]: r["probability"] for r in fit.transform(df).collect()}
    assert [got[r[0]] for r in rows] == pytest.approx(list(total / n))


def test_trees_of_nothing_and_of_one_class(spark, df):
    for table in (df.limit(0), df.withColumn("y", F.lit(1))):
        fit = trees.fit_boosted(table, FEATURES, "y", 2, 2)
        assert not any(t.splits for t in fit.trees) and fit.transform(df).count() == 900
        forest = trees.fit_forest(table, FEATURES, "y", ["id"], 2, 2)
        assert not any(t.splits for t in forest.trees)


@pytest.mark.parametrize(("ridge", "weight"), [(0.0, None), (3.0, "b")])
def test_newton_equals_numpy(spark, df, rows, ridge, weight):
    known = [r for r in rows if r[3] is not None and r[4] is not None]
    x = np.array([[r[1], r[3], 1.0] for r in known])
    y, v = np.array([r[4] for r in known]), np.array([r[2] if weight else 1.0 for r in known])
    penalty, w = np.array([ridge, ridge, 0.0]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        gram = (x * (v * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        w = w + np.linalg.solve(gram, x.T @ (v * (y - p)) - penalty * w)
    fit = models.newton_logistic(df, ["a", "c"], "y", ridge=ridge, weight=weight)
    assert fit.weights == pytest.approx(list(w), abs=1e-8)
    assert fit.errors == pytest.approx(list(np.sqrt(np.diag(np.linalg.inv(gram)))), abs=1e-8)
    losses = [loss for loss, _ in fit.history]
    assert losses == sorted(losses, reverse=True) and len(losses) < 12
    assert [r["feature"] for r in fit.table(spark).collect()] == ["a", "c", "constant"]
    assert fit.transform(df).where("probability IS NULL").count() == sum(r[3] is None for r in rows)


def test_newton_without_curvature(spark, df):
    """A feature that says nothing, one that is constant, and no rows at all."""
    fit = models.newton_logistic(df.withColumn("k", F.lit(0.0)), ["a", "k"], "y")
    assert fit.weights[1] == 0 and math.isnan(fit.errors[1]) and abs(fit.weights[0]) > 0.5
    assert models.newton_logistic(df.limit(0), ["a"], "y").weights == [0.0, 0.0]


# --- out-of-fold means


def encoded(df, **settings):
    e = T.OutOfFoldEncoder("k", "y", ["id"], **settings)
    model = e.fit(df)
    return {r["id"]: r["k_mean_encoding"] for r in model.transform_train(df).collect()}, model


def test_own_label_never_enters(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["x"] * 6 + ["y", "z", None]), rng.choice([0, 1, 1, None])) for i in range(120)] + [(500, "once", 1)]
    schema = "id long, k string, y int"
    before, model = encoded(spark.createDataFrame(rows, schema), folds=4, prior=3.0)
    fold = {i: int(unit(1, i) * 4) for i, *_ in rows}
    for i, k, _ in rows:
        others = [(a, b) for j, a, b in rows if fold[j] != fold[i] and b is not None]
        mean, mine = np.mean([b for _, b in others]), [b for a, b in others if a == k]
        assert before[i] == pytest.approx((sum(mine) + 3 * mean) / (len(mine) + 3))
    flipped = [(i, k, y if i != 17 else (0 if y == 1 else 1)) for i, k, y in rows]
    after, _ = encoded(spark.createDataFrame(flipped, schema), folds=4, prior=3.0)
    assert after[17] == before[17] and after[500] == pytest.approx(before[500]) or fold[500] != fold[17]
    assert any(after[i] != before[i] for i in after if fold[i] != fold[17])
    known = [(k, y) for _, k, y in rows if y is not None]
    mean = np.mean([y for _, y in known])
    new = {r["k"]: r["k_mean_encoding"] for r in model.transform(spark.createDataFrame([("x",), ("new",), (None,)], "k string")).collect()}
    part = lambda key: [y for k, y in known if k == key]
    assert new["new"] == pytest.approx(mean) and new["x"] == pytest.approx((sum(part("x")) + 3 * mean) / (len(part("x")) + 3))
    assert new[None] == pytest.approx((sum(part(None)) + 3 * mean) / (len(part(None)) + 3))


def test_means_of_nothing(spark):
    empty, _ = encoded(spark.createDataFrame([], "id long, k string, y int"))
    assert empty == {}
    none, _ = encoded(spark.createDataFrame([(1, "a", None)], "id long, k string, y int"))
    assert none == {1: None}


# --- incremental load


@pytest.mark.parametrize("bloom", [True, False])
def test_new_rows(spark, bloom):
    rng = random.Random(3)
    key = lambda: (rng.choice([None, *"abcdefgh"]), rng.choice([None, *range(40)]))
    history, new = [(*key(), i) for i in range(250)], [(*key(), i) for i in range(150)]
    schema = "k string, n int, v int"
    got = P.new_rows(spark.createDataFrame(new, schema), spark.createDataFrame(history, schema), ["k", "n"], bloom=bloom)
    old, want = {r[:2] for r in history}, {}
    for *k, v in new:
        if tuple(k) not in old:
            want[tuple(k)] = min(v, want.get(tuple(k), v))
    assert {(r["k"], r["n"]): r["v"] for r in got.collect()} == want and 0 < len(want) < len(set(new))
    assert not uses_python(got)
    none = spark.createDataFrame([], schema)
    assert P.new_rows(none, spark.createDataFrame(history, schema), ["k", "n"], bloom=bloom).count() == 0
    assert P.new_rows(spark.createDataFrame(new, schema), none, ["k", "n"], bloom=bloom).count() == len({r[:2] for r in new})


def test_only_suspects_are_shuffled(spark):
    """Of 50,000 keys in history, those of the new period and few others come through the filter, without a shuffle."""
    history = spark.range(50_000).select(F.col("id").alias("k"))
    new = spark.range(49_900, 50_100).select(F.col("id").alias("k"))
    bits = 1 << 15
    left = P.maybe_in(history, ["k"], P.bloom_filter(new, ["k"], bits), bits)
    assert left.where("k >= 49900").count() == 100 and left.count() < 200
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and plan.count("BroadcastHashJoin") == P.BLOOM_HASHES


# --- tuner


def test_fit_takes_a_parameter_map(spark):
    """As for any estimator: settings for one fit, which leave the tuner as it was."""
    df = spark.createDataFrame([(m, float(i), int(i > 4)) for m in range(1, 7) for i in range(10)], "m int, value double, y int")
    rule = models.MeanRule("value", "y", 1.0)
    folds = K.rolling_folds(1, train=2, valid=1, step=1, n=2)
    cv = K.TimeFoldValidator(rule, [{}], "y", folds=folds, time=F.col("m"))
    limits = [cv.fit(df, extra).best_model.getOrDefault("limit") for extra in (None, {rule.factor: 2.0}, None)]
    assert limits == [7.0, 14.0, 7.0]


def test_a_failed_fit_holds_no_fold(spark):
    df = spark.createDataFrame([(m, float(m), 1) for m in range(1, 7)], "m int, value double, y int")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    cv = K.TimeFoldValidator(models.MeanRule("nothing", "y"), [{}], "y", folds=K.rolling_folds(1, train=2, valid=1, step=1, n=2), time=F.col("m"))
    with pytest.raises(Exception, match="nothing"):
        cv.fit(df)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def _passes(spark, monkeypatch, fit):
    """Most partitions of what an estimator is given while `fit` runs over keys joined by a shuffle, and what is left behind."""
    seen, shared, files = [], Path(shared_folder(spark).split(":", 1)[-1]), "ontime-held-*"
    plain = models.MeanRule._fit
    monkeypatch.setattr(models.MeanRule, "_fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or plain(self, df))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.range(2000).selectExpr("id", "CAST(id % 9 + 1 AS INT) AS m", "id % 7 / 7D AS value", "CAST(id % 5 = 0 AS INT) AS y")

        def prepare(train, other):
            means = train.groupBy("id").agg(F.avg("y").alias("mean"))
            return train.join(means.hint("merge"), "id"), other.join(means.hint("merge"), "id", "left")

        fit(df, prepare)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert not list(shared.glob(files))
    return max(seen)


def test_passes_over_a_fold_read_few_partitions(spark, monkeypatch):
    """A fit passes many times over its rows; a cached join would give each pass all partitions of its shuffle."""
    rule = models.MeanRule("value", "y")
    cv = lambda df, prepare: K.TimeFoldValidator(rule, [{}], "y", prepare=prepare, folds=K.rolling_folds(1, train=3, valid=1, step=3, n=2), time=F.col("m")).fit(df)
    judge = lambda scored: scored.count()
    plain = lambda df, prepare: K.kfold(rule, [{}], df, "y", folds=2, prepare=prepare, key=["id"], evaluator=judge)
    once = lambda df, prepare: K.evaluate_holdout(rule, df.where("m < 8"), df.where("m >= 8"), "y", "over", prepare)[1].count()
    assert all(_passes(spark, monkeypatch, fit) < 16 for fit in (cv, plain, once))


def test_levels_of_a_forest_read_counts(spark, monkeypatch):
    """Rows that share all bins are counted before the levels; the forest is the same without that."""
    df = spark.range(3000).selectExpr("id", "id % 7 AS a", "id % 5 AS b", "CAST(id % 7 > 3 AND id % 5 > 1 OR id % 11 = 0 AS INT) AS y")
    edges, seen, sums = {"a": [1.0, 3.0, 4.0], "b": [1.0, 2.0]}, [], trees.histograms
    monkeypatch.setattr(trees, "histograms", lambda rows, *more: seen.append(rows.count()) or sums(rows, *more))
    fit = lambda: trees.fit_forest(df, ["a", "b"], "y", ["id"], 3, 2, edges=edges, some=1, seed=5)
    few = fit()
    assert max(seen) <= 3 * 4 * 3 * 2
    monkeypatch.setattr(trees, "FEW_CELLS", 0)
    many = fit()
    assert max(seen) > 5000 and few == many
