"""Forests and boosted trees grown level by level: each level is one aggregation of histograms.

Features are cut into bins once. For every level the rows' statistics are summed by tree, node, feature
and bin, before the shuffle already, and what reaches the driver is bounded by the settings: nodes times
features times bins (for a forest, times trees). The best split of each node is found from running sums over the bins; where a row
stands is an expression over its bins, so no table is rewritten between levels.

Forests draw their rows by a Poisson count from a hash of the row's key and the tree's number, and
features by a hash of tree and node: reruns agree however rows are dealt out. Boosted trees use gradient
and hessian of the log loss, or of squares, with penalties on the leaves: L1 (alpha), L2 (lambda),
least gain of a split (gamma) and least hessian of a child.

Cases: a null value of a feature is in the lowest bin, with the smallest values. Rows with a null label are
left out of the fit. A table without rows, or with one class, gives trees of one leaf. Equal gains go to
the feature named first and the lowest bin; gains are compared to ten digits, so the order of
summation decides nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontime.functions import scalar as S
from ontime.session import stored

DIGITS = 10
#: Combinations of bins up to which a forest's rows are counted by combination before its levels read them.
FEW_CELLS = 100_000


@dataclass
class Split:
    feature: str
    bin: int  # rows whose bin is at most this go left
    gain: float


@dataclass
class Tree:
    """Nodes are numbered from 1; the children of n are 2n and 2n + 1."""

    splits: dict[int, Split] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)


@dataclass
class Trees:
    """A fitted model: edges of the bins, trees, and how their leaves add up."""

    features: list[str]
    edges: dict[str, list[float]]
    trees: list[Tree]
    base: float
    kind: str  # forest, logistic or squares

    def score(self) -> Column:
        """Probability of the label 1, or the number (squares)."""
        left = lambda s: F.coalesce(F.col(s.feature) <= F.lit(self.edges[s.feature][s.bin]), F.lit(True))
        total = reduce(lambda a, b: a + b, [place(t, left, lambda n, t=t: t.leaves[n]) for t in self.trees], F.lit(self.base))
        return total / F.lit(float(len(self.trees))) if self.kind == "forest" else S.sigmoid(total) if self.kind == "logistic" else total

    def transform(self, df: DataFrame, name: str = "probability", threshold: float = 0.5) -> DataFrame:
        """Adds the score, and for classes the prediction 0 or 1."""
        out = df.withColumn(name, self.score())
        return out if self.kind == "squares" else out.withColumn("prediction", (F.col(name) >= threshold).cast("int"))

    def importance(self, spark: SparkSession) -> DataFrame:
        """feature, importance: its share of all splits' gains, the largest first."""
        gains = dict.fromkeys(self.features, 0.0)
        for t in self.trees:
            for s in t.splits.values():
                gains[s.feature] += s.gain
        whole = sum(gains.values()) or 1.0
        rows = sorted(((c, g / whole) for c, g in gains.items()), key=lambda x: (-x[1], x[0]))
        return spark.createDataFrame(rows, "feature string, importance double")

    def table(self, spark: SparkSession) -> DataFrame:
        """tree, node, feature, bin, gain (null for leaves), value (null for splits)."""
        rows = []
        for i, t in enumerate(self.trees):
            rows += [(i, n, s.feature, s.bin, float(s.gain), None) for n, s in t.splits.items()]
            rows += [(i, n, None, None, None, float(v)) for n, v in t.leaves.items()]
        return spark.createDataFrame(rows, "tree int, node int, feature string, bin int, gain double, value double")


def bin_edges(df: DataFrame, features: list[str], bins: int = 32) -> dict[str, list[float]]:
    """Upper edges of all bins but the last, from quantile sketches in one aggregation."""
    points = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), points, 100 * bins).alias(c) for c in features]).first()
    return {c: sorted(set(row[c] or [])) for c in features}


def bin_of(value: Column, edges: list[float]) -> Column:
    """The number of edges below the value; 0 for null."""
    if not edges:
        return F.lit(0)
    return F.coalesce(reduce(lambda a, b: a + b, [(value > F.lit(e)).cast("int") for e in edges]), F.lit(0))


def place(tree: Tree, left: Callable[[Split], Column], at: Callable[[int], float]) -> Column:
    """What `at` says of the node that a row comes to: a leaf, or one of the open level."""

    def below(n: int) -> Column:
        s = tree.splits.get(n)
        return F.lit(at(n)) if s is None else F.when(left(s), below(2 * n)).otherwise(below(2 * n + 1))

    return below(1)


def _binned_left(s: Split) -> Column:
    return F.col(f"_bin_{s.feature}") <= s.bin


def histograms(rows: DataFrame, features: list[str], width: int) -> dict[tuple[int, int], np.ndarray]:
    """Sums of _a and _b by tree and node, as an array of features x bins x 2. rows: _tree, _node, _a, _b, a bin per feature."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"_bin_{c}").alias("b")) for i, c in enumerate(features)]))
    sums = rows.select("_tree", "_node", "_a", "_b", each.alias("_x")).groupBy("_tree", "_node", "_x.f", "_x.b").agg(F.sum("_a").alias("a"), F.sum("_b").alias("b"))
    out: dict[tuple[int, int], np.ndarray] = {}
    for tree, node, f, b, a, h in sums.toLocalIterator():  # trees x nodes x features x bins at most
        out.setdefault((tree, node), np.zeros((len(features), width, 2)))[f, b] = a, h
    return out


def best_split(cells: np.ndarray, allowed: list[int], gain: Callable, least: float) -> tuple[int, int, float] | None:
    """(feature, bin, gain) of the greatest gain above zero, from features x bins x (a, b)."""
    best = None
    for f in allowed:
        left = np.cumsum(cells[f], axis=0)[:-1]
        whole = cells[f].sum(axis=0)
        right = whole - left
        ok = (left[:, 1] >= least) & (right[:, 1] >= least) & (left[:, 1] > 0) & (right[:, 1] > 0)
        for b in np.flatnonzero(ok):
            g = round(float(gain(left[b], right[b], whole)), DIGITS)
            if g > 0 and (best is None or g > best[2]):
                best = f, int(b), g
    return best


def unit(*parts) -> float:
    """functions.scalar.uniform for numbers that the driver knows."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / float(1 << 52)


def chosen(features: list[str], some: int, *key) -> list[int]:
    """`some` features for a key, those with the least hashes."""
    order = sorted(range(len(features)), key=lambda i: (unit(*key, features[i]), i))
    return sorted(order[:some])


def poisson(u: Column, most: int = 8) -> Column:
    """A count with mean 1 from a uniform number."""
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(most)])
    return reduce(lambda a, b: a + b, [(u >= F.lit(float(p))).cast("int") for p in below])


def _grow(trees: list[Tree], level_rows: Callable[[int], DataFrame], features: list[str], width: int, depth: int, pick: Callable, leaf: Callable) -> None:
    """Adds splits and leaves to the trees, a level of all of them with each aggregation."""
    open_ = {(t, 1) for t in range(len(trees))}
    for level in range(depth + 1):
        cells = histograms(level_rows(level), features, width) if open_ else {}
        following = set()
        for t, n in sorted(open_):
            found = cells.get((t, n), np.zeros((len(features), width, 2)))
            split = pick(t, n, found) if level < depth else None
            if split is None:
                trees[t].leaves[n] = float(leaf(found[0].sum(axis=0)))
            else:
                trees[t].splits[n] = Split(features[split[0]], split[1], split[2])
                following |= {(t, 2 * n), (t, 2 * n + 1)}
        open_ = following


def _prepared(df: DataFrame, features: list[str], label: str, edges: dict[str, list[float]], more: list[Column] = ()) -> DataFrame:
    """Bins and label of the rows that have one, stored: all levels of all trees read this."""
    bins = [bin_of(F.col(c).cast("double"), edges[c]).alias(f"_bin_{c}") for c in features]
    return stored(df.where(F.col(label).isNotNull()).select(*bins, F.col(label).cast("double").alias("_y"), *more))


def fit_forest(df: DataFrame, features: list[str], label: str, key: list[str], trees: int = 20, depth: int = 5, bins: int = 32,
               edges: dict[str, list[float]] | None = None, some: int | None = None, least: float = 1.0, seed: int = 1) -> Trees:
    """A forest of classifiers by Gini impurity. key: columns that name a row; some: features tried at each node (default:
    the square root of their number); least: rows of a child."""
    edges = edges or bin_edges(df, features, bins)
    base = _prepared(df, features, label, edges, [F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]).alias("_key")])
    out = [Tree() for _ in range(trees)]
    some = some or max(1, round(math.sqrt(len(features))))
    width = 1 + max(map(len, edges.values()))
    # each row's counts are drawn once; a generator's output is a column, so its hash isn't computed for each step of the count
    draws = base.select("*", F.posexplode(F.array(*[S.uniform(seed, F.col("_key"), F.lit(t)) for t in range(trees)])).alias("_tree", "_u"))
    bins_of = [f"_bin_{c}" for c in features]
    drawn = draws.select(*bins_of, "_y", "_tree", poisson(F.col("_u")).alias("_w")).where("_w > 0")
    if math.prod(len(edges[c]) + 1 for c in features) <= FEW_CELLS:  # rows that share all bins and the label stand together
        drawn = stored(drawn.groupBy(*bins_of, "_y", "_tree").agg(F.sum("_w").alias("_w")))

    def rows(level: int) -> DataFrame:
        node = reduce(lambda a, t: F.when(F.col("_tree") == t, place(out[t], _binned_left, int)).otherwise(a), range(trees), F.lit(0))
        r = drawn.withColumns({"_node": node, "_a": F.col("_w") * F.col("_y"), "_b": F.col("_w").cast("double")})
        return r.where(F.col("_node") >= 2**level)  # leaves of levels before are done

    def gain(left, right, whole):
        gini = lambda x: 2 * x[0] / x[1] * (1 - x[0] / x[1]) if x[1] else 0.0
        return gini(whole) - left[1] / whole[1] * gini(left) - right[1] / whole[1] * gini(right)

    weight = [1.0] * trees  # rows of each tree, so that a split's gain counts by how many it splits

    def pick(t: int, n: int, cells: np.ndarray):
        here = cells[0, :, 1].sum()
        if n == 1:
            weight[t] = here or 1.0
        found = best_split(cells, chosen(features, some, seed, t, n), gain, least)
        return found and (found[0], found[1], round(float(found[2] * here / weight[t]), DIGITS))

    _grow(out, rows, features, width, depth, pick, lambda s: s[0] / s[1] if s[1] else 0.0)
    return Trees(features, edges, out, 0.0, "forest")


def fit_boosted(df: DataFrame, features: list[str], label: str, rounds: int = 20, depth: int = 4, rate: float = 0.1, gamma: float = 0.0,
                alpha: float = 0.0, lam: float = 1.0, positive_weight: float = 1.0, least_hessian: float = 1.0, share: float = 1.0,
                bins: int = 32, edges: dict[str, list[float]] | None = None, seed: int = 1, squares: bool = False) -> Trees:
    """Boosted trees with penalties on the leaves. share: of features for each tree, chosen by a hash; positive_weight:
    of rows with the label 1; squares: fit numbers instead of classes.

    A leaf's value is -T(G) / (H + lam) * rate, where T moves the sum of gradients towards zero by alpha.
    """
    edges = edges or bin_edges(df, features, bins)
    base = _prepared(df, features, label, edges)
    start = 0.5 if squares else 0.0
    width = 1 + max(map(len, edges.values()))
    done: list[Tree] = []
    shrink = lambda g: np.sign(g) * max(abs(g) - alpha, 0.0)
    part = lambda x: shrink(x[0]) ** 2 / (x[1] + lam) if x[1] + lam > 0 else 0.0
    gain = lambda left, right, whole: (part(left) + part(right) - part(whole)) / 2 - gamma
    value = lambda s: -rate * shrink(s[0]) / (s[1] + lam) if s[1] + lam > 0 else 0.0
    margin = F.lit(start)
    for k in range(rounds):
        allowed = chosen(features, max(1, round(share * len(features))), seed, "tree", k)
        tree = [Tree()]
        w = F.when(F.col("_y") == 1, F.lit(positive_weight)).otherwise(1.0)
        p = margin if squares else S.sigmoid(margin)
        stats = base.withColumns({"_tree": F.lit(0), "_a": w * (p - F.col("_y")), "_b": w * (F.lit(1.0) if squares else p * (1 - p))})

        def rows(level: int, stats=stats, tree=tree) -> DataFrame:
            return stats.withColumn("_node", place(tree[0], _binned_left, int)).where(F.col("_node") >= 2**level)

        _grow(tree, rows, features, width, depth, lambda t, n, cells, allowed=allowed: best_split(cells, allowed, gain, least_hessian), value)
        done += tree
        # the sum so far is a column of a stored table, so plans don't grow with the rounds
        base = base.withColumn("_margin", margin + place(tree[0], _binned_left, lambda n, tree=tree: tree[0].leaves[n]))
        if k % 10 == 9:
            base = stored(base)
        margin = F.col("_margin")
    return Trees(features, edges, done, start, "squares" if squares else "logistic")
