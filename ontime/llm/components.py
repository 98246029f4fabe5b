"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontime.llm.common import drop_tables, materialise, merged


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 with links a[i]-b[i]: the smallest node of each node's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def _forests(rows: int = 1_000_000):
    """Of the links that a task reads, a forest: each node with the smallest one of its component there. rows: how many
    links are looked at together."""

    def of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v")]
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        label = forest(at[: len(ends[0])], at[len(ends[0]) :], len(nodes))
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                yield of(held)
                held = []
        if held:
            yield of(held)

    return run


def settled(edges: DataFrame) -> bool:
    """Whether every node has one link to a smaller node at most, and that one has none: stars around their smallest nodes."""
    ends = edges.select(F.inline(F.array(*[F.struct(F.col(c).alias("node"), F.lit(c == "u").cast("long").alias("up")) for c in ("u", "v")])))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return nodes.agg(F.count_if(F.expr("up > 1 OR (up = 1 AND n > 1)"))).first()[0] == 0


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the component's smallest node) for every node that has a link.

    links: a, b long. Each task first makes a forest of the links it reads, which settles what fits into one. Then
    large-star and small-star rounds: every node hands its neighbours the smallest node it knows, until only stars are
    left; a few rounds for components of any shape. Each round is a join and two aggregations whose rows stay in
    proportion to the links.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges.mapInArrow(_forests(), "u long, v long"), "links")
    for _ in range(rounds):
        if settled(edges):
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours are linked to the smallest node
        large = both.join(merged(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours, and the node itself, are linked to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(merged(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last = edges
        edges = materialise(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        drop_tables(last)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
