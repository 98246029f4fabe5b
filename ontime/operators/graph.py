"""Graphs as tables: vertices (id), edges (src, dst, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontime.functions import scalar as S
from ontime.session import stored


def flight_graph(flights: DataFrame, src: str = "ORIGIN", dst: str = "DEST", carrier: str = "OP_UNIQUE_CARRIER", delay: str = "PREV_DEP_DEL15"):
    """(vertices, edges): airports, and one edge per flight with carrier and delay."""
    edges = flights.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(carrier).alias("carrier"), F.col(delay).alias("prev_delay"))
    return nodes(edges), edges


def vertices_with_code(df: DataFrame, key: str, code: str) -> DataFrame:
    """id and its first code."""
    return df.groupBy(F.col(key).alias("id")).agg(F.min(code).alias("code"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("inDegree"))


def route_delay(edges: DataFrame) -> DataFrame:
    """src, dst, carrier, avg_prev_delay_carrier."""
    return edges.groupBy("src", "dst", "carrier").agg(F.avg("prev_delay").alias("avg_prev_delay_carrier"))


def mean_in_degree(df: DataFrame, origin: str, degree: str = "inDegree") -> DataFrame:
    return df.groupBy(origin).agg(F.avg(degree).alias("mean_in_degree")).orderBy(F.desc("mean_in_degree"), origin)


def edges_of_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """src, dst, n from lines 'node TAB {dest: count, ...}'; a node without targets gives one row with
    null dst."""
    part = F.split(column, "\t")
    rows = lines.select(part[0].alias("src"), S.text_map(F.get(part, F.lit(1))).alias("m"))
    return rows.select("src", F.explode_outer("m").alias("dst", "n"))


def title_index(lines: DataFrame, column: str = "value") -> DataFrame:
    """title, id, in_degree, out_degree from tab-separated lines."""
    part = F.split(column, "\t")
    item = lambda i, kind: F.get(part, F.lit(i)).try_cast(kind)
    return lines.select(item(0, "string").alias("title"), item(1, "string").alias("id"), item(2, "int").alias("in_degree"), item(3, "int").alias("out_degree"))


def out_degrees(edges: DataFrame) -> DataFrame:
    """id, degree: distinct targets; nodes without any have none here."""
    return edges.where("dst IS NOT NULL").groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("degree"))


def degree_stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, those with targets, dangling ones, mean degree of those with targets."""
    d = out_degrees(edges).agg(F.count("*").alias("n_with_targets"), F.avg("degree").alias("mean_degree"))
    n = nodes(edges).where("id IS NOT NULL").agg(F.count("*").alias("n_nodes"))
    return n.crossJoin(d).select("n_nodes", "n_with_targets", (F.col("n_nodes") - F.col("n_with_targets")).alias("n_dangling"), "mean_degree")


def dangling(edges: DataFrame) -> DataFrame:
    """Nodes that are the source of no edge. One aggregation by node over the edges' ends, which combines before the shuffle."""
    ends = F.inline(F.array(F.struct(F.col("src").alias("id"), F.col("dst").isNotNull().alias("_out")), F.struct(F.col("dst").alias("id"), F.lit(False).alias("_out"))))
    return edges.select(ends).where("id IS NOT NULL").groupBy("id").agg(F.bool_or("_out").alias("_out")).where("NOT _out").select("id")


def adjacency(edges: DataFrame) -> DataFrame:
    """src, targets: sorted distinct targets."""
    return edges.where("dst IS NOT NULL").groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("targets"))


def top(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), F.asc(tie)).limit(k)


def random_rows(df: DataFrame, k: int, seed: int, key: list[str]) -> DataFrame:
    """k rows in an order by a hash of their key: reruns agree however the rows are dealt out."""
    return df.orderBy(S.uniform(seed, *[F.col(c) for c in key]), *key).limit(k)


def pagerank(edges: DataFrame, alpha: float = 0.15, rounds: int = 10) -> DataFrame:
    """id, rank after `rounds` rounds of alpha / N + (1 - alpha) * (dangling mass / N + what comes in).

    Edges count by `n` where there is such a column. The sum of ranks stays 1. Each round is one
    join on the node and one aggregation. Ranks are used twice in a round, so plans would double:
    each round's ranks are stored.
    """
    many = F.col("n").cast("double") if "n" in edges.columns else F.lit(1.0)
    e = edges.where("dst IS NOT NULL").groupBy("src", "dst").agg(F.sum(many).alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("total"))
    e = stored(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("w")))
    base = nodes(edges).where("id IS NOT NULL").join(out.select(F.col("src").alias("id"), F.lit(False).alias("dangling")), "id", "left")
    base = stored(base.select("id", F.coalesce("dangling", F.lit(True)).alias("dangling")))
    n = base.count()
    ranks = base.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(1, rounds + 1):
        mass = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("mass"))
        moved = e.join(ranks, e["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("w") * F.col("rank")).alias("got"))
        new = base.join(moved, base["id"] == moved["dst"], "left").crossJoin(F.broadcast(mass))
        rank = F.lit(alpha / max(n, 1)) + (1 - alpha) * (F.col("mass") / n + F.coalesce("got", F.lit(0.0)))
        ranks = new.select("id", "dangling", rank.alias("rank"))
        if i < rounds:
            ranks = stored(ranks)
    return ranks.select("id", "rank")


def weights(edges: DataFrame) -> DataFrame:
    """src, dst, w: each node's distinct edges with their share of what leaves it; `n` counts where it is there."""
    many = F.col("n").cast("double") if "n" in edges.columns else F.lit(1.0)
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.sum(many).alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("total"))
    return e.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("w"))


def pagerank_converged(edges: DataFrame, alpha: float = 0.15, tolerance: float = 1e-10, most: int = 500) -> tuple[DataFrame, int]:
    """(id, rank where pagerank's rounds lead to, the number of rounds): only what changed is passed on.

    What a node got and has not passed on waits as its residual; a round passes on the residuals of the active nodes,
    those above a limit, so a round's join has the edges of these alone. It stops when the residuals' sum shows that
    the L1 distance to the limit is below `tolerance`; after `most` rounds without that it raises an error.

    The mass of dangling nodes goes to all nodes alike, as the jumps do, so it scales all ranks by one factor: rounds
    leave it out, and the ranks are brought to the sum 1 at the end. It so leaves at once instead of going round.
    alpha must be above 0. No edges give no ranks. Edge weights must not be negative.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    e = stored(weights(edges))
    state = stored(nodes(edges).where("id IS NOT NULL").select("id", F.lit(0.0).alias("x"), F.lit(1.0).alias("res")))
    n = state.count()
    if n == 0:
        return state.select("id", F.col("x").alias("rank")), 0
    # all of x is at least 1 a node, a waiting residual adds at most 1 / alpha times itself, scaling doubles the distance
    least = tolerance * alpha / 4
    active = F.col("res") > least
    for done in range(most + 1):
        waiting = state.agg(F.sum("res")).first()[0]
        if waiting <= 2 * least * n:
            total = state.agg(F.sum("x")).first()[0]
            return state.select("id", (F.col("x") / F.lit(total)).alias("rank")), done
        moved = e.join(state.where(active).select(F.col("id").alias("src"), "res"), "src").groupBy("dst").agg(F.sum(F.col("w") * F.col("res")).alias("got"))
        new = state.join(moved.withColumnRenamed("dst", "id"), "id", "left")
        got = F.lit(1 - alpha) * F.coalesce("got", F.lit(0.0))
        state = stored(new.select("id", F.when(active, F.col("x") + F.col("res")).otherwise(F.col("x")).alias("x"), F.when(active, got).otherwise(F.col("res") + got).alias("res")))
    raise RuntimeError(f"the ranks have not converged after {most} rounds")


def named(scores: DataFrame, names: DataFrame, key: str = "id", by: str = "rank", k: int = 20) -> DataFrame:
    """The k best with their names, best first."""
    return top(scores, by, k, key).join(names, key).orderBy(F.desc(by), key)


def union_features(lists: list[DataFrame]) -> DataFrame:
    """All features that any of the lists has."""
    return reduce(lambda a, b: a.union(b), lists).distinct()
