"""Merkle manifest of a dataset by nested-interval labels: expressions and joins only.

Every row is a leaf; per source the leaves, in the order of their ids, have ranks 0, 1, ... A node
is labelled with the interval [lo, hi) of the ranks that it covers, so

- a run of `fan` nodes of a level is what has the same bucket, lo div fan^level;
- an ancestor is found by containment: the node of its level, in that bucket, whose interval
  holds the node's own. Going down from the top, every level joins the one above, so a node meets
  one parent and a parent `fan` children at most, however large the source;
- the siblings are the intervals of the parent's children other than the node's own: those that
  end before it begins stand left of it, those that begin after its end stand right.

The topmost nodes of the sources are the leaves of a tree of the same kind, over all sources. What a
row needs to prove that it belongs to the dataset is the list of its siblings, level by level,
kept as `path`: folding a leaf with it gives the root.

Ranks come from a table sorted over all tasks: a task counts its rows by source, and sums of the
counts of the tasks before it (a row per task and source) give where its rows begin. No source
has to fit into a task, and digests travel instead of texts.

Cases: a null is a field of its own, unlike an empty text. Null ids come first in their source,
rows with equal ids in the order of their digests; equal rows are leaves of their own, with the
siblings of their place. The null source comes before all others. A source of one row has that
row's leaf as its top; a dataset of one row has no siblings at all. An empty table gives an empty
result. Other columns are ignored; texts of any length are digested where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontime.llm.common import drop_tables, materialise

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One row per task and source: up to so many are sent to all.
FEW = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """'-' for null, else the number of UTF-8 bytes, ':' and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: tuple[str, ...] = FIELDS, **instead: Column) -> Column:
    """The digest of a row; instead: other values for some fields."""
    return digest(*[field(instead.get(c, F.col(c))) for c in fields])


def lower_every_fifth(text: str = "text", doc_id: str = "doc_id") -> Column:
    """The text with A-Z lower-cased where 5 divides crc32 of the id, else as it is."""
    hit = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate(F.col(text), _UPPER, _LOWER)).otherwise(F.col(text))


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds lo, the rank of each row in its tree, and size, the tree's number of rows.

    Wholly equal rows may be many, so rows are also dealt out by their place in the input.
    """
    spark = rows.sparkSession
    rows = materialise(rows.withColumn("_any", F.monotonically_increasing_id()), "leaves")
    by = [F.asc_nulls_first(c) for c in (tree, *order, "_any")]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed, "sorted-leaves")
    task = F.shiftright("_at", 33)
    tallies = placed.groupBy(F.col(tree).alias("_t"), task.alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("_t")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialise(tallies.select("_t", "_p", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size")), "starts")
    few = starts.count() <= FEW
    joined = placed.join(F.broadcast(starts) if few else starts, F.col(tree).eqNullSafe(F.col("_t")) & (task == F.col("_p")))
    out = materialise(joined.withColumn("lo", F.col("_at") + F.col("_shift")).drop("_any", "_at", "_t", "_p", "_shift"), "ranked")
    drop_tables(rows, placed, starts)
    return out.select(*[F.col(c) for c in out.columns])


def _bucket(level: int, fan: int) -> Column:
    return F.expr(f"lo div {fan**level}")


def levels(leaves: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """Nodes of each level above the leaves: tree, size (leaves of its tree), lo, hi, digest, children.

    leaves: tree, lo, size, digest, item. Level by level the nodes of a bucket become one, for trees that
    still have more than one. A tree of one leaf has, in the first level, that leaf itself.
    """
    hi = F.col("lo") + 1
    below = leaves.withColumn("hi", hi)
    out: list[DataFrame] = []
    level = 1
    while True:
        child = ["lo", "hi", "digest", *(["item"] if level == 1 else [])]
        runs = below.groupBy("tree", "size", _bucket(level, fan).alias("_b")).agg(F.array_sort(F.collect_list(F.struct(*child))).alias("children"))
        joined = F.array_join(F.transform("children", lambda c: c["digest"]), "")
        own = F.when(F.col("size") == 1, F.col("children")[0]["digest"]).otherwise(F.sha2(joined, 256))
        ends = F.array_max(F.transform("children", lambda c: c["hi"]))
        nodes = runs.select("tree", "size", F.col("children")[0]["lo"].alias("lo"), ends.alias("hi"), own.alias("digest"), "children")
        out.append(materialise(nodes, f"nodes-{level}"))
        below = out[-1].where(F.col("size") > fan**level).select("tree", "size", "lo", "hi", "digest")
        if below.isEmpty():
            return out
        level += 1


def _sibling_pair(children: Column, lo: Column, hi: Column) -> Column:
    """left and right: digests of the parent's other children, by their intervals."""
    text = lambda keep: F.array_join(F.transform(F.filter(children, keep), lambda c: c["digest"]), "")
    return F.struct(text(lambda c: c["hi"] <= lo).alias("left"), text(lambda c: c["lo"] >= hi).alias("right"))


_PATH = "array<struct<left:string,right:string>>"


def attach(nodes: list[DataFrame], above: DataFrame | None = None, fan: int = FAN) -> DataFrame:
    """tree, digest (the leaf), item, top (its tree's topmost digest), path, and above's columns: one row per leaf.

    nodes: as levels() gives them. above: tree, path_up and more for each tree, whose path follows the top's.
    """
    more = [c for c in above.columns if c not in ("tree", "path_up")] if above is not None else []
    upper: DataFrame | None = None
    for level in range(len(nodes), 0, -1):
        here = nodes[level - 1]
        tops = here.where(F.col("size") <= fan**level).withColumn("top", F.col("digest"))
        if above is None:
            tops = tops.withColumn("path", F.expr(f"CAST(array() AS {_PATH})"))
        else:
            same = tops["tree"].eqNullSafe(above["tree"])
            tops = tops.join(above, same).drop(above["tree"]).withColumnRenamed("path_up", "path")
        columns = ["tree", "size", "lo", "hi", "digest", "children", "top", "path", *more]
        placed = tops.select(*columns)
        if upper is not None:
            p = upper.select(F.col("tree").alias("_tree"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("children").alias("_kin"),
                             "top", F.col("path").alias("_path"), *more, F.expr(f"lo div {fan ** (level + 1)}").alias("_b"))
            below = here.where(F.col("size") > fan**level)
            holds = (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
            met = below.join(p, F.col("tree").eqNullSafe(F.col("_tree")) & (_bucket(level + 1, fan) == F.col("_b")) & holds)
            path = F.concat(F.array(_sibling_pair(F.col("_kin"), F.col("lo"), F.col("hi"))), F.col("_path"))
            placed = placed.unionByName(met.withColumn("path", path).select(*columns))
        upper = materialise(placed, f"paths-{level}") if level > 1 else placed
    at = F.expr("filter(children, c -> true)")
    each = upper.select("tree", "size", "top", "path", *more, "children", F.explode(at).alias("_c"))
    own = F.array(_sibling_pair(F.col("children"), F.col("_c.lo"), F.col("_c.hi")))
    path = F.when(F.col("size") == 1, F.col("path")).otherwise(F.concat(own, F.col("path")))
    return each.select("tree", F.col("_c.digest").alias("digest"), F.col("_c.item").alias("item"), "top", path.alias("path"), *more)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


def proof(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.aggregate(path, F.lit(""), lambda acc, p: F.concat(acc, p["left"], p["right"])), 256)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "source", order: str = "doc_id", fan: int = FAN, seen: Column | None = None) -> DataFrame:
    """One row per row of docs: order's column, `tree`, leaf, subroot, root, path (siblings level by level).

    seen: a digest to be checked against the manifest, of another state of the row; kept as `seen`.
    """
    item = F.struct(F.col(order).alias("id"), (leaf(fields) if seen is None else seen).alias("seen"))
    leaves = docs.select(F.col(tree).cast("string").alias("tree"), F.col(order).alias("_id"), leaf(fields).alias("digest"), item.alias("item"))
    leaves = ranked(leaves, "tree", ["_id", "digest"])
    nodes = levels(leaves.drop("_id"), fan)
    tops = None
    for level, here in enumerate(nodes, 1):
        top = here.where(F.col("size") <= fan**level).select("tree", "digest")
        tops = top if tops is None else tops.unionByName(top)
    sources = tops.select(F.lit("").alias("tree"), F.col("tree").alias("item"), "digest")
    sources = ranked(sources, "tree", ["item"])
    above = attach(levels(sources, fan), None, fan).select(F.col("item").alias("tree"), F.col("path").alias("path_up"), F.col("top").alias("root"))
    above = materialise(above, "sources")
    rows = attach(nodes, above, fan)
    return rows.select(F.col("item.id").alias(order), F.col("tree").alias(tree), F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", "path", F.col("item.seen").alias("seen"))


def verify(rows: DataFrame) -> DataFrame:
    """Adds proof_sha256, folded_root (of `seen` with the manifest's siblings) and verified."""
    rows = rows.withColumns({"proof_sha256": proof(F.col("path")), "folded_root": fold(F.col("seen"), F.col("path"))})
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: the manifest of docs, and every row,
    some of them tampered with, held against it."""
    rows = verify(manifest(docs, seen=leaf(text=lower_every_fifth())))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
