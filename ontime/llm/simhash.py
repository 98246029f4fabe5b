"""SimHash near-dedup with pivot distance tables.

A document's fingerprint has a bit for each majority among the hashes of its three-word
shingles. Documents link when their fingerprints differ in few bits. Only distinct fingerprints
are compared: copies share one, however many they are.

For each distinct fingerprint its Hamming distances to many reference fingerprints (pivots) are
computed once. By the triangle inequality two fingerprints within `bits` of each other can't
differ by more than `bits` in any of these coordinates, so pairs are discarded by their largest
coordinate difference before the bits themselves are compared. Pairs come from bands: with
`bits` differing bits over `blocks` blocks, at least blocks - bits blocks are equal, so every
link shows up under one of the choices of that many blocks. A band's fingerprints are sorted by
their first pivot distance, and each meets only those within `bits` of it there.

A band with more than `cap` fingerprints is dealt out in tiles: each part of it meets each
other part in a task of its own, so no task holds more than two parts and no link is lost.
Tasks hand on one link per fingerprint at most (a forest of what they linked), never all pairs.

Cases: null and empty texts have fingerprint zero and link like any other; shorter texts than
three words have one shingle, all their words. Rows with a null id get a component like others,
named by the smallest id in it, or null if there is none. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontime.llm import jaccard
from ontime.llm.common import materialise, merged, text_chunks
from ontime.llm.components import components, forest

BITS = 3
PIVOTS = [int(x) for x in np.random.default_rng(64).integers(0, 2**63, 16, dtype=np.int64)]


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six white characters
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words]).tolist()
    ends = ends.tolist()
    width = min(3, len(words))
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(joined[s:e], 42) for s, e in zip(starts, ends[width - 1 :])], dtype=np.uint64)  # noqa: B905
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        votes += np.unpackbits(hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches):
        prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (64 bits as a long)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(prints: DataFrame) -> DataFrame:
    """Adds near and far: sixteen pivot distances, a byte each."""
    distance = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long") for p in PIVOTS]

    def packed(cols: list[Column]) -> Column:
        out = cols[0]
        for i, c in enumerate(cols[1:], 1):
            out = out.bitwiseOR(F.shiftleft(c, 8 * i))
        return out

    return prints.withColumn("near", packed(distance[:8])).withColumn("far", packed(distance[8:]))


def bands(blocks: int, bits: int) -> list[int]:
    """Masks of all choices of blocks that leave out `bits` of them."""
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    masks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]  # noqa: B905
    return [sum(c) for c in combinations(masks, blocks - bits)]


def _link_sorted(pdf: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Links among rows of whole groups (equal band, key and tile); one per fingerprint at most."""
    pivot = np.concatenate([pdf[c].to_numpy(np.int64).view(np.uint8).reshape(-1, 8) for c in ("near", "far")], axis=1).astype(np.int8)
    group = pdf.groupby(["band", "key", "tile"], sort=False).ngroup().to_numpy()
    order = np.lexsort((pivot[:, 0], group))
    pivot, group = pivot[order], group[order]
    fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)[order]
    part = pdf["part"].to_numpy(np.int64)[order]
    label = np.arange(len(fp))
    at, lag = np.arange(len(fp) - 1), 1
    found_a, found_b, held = [], [], 0
    while len(at):
        at = at[at + lag < len(fp)]
        other = at + lag
        go = (group[at] == group[other]) & (pivot[other, 0] - pivot[at, 0] <= bits)
        at, other = at[go], other[go]  # sorted: who fails here fails at every larger lag
        if len(at):
            close = np.abs(pivot[at] - pivot[other]).max(axis=1) <= bits
            a, b = at[close], other[close]
            # a tile of two parts leaves pairs inside a part to that part's own tile
            mine = (part[a] != part[b]) | (part[a] < 0)
            a, b = a[mine], b[mine]
            linked = np.bitwise_count(fp[a] ^ fp[b]) <= bits
            found_a.append(a[linked])
            found_b.append(b[linked])
            held += int(linked.sum())
            if held > 1_000_000:
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                label = forest(np.concatenate([a, np.arange(len(fp))]), np.concatenate([b, label]), len(fp))
                found_a, found_b, held = [], [], 0
        lag += 1
    none = np.zeros(0, dtype=np.int64)
    a, b = np.concatenate([none, *found_a]), np.concatenate([none, *found_b])
    label = forest(np.concatenate([a, np.arange(len(fp))]), np.concatenate([b, label]), len(fp))
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return pd.DataFrame({"a": fp[moved].view(np.int64), "b": fp[label[moved]].view(np.int64)})


def _link_partition(bits: int, rows: int = 50_000):
    """Links over a partition sorted by band, key and tile, whole groups at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if pdf.empty:
                continue
            held.append(pdf)
            if sum(map(len, held)) < rows:
                continue
            whole = pd.concat(held, ignore_index=True)
            last = whole.iloc[-1]
            open_group = (whole["band"] == last["band"]) & (whole["key"] == last["key"]) & (whole["tile"] == last["tile"])
            if not open_group.all():
                yield _link_sorted(whole[~open_group], bits)
            held = [whole[open_group]]
        if held:
            yield _link_sorted(pd.concat(held, ignore_index=True), bits)

    return run


def links(prints: DataFrame, bits: int = BITS, cap: int = 4096, blocks: int | None = None) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp), a forest of every task's pairs."""
    if blocks is None:  # longer keys for more fingerprints; each choice finds every link
        blocks = bits + 2 if prints.count() < 1 << 27 else bits + 3
    rows = pivot_table(prints.select("fp").distinct())
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(bands(blocks, bits))])
    banded = rows.withColumn("_b", F.explode(keys)).select("_b.band", "_b.key", "fp", "near", "far")
    sizes = banded.groupBy("band", "key").count().where("count > 1")
    banded = banded.join(sizes, ["band", "key"])
    parts = F.ceil(F.col("count") / F.lit(cap)).cast("int")
    small = banded.where(F.col("count") <= cap).select("band", "key", F.lit(0).alias("tile"), F.lit(-1).alias("part"), "fp", "near", "far")
    large = banded.where(F.col("count") > cap).withColumn("n", parts)
    large = large.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    # tile (i, j), i <= j, meets part i with part j; tile (i, i) is part i alone
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    large = large.select(
        "band", "key", (F.lit(1) + low * F.col("n") + high).alias("tile"),
        F.when(low == high, F.lit(-1)).otherwise(F.col("part")).alias("part"), "fp", "near", "far",
    )
    together = small.unionByName(large).repartition("band", "key", "tile").sortWithinPartitions("band", "key", "tile")
    return together.mapInPandas(_link_partition(bits), "a long, b long")


def near_dedup(docs: DataFrame, bits: int = BITS, cap: int = 4096, blocks: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each row of docs."""
    rows = materialise(fingerprints(docs), "fingerprints")
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    linked = components(links(prints, bits, cap, blocks))
    roots = prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    names = materialise(roots.join(ids, "root").select("fp", "component_id"), "near-components")
    return rows.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def close_sets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """a, b (a < b): each set of shingles with the smallest of its SimHash component. rows: doc_id, set of every row."""
    near = near_dedup(docs).select("doc_id", "component_id").dropDuplicates(["doc_id"])
    ids = rows.groupBy("doc_id").agg(F.min("set").alias("set"))
    here = ids.join(merged(near), ids["doc_id"].eqNullSafe(near["doc_id"])).select("component_id", "set").distinct()
    least = here.groupBy("component_id").agg(F.min("set").alias("a"))
    pairs = here.join(merged(least), here["component_id"].eqNullSafe(least["component_id"])).where("a < set")
    return materialise(pairs.select("a", F.col("set").alias("b")).distinct(), "close-sets")


def keep_one(docs: DataFrame, width: int = jaccard.WIDTH, similarity: float = jaccard.SIMILARITY) -> DataFrame:
    """The document with the smallest id of each group of near copies, all columns kept.

    Fingerprints come first: what bands and pivot distances link (near_dedup) is checked by the Jaccard similarity of the
    texts' `width`-word shingles, and stands where that holds. Fingerprints of three words and few bits leave most near
    copies apart, so sets that are still in different groups then meet by jaccard, which finds every pair as similar.
    A group without any id keeps its rows: nothing tells them apart. Rows that share id and text with the one that
    stays are copies of it; exact dedup removes them.
    """
    groups = jaccard.near_groups(docs, width, similarity, lambda rows: close_sets(docs, rows))
    stays = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    stays = stays.withColumnRenamed("doc_id", "_stays")
    return docs.join(stays, docs["doc_id"].cast("long").eqNullSafe(F.col("_stays")), "left_semi")
