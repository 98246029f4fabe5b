"""Exact dedup with a cuckoo-filter index over the digests of whole texts.

Digests are dealt to buckets by their leading bits. Each bucket holds its content (one entry
per live digest: the id that stays and how many rows share it) and a cuckoo filter over it. A
digest is first looked up in the filter; a hit is verified against the bucket's content, a
miss is inserted. When an insertion finds no free slot the filter is rebuilt at twice the size
from the bucket's stored keys. Documents can be deleted again (apply_changes): a digest lives as long as any of its
documents does, and leaves its bucket's filter with the last one.

Copies of one text, however many, are counted inside each task before they are dealt out, so
a bucket gets at most one row per digest and task.

Cases: null text counts as empty; empty texts are equal to each other and to texts that only
hold nothing (a text of white space is one space, not empty). The smallest id stays; among
rows that share text and id, or that all lack an id, one row stays. A null id never stays
while a row with an id exists. Texts of any length are hashed in the JVM and go no further. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontime.llm.common import SPACE, materialise, text_or_empty

SLOTS = 4
MAX_KICKS = 200


class CuckooFilter:
    """Partial-key cuckoo filter: 16-bit fingerprints, four slots a row, insert and delete."""

    def __init__(self, capacity: int = 64):
        rows = 1
        while rows * SLOTS * 0.9 < capacity:
            rows *= 2
        self.rows = [[] for _ in range(rows)]
        self.mask = rows - 1
        self._state = 0x2545F491

    def _place(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[-2:], "big") or 1
        first = int.from_bytes(key[8:14], "big") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, row: int, mark: int) -> int:
        return row ^ ((mark * 0x5BD1E995 >> 3) & self.mask)

    def __contains__(self, key: bytes) -> bool:
        mark, a, b = self._place(key)
        return mark in self.rows[a] or mark in self.rows[b]

    def insert(self, key: bytes) -> bool:
        """False when no slot could be freed: the filter has to grow."""
        mark, a, b = self._place(key)
        for row in (a, b):
            if len(self.rows[row]) < SLOTS:
                self.rows[row].append(mark)
                return True
        row, moved = a, []
        for _ in range(MAX_KICKS):
            self._state = (self._state * 1103515245 + 12345) & 0x7FFFFFFF
            slot = self._state % SLOTS
            moved.append((row, slot))
            self.rows[row][slot], mark = mark, self.rows[row][slot]
            row = self._other(row, mark)
            if len(self.rows[row]) < SLOTS:
                self.rows[row].append(mark)
                return True
        for row, slot in reversed(moved):  # undo, so that no fingerprint is lost
            self.rows[row][slot], mark = mark, self.rows[row][slot]
        return False

    def delete(self, key: bytes) -> bool:
        mark, a, b = self._place(key)
        for row in (a, b):
            if mark in self.rows[row]:
                self.rows[row].remove(mark)
                return True
        return False


class CuckooIndex:
    """One bucket: content by digest, with a cuckoo filter in front of it."""

    def __init__(self):
        self.content: dict[bytes, list] = {}  # digest -> [order key, number of rows]
        self.filter = CuckooFilter()
        self.resized = 0

    def find(self, digest: bytes) -> list | None:
        return self.content.get(digest) if digest in self.filter else None

    def add(self, digest: bytes, key: tuple, rows: int = 1) -> None:
        entry = self.find(digest)
        if entry is None:
            self.content[digest] = [key, rows]
            if not self.filter.insert(digest):
                self._grow()
        else:
            entry[0] = min(entry[0], key)
            entry[1] += rows

    def remove(self, digest: bytes, rows: int | None = None) -> bool:
        """Take away some rows (or all) of a live digest, which is forgotten with its last row; False
        if it isn't live."""
        entry = self.find(digest)
        if entry is None:
            return False
        entry[1] -= entry[1] if rows is None else rows
        if entry[1] > 0:
            return True
        del self.content[digest]
        return self.filter.delete(digest)

    def _grow(self) -> None:
        size = 2 * SLOTS * len(self.filter.rows)
        while True:
            self.resized += 1
            self.filter = CuckooFilter(size)
            if all(self.filter.insert(d) for d in self.content):
                return
            size *= 2


def text_sha256(name: str = "text") -> Column:
    return F.sha2(F.regexp_replace(text_or_empty(name), SPACE, " ").cast("binary"), 256)


#: An id as pandas gets it: with nulls in it a column would come as floats, which hold 53 bits.
ID = "no_id boolean, id long"


def _id(name: str) -> list[Column]:
    return [F.col(name).isNull().alias("no_id"), F.coalesce(F.col(name), F.lit(0)).cast("long").alias("id")]


def _id_or_null() -> Column:
    return F.when(~F.col("no_id"), F.col("id"))


def _combine(batches: Iterator[pd.DataFrame], keep: int = 100_000) -> Iterator[pd.DataFrame]:
    """Count copies inside a task; hands on at most `keep` digests at a time."""
    held: dict[bytes, list] = {}

    def out():
        rows = [(d, *k, n) for d, (k, n) in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["digest", "no_id", "id", "row", "n"])

    for pdf in batches:
        for d, no_id, i, r in zip(pdf["digest"], pdf["no_id"], pdf["id"], pdf["row"], strict=True):
            d, key = bytes(d), (no_id, i, r)
            entry = held.get(d)
            if entry is None:
                held[d] = [key, 1]
            else:
                entry[0] = min(entry[0], key)
                entry[1] += 1
        if len(held) >= keep:
            yield out()
    yield out()


def _index_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    index = CuckooIndex()
    for d, no_id, i, r, n in zip(pdf["digest"], pdf["no_id"], pdf["id"], pdf["row"], pdf["n"], strict=True):
        index.add(bytes(d), (no_id, i, r), int(n))
    rows = [(d, *k, n) for d, (k, n) in index.content.items()]
    return pd.DataFrame(rows, columns=["digest", "no_id", "id", "keep_row", "group_size"])


def _change_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rebuild a bucket's index from its stored keys, then delete, then insert."""
    index = CuckooIndex()
    columns = [pdf[c].tolist() for c in ("digest", "no_id", "id", "before", "gone", "added")]
    rows = [(bytes(d), (no_id, i), *n) for d, no_id, i, *n in zip(*columns, strict=True)]
    for d, key, before, _, _ in rows:
        if before:
            index.add(d, key, before)
    for d, _, _, gone, _ in rows:
        if gone:
            index.remove(d, gone)
    for d, key, _, _, added in rows:
        if added:
            index.add(d, key, added)
    return pd.DataFrame([(d, *k, n) for d, (k, n) in index.content.items()], columns=["digest", "no_id", "id", "group_size"])


def apply_changes(live: DataFrame, changes: DataFrame, bucket_rows: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(live documents, index of live digests) after deletions and then insertions.

    live: digest binary, doc_id long, n long (rows that share both). changes: digest, doc_id, op
    ('insert' or 'delete'), a row for each document. Deleting a document that isn't live does
    nothing. The first result is like live; the second has digest, keep_id (the smallest live id),
    group_size. Documents are counted by digest and id first, so a bucket gets one row per digest,
    and about bucket_rows of them, however many documents share one.
    """
    none = F.lit(0).cast("long")
    count = lambda op: F.when(F.col("op") == op, 1).otherwise(0).cast("long")
    rows = live.select("digest", "doc_id", F.col("n").cast("long").alias("n"), none.alias("minus"), none.alias("plus"))
    rows = rows.unionByName(changes.select("digest", "doc_id", none.alias("n"), count("delete").alias("minus"), count("insert").alias("plus")))
    docs = rows.groupBy("digest", "doc_id").agg(F.sum("n").alias("before"), F.sum("minus").alias("minus"), F.sum("plus").alias("added"))
    docs = docs.withColumn("gone", F.least("before", "minus"))
    docs = materialise(docs.withColumn("n", F.col("before") - F.col("gone") + F.col("added")), "dedup-documents")
    sums = [F.sum(c).alias(c) for c in ("before", "gone", "added")]
    digests = docs.groupBy("digest").agg(F.min(F.when(F.col("n") > 0, F.col("doc_id"))).alias("keep_id"), *sums)
    digests = materialise(digests, "dedup-digests")
    buckets = max(8, -(-digests.count() // bucket_rows))
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets))
    rows = digests.select("digest", *_id("keep_id"), "before", "gone", "added", bucket.alias("bucket"))
    index = rows.groupBy("bucket").applyInPandas(_change_bucket, f"digest binary, {ID}, group_size long")
    return docs.where("n > 0").select("digest", "doc_id", "n"), index.select("digest", _id_or_null().alias("keep_id"), "group_size")


def _index(keys: DataFrame, bucket_rows: int = 50_000) -> DataFrame:
    """digest, keep_id, keep_row, group_size of stored keys (doc_id, digest, row)."""
    buckets = max(8, -(-keys.count() // bucket_rows))
    counted = keys.select("digest", *_id("doc_id"), "row").mapInPandas(_combine, f"digest binary, {ID}, row long, n long")
    index = (
        counted.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandas(_index_bucket, f"digest binary, {ID}, keep_row long, group_size long")
    )
    return index.select("digest", _id_or_null().alias("keep_id"), "keep_row", "group_size")


def exact_dedup(docs: DataFrame, bucket_rows: int = 50_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs.

    bucket_rows: rows that a bucket of the index gets at most, on average.
    """
    keys = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.unhex(text_sha256()).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "dedup-keys",
    )
    index = _index(keys, bucket_rows)
    return keys.join(index, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    keyed = docs.select(
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)],
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(text_sha256()).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    stored = materialise(keyed, "dedup-docs", "zstd")
    kept = _index(stored.select("doc_id", "digest", "row")).select(F.col("keep_row").alias("row"))
    rows = stored.join(kept, "row", "left_semi")
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])

