"""Tables stored in buckets of a key, sorted within: joins and groups by that key need no exchange."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ontime.session import shared_folder


#: Rows of a bucket, and the fewest buckets that tables are cut into.
BUCKET_ROWS, FEWEST = 1_000_000, 8


def buckets_for(*tables: DataFrame) -> int:
    """How many buckets tables that are to meet need, so that the largest has some BUCKET_ROWS rows in each: a power of
    two, so that a task's part doesn't grow with the tables."""
    most = max(t.count() for t in tables)
    return max(FEWEST, 1 << max(0, -(-most // BUCKET_ROWS) - 1).bit_length())


def write_bucketed(df: DataFrame, keys: list[str], buckets: int, name: str | None = None, path: str | None = None) -> DataFrame:
    """The table, stored as `buckets` files sorted by `keys`, and read again as a table of the catalog.

    name: of the catalog's table; one of that name is written anew, but not from its own rows (Spark raises an
    error). path: where its files lie, else a new folder that driver and executors share. Rows are dealt by the hash of
    the keys before they are written, so a bucket is one file and its order holds. Rows with null keys share a bucket;
    where these are many, leave them out: a join doesn't need them. Tables that are to meet need the same
    number of buckets and keys of equal types.
    """
    name = name or f"bucketed_{uuid.uuid4().hex[:12]}"
    if not re.fullmatch(r"\w+(\.\w+)?", name):
        raise ValueError(f"not a table's name: {name}")
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/ontime-{name}-{uuid.uuid4().hex[:12]}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").option("path", path).format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)


def drop_bucketed(spark: SparkSession, name: str) -> None:
    """Takes the table out of the catalog; its files stay where they are."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def co_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join of two tables with the same buckets: each task merges one bucket of both."""
    return left.join(right.hint("merge"), keys, how)
