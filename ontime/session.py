"""A session with the settings the library counts on."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "ontime", master: str | None = None, **conf) -> SparkSession:
    """UTC, adaptive execution with skew joins; ANSI mode stays as Spark has it (on)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()


def stored(df: DataFrame) -> DataFrame:
    """The table computed and written to the checkpoint folder: later plans start from there.

    A cluster names the folder in spark.checkpoint.dir. Where it is unset and the session runs on this
    machine alone, as in tests, a temporary one takes its place; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def hold(df: DataFrame) -> DataFrame:
    """The table written to the shared folder, for many passes: they read few files, while a cached plan keeps all
    partitions of its last shuffle, however small, for each pass. release() removes it."""
    path = f"{shared_folder(df.sparkSession)}/ontime-held-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Removes what hold() wrote."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/ontime-held-" in f}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _scratch().name


@cache
def _scratch() -> tempfile.TemporaryDirectory:
    """One folder for this process, removed when it ends."""
    return tempfile.TemporaryDirectory(prefix="spark-checkpoint-", ignore_cleanup_errors=True)
