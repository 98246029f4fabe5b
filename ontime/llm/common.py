"""What several operators share: the shared folder, word positions, numpy hashing of words."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as every contract of this package means them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that numpy helpers look at together; bounds the memory of a Python worker.
CHUNK_BYTES = 1 << 20

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir, which driver and executors share.

    Where that setting is unset and the session runs on this machine alone (tests) a temporary
    folder takes its place; on a cluster executors would not see it, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_folder.get(spark.sparkContext.applicationId)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_folder[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-ontime-")
    return f"{base.rstrip('/')}/ontime-{spark.sparkContext.applicationId}"


_own_folder: dict[str, str] = {}
_paths: dict[str, SparkSession] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used, removed when the application ends, or before by drop_path."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if not _paths:
        atexit.register(_drop_all)
    _paths[path] = spark
    if (made := _scope.get()) is not None:
        made.add(path)
    return path


_scope: ContextVar[set[str] | None] = ContextVar("paths made in a scope", default=None)


@contextmanager
def scope() -> Iterator[set[str]]:
    """The set of paths that are made inside, by this thread: whoever opens the scope may drop them."""
    outer, made = _scope.get(), set()
    token = _scope.set(made)
    try:
        yield made
    finally:
        _scope.reset(token)
        if outer is not None:
            outer |= made


def drop_path(spark: SparkSession, path: str) -> None:
    _paths.pop(path, None)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _drop_all() -> None:
    for path, spark in list(_paths.items()):
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended; the folder's owner clears it
            return


#: Whether the shuffle files of an execution are removed at its end; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, compression: str | None = None, drop_shuffles: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors.

    compression: a codec of Parquet's for tables that stay long (default: the session's).
    drop_shuffles: the write's shuffles leave the disk when it ends, for those that are large.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    if drop_shuffles:
        spark.conf.set(CLEANUP, "true")
    try:
        (df.write.option("compression", compression) if compression else df.write).parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """df for a join by sorted shuffles at any size: the broadcast of a small table is collected and built in the driver's
    memory, where a chain of many joins on small inputs leaves more than the tables hold."""
    return df.hint("merge")


def scratch_of(df: DataFrame) -> set[str]:
    """The paths of materialised tables that df reads."""
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    bare = lambda p: p.split(":", 1)[-1].lstrip("/")
    read = {bare(f) for f in folders}
    return {p for p in _paths if bare(p) in read}


def drop_tables(*tables: DataFrame | None) -> None:
    """Remove materialised tables that nothing reads any more."""
    for df in tables:
        if df is not None:
            for path in scratch_of(df):
                drop_path(df.sparkSession, path)


def drop_scratch(spark: SparkSession, paths: set[str], docs: DataFrame | None = None) -> None:
    """Remove those of paths that docs doesn't read."""
    for path in paths & set(_paths) - (scratch_of(docs) if docs is not None else set()):
        drop_path(spark, path)


def scratch_paths() -> set[str]:
    return set(_paths)


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes of text (one text at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = compute.binary_length(batch.column(batch.schema.get_field_index(text)))
        ends = np.cumsum(np.nan_to_num(sizes.to_numpy(zero_copy_only=False).astype(float)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0.0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column in one array, and where each text starts (n + 1 offsets).

    Null texts are empty.
    """
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and where each text's words start (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_IS_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]  # words never cross texts
    begins[edge] = word[edge]
    ends[edge - 1] = word[edge - 1]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits, so that low and high bits are equally good."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_pow_cache: dict[str, np.ndarray] = {"up": _powers(1 << 12, _BASE), "down": _powers(1 << 12, _INVERSE)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_pow_cache[kind]) < n:
        _pow_cache[kind] = _powers(max(n, 2 * len(_pow_cache[kind])), _BASE if kind == "up" else _INVERSE)
    return _pow_cache[kind][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2**64 (n + 1), for span_hash."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power("up", len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's content, the same wherever the span lies."""
    raw = (prefix[stops] - prefix[starts]) * _power("down", len(prefix))[starts]
    return mix64(raw + mix64((stops - starts).astype(np.uint64)))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of 64 bits for each word (as words_of finds them), the halves of its XXH3 of 128 bits.

    Not a polynomial over bytes: there are plain strings of a thousand bytes that those can't tell apart modulo 2**64.
    """
    at = np.append(0, np.cumsum(stops - starts)).astype(np.int64)
    packed = np.ascontiguousarray(data[~_IS_SPACE[data]])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(packed)]).dictionary_encode()
    digests = b"".join([xxhash.xxh3_128_digest(w) for w in words.dictionary.to_pylist()])
    each = np.frombuffer(digests, dtype=np.uint64).reshape(-1, 2)[words.indices.to_numpy()]
    return np.ascontiguousarray(each[:, 0]), np.ascontiguousarray(each[:, 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values (len - width + 1), by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[: len(values) - step], values[step:])
        have += step
    return values


def runs_of(values: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal values; a run also ends at each of `cuts`."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    new[cuts[(cuts > 0) & (cuts < len(values))]] = True
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], len(values))

