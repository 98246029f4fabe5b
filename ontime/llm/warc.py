"""WARC archives: written with an index first, read back by coalesced byte ranges.

Records are gzip members of their own, so each can be read without the rest of its file.
Writing yields an index row for every record: file, offset, length, URL and digest. A reader
picks records from the index, sorts them by file and offset, merges neighbouring ranges into
one read where the gap is small, and cuts the records out of it.

Files are written by name of the task's attempt; the index names only files of attempts that
succeeded, so a task that runs twice after a lost executor leaves a file nobody refers to. The
index is a table in the shared folder, written once. Files go to the folder given, through
Arrow's file systems (file, hdfs, s3, gs).

Of records with equal payloads of at least `least` bytes, the one with the largest page_id is
the response and the others revisit it; smaller payloads are always responses.

Cases: null html is an empty payload, null url an empty target. Rows with a null page_id are
written and read like others; among equal payloads any page_id counts as larger. Rows that share
page_id and payload are alike: all of them responses, or all revisits. Payloads of any length are
one record, held once by the task that writes or reads it. An empty table gives an empty index and
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontime.llm.common import materialise, new_path, text_chunks

INDEX = "page_id long, url string, file string, offset long, length long, digest string, payload_bytes long, record_type string"
#: Bytes between two records that are rather read than skipped, and the longest read.
GAP, LONGEST = 1 << 16, 8 << 20
#: Beyond so many read tasks each gets more pieces, one after the other.
MOST_TASKS = 20_000
_NO_ID = -(1 << 63)


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _date() -> str:
    return "2024-01-01T00:00:00Z"


def record(page_id, url: str, payload: bytes, digest: str, refers_to, kind: str) -> bytes:
    """One WARC/1.1 record; a revisit has no payload, but its size and digest."""
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {_date()}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        body = b""
    else:
        head += ["Content-Type: text/html; charset=utf-8"]
        body = payload
    head += [f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and body of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    return fields, rest[: int(fields["Content-Length"])]


def _gzip(raw: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _writer(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, file, fs, root = None, 0, "", None, ""
        names = [f.split()[0] for f in INDEX.split(", ")]
        for batch in text_chunks(batches, "html"):
            if out is None:
                fs, root = file_system(folder)
                fs.create_dir(root, recursive=True)
                file = f"{uuid.uuid4().hex}.warc.gz"
                out = fs.open_output_stream(f"{root}/{file}", compression=None)
            rows = []
            for page, url, html, kind, refers in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "kind", "refers")], strict=True):
                payload = (html or "").encode()
                digest = sha1_base32(payload)
                member = _gzip(record(page, url or "", payload, digest, refers, kind), level)
                out.write(member)
                rows.append((page, url, file, at, len(member), digest, len(payload), kind))
                at += len(member)
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"}), preserve_index=False)
        if out is not None:
            out.close()

    return run


def write(pages: DataFrame, folder: str, least: int = 0, level: int = 2) -> DataFrame:
    """Write pages (page_id, url, html) as archives in folder; the index, already stored."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    p = p.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("id", F.coalesce("page_id", F.lit(_NO_ID)))
    big = F.length(F.col("html").cast("binary")) >= least
    copies = p.where(big).groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("n"))
    copies = materialise(copies.where("n > 1").drop("n"), "warc-copies")
    joined = p.join(copies, "sha", "left").withColumn("revisit", big & F.col("last").isNotNull() & (F.col("id") != F.col("last")))
    records = joined.select(
        "page_id", "url", "html", F.when(F.col("revisit"), "revisit").otherwise("response").alias("kind"), F.when(F.col("revisit"), F.col("last")).alias("refers")
    )
    return materialise(records.mapInArrow(_writer(folder, level), INDEX), "warc-index")


def ranges(spans: list[tuple[int, int]], gap: int = GAP, longest: int = LONGEST) -> Iterator[tuple[int, int, int, int]]:
    """Coalesce sorted (offset, length): yields (start, stop, first, past) over the spans."""
    first = 0
    for i in range(1, len(spans) + 1):
        start, stop = spans[first][0], spans[i - 1][0] + spans[i - 1][1]
        if i == len(spans) or spans[i][0] - stop > gap or spans[i][0] + spans[i][1] - start > longest:
            yield start, stop, first, i
            first = i


def _reader(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = file_system(folder)
        for pdf in batches:
            for file, group in pdf.groupby("file", sort=False):
                group = group.sort_values("offset")
                spans = list(zip(group["offset"].tolist(), group["length"].tolist(), strict=True))
                with fs.open_input_file(f"{root}/{file}") as f:
                    for start, stop, first, past in ranges(spans):
                        data = f.read_at(stop - start, start)
                        yield pd.DataFrame(
                            [_row(data[o - start : o - start + n]) for o, n in spans[first:past]],
                            columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"],
                        ).astype({"page_id": "Int64", "refers_to": "Int64"})

    return run


def _row(member: bytes) -> tuple:
    fields, body = parse(zlib.decompress(member, 31))
    number = lambda s: None if s in ("", "none") else int(s)
    page = number(fields["WARC-Record-ID"][len("<urn:page:") : -1])
    kind, refers = fields["WARC-Type"], None
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])
    if kind == "revisit":
        refers = number(fields["WARC-Refers-To"][len("<urn:page:") : -1])
    elif (sha1_base32(body), len(body)) != (digest, size):
        raise ValueError(f"page {page}: payload and digest differ")
    return page, fields.get("WARC-Target-URI", ""), size, digest, kind, refers, body.decode() if kind == "response" else None


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def read(index: DataFrame, folder: str, piece: int = 8 << 20) -> DataFrame:
    """The records that index rows name, read by sorted and coalesced byte ranges.

    Neighbouring records of one file, `piece` bytes of it, go to the same task. There are as many
    tasks as the records have such pieces: index rows are a hundredth of what they point at, so
    adaptive execution, which goes by their size, would read all with a few tasks.
    """
    wanted = index.select("file", "offset", "length", F.floor(F.col("offset") / piece).alias("piece"))
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = min(max(index.sparkSession.sparkContext.defaultParallelism, -(-total // piece)), MOST_TASKS)
    wanted = wanted.repartition(tasks, "file", "piece").sortWithinPartitions("file", "offset")
    return wanted.mapInPandas(_reader(folder), READ)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder and read all records back."""
    folder = new_path(pages.sparkSession, "warc")
    return read(write(pages, folder, least), folder)
