"""Suffix-array dedup over bytes: column-wise construction for many documents at once.

The full method inserts one symbol of every document each round, from the last to the first, and
keeps the collection's Burrows-Wheeler transform and common prefixes up to date. Its rounds are
as many as the longest document has bytes, and each goes through all of the transform, so it is
applied here to collections of short pieces that can share long strings:

1. Every string of `passage` bytes has an anchor, the least hash (leftmost of equals) of its runs
   of `seed` bytes. Neighbouring strings with the same anchor form a piece, which reaches `size`
   bytes beyond the start of its last string, as far as the document goes. Equal strings have
   equal anchors at the same place, so only pieces under one anchor can share strings.
2. Pieces with equal content (equal anchor and content hash) are repeated as a whole.
3. Anchors with pieces of different content: these pieces, one of each content, are the
   documents of a collection, aligned at the anchor. Round by round a column is inserted, right
   to left: one symbol of each piece goes to its place in the transform (a stable sort of the
   previous order by the new symbol), and the common prefixes of neighbours are updated from
   the minima between them. A string is repeated when the common prefix with a neighbour of its
   own column is as long as the string.

Two lengths are told apart. Bytes under repeated strings of `size` bytes are removed. Bytes under
repeated strings of `passage` bytes are only counted: a passage of fifty-odd words has 280 to 340
bytes and so no common string of 400.

A collection is bounded by `hot` pieces; anchors with more have their strings dealt out by
content digest and counted instead. Columns are held in memory, not in external files: pieces
have less than passage + size bytes, and a round reads and writes its column once, in order.

Cases: null texts are empty; shorter texts than `size` lose nothing. Texts of any length are cut into
pieces in one go, by one task each. Rows with equal or null
ids, and wholly equal rows, are separate documents. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontime.llm.common import byte_values, materialise, prefix_hash, runs_of, span_hash, text_bytes, text_chunks
from ontime.llm.substring_dedup import identified, least_places

SIZE, PASSAGE, SEED = 400, 256, 32
#: Bits of `span` for the number of strings and for the anchor's distance from the first one.
_FEW = 12
PIECE = "anchor long, piece long, id long, h long, span long, kind int"
#: What a task knows of a piece: nothing; that it has a copy, for which it stands; that it is such a copy.
OPEN, FIRST, COPY = 0, 1, 2


def _pieces(size: int, passage: int, seed: int):
    """Pieces of each text: anchor hash, content hash, and (start, anchor - start, strings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            data, offsets = text_bytes(batch.column("text"))
            raw = memoryview(np.ascontiguousarray(data))
            out = []
            for row in range(batch.num_rows):
                s, e = int(offsets[row]), int(offsets[row + 1])
                if e - s < passage:
                    continue
                prefix = prefix_hash(byte_values(data[s:e]))
                at = np.arange(e - s - seed + 1)
                hashes = span_hash(prefix, at, at + seed)
                place = least_places(hashes, passage - seed + 1)
                first, past = runs_of(place, np.zeros(0, np.int64))
                anchor = place[first]
                content = [xxhash.xxh3_64_intdigest(raw[s + f : min(s + p - 1 + size, e)]) for f, p in zip(first.tolist(), past.tolist(), strict=True)]
                span = (first << (2 * _FEW)) | ((anchor - first) << _FEW) | (past - first)
                out.append((np.full(len(first), row), hashes[anchor].view(np.int64), np.array(content, dtype=np.uint64).view(np.int64), span))
            if out:
                rows, anchors, contents, spans = (np.concatenate(x) for x in zip(*out, strict=True))
                rows = pa.array(rows)
                cols = [pa.array(anchors), pa.array(contents), batch.column("id").take(rows), batch.column("h").take(rows), pa.array(spans)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(_kinds(anchors, contents))], ["anchor", "piece", "id", "h", "span", "kind"])

    return run


def _kinds(anchor: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Copies inside a task: one of each content stands for the others."""
    order = np.lexsort((content, anchor))
    starts = np.flatnonzero(np.append(True, (anchor[order][1:] != anchor[order][:-1]) | (content[order][1:] != content[order][:-1])))
    sizes = np.diff(np.append(starts, len(order)))
    kind = np.full(len(order), COPY, dtype=np.int32)
    kind[order[starts]] = np.where(sizes > 1, FIRST, OPEN)
    return kind


def _sort_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of pieces sorted by anchor and content: all with a copy (copies), and one of each content
    whose anchor has other contents too (not copies).

    Between batches only the first row of the open content is kept, so copies may be many. Copies
    that a task has found already pass through.
    """
    held, held_size, held_done, held_after = None, 0, False, False
    # held: first row of the open content; done: it was given out as a copy; after: its anchor had another before it

    for pdf in _with_end(batches):
        ended = pdf is None
        if not ended:
            known = (pdf["kind"] == COPY).to_numpy()
            if known.any():
                yield pdf[known].assign(copy=True)
                pdf = pdf[~known]
            if pdf.empty:
                continue
        elif held is None:
            return
        joined = held if ended else (pdf if held is None else pd.concat([held, pdf], ignore_index=True))
        anchor, piece = joined["anchor"].to_numpy(), joined["piece"].to_numpy()
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(joined)))
        total = sizes + np.add.reduceat((joined["kind"] == FIRST).to_numpy().astype(np.int64), starts)
        after = np.append(False, anchor[starts][1:] == anchor[starts][:-1])
        if held is not None:
            total[0] += held_size - 1 - int(joined["kind"].iloc[0] == FIRST)
            after[0] = held_after
        before = np.append(anchor[starts][:-1] == anchor[starts][1:], False)
        copies = np.repeat(total > 1, sizes)
        if held is not None and held_done:
            copies[0] = False
        closed = np.ones(len(starts), dtype=bool)
        closed[-1] = ended
        single = np.flatnonzero(closed & (after | before))
        yield pd.concat([joined[copies].assign(copy=True), joined.iloc[starts[single]].assign(copy=False)])
        if not ended:
            held, held_size, held_after = joined.iloc[[starts[-1]]], int(total[-1]), bool(after[-1])
            held_done = bool(total[-1] > 1)


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    for pdf in batches:
        if len(pdf):
            yield pdf
    yield None


def _cut_pieces(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"anchor": pa.int64(), "id": pa.int64(), "h": pa.int64(), "span": pa.int64(), "content": pa.binary()}
        for batch in text_chunks(batches):
            out = []
            for i, h, text, wanted in zip(*[batch.column(c).to_pylist() for c in ("id", "h", "text", "wanted")], strict=True):
                raw = text.encode()
                for x in wanted:
                    start, n = x["span"] >> (2 * _FEW), x["span"] & ((1 << _FEW) - 1)
                    out.append((x["anchor"], i, h, x["span"], raw[start : start + n - 1 + size]))
                    if len(out) == 5_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))

    return run


def insert_columns(columns: np.ndarray, group: np.ndarray, sizes: tuple[int, ...], starts: int) -> list[np.ndarray]:
    """Repeated strings of aligned pieces, by inserting columns from the last to the first.

    columns: pieces x places, symbols 0 to 255, 256 where a piece has none; group: sorted group
    numbers. Returns, for each of sizes, pieces x starts: whether the string of that many symbols
    from each of the first `starts` places also stands there in another piece of the group.
    """
    n, width = columns.shape
    found = [np.zeros((n, starts), dtype=bool) for _ in sizes]
    order = np.arange(n)
    common_until = np.full(n + 1, width)  # place where a piece and the one before it in the order part
    base = group.astype(np.int64) << 9
    for place in range(width - 1, -1, -1):
        symbol = columns[order, place].astype(np.int64)  # the transform's part for this column
        key = base | symbol
        perm = np.argsort(key, kind="stable")
        sorted_key = key[perm]
        p, q = perm[:-1], perm[1:]
        until = common_until[q]
        apart = np.flatnonzero((sorted_key[1:] == sorted_key[:-1]) & (q != p + 1))
        if len(apart):
            bounds = np.stack([p[apart] + 1, q[apart] + 1], axis=1).ravel()
            until[apart] = np.minimum.reduceat(common_until, bounds)[::2]
        until[(sorted_key[1:] != sorted_key[:-1]) | (symbol[perm[1:]] == 256)] = place
        common_until = np.concatenate([[place], until, [place]])
        order = order[perm]
        if place < starts:
            for size, hit in zip(sizes, found, strict=True):
                enough = common_until - place >= size
                hit[order[enough[:-1] | enough[1:]], place] = True
    return found


def _collections(size: int, passage: int, seed: int, rows: int = 6_000):
    """Repeated strings among pieces sorted by anchor, whole anchors at a time."""
    reach = passage - seed  # bytes of a string that may precede its anchor

    def repeated(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        group = np.cumsum(np.append(0, pdf["anchor"].to_numpy()[1:] != pdf["anchor"].to_numpy()[:-1]))
        span = pdf["span"].to_numpy()
        start, n = span >> (2 * _FEW), span & ((1 << _FEW) - 1)
        left = reach - ((span >> _FEW) & ((1 << _FEW) - 1))  # column of the piece's first byte
        columns = np.full((len(pdf), reach + size), 256, dtype=np.uint16)
        for i, content in enumerate(pdf["content"]):
            columns[i, left[i] : left[i] + len(content)] = np.frombuffer(content, dtype=np.uint8)
        for length, found in zip((size, passage), insert_columns(columns, group, (size, passage), reach + 1), strict=True):
            # the bytes after a piece's strings are there for comparison; strings that start in them
            # belong to the next piece
            at = np.arange(reach + 1)
            flat = (found & (at >= left[:, None]) & (at < (left + n)[:, None])).ravel()
            first, past = runs_of(flat, np.arange(len(pdf)) * (reach + 1))
            first, past = first[flat[first]], past[flat[first]]
            i = first // (reach + 1)
            begin = start[i] + first % (reach + 1) - left[i]
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[i], "h": pdf["h"].to_numpy()[i], "start": begin, "n": past - first, "length": length})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if pdf.empty:
                continue
            held.append(pdf)
            if sum(map(len, held)) < rows:
                continue
            whole = pd.concat(held, ignore_index=True)
            is_open = (whole["anchor"] == whole["anchor"].iloc[-1]).to_numpy()
            for part in _parts(whole[~is_open], rows):
                yield from repeated(part)
            held = [whole[is_open]]
        if held:
            for part in _parts(pd.concat(held, ignore_index=True), rows):
                yield from repeated(part)

    return run


def _parts(pdf: pd.DataFrame, rows: int) -> Iterator[pd.DataFrame]:
    """Cut a table sorted by anchor into parts of about `rows` rows, anchors whole."""
    if pdf.empty:
        return
    anchor = pdf["anchor"].to_numpy()
    ends = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(pdf))
    begin = 0
    while begin < len(pdf):
        k = np.searchsorted(ends, begin + rows, side="right") - 1
        end = int(ends[k]) if k >= 0 and ends[k] > begin else int(ends[np.searchsorted(ends, begin, side="right")])
        yield pdf.iloc[begin:end]
        begin = end


def _digests(size: int, passage: int):
    """Each string of the pieces of very common anchors, as a digest of its content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, h, span, content in zip(pdf["id"], pdf["h"], pdf["span"], pdf["content"], strict=True):
                start, n = span >> (2 * _FEW), span & ((1 << _FEW) - 1)
                for length in (size, passage):
                    some = min(n, len(content) - length + 1)
                    if some > 0:
                        digest = [xxhash.xxh3_128_digest(content[k : k + length]) for k in range(some)]
                        yield pd.DataFrame({"digest": digest, "id": i, "h": h, "start": start + np.arange(some), "length": length})

    return run


RUNS = "id long, h long, start long, n long, length int"


def repeats(docs: DataFrame, size: int = SIZE, seed: int = SEED, hot: int = 20_000, passage: int = PASSAGE) -> DataFrame:
    """id, h, start, n, length: n strings of `length` bytes (size or passage) from `start` on that also
    start elsewhere."""
    passage = min(passage, size)
    d = identified(docs)
    pieces = d.select("id", "h", "text").mapInArrow(_pieces(size, passage, seed), PIECE)
    # copies found in a task are dealt evenly, the rest by anchor
    deal = F.when(F.col("kind") == COPY, F.xxhash64("id", "span")).otherwise(F.col("anchor"))
    together = pieces.repartition(deal).sortWithinPartitions("anchor", "piece")
    sorted_out = materialise(together.mapInPandas(_sort_out, PIECE + ", copy boolean"), "pieces")
    start, n = F.shiftright("span", 2 * _FEW), F.col("span").bitwiseAND(F.lit((1 << _FEW) - 1))
    copies = sorted_out.where("copy").select("id", "h", start.alias("start"), n.alias("n"), F.lit(0).alias("length"))
    single = sorted_out.where("NOT copy")
    wanted = single.groupBy("id", "h").agg(F.collect_set(F.struct("anchor", "span")).alias("wanted"))
    contents = d.join(wanted, ["id", "h"]).select("id", "h", "text", "wanted")
    contents = contents.mapInArrow(_cut_pieces(size), "anchor long, id long, h long, span long, content binary")
    common = materialise(single.groupBy("anchor").count().where(F.col("count") > hot).select("anchor"), "hot-anchors")
    n_hot = common.count()
    found = copies
    if n_hot:
        contents = materialise(contents, "contents")
        hint = F.broadcast(common) if n_hot <= 100_000 else common
        every = contents.join(hint, "anchor", "left_semi").mapInPandas(_digests(size, passage), "digest binary, id long, h long, start long, length int")
        often = every.groupBy("digest").count().where("count > 1").select("digest")
        found = found.unionByName(every.join(often, "digest").select("id", "h", "start", F.lit(1).cast("long").alias("n"), "length"))
        contents = contents.join(hint, "anchor", "left_anti")
    sorted_rows = contents.repartition("anchor").sortWithinPartitions("anchor")
    return found.unionByName(sorted_rows.mapInPandas(_collections(size, passage, seed), RUNS))


def _covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of (start, stop), sorted, as maximal runs."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def _remove(size: int, passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw, strings, passages = text.encode(), [], []
                for s in spans or ():
                    start, n, length = s["start"], s["n"], s["length"]
                    if length in (0, size):  # 0: a copied piece, all its strings that fit into the document
                        last = min(start + n - 1, len(raw) - size)
                        if last >= start:
                            strings.append((start, last + size))
                    if length in (0, passage):
                        passages.append((start, start + n - 1 + passage))
                gone = _covered(strings)
                edges = [0, *(x for span in gone for x in span), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                shared = sum(b - a for a, b in _covered(passages))
                out.append((len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), shared, left))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            arrays = [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "kept"])

    return run


def suffix_dedup(docs: DataFrame, size: int = SIZE, seed: int = SEED, hot: int = 20_000, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes (under strings of `passage`
    bytes that also start elsewhere; they stay), kept (bytes): one row per row of docs."""
    passage = min(passage, size)
    found = materialise(repeats(docs, size, seed, hot, passage), "repeats")
    per_doc = found.groupBy("id", "h").agg(F.collect_list(F.struct("start", "n", "length")).alias("spans"))
    joined = identified(docs).join(per_doc, ["id", "h"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, kept binary"
    return joined.mapInArrow(_remove(size, passage), schema)
