"""Substring dedup over words: seed, extend, keep maximal repeats.

Seeds are winnowed anchors: of the `size - seed + 1` runs of `seed` words in each window of
`size` words, the one with the least hash (the leftmost of equals). Equal windows choose the same
anchor at the same place, so documents that share a window meet under its anchor. Anchors that
only one document has are dropped at once; for the others the texts are read again and each
occurrence is extended both ways, as far as the windows go that chose it. A window is a repeat
when a document with a smaller id has it under the same anchor; neighbouring repeats join to
maximal ones.

Windows are compared by hashes of 128 bits, made of such hashes of their words. Extensions are compared in the order of ids, streaming, with one entry per distinct window. For
anchors with more than `hot` occurrences the windows themselves are dealt out and aggregated
before the shuffle, so no task gets all occurrences of a common passage.

Cases: null text has no words; texts shorter than a window lose nothing. A null id counts as
larger than any other, and rows without ids, or with equal ids, never remove words of each
other. Texts of any length are cut into windows in one go, by one task each. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontime.llm.common import (
    drop_scratch,
    materialise,
    prefix_hash,
    runs_of,
    scope,
    sliding_min,
    span_hash,
    text_bytes,
    text_chunks,
    text_or_empty,
    word_hashes,
    words_of,
)

SIZE, SEED = 13, 4
#: Bytes of a window's two hashes.
WIDTH = 16
LAST_ID = (1 << 63) - 1
_POSITION = np.uint64((1 << 28) - 1)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, id (null: the largest long), h (of the text), text: id and h tell rows apart as far
    as their results differ."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return d.select("doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("h"), "text")


def least_places(hashes: np.ndarray, width: int, block: int = 1 << 27) -> np.ndarray:
    """For each run of `width` hashes: the place of its least one, leftmost of equals. Looked at in
    blocks, so that places inside a block fit into the low bits of a hash."""
    out = [np.zeros(0, dtype=np.int64)]
    for b in range(0, len(hashes) - width + 1, block):
        part = hashes[b : b + block + width - 1]
        packed = (part & ~_POSITION) | np.arange(len(part), dtype=np.uint64)
        out.append((sliding_min(packed, width) & _POSITION).astype(np.int64) + b)
    return np.concatenate(out)


def _windows(words: tuple[np.ndarray, np.ndarray], size: int, seed: int):
    """Over both hashes of the words of several texts: anchor place of each window start, seed hashes, and what
    span_hash needs for each of the two."""
    prefixes = [prefix_hash(w) for w in words]
    n = len(words[0]) - seed + 1
    if n < size - seed + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), prefixes
    at = np.arange(n)
    seeds = span_hash(prefixes[0], at, at + seed)
    return least_places(seeds, size - seed + 1), seeds, prefixes


def _inside(bounds: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of n window starts have all their words in one text (bounds: n_texts + 1)."""
    ok = np.zeros(n, dtype=bool)
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        if e - s >= size:
            ok[s : e - size + 1] = True
    return ok


#: What a task knows of an anchor occurrence: nothing; that other documents have the anchor too;
#: that all its windows are in a document with a smaller id.
OPEN, SHARED, REPEAT = 0, 1, 2
ANCHOR = "anchor long, id long, h long, span long, kind int"


def _kinds(anchor: np.ndarray, ids: np.ndarray, content: list[np.ndarray]) -> np.ndarray:
    """Sort out occurrences inside a task, so that of a common passage few rows must meet others.

    Of equal content the smallest id stays open; of an anchor, rows of two ids do.
    """
    kind = np.zeros(len(anchor), dtype=np.int32)
    if not len(anchor):
        return kind
    order = np.lexsort((ids, *content, anchor))
    same = np.ones(len(order) - 1, dtype=bool)
    for x in (anchor, *content):
        same &= x[order][1:] == x[order][:-1]
    starts = np.flatnonzero(np.append(True, ~same))
    least = np.repeat(ids[order][starts], np.diff(np.append(starts, len(order))))
    kind[order[ids[order] > least]] = REPEAT
    left = np.flatnonzero(kind == OPEN)
    left = left[np.lexsort((ids[left], anchor[left]))]
    a, i = anchor[left], ids[left]
    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    is_least = i == np.repeat(i[starts], np.diff(np.append(starts, len(a))))
    second = ~is_least & np.append(False, is_least[:-1])
    kind[left[~is_least & ~second]] = SHARED
    return kind


def _anchors(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            data, offsets = text_bytes(batch.column("text"))
            starts, stops, bounds = words_of(data, offsets)
            place, seeds, prefixes = _windows(word_hashes(data, starts, stops), size, seed)
            ok = np.flatnonzero(_inside(bounds, len(place), size))
            doc = np.searchsorted(bounds, ok, side="right") - 1
            first, past = runs_of(place[ok], np.flatnonzero(np.diff(doc, prepend=-1)))
            d = doc[first]
            at = ok[first] - bounds[d]
            anchor = seeds[place[ok[first]]].view(np.int64)
            ids = batch.column("id").to_numpy()[d]
            # the first and the last window of a run hold all its words
            ends = [span_hash(p, w, w + size) for w in (ok[first], ok[past - 1]) for p in prefixes]
            kind = _kinds(anchor, ids, [*ends, past - first])
            cols = [pa.array(anchor), pa.array(ids), batch.column("h").take(pa.array(d)), pa.array((at << 8) | (past - first)), pa.array(kind)]
            yield pa.RecordBatch.from_arrays(cols, ["anchor", "id", "h", "span", "kind"])

    return run


#: Rows of one id under one anchor that a task holds back.
MOST_HELD = 50_000


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows, sorted by anchor, whose anchor occurs in documents with different ids.

    Rows of an anchor are held back only as long as all of them are of one id, and not more than
    MOST_HELD: beyond that they are handed on as if another id had followed, which costs work if
    none does, but changes nothing. Rows whose kind is known already pass through.
    """
    held: pd.DataFrame | None = None
    open_anchor = None  # an anchor already known to be shared
    for pdf in batches:
        known = (pdf["kind"] != OPEN).to_numpy()
        if known.any():
            yield pdf[known]
            pdf = pdf[~known]
        if pdf.empty:
            continue
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
            held = None
        anchor, ids = pdf["anchor"].to_numpy(), pdf["id"].to_numpy()
        starts = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        low, high = np.minimum.reduceat(ids, starts), np.maximum.reduceat(ids, starts)
        shared = low < high
        if open_anchor is not None and anchor[0] == open_anchor:
            shared[0] = True
        sizes = np.diff(np.append(starts, len(pdf)))
        keep = np.repeat(shared, sizes)
        if shared[-1]:
            open_anchor = anchor[-1]
        elif sizes[-1] > MOST_HELD:
            keep[starts[-1] :] = True
            open_anchor = anchor[-1]
        else:
            held = pdf.iloc[starts[-1] :]
        yield pdf[keep]


def _extend(size: int, seed: int):
    """Content hashes of the windows around each anchor occurrence of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            data, offsets = text_bytes(batch.column("text"))
            starts, stops, bounds = words_of(data, offsets)
            prefixes = [prefix_hash(w) for w in word_hashes(data, starts, stops)]
            seen = batch.column("seen")
            each = seen.flatten()  # of all texts one after the other
            row = np.repeat(np.arange(len(seen)), np.diff(seen.offsets.to_numpy()))
            span = each.field("span").to_numpy()
            at, n = span >> 8, span & 255
            ends = np.cumsum(n)
            begin = np.repeat(bounds[row] + at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
            windows = np.stack([span_hash(p, begin, begin + size) for p in prefixes], axis=1)
            edges = np.append(0, ends * WIDTH).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(windows))])
            row = pa.array(row)
            cols = [each.field("anchor"), batch.column("id").take(row), batch.column("h").take(row), pa.array(at), packed]
            yield pa.RecordBatch.from_arrays(cols, ["anchor", "id", "h", "at", "windows"])

    return run


def _repeats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Window starts that an earlier id has too; rows come sorted by anchor, then id."""
    names = ["id", "h", "start", "n"]
    known: dict[bytes, int] = {}  # of the open anchor: window -> smallest id
    open_anchor = None
    for pdf in batches:
        if pdf.empty:
            continue
        count = pdf["windows"].str.len().to_numpy() // WIDTH
        window = np.frombuffer(b"".join(pdf["windows"]), dtype=np.int64).reshape(-1, 2)
        row = np.repeat(np.arange(len(pdf)), count)
        anchor, ids = pdf["anchor"].to_numpy()[row], pdf["id"].to_numpy()[row]
        order = np.lexsort((ids, window[:, 1], window[:, 0], anchor))
        a, w, i = anchor[order], window[order], ids[order]
        new = np.append(True, (a[1:] != a[:-1]) | (w[1:] != w[:-1]).any(axis=1))
        starts = np.flatnonzero(new)
        least = i[starts]
        if open_anchor is not None:
            for k in np.flatnonzero(a[starts] == open_anchor):
                least[k] = min(least[k], known.get(w[starts[k]].tobytes(), LAST_ID))
        if a[-1] != open_anchor:
            known = {}
            open_anchor = a[-1]
        for k in np.flatnonzero(a[starts] == open_anchor):
            known[w[starts[k]].tobytes()] = int(least[k])
        again = np.zeros(len(row), dtype=bool)
        again[order] = i > np.repeat(least, np.diff(np.append(starts, len(i))))
        within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        first, past = runs_of(again, np.flatnonzero(within == 0))
        first, past = first[again[first]], past[again[first]]
        r = row[first]
        start = pdf["at"].to_numpy()[r] + within[first]
        yield pd.DataFrame({"id": pdf["id"].to_numpy()[r], "h": pdf["h"].to_numpy()[r], "start": start, "n": past - first})[names]


def repeats(docs: DataFrame, size: int = SIZE, seed: int = SEED, hot: int = 50_000) -> DataFrame:
    """id, h, start, n: n windows from word `start` on that a document with a smaller id has."""
    d = identified(docs)
    seeds = d.select("id", "h", "text").mapInArrow(_anchors(size, seed), ANCHOR)
    # occurrences that need no others are dealt evenly, the rest by anchor
    deal = F.when(F.col("kind") == OPEN, F.col("anchor")).otherwise(F.xxhash64("id", "span"))
    together = seeds.repartition(deal).sortWithinPartitions("anchor", "id")
    met = materialise(together.mapInPandas(_shared, ANCHOR), "shared-anchors", drop_shuffles=True)
    shared = met.where(F.col("kind") != REPEAT).select("anchor", "id", "h", "span")
    per_doc = shared.groupBy("id", "h").agg(F.collect_set(F.struct("anchor", "span")).alias("seen"))
    texts = d.join(per_doc, ["id", "h"]).select("id", "h", "text", "seen")
    extended = texts.mapInArrow(_extend(size, seed), "anchor long, id long, h long, at long, windows binary")
    common = shared.groupBy("anchor").count().where(F.col("count") > hot).select("anchor", F.lit(True).alias("is_hot"))
    common = materialise(common, "hot-anchors")
    n_hot = common.count()
    if n_hot:
        extended = materialise(extended, "extended", drop_shuffles=True)
        split = extended.join(F.broadcast(common) if n_hot <= 100_000 else common, "anchor", "left")
        extended = split.where("is_hot IS NULL").drop("is_hot")
    sorted_rows = extended.repartition("anchor").sortWithinPartitions("anchor", "id")
    found = sorted_rows.mapInPandas(_repeats, "id long, h long, start long, n long")
    repeat = met.where(F.col("kind") == REPEAT).select("id", "h", F.shiftright("span", 8).alias("start"), F.col("span").bitwiseAND(255).alias("n"))
    found = found.unionByName(repeat)
    if n_hot:
        one = split.where("is_hot").select("anchor", "id", "h", "at", F.posexplode(F.expr(
            f"transform(sequence(0, length(windows) div {WIDTH} - 1), i -> substring(windows, i * {WIDTH} + 1, {WIDTH}))")).alias("k", "window"))
        least = one.groupBy("anchor", "window").agg(F.min("id").alias("least"))
        again = one.join(least, ["anchor", "window"]).where("id > least")
        found = found.unionByName(again.select("id", "h", (F.col("at") + F.col("k")).alias("start"), F.lit(1).cast("long").alias("n")))
    return found


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            n_words, n_removed, digests, kept_text = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = text.encode().split()
                if spans:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    for s in spans:
                        edge[s["start"]] += 1
                        edge[s["start"] + s["n"] + size - 1] -= 1
                    kept = [w for w, c in zip(words, np.cumsum(edge)[:-1].tolist(), strict=True) if not c]
                else:
                    kept = words
                joined = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                kept_text.append(joined.decode())
            cols = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_text, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, size: int = SIZE, seed: int = SEED, hot: int = 50_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text: one row for each row of docs."""
    with scope() as made:
        found = materialise(repeats(docs, size, seed, hot), "repeats", drop_shuffles=True)
    drop_scratch(docs.sparkSession, made, found)
    per_doc = found.groupBy("id", "h").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    joined = identified(docs).join(per_doc, ["id", "h"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut(size), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
