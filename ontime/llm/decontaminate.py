"""Benchmark decontamination with suffix arrays of the training texts.

Documents are cut into shards where they are read: a shard's words, one document after the other, are
a sequence of symbols, and its suffix array is the order of the places where a word that the
benchmark knows stands. Every suffix of every benchmark item is searched in every shard: word by word
the range of the array whose suffixes begin with it gets narrower, by binary search inside the
range. When the range is empty the longest verbatim match of that suffix is known, with its
locations; the range after a whole window (10 words, or all words of a shorter item) holds
all places where that window stands. Words under one are hit.

The benchmark goes to the tasks in blocks of a checked size, one block after the other: each is a
stated set of queries against all rows. Words are told apart by their bytes, never by a hash. A
text longer than a shard is cut into stretches that overlap by a window less one word, so memory
doesn't follow the length of a text but for its words' hits. Nothing is shuffled: rows stay where they
are, and the matches of a common passage are ranges of an array, not pairs of rows.

Cases: null and empty texts have no words and hit nothing; items without words match nothing; an item
of fewer than 10 words is one window. Rows of the benchmark with the same id are one item, a null id
is an item written as an empty text. Null, repeated and tied doc_ids are rows of their own. An empty
table of documents gives an empty result, an empty benchmark no hits. All columns of docs are kept,
but for scan()'s own names, which take the place of others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontime.llm.common import materialise, text_bytes, text_chunks, text_or_empty

WINDOW = 10
#: Words of a shard; bytes of benchmark words that a task holds at a time; words of a piece of an item.
SHARD_WORDS, BLOCK_BYTES, PIECE_WORDS = 1 << 20, 4 << 20, 1 << 12

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of words once lower-cased: digits, a-z, and all of characters beyond ASCII.
_IN_WORD = np.zeros(256, dtype=bool)
for _a, _b in (("0", "9"), ("a", "z"), ("\x80", "\xff")):
    _IN_WORD[ord(_a) : ord(_b) + 1] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of several texts as one Arrow array of bytes, and where each text's words start (n + 1)."""
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    word = _IN_WORD[low]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(data))]  # words never cross texts
    begins[edge] = word[edge]
    starts = np.flatnonzero(begins)
    kept = np.cumsum(word)
    at = np.append(kept[starts] - 1, kept[-1]).astype(np.int64)
    packed = np.ascontiguousarray(low[word])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(packed)])
    return words, np.searchsorted(starts, offsets)


def suffix_array(symbols: np.ndarray, deepest: int) -> np.ndarray:
    """Places with a symbol of 0 or more, ordered by what follows: by prefix doubling, until all
    suffixes differ or as many symbols as the longest query has are compared.

    A negative symbol ends a suffix.
    """
    at = np.flatnonzero(symbols >= 0)
    n = len(symbols)
    rank = np.where(symbols >= 0, symbols.astype(np.int64) + 1, 0)
    order = at[np.argsort(rank[at], kind="stable")]
    depth = 1
    while depth < deepest and len(order) > 1:
        later = order + depth
        second = np.zeros(len(order), dtype=np.int64)
        inside = later < n
        second[inside] = rank[later[inside]]
        first = rank[order]
        # only suffixes with equal ranks are sorted on
        tied = np.zeros(len(order), dtype=bool)
        tied[1:] = first[1:] == first[:-1]
        tied[:-1] |= first[1:] == first[:-1]
        place = np.flatnonzero(tied)
        if not len(place):
            break
        perm = np.lexsort((second[place], first[place]))
        order[place], second[place] = order[place][perm], second[place][perm]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[order] = np.cumsum(new)
        depth *= 2
    return order


def search(symbols: np.ndarray, array: np.ndarray, queries: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: np.ndarray):
    """For each query suffix (lengths[i] symbols of queries from starts[i] on): lo and hi of the range of the array that
    begins with its first window[i] symbols (empty if none does). And for each length from there on, up to the longest
    match: length, and lo, hi and suffix of the ranges that begin with so many of its symbols."""
    n = len(starts)
    low, high = np.zeros(n, dtype=np.int64), np.full(n, len(array), dtype=np.int64)
    found = np.zeros((n, 2), dtype=np.int64)
    deeper: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    live = np.flatnonzero(lengths > 0) if len(array) else np.zeros(0, np.int64)
    padded = np.append(symbols, -1)
    depth = 0
    while len(live):
        wanted = queries[starts[live] + depth]

        def bound(least: np.ndarray, depth=depth, live=live) -> np.ndarray:
            lo, hi = low[live].copy(), high[live].copy()
            while True:
                open_ = lo < hi
                if not open_.any():
                    return lo
                mid = (lo + hi) >> 1
                after = np.minimum(array[np.minimum(mid, len(array) - 1)] + depth, len(symbols))
                less = open_ & (padded[after] < least)
                lo = np.where(less, mid + 1, lo)
                hi = np.where(open_ & ~less, mid, hi)

        lo, hi = bound(wanted), bound(wanted + 1)
        hit = hi > lo
        live, lo, hi = live[hit], lo[hit], hi[hit]
        depth += 1
        low[live], high[live] = lo, hi
        whole = window[live] == depth
        found[live[whole], 0], found[live[whole], 1] = lo[whole], hi[whole]
        at_least = (window[live] > 0) & (window[live] <= depth)
        if at_least.any():
            deeper.append((depth, lo[at_least], hi[at_least], live[at_least]))
        live = live[lengths[live] > depth]
    return found[:, 0], found[:, 1], deeper


class Block:
    """Pieces of items, ready to be searched: their vocabulary, and every suffix once."""

    def __init__(self, pieces: list[tuple[str, list[str]]], window: int = WINDOW):
        self.names = sorted({name for name, _ in pieces})
        number = {name: i for i, name in enumerate(self.names)}
        words = sorted({w.encode() for _, ws in pieces for w in ws})
        self.words = words
        known = {w: i for i, w in enumerate(words)}
        symbols, starts, lengths, owner = [], [], [], []
        for name, ws in pieces:
            base = len(symbols)
            symbols += [known[w.encode()] for w in ws]
            starts += range(base, base + len(ws))
            lengths += range(len(ws), 0, -1)
            owner += [number[name]] * len(ws)
            symbols.append(-1)
        self.symbols = np.array(symbols, dtype=np.int32)
        starts, lengths, owner = (np.array(x, dtype=np.int64) for x in (starts, lengths, owner))
        piece = np.cumsum(np.append(0, self.symbols[:-1] < 0))[starts] if len(starts) else starts
        begins = np.append(True, piece[1:] != piece[:-1]) if len(starts) else np.zeros(0, bool)
        # equal suffixes are searched once: they share a rank in the suffix array of the block itself
        self.deepest = int(lengths.max()) if len(lengths) else 0
        order = suffix_array(self.symbols, self.deepest)
        at = np.searchsorted(starts, order)
        same = np.zeros(len(order), dtype=bool)
        if len(order) > 1:
            a, b = order[:-1], order[1:]
            equal = lengths[at][1:] == lengths[at][:-1]
            for i in np.flatnonzero(equal):
                n = lengths[at][i]
                same[i + 1] = np.array_equal(self.symbols[a[i] : a[i] + n], self.symbols[b[i] : b[i] + n])
        group = np.cumsum(~same) - 1
        first = np.flatnonzero(~same)
        self.starts, self.lengths = starts[at[first]], lengths[at[first]]
        # a suffix holds a window at its start if it is long enough, or is all of a short item
        self.window = np.zeros(len(first), dtype=np.int64)
        whole = (lengths[at] >= window) | begins[at]
        np.maximum.at(self.window, group[whole], np.minimum(lengths[at][whole], window))
        pairs = np.unique(np.stack([group[whole], owner[at][whole]], axis=1), axis=0) if whole.any() else np.zeros((0, 2), np.int64)
        self.owners = pairs[:, 1]
        self.owned = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        self.owner_of = np.full(len(first), len(self.names), dtype=np.int64)
        np.minimum.at(self.owner_of, group, owner[at])


def _longest(array: np.ndarray, bounds: np.ndarray, deeper: list, block: Block) -> np.ndarray:
    """For each text: length, first place and first item of its longest match of a window or more (else zeros)."""
    best = np.zeros((len(bounds) - 1, 3), dtype=np.int64)
    for depth, lo, hi, query in reversed(deeper):
        order = np.lexsort((block.owner_of[query], hi, lo))  # ranges once, with the first of their items
        new = np.append(True, (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1]))
        lo, hi, query = lo[order][new], hi[order][new], query[order][new]
        count = hi - lo
        place = array[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]
        item = np.repeat(block.owner_of[query], count)
        text = np.searchsorted(bounds, place, side="right") - 1
        order = np.lexsort((item, place, text))
        order = order[np.append(True, text[order][1:] != text[order][:-1])]
        order = order[best[text[order], 0] == 0]
        best[text[order]] = np.stack([np.full(len(order), depth), place[order], item[order]], axis=1)
    return best


def _hits(symbols: np.ndarray, bounds: np.ndarray, block: Block):
    """In a shard of texts (bounds: n + 1): runs (start, end) of hit places, pairs (text, item), and for each
    text its longest match: length, place, item."""
    array = suffix_array(symbols, block.deepest)
    low, high, deeper = search(symbols, array, block.symbols, block.starts, block.lengths, block.window)
    best = _longest(array, bounds, deeper, block)
    query = np.flatnonzero(high > low)
    if not len(query):
        return np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64), best
    # windows once: suffixes that go on differently share the range of their first words
    ranges, which = np.unique(np.stack([low[query], high[query], block.window[query]], axis=1), axis=0, return_inverse=True)
    which = which.ravel()
    count = ranges[:, 1] - ranges[:, 0]
    at = array[np.repeat(ranges[:, 0] - np.cumsum(count) + count, count) + np.arange(count.sum())]
    place_of = np.repeat(np.arange(len(ranges)), count)
    edge = np.zeros(len(symbols) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + ranges[place_of, 2], -1)
    hit = np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]])
    change = np.diff(hit)
    runs = np.stack([np.flatnonzero(change == 1), np.flatnonzero(change == -1)], axis=1)
    # a text and a window once, then the window's items
    owned = block.owned[query + 1] - block.owned[query]
    owner = block.owners[np.repeat(block.owned[query] - np.cumsum(owned) + owned, owned) + np.arange(owned.sum())]
    owners = np.unique(np.stack([np.repeat(which, owned), owner], axis=1), axis=0)
    first = np.searchsorted(owners[:, 0], np.arange(len(ranges) + 1))
    pairs = np.unique(np.stack([np.searchsorted(bounds, at, side="right") - 1, place_of], axis=1), axis=0)
    some = first[pairs[:, 1] + 1] - first[pairs[:, 1]]
    item = owners[np.repeat(first[pairs[:, 1]] - np.cumsum(some) + some, some) + np.arange(some.sum()), 1]
    return runs, np.unique(np.stack([np.repeat(pairs[:, 0], some), item], axis=1), axis=0), best


def _shards(bounds: np.ndarray, shard: int, overlap: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, first word, end): texts in order, in parts of about `shard` words."""
    part, size = [], 0
    for i, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        at = s
        while at < e:
            stop = e if e - at <= shard else at + shard
            if part and size + stop - at > shard:
                yield part
                part, size = [], 0
            part.append((i, at, stop))
            size += stop - at
            if stop == e:
                break
            at = stop - overlap
    if part:
        yield part


def _search_block(shared, window: int, shard: int):
    """Adds a block's findings to those of the blocks before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        vocabulary = pa.array(block.words, pa.large_binary())
        for batch in text_chunks(batches, limit=4 << 20):
            names = batch.schema.names
            data, offsets = text_bytes(batch.column("text"))
            words, bounds = tokens(data, offsets)
            symbols = compute.index_in(words, value_set=vocabulary).fill_null(-1).to_numpy() if len(words) else np.zeros(0, np.int32)
            n = batch.num_rows
            runs: list[list] = [[] for _ in range(n)]
            items: list[set] = [set() for _ in range(n)]
            best = [(0, 0, "")] * n
            for part in _shards(bounds, max(shard, 2 * window), window - 1):
                own = np.concatenate([np.append(symbols[s:e], -1) for _, s, e in part])
                edges = np.cumsum([0, *[e - s + 1 for _, s, e in part]])
                found, pairs, most = _hits(own, edges, block)
                which = np.searchsorted(edges, found[:, 0], side="right") - 1
                for k, (a, b) in zip(which.tolist(), found.tolist(), strict=True):
                    i, s, _ = part[k]
                    shift = s - int(edges[k]) - int(bounds[i])
                    runs[i].append((a + shift, b + shift))
                for k, item in pairs.tolist():
                    items[part[k][0]].add(item)
                for k, (length, place, item) in enumerate(most.tolist()):
                    i, s, _ = part[k]
                    if length:
                        best[i] = min(best[i], (-length, place - int(edges[k]) + s - int(bounds[i]), block.names[item]))
            before = {c: batch.column(c).to_pylist() for c in ("_bench_runs", "_bench_items", "_bench_best")}
            merged = [_merged(list(zip(r[::2], r[1::2], strict=True)) + new) for r, new in zip(before["_bench_runs"], runs, strict=True)]
            named = [sorted({*old, *(block.names[k] for k in new)}) for old, new in zip(before["_bench_items"], items, strict=True)]
            best = [min(b, (-old["words"], old["start"], old["item"] or "")) for old, b in zip(before["_bench_best"], best, strict=True)]
            best = [{"words": -w, "start": s, "item": x if w else None} for w, s, x in best]
            new = {"_bench_n": pa.array(np.diff(bounds), pa.int64()), "_bench_runs": pa.array([[x for r in m for x in r] for m in merged], pa.list_(pa.int64())),
                   "_bench_items": pa.array(named, pa.list_(pa.string())), "_bench_best": pa.array(best, batch.schema.field("_bench_best").type)}
            columns = [new[c].cast(batch.schema.field(c).type) if c in new else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pieces(window: int, size: int):
    """Items as pieces of up to `size` words that overlap by a window less one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            words, bounds = tokens(*text_bytes(batch.column("text")))
            words = words.cast(pa.large_string()).to_pylist()
            names, out = batch.column("item").to_pylist(), []
            for name, s, e in zip(names, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                while s < e:
                    stop = e if e - s <= size else s + size
                    out.append((name, words[s:stop]))
                    s = e if stop == e else stop - window + 1
            for i in range(0, len(out), 1000):
                some = out[i : i + 1000]
                cols = [pa.array([x[0] for x in some], pa.string()), pa.array([x[1] for x in some], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, ["item", "words"])

    return run


def blocks_of(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, item_id: str = "item_id") -> Iterator[Block]:
    """The benchmark's items, each once, in blocks of about block_bytes at most (one piece at least)."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), text_or_empty().alias("text"))
    pieces = items.mapInArrow(_pieces(window, max(PIECE_WORDS, 2 * window)), "item string, words array<string>").distinct()
    size = F.expr("aggregate(words, 0L, (n, w) -> n + octet_length(w) + 8)").alias("_size")
    pieces = materialise(pieces.withColumn("_size", size), "benchmark-pieces")
    total, largest = pieces.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.coalesce(F.max("_size"), F.lit(0))).first()
    n = -(-total // block_bytes)
    key = F.xxhash64("item", "words")
    while n > 1:  # blocks by hash are about equal; more of them until none is too large
        most = pieces.groupBy(F.pmod(key, F.lit(n))).agg(F.sum("_size").alias("_s")).agg(F.max("_s")).first()[0]
        if most <= max(2 * block_bytes, largest):
            break
        n *= 2
    for i in range(n):
        rows = pieces.where(F.pmod(key, F.lit(n)) == i).select("item", "words").toLocalIterator()
        yield Block([(r[0], r[1]) for r in rows], window)


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, shard: int, block_bytes: int) -> DataFrame:
    """docs with the columns _bench_n, _bench_runs, _bench_items and _bench_best."""
    empty = {"n": "0L", "runs": "CAST(array() AS array<long>)", "items": "CAST(array() AS array<string>)", "best": "named_struct('words', 0L, 'start', 0L, 'item', CAST(NULL AS string))"}
    d = docs.withColumns({"_bench_null": F.col("text").isNull(), "text": text_or_empty(), **{f"_bench_{k}": F.expr(v) for k, v in empty.items()}})
    schema = d.schema
    for f in schema.fields:
        f.nullable = True
    done = 0
    for block in [*blocks_of(benchmark, window, block_bytes)] or [Block([], window)]:
        if done and done % 4 == 0:  # no more Python workers at a time than that
            d = materialise(d, "searched")
        d = d.mapInArrow(_search_block(docs.sparkSession.sparkContext.broadcast(block), window, shard), schema)
        done += 1
    return d.withColumn("text", F.when(~F.col("_bench_null"), F.col("text")))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs' columns, n_words, hits (runs of hit words: start, end), items (ids of items with a window in the text, as
    text, sorted) and longest (the longest verbatim match of a window or more, the first of equals: words, start,
    item; of texts longer than a shard, as far as a stretch goes)."""
    d = _searched(docs, benchmark, window, shard, block_bytes)
    pair = "transform(sequence(1, size(_bench_runs) div 2), i -> struct(_bench_runs[2 * i - 2] AS start, _bench_runs[2 * i - 1] AS end))"
    new = {
        "n_words": F.col("_bench_n"),
        "hits": F.expr(f"CASE WHEN size(_bench_runs) > 0 THEN {pair} ELSE array() END"),
        "items": F.col("_bench_items"),
        "longest": F.col("_bench_best"),
    }
    return d.select(*[c for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the documents in which a window of the benchmark stands."""
    d = _searched(docs, benchmark, window, SHARD_WORDS, BLOCK_BYTES)
    return d.where(F.size("_bench_runs") == 0).select(*docs.columns)


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match: one row per document of scan()."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.col("longest.words").alias("longest_match"),
    )
