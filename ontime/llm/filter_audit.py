"""Filter interaction audit: what every filter removes, alone and after others, in all orders.

A document's mask has a bit for each filter that it fails. Four filters look at one text; the
fifth asks whether the same text stands in a document with a smaller id, anywhere in the table:

1. Where texts are read, a task keeps in mind the texts it has seen, up to a bound. A copy with a larger id
   than one of them is a duplicate at once; only a text with the smallest id so far goes on. So of a text
   that fills a third of the table, one row or few per task are left.
2. Texts are dealt out by prefixes of their own: 16 characters, and where a prefix has more than its
   share of the table's bytes, 256 or 4096; below a head that long the whole text's digest is added. A
   text's prefixes are hashed when it is read, so one count of hashes finds the heavy ones, `parts` of a
   length at most. Prefixes are the keys of a range partitioning; inside a task texts are sorted.
3. Prefix by prefix, a task inserts full texts into a compressed trie, whose terminals hold the smallest id. A
   row that comes after a smaller id, or before one, is a duplicate. A trie that has grown over its bound is
   given out when another text follows: all texts before that one are complete.
4. Rows are narrow now (id, part, mask); labels join them, and they are counted by part and mask. All
   orders, steps and Shapley sums come from these counts.

Cases: null text is empty text, and equal to it. Rows with equal ids are never smaller than one another; a
null id is larger than any other. Null parts and empty ones are one part. Several labels of one id count as
quality and toxic if one of them says so; unlabelled documents are neither. An empty table gives an empty
result. Other columns are ignored. Words of very long texts are counted in stretches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontime.llm.common import drop_tables, materialise, text_chunks, text_or_empty

FILTERS = "ABCDE"
LAST_ID = (1 << 63) - 1
#: Bytes of texts that a task keeps in mind; that a trie may hold; characters of prefixes, shorter ones first.
SEEN_BYTES, TRIE_BYTES, LENGTHS = 32 << 20, 8 << 20, (16, 256, 4096)
#: Into how many equal shares the texts' bytes are thought to be cut, at least and at most, and bytes of a share between.
PARTS, MOST_PARTS, PART_BYTES = 4096, 50_000, 64 << 20
#: Bytes of a text whose words are looked at together.
STRETCH = 4 << 20

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = re.compile(rb"[#$%&*|]")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _stretches(raw: bytes) -> Iterator[bytes]:
    at = 0
    while len(raw) - at > STRETCH:
        cut = _SPACE.search(raw, at + STRETCH)
        stop = cut.start() if cut else len(raw)
        yield raw[at:stop]
        at = stop
    yield raw[at:] if at else raw


def mask_of(raw: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    n, distinct = 0, set()
    for part in _stretches(raw):
        words = part.split()  # ASCII white space is what the words are told apart by
        n += len(words)
        distinct.update(words)
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    points = len(raw) - len(raw.translate(None, bytes(range(0x80, 0xC0)))) if not raw.isascii() else 0
    return (n < 50) | (100 * len(distinct) < 65 * n) << 1 | (100 * capitals > 5 * (len(raw) - points)) << 2 | bool(_MARKS.search(raw)) << 3


DUPLICATE = 1 << 4
_ROW = pa.schema([("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("text", pa.string()), ("size", pa.int64()), ("heads", pa.list_(pa.int64()))])
MEASURED = "id long, part string, mask int, text string, size long, heads array<long>"


def _heads(text: str) -> list[int]:
    """Hashes of a text's prefixes: of one as long as each of LENGTHS that is shorter than the text."""
    return [xxhash.xxh64_intdigest(text[:n].encode()) - (1 << 63) for n in LENGTHS if n < len(text)]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, part, mask, and the text of rows that may be the first of their text (others: null)."""
    seen: dict[bytes, int] = {}
    held = 0
    for batch in text_chunks(batches):
        ids, parts, texts = (batch.column(c).to_pylist() for c in ("id", "part", "text"))
        masks, kept = [], []
        for i, text in zip(ids, texts, strict=True):
            raw = text.encode()
            mask, least = mask_of(raw), seen.get(raw)
            first = least is None or i <= least
            if first:
                if least is None:
                    held += len(raw) + 128
                    if held > SEEN_BYTES:
                        seen, held = {}, len(raw) + 128
                seen[raw] = i
            masks.append(mask if first else mask | DUPLICATE)
            kept.append(text if first else None)
        sizes = [None if t is None else len(t.encode()) for t in kept]
        heads = [None if t is None else _heads(t) for t in kept]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, parts, masks, kept, sizes, heads), _ROW, strict=True)], schema=_ROW)


class Trie:
    """A compressed trie of byte strings; a terminal holds the smallest id of its string and the rows with that id."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = [b"", {}, None]  # label, children by first byte, terminal

    def insert(self, raw: bytes) -> list:
        """The terminal of a string: [smallest id or None, rows]."""
        node, at = self.root, 0
        while at < len(raw):
            below = node[1].get(raw[at])
            if below is None:
                node[1][raw[at]] = below = [raw[at:], {}, None]
                node = below
                break
            label = below[0]
            if not raw.startswith(label, at):
                same = _common(label, raw, at)
                upper = [label[:same], {label[same]: below}, None]
                below[0] = label[same:]
                node[1][raw[at]] = below = upper
            node, at = below, at + len(below[0])
        if node[2] is None:
            node[2] = [None, []]
        return node[2]

    def terminals(self) -> Iterator[list]:
        stack = [self.root]
        while stack:
            _, children, terminal = stack.pop()
            if terminal is not None:
                yield terminal
            stack.extend(children.values())


def _common(label: bytes, raw: bytes, at: int) -> int:
    """How many bytes of label raw has from `at` on: less than all of them."""
    low, high = 1, len(label) - 1
    while low < high:
        mid = (low + high + 1) >> 1
        if raw.startswith(label[:mid], at):
            low = mid
        else:
            high = mid - 1
    return low


def _tries(most: int):
    """Rows with their duplicate bit; rows come sorted by prefix and text."""

    def flush(rows):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], ["id", "part", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, prefix, last, out = Trie(), 0, None, None, []
        for batch in text_chunks(batches):
            for key, text, i, part, mask in zip(*[batch.column(c).to_pylist() for c in ("prefix", "text", "id", "part", "mask")], strict=True):
                raw = text.encode()
                if key != prefix or (held > most and raw != last):
                    out += _firsts(trie)
                    trie, held, prefix = Trie(), 0, key
                terminal = trie.insert(raw)
                least = terminal[0]
                if least is None or i < least:
                    if least is None:
                        held += len(raw) + 256
                    else:
                        out += [(x, p, m | DUPLICATE) for (x, p, m), n in terminal[1].items() for _ in range(n)]
                    terminal[0], terminal[1] = i, {(i, part, mask): 1}
                elif i == least:  # rows of one id: counted, not listed
                    terminal[1][(i, part, mask)] = terminal[1].get((i, part, mask), 0) + 1
                else:
                    out.append((i, part, mask | DUPLICATE))
                last = raw
                if len(out) >= 10_000:
                    yield flush(out)
                    out = []
        out += _firsts(trie)
        if out:
            yield flush(out)

    return run


def _firsts(trie: Trie) -> list[tuple]:
    return [row for _, rows in trie.terminals() if rows for row, n in rows.items() for _ in range(n)]


def prefixed(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Adds prefix, the key by which texts are dealt out, to rows as MEASURED with text.

    parts: a prefix is heavy from this part of all bytes on (default: by the table's size).
    """
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = parts or min(max(PARTS, total // PART_BYTES), MOST_PARTS)
    hashes = rows.select("size", F.posexplode("heads").alias("level", "head"))
    sums = hashes.groupBy("level", "head").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * parts > total)
    heavy: list[set] = [set() for _ in LENGTHS]
    for level, head, _ in sums.toLocalIterator():
        heavy[level].add(head)

    @F.pandas_udf("int")
    def cut(heads: pd.Series) -> pd.Series:
        """Characters of the prefix; 0 if even the longest one is heavy."""

        def one(found):
            for level, n in enumerate(LENGTHS):
                if level >= len(found) or found[level] not in heavy[level]:
                    return n
            return 0

        return heads.map(one)

    cuts = rows.withColumn("_cut", cut("heads"))
    longest = F.concat(F.substring("text", 1, LENGTHS[-1]), F.sha2("text", 256))
    prefix = F.when(F.col("_cut") == 0, longest).otherwise(F.expr("substring(text, 1, _cut)"))
    return cuts.select("id", "part", "mask", "text", prefix.alias("prefix"))


def masks(docs: DataFrame, part: str = "source", trie_bytes: int = TRIE_BYTES, parts: int | None = None) -> DataFrame:
    """id, part, mask (bits of A to E that the document fails): one row per row of docs."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_or_empty().alias("text"))
    rows = materialise(d.mapInArrow(_measure, MEASURED), "measured")
    texts = prefixed(rows.where("text IS NOT NULL"), parts)
    dealt = texts.repartitionByRange("prefix").sortWithinPartitions("prefix", "text")
    tried = dealt.mapInArrow(_tries(trie_bytes), "id long, part string, mask int")
    out = materialise(tried.unionByName(rows.where("text IS NULL").select("id", "part", "mask")), "masks")
    drop_tables(rows)
    return out


def cells(found: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: counts of documents."""
    flags = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    joined = found.join(flags, "id", "left")
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def interactions(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and what the step's filter does there: a row per part, order and step.

    counts: as cells() gives them, 32 at most for a part. Each part becomes one row with its masks in an array,
    on which all orders and steps are sums.
    """
    orders = ["".join(p) for p in permutations(FILTERS)]
    per_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    rows = per_part.select("part", "cells", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda letter: F.expr(f"shiftleft(1, instr('{FILTERS}', {letter}) - 1)")
    rows = rows.withColumn("own", bit("substring(filter_order, step, 1)"))
    before = F.expr(f"aggregate(sequence(1, step), 0, (acc, i) -> acc | CASE WHEN i < step THEN shiftleft(1, instr('{FILTERS}', substring(filter_order, i, 1)) - 1) ELSE 0 END)")
    rows = rows.withColumn("before", before)
    some = lambda what, when: F.expr(f"aggregate(filter(cells, c -> {when}), 0L, (acc, c) -> acc + {what})")
    fails, earlier = "(c.mask & own) <> 0", "(c.mask & before) <> 0"
    removed = f"{fails} AND NOT {earlier}"
    # a document leaves at a filter in as many of the 120 orders as it fails filters, turn by turn
    return rows.select(
        "part", "filter_order", "step",
        some("c.n", f"NOT ({fails}) AND NOT {earlier}").alias("kept"),
        some("c.n", removed).alias("removed"),
        some("c.n", f"{fails} AND {earlier}").alias("redundant"),
        some("c.n", "c.mask = own").alias("unique_fails"),
        some("c.good", removed).alias("good_lost"),
        some("c.toxic", removed).alias("toxic_lost"),
        some(f"c.n * CAST({len(orders)} div bit_count(c.mask) AS bigint)", fails).alias("shapley"),
    )


def shares(audit: DataFrame) -> Column:
    """Shapley value of a filter: documents it removes, on average over all orders."""
    return audit["shapley"] / len(list(permutations(FILTERS)))


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source", trie_bytes: int = TRIE_BYTES, parts: int | None = None) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return interactions(cells(masks(docs, part, trie_bytes, parts), labels))
