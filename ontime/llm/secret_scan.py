"""Secret scans over an incremental blob ledger, as DataFrame expressions only.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds one
row for each blob and rule version that was ever scanned. A scan looks only at pairs the
ledger lacks, one copy of each blob, however many paths hold it, appends what it found and
joins the findings back to all paths. Scanning again costs nothing for blobs already seen; a
new version of the rules costs one scan of each blob.

Spans are code points, end exclusive. Where a rule matched follows from the text between its
matches: split and extract give both, and their lengths add up to positions.

Cases: null text counts as empty; spans that start together stand in the order of RULES; a text of any
length is scanned whole, in one row; blobs without findings have ledger rows too, with no spans.
A null id is a path like any other. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontime.llm.common import materialise, text_or_empty

#: Rules in the order in which spans that start together are listed: kind, a cheap test in SQL
#: that holds wherever the pattern can match, the pattern, the group whose length counts, and
#: the least length. Those after the first three are additions.
RULES_VERSION = 1
RULES = [
    (
        "assign",
        "_low LIKE '%passw%' OR _low LIKE '%secret%' OR _low LIKE '%token%' OR _low LIKE '%api%key%'",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        12,
    ),
    ("access", "contains(_t, 'AKIA')", r"(AKIA[A-Z0-9]+)", 1, 18),
    ("hex", r"_t RLIKE '[0-9a-f]{16}'", r"([0-9a-f]{16,})", 1, 16),
    ("private_key", "contains(_t, 'PRIVATE KEY-----')", r"(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)", 1, 1),
    ("web_token", "contains(_t, 'eyJ')", r"(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 1, 1),
]
BASE = ("assign", "access", "hex")


SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"

#: Matches that one fold places. A fold copies its state at each step, so many matches of one text are placed
#: block by block, from where the blocks before end.
BLOCK = 256


def _spans(pattern: str, group: int, least: int, kind: str, rank: int) -> Column:
    """An array of (start, rank, kind, end) of the pattern's matches in _t."""
    pattern_lit = F.lit(pattern)
    whole = F.regexp_extract_all("_t", pattern_lit, F.lit(0))
    part = F.regexp_extract_all("_t", pattern_lit, F.lit(group))
    between = F.split("_t", pattern, -1)
    lengths = F.arrays_zip(
        F.transform(between, F.length).alias("gap"), F.transform(whole, F.length).alias("whole"), F.transform(part, F.length).alias("part")
    )
    until = lambda x: x["gap"] + F.coalesce(x["whole"], F.lit(0))

    def step(state, x):
        begin, end = state["at"] + x["gap"], state["at"] + until(x)
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        good = F.coalesce(x["part"] >= least, F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    def placed(block, begin):
        start = F.struct(begin.alias("at"), F.array().cast(SPANS).alias("found"))
        return F.aggregate(block, start, step, lambda x: x["found"])

    def all_placed(blocks):
        lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + until(x)))
        begins = F.aggregate(lengths, F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))
        return F.flatten(F.zip_with(blocks, F.slice(begins, 1, F.size(blocks)), placed))

    cut = lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(BLOCK)), lambda i: F.slice(x, i + 1, BLOCK))
    return _once(_once(lengths, cut), all_placed)


def _once(x: Column, f) -> Column:
    """f(x), with x computed once however often f names it."""
    return F.transform(F.array(x), f)[0]


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """blob, spans: what the rules find in each blob's text, in order of start and rule."""
    empty = F.array().cast(SPANS)
    t = blobs.select("blob", text_or_empty().alias("_t"))
    t = t.withColumn("_low", F.lower("_t"))
    found = [
        F.when(F.expr(test), _spans(pattern, group, least, kind, rank)).otherwise(empty)
        for rank, (kind, test, pattern, group, least) in enumerate(rules)
    ]
    return t.select("blob", F.array_sort(F.concat(*found)).alias("spans"))


#: Blobs with several paths that are sent to all tasks, 40 bytes each.
FEW = 100_000

LEDGER = f"blob binary, rules int, spans {SPANS}"
_NO_ID = -(1 << 63)


def versions(docs: DataFrame) -> DataFrame:
    """doc_id, id (null: the least long), blob (binary SHA-256), text: a row for each path's version."""
    d = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), text_or_empty().alias("text"))
    return d.select("doc_id", "id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("blob"), "text")


def extend_ledger(all_versions: DataFrame, paths: DataFrame, ledger: DataFrame | None, rules=RULES, version: int = RULES_VERSION) -> DataFrame:
    """Ledger rows of the blobs in paths that `ledger` lacks under this version of the rules.

    One copy of each unseen blob is scanned, the one with the largest id. Without a ledger only blobs
    with several paths have to be told apart: where these are few, texts stay where they are.
    """
    one = paths.groupBy("blob").agg(F.max("id").alias("id"), F.count("*").alias("n"))
    texts = all_versions.select("blob", "id", "text")
    copies = None
    if ledger is not None:
        one = one.join(ledger.where(F.col("rules") == version), "blob", "left_anti")
    else:
        copies = materialise(one.where("n > 1").select("blob", F.col("id").alias("last")), "blob-copies")
    if copies is not None and copies.count() <= FEW:
        unseen = texts.join(F.broadcast(copies), "blob", "left").where(F.col("last").isNull() | (F.col("id") == F.col("last")))
    else:  # by both keys, so that the copies of one blob are dealt out
        unseen = texts.join(one.select("blob", "id"), ["blob", "id"])
    # rows that share id and content are scanned twice, but noted once
    return scan(unseen, rules).select("blob", F.lit(version).alias("rules"), "spans").dropDuplicates(["blob"])


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES, version: int = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """(doc_id, blob, spans for every path; the ledger with the new rows)."""
    all_versions = versions(docs)
    paths = materialise(all_versions.select("doc_id", "id", "blob"), "blob-paths")
    new = materialise(extend_ledger(all_versions, paths, ledger, rules, version), "blob-ledger")
    known = new if ledger is None else ledger.unionByName(new)
    found = known.where((F.col("rules") == version) & (F.size("spans") > 0)).select("blob", "spans")
    return paths.join(found, "blob", "left").select("doc_id", "blob", "spans"), known


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(findings: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text) from (doc_id, spans)."""
    spans = F.coalesce("spans", F.array().cast(SPANS))
    f = findings.select("doc_id", spans.alias("s"))
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("s", lambda x: x["kind"].isin(*BASE))
    return f.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"))
