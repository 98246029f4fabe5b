"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's share follows its weight, but no source is repeated more than `repeats` times;
what a source can't take is shared out among the others by weight. The mix is a number of
blocks of `block` tokens; sources get whole blocks by the highest quotients
target / (2k + 1), and each source's blocks go to its shards in the same way. A shard is a
part of one source, about `shard_tokens` tokens in a seeded order; its blocks are cut from
that order. A shard whose quota exceeds its blocks takes all of them once (or `repeats` times)
and then the leading blocks of the seeded order, so few documents are cut.

Highest quotients are found without listing all of them: the seats that every entry is sure to
get follow from bounds on the divisor, and only the few quotients around it are ranked.

Texts are counted once into a narrow table of sizes, from which shares, shards and quotas follow.

Cases: null and empty texts have size 0 and take nothing; a text of any length is one document, cut
at most once; null sources form one source, the
last; rows with equal or null ids are mixed as separate rows, in the order of id, then size.
An empty table gives an empty result. Other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontime.llm.common import WORD, materialise, text_or_empty

WEIGHTS = (3, 1, 2)


def md5_key(salt: str, name: str = "doc_id"):
    """A seeded order of ids that any SQL engine can repeat."""
    return F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(name).cast("string"), F.lit("null"))))


def _long_of_md5(column):
    return F.conv(F.substring(column, 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """Adds weight and target to a table of sources (source, source_size, n_docs).

    One row per source: weights are given for each, so this table is as small as a setting.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("rank", F.row_number().over(order))
    s = s.withColumn("weight", F.element_at(wheel, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source, by ratio, that isn't full sets the level for itself and all after it
    free = F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))
    s = s.withColumn("level", F.min(free).over(everything)["level"])
    return s.withColumn("target", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap")))


def sainte_lague(entries: DataFrame, group: list[str], claim: str, seats: str, order: str, out: str) -> DataFrame:
    """Adds `out`: how many of the group's `seats` each entry gets for its `claim`."""
    by = Window.partitionBy(*(group or [F.lit(1)]))
    e = entries.withColumn("_n", F.sum(F.when(F.col(claim) > 0, 1).otherwise(0)).over(by))
    e = e.withColumn("_t", F.sum(claim).over(by))
    low = F.floor(F.try_divide(F.col(claim) * (F.col(seats) - F.col("_n") / 2), F.col("_t")) - 1.5)
    high = F.ceil(F.try_divide(F.col(claim) * (F.col(seats) + F.col("_n") / 2), F.col("_t")) + 1.5)
    e = e.withColumn("_low", F.greatest(F.lit(0), F.coalesce(low, F.lit(0))).cast("long"))
    e = e.withColumn("_high", F.when(F.col(claim) > 0, F.greatest("_low", high)).otherwise(F.col("_low")).cast("long"))
    e = e.withColumn("_left", F.col(seats) - F.sum("_low").over(by))
    ks = F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1))
    q = e.withColumn("_k", F.explode_outer(ks))
    q = q.withColumn("_quotient", F.col(claim) / (2 * F.col("_k") + 1))
    best = by.orderBy(F.col("_quotient").desc_nulls_last(), F.col(order).asc(), F.col("_k"))
    q = q.withColumn("_won", F.when(F.col("_k").isNotNull() & (F.row_number().over(best) <= F.col("_left")), 1).otherwise(0))
    kept = [F.first(c).alias(c) for c in entries.columns if c not in (*group, order)]
    keys = [*group, order]
    return q.groupBy(*keys).agg(*kept, (F.first("_low") + F.sum("_won")).alias(out)).select(*entries.columns, out)


def quotas(sizes: DataFrame, weights, share, repeats, block, shard_tokens, shard_rows) -> DataFrame:
    """Blocks for each shard. sizes: source, size, key (seeded order)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    s = targets(sources, weights, share, repeats)
    s = s.withColumn("blocks", F.floor(F.col("total") / F.lit(float(block)) + 0.5))
    s = sainte_lague(s, [], "target", "blocks", "rank", "source_blocks")
    parts = F.greatest(F.ceil(F.col("source_size") / F.lit(shard_tokens)), F.ceil(F.col("n_docs") / F.lit(shard_rows)))
    return s.select("source", "rank", "source_size", "target", "source_blocks", F.greatest(F.lit(1), parts).alias("shards"))


def words_in(name: str = "text"):
    """The number of words of a text."""
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("long")


def _mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, repeats: int = 2, block: int = 16,
         shard_tokens: int = 1_000_000, shard_rows: int = 50_000, seed: int = 1, words: str | None = None) -> DataFrame:
    """The columns of docs as c0, c1, ..., and what mix adds."""
    rows = docs.select(
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)],
        F.col("doc_id").alias("doc_id"),
        F.col("source").alias("source"),
        (F.col(words).cast("long") if words else words_in()).alias("size"),
        md5_key(str(seed)).alias("key"),
    )
    sizes = rows.select("doc_id", "source", "size")
    sizes = sizes if words else materialise(sizes, "mix-sizes")
    sources = quotas(sizes.select("source", "size"), weights, share, repeats, block, shard_tokens, shard_rows)
    sources = materialise(sources, "mix-sources")
    few = sources.count() <= 50_000  # under a few MB
    named = sources.withColumnRenamed("source", "named")
    named = F.broadcast(named) if few else named
    shard = F.pmod(_long_of_md5(md5_key(f"{seed}:shard")), F.col("shards"))
    with_source = lambda df: df.join(named, F.col("source").eqNullSafe(F.col("named")), "left").withColumn("shard", shard)
    sums = with_source(sizes).groupBy("rank", "shard").agg(
        F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks")
    )
    sums = sums.withColumn("nb", F.ceil(F.col("shard_size") / F.lit(float(block))))
    sums = sums.withColumn("claim", F.col("shard_size").cast("double"))
    sums = sainte_lague(sums, ["rank"], "claim", "source_blocks", "shard", "quota")
    sums = materialise(
        sums.select("rank", "shard", "shard_size", "nb", F.least("quota", F.col("nb") * repeats).alias("quota")), "mix-shards"
    )
    small = F.broadcast(sums) if sums.count() <= 50_000 else sums
    order = Window.partitionBy("rank", "shard").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    full = with_source(rows).join(small, ["rank", "shard"])
    end = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    full = full.withColumn("start", end - F.col("size"))
    full = full.withColumn("passes", F.when(F.col("nb") > 0, F.floor(F.col("quota") / F.col("nb"))).otherwise(0).cast("long"))
    cut = (F.col("quota") - F.col("passes") * F.col("nb")) * block
    full = full.withColumn("extra", F.least("size", F.greatest(F.lit(0), cut - F.col("start"))).cast("long"))
    return full.withColumn("taken", F.col("passes") * F.col("size") + F.col("extra"))


ADDED = ["size", "source_size", "target", "taken", "passes", "extra"]


def mix(docs: DataFrame, **settings) -> DataFrame:
    """docs with size, source_size, target, taken, passes (whole copies) and extra (leading
    words of one more copy): taken = passes * size + extra. They replace columns of these names.

    Settings: weights, share, repeats, block, shard_tokens, shard_rows, seed, and words: a column of
    docs that holds the texts' sizes already, so that texts aren't needed.
    """
    mixed = _mix(docs, **settings)
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ADDED]
    return mixed.select(*kept, *ADDED)


def take(docs: DataFrame, **settings) -> DataFrame:
    """The mixed table: each row of docs as often as the mix takes it, all columns kept.

    Whole copies keep their text; a document cut by its shard's last block comes once more with
    the words up to there, joined by spaces.
    """
    mixed = _mix(docs, **settings)
    copies = F.concat(
        F.array_repeat(F.col("size"), F.col("passes").cast("int")),
        F.when(F.col("extra") > 0, F.array("extra")).otherwise(F.array().cast("array<bigint>")),
    )
    rows = mixed.withColumn("words", F.explode(copies)).where("words > 0")
    whole = F.col(f"c{docs.columns.index('text')}")
    cut = F.concat_ws(" ", F.slice(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), 1, F.col("words").cast("int")))
    text = F.when(F.col("words") == F.col("size"), whole).otherwise(cut)
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
