"""Quality rules whose thresholds are quantiles of the data, as DataFrame expressions only.

Every document gets counts from its whole text. For each language and source a sketch of each rate
is built from the texts that pass the base rule: a histogram whose buckets are the rates' leading
BITS bits, so a quantile is off by 1 / 256 of its value at most, at any size. Sketches merge by
adding counts, so a language's and the whole table's come from merging their sources' without
reading the documents again, and reruns agree however rows are dealt out.

All fences come from the sketches. A rate's upper fence is q + multiple * spread, where q is the
group's quantile at that rate's `level` and spread the distance from the median to it, the
group's or the whole table's, whichever is larger: what most of the group does, and as far again
as texts spread. Where nothing spreads (all rates 0, say) the fence is that value. A rate is a
count over a length, so it has no finer resolution than one event: a text goes when it is beyond
the fence even with one event less. RULES gives levels and multiples; nothing else is fixed.

A small group knows little of itself: the fence of n texts is the mean of their own and their
language's, with weights n and `shrink`, and a language's that of its own and the table's. A table
of n texts reaches (n + shrink) / n times as far. No size switches from one rule to another.

Cases: null and empty texts have no words and fail the base rule; null language or source is a
group of its own; repeated rows are separate rows. Texts on a fence stay, so a table with one text
keeps it if it passes the base rule. Texts of any length are counted whole,
in one row; those of 2**24 words or more are compared word by word instead of by hash. An empty
table gives an empty result. Other columns are ignored unless asked for with `keep`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontime.llm.common import WORD, materialise, text_or_empty

#: Rate: (its count, its length, level of the quantile, multiple of its distance from the median,
#: whether low values fail too). Levels say what share of a group may be junk: characters and word
#: lengths leave room for a fifth; repeats are rare in most texts and frequent in a few good ones,
#: so their quantile lies further out.
RULES = {
    "symbol_rate": ("n_symbols", "word_chars", 0.80, 5.0, False),
    "shout_rate": ("n_shouts", "word_chars", 0.80, 5.0, False),
    "capital_rate": ("n_capitals", "word_chars", 0.80, 5.0, False),
    "dup_line_rate": ("n_dup_lines", "n_lines", 0.98, 3.0, False),
    "repeat_rate": ("n_repeat_words", "n_words", 0.98, 3.0, False),
    "word_length": ("word_chars", "n_words", 0.80, 5.0, True),
}
#: The base rule, over the counts.
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"

_BITS = 24  # of a packed number that hold a position in a text
_LOW = (1 << _BITS) - 1
_WHITE = " \t\n\x0b\x0c\r"


#: Positions of three-word windows found twice or more, by their words.
_EXACT = """sort_array(flatten(transform(array(sort_array(transform(sequence(0, _n - 3),
    i -> struct(_w[i] AS a, _w[i + 1] AS b, _w[i + 2] AS c, i AS i)))),
    s -> transform(filter(sequence(0, size(s) - 1),
        j -> (j > 0 AND struct(s[greatest(j - 1, 0)].a, s[greatest(j - 1, 0)].b, s[greatest(j - 1, 0)].c) = struct(s[j].a, s[j].b, s[j].c))
          OR (j < size(s) - 1 AND struct(s[least(j + 1, size(s) - 1)].a, s[least(j + 1, size(s) - 1)].b, s[least(j + 1, size(s) - 1)].c) = struct(s[j].a, s[j].b, s[j].c))),
        j -> s[j].i))))"""


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rates."""
    t = docs.select(*keep, text_or_empty().alias("_t"))
    t = t.select("*", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)).alias("_w"))
    t = t.select("*", F.size("_w").alias("_n"))
    # three-word windows as numbers: a hash above, the position below; equal windows sort together
    packed = f"""CASE WHEN _n BETWEEN 3 AND {_LOW} THEN sort_array(transform(sequence(0, _n - 3),
        i -> (xxhash64(_w[i], _w[i + 1], _w[i + 2]) & {~_LOW}) | i)) ELSE array() END"""
    t = t.select("*", F.expr(packed).alias("_p"))
    same = f"""(shiftright(_p[a], {_BITS}) = shiftright(_p[b], {_BITS})
        AND _w[int(_p[a] & {_LOW})] = _w[int(_p[b] & {_LOW})]
        AND _w[int(_p[a] & {_LOW}) + 1] = _w[int(_p[b] & {_LOW}) + 1]
        AND _w[int(_p[a] & {_LOW}) + 2] = _w[int(_p[b] & {_LOW}) + 2])"""
    at = lambda a, b: same.replace("[a]", f"[{a}]").replace("[b]", f"[{b}]")
    found = f"""CASE WHEN size(_p) > 1 THEN sort_array(transform(filter(sequence(0, size(_p) - 1),
        j -> (j > 0 AND {at('greatest(j - 1, 0)', 'j')}) OR (j < size(_p) - 1 AND {at('j', 'least(j + 1, size(_p) - 1)')})),
        j -> int(_p[j] & {_LOW}))) ELSE array() END"""
    # different windows with the same bits of hash may part equal ones: then words themselves are sorted
    clash = f"""size(_p) > 1 AND exists(sequence(1, size(_p) - 1),
        j -> shiftright(_p[j - 1], {_BITS}) = shiftright(_p[j], {_BITS}) AND NOT {at('j - 1', 'j')})"""
    t = t.select("*", F.expr(f"CASE WHEN _n > {_LOW} OR {clash} THEN {_EXACT} ELSE {found} END").alias("_r"))
    covered = """CASE WHEN size(_r) = 0 THEN 0L ELSE aggregate(sequence(0, size(_r) - 1), 3L,
        (s, k) -> s + CASE WHEN k = 0 THEN 0L ELSE least(3, _r[k] - _r[k - 1]) END) END"""
    t = t.select(
        *keep,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.translate("_t", _WHITE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(F.translate("_t", "!?", ""))).cast("long").alias("n_shouts"),
        (F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
        F.expr(covered).alias("n_repeat_words"),
    )
    lines = F.size("_l").cast("long")
    t = t.select("*", lines.alias("n_lines"), (lines - F.size(F.array_distinct("_l"))).alias("n_dup_lines"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouts", "n_capitals", "n_lines"]
    rates = [(F.col(a) / F.greatest(F.col(b), F.lit(1))).alias(rate) for rate, (a, b, *_) in RULES.items()]
    return t.select(*keep, *counts, *rates, F.expr(BASE_FAILED).alias("base_failed"))


#: Leading bits of a rate that tell buckets apart, and bits after the point that a rate is cut to.
BITS, POINT = 9, 20


def sketches(measured: DataFrame, *by: str) -> DataFrame:
    """by, rate, bucket, n: the histograms of the rates of texts that pass the base rule, for each of by.

    A bucket is named by its least value. At most 2**(BITS - 1) of them begin with the same power of two.
    """
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.floor(F.col(r) * F.lit(float(1 << POINT))).alias("v")) for r in RULES]))
    rows = measured.where("NOT base_failed").select(*by, each.alias("_r")).select(*by, "_r.rate", "_r.v")
    return rows.withColumn("bucket", F.expr(f"shiftleft(shiftright(v, {_dropped('v')}), {_dropped('v')})")).groupBy(*by, "rate", "bucket").agg(F.count("*").alias("n"))


def _dropped(v: str) -> str:
    return f"greatest(length(bin({v})) - {BITS}, 0)"


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """by, n, and for each fence start_<fence> and spread_<fence>, from the merged sketches of each of by.

    Quantiles are upper ends of buckets on an upper fence's side of the spread and least values on the other, so a
    spread is never less than what the sketch can tell apart.
    """
    merged = sketch.groupBy(*by, "rate", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "rate")  # a row per bucket, whatever the number of texts
    merged = merged.select(*by, "rate", "bucket", F.sum("n").over(w.orderBy("bucket")).alias("below"), F.sum("n").over(w).alias("total"))
    at = lambda rate, p: F.min(F.when((F.col("rate") == rate) & (F.col("below") * 100 >= F.col("total") * p), F.col("bucket")))
    starts, spreads = [F.max("total").alias("n")], []
    for name in fence_names():
        side, rate = name.split("_", 1)
        level = round(100 * RULES[rate][2])
        starts += [at(rate, level if side == "high" else 100 - level).alias(f"start_{name}"), at(rate, 50).alias(f"mid_{name}")]
        least, end = "CAST({0} AS double)", "CAST(CASE WHEN {0} = 0 THEN 0 ELSE {0} + shiftleft(1L, {1}) END AS double)"
        sides = zip((f"start_{name}", f"mid_{name}"), (end, least) if side == "high" else (least, end), strict=True)
        start, mid = (F.expr(value.format(c, _dropped(c))) / F.lit(float(1 << POINT)) for c, value in sides)
        spreads += [start.alias(f"start_{name}"), (start - mid if side == "high" else mid - start).alias(f"spread_{name}")]
    return merged.groupBy(*by).agg(*starts).select(*by, "n", *spreads)


def _fence(name: str, least_spread: float | None, wider: Column | None = None) -> Column:
    side, rate = name.split("_", 1)
    reach = F.lit(RULES[rate][3]) * F.greatest(F.col(f"spread_{name}"), F.lit(least_spread))
    reach = reach if wider is None else reach * wider
    return (F.col(f"start_{name}") + reach if side == "high" else F.col(f"start_{name}") - reach).alias(name)


def thresholds(measured: DataFrame, shrink: int = 50) -> DataFrame:
    """lang, source, group_docs, and low and high for each rate: one row per language and source.

    shrink: how many texts a language's fence weighs beside the group's own, and the table's beside a language's.
    """
    names = fence_names()
    sketch = materialise(sketches(measured, "lang", "source"), "quality-sketches")
    whole = quantiles(sketch).first()  # one row of numbers, nulls where no text passes
    spreads = {x: whole[f"spread_{x}"] for x in names}
    table = quantiles(sketch).select(*[_fence(x, spreads[x], (F.col("n") + shrink) / F.col("n")) for x in names]).first()

    def shrunk(name: str, above: Column) -> Column:
        return ((F.col("n") * F.col(name) + shrink * above) / (F.col("n") + shrink)).alias(name)

    by_lang = quantiles(sketch, "lang").select("lang", "n", *[_fence(x, spreads[x]) for x in names])
    by_lang = by_lang.select(F.col("lang").alias("l_lang"), *[shrunk(x, F.lit(table[x])).alias(f"l_{x}") for x in names])
    own = quantiles(sketch, "lang", "source").select("lang", "source", "n", *[_fence(x, spreads[x]) for x in names])
    g = own.join(by_lang, own["lang"].eqNullSafe(by_lang["l_lang"]))
    return g.select("lang", "source", F.col("n").alias("group_docs"), *[shrunk(x, F.col(f"l_{x}")) for x in names])


def fence_names() -> list[str]:
    return [x for rate, (*_, both) in RULES.items() for x in ([f"high_{rate}", f"low_{rate}"] if both else [f"high_{rate}"])]


def quality(docs: DataFrame, keep: list[str] | None = None, shrink: int = 50) -> DataFrame:
    """keep (doc_id) and the counts, base_failed, kept and reasons (rates beyond their fence)."""
    keep = list(keep or ["doc_id"])
    extra = [c for c in ("lang", "source") if c not in keep]
    m = materialise(measures(docs, keep + extra), "quality-counts", "zstd")
    limits = materialise(thresholds(m, shrink), "quality-limits")
    few = limits.count() <= 20_000  # under 4 MB
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    m = m.join(
        F.broadcast(limits) if few else limits,
        m["lang"].eqNullSafe(F.col("_lang")) & m["source"].eqNullSafe(F.col("_source")),
        "left",
    )
    beyond = {}
    for rate, (count, length, _, _, both) in RULES.items():
        moved = lambda by: (F.col(count) + by) / F.greatest(F.col(length), F.lit(1))  # noqa: B023, E731
        sides = [moved(-1) > F.col(f"high_{rate}")] + ([moved(1) < F.col(f"low_{rate}")] if both else [])
        beyond[rate] = F.coalesce(reduce(lambda a, b: a | b, sides), F.lit(False))
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in beyond.items()]))
    m = m.withColumn("reasons", reasons).withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))
    return m.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reasons")


def keep_good(docs: DataFrame, shrink: int = 50) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)],
                        F.col("text"), F.col("lang").alias("lang"), F.col("source").alias("source"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    q = quality(plain, names, shrink).where("kept")
    return q.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])

