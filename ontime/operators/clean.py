"""Projection, filtering and cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontime import columns as C
from ontime.functions import scalar as S


def cast_all(df: DataFrame, columns: list[str], kind: str = "string") -> DataFrame:
    return df.withColumns({c: F.col(c).cast(kind) for c in columns})


def to_integers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Whole numbers, with the colon of clock texts left out; null where it isn't a number."""
    text = {c for c, kind in df.dtypes if kind == "string"}
    plain = lambda c: F.regexp_replace(c, ":", "") if c in text else F.col(c)
    return df.withColumns({c: plain(c).try_cast("int") for c in columns})


def drop_duplicates(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row for each key: the first in the order of `order`, or else of all other columns, nulls
    first. So reruns agree; an aggregate, so most duplicates go before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.select(*keys).distinct()
    row = F.min(F.struct(*[c for c in dict.fromkeys([*(order or []), *others]) if c not in keys]))
    kept = df.groupBy(*keys).agg(row.alias("_row"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def duplicate_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows before, after, dropped, and dropped as a percentage of those left."""
    before = df.agg(F.count("*").alias("before"))
    after = df.select(*keys).distinct().agg(F.count("*").alias("after"))
    dropped = F.col("before") - F.col("after")
    both = before.crossJoin(after)  # a row each
    return both.select("before", "after", dropped.alias("dropped"), F.round(F.try_divide(dropped * 100, "after"), 2).alias("percent"))


#: Bits of a Bloom filter for each key, hashes of a key, and bytes up to which the filter is sent to all tasks.
BLOOM_BITS, BLOOM_HASHES, BLOOM_BYTES = 16, 3, 64 << 20


def _bloom_place(keys: list[str], n: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(n), *[F.col(k) for k in keys]), F.lit(bits))


def bloom_filter(df: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """_part, _bits: a Bloom filter of the rows' keys, as bitmaps of 32768 bits each, built by one aggregation."""
    places = F.explode(F.array(*[_bloom_place(keys, n, bits) for n in range(BLOOM_HASHES)]))
    each = df.select(places.alias("_place"))
    return each.groupBy(F.bitmap_bucket_number("_place").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))


def maybe_in(df: DataFrame, keys: list[str], bloom: DataFrame, bits: int) -> DataFrame:
    """Rows whose keys the filter may hold: all that it holds, and few others. The filter is sent to the rows, which
    are not shuffled. Rows with a null key count as keys too."""
    columns = df.columns
    for n in range(BLOOM_HASHES):
        df = df.withColumn("_place", _bloom_place(keys, n, bits))
        df = df.join(F.broadcast(bloom), F.bitmap_bucket_number("_place") == F.col("_part"))
        at = F.bitmap_bit_position("_place")
        octet = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        df = df.where(F.expr("1") == F.call_function("getbit", octet, (at % 8).cast("int"))).select(*columns)
    return df


def new_rows(new: DataFrame, history: DataFrame, keys: list[str], order: list[str] | None = None, bloom: bool | None = None) -> DataFrame:
    """Rows of a new period whose keys history lacks, one per key (see drop_duplicates). Null keys equal each other.

    History may be very large, so only its suspects are shuffled: rows that a Bloom filter of the new keys lets
    through, about one in 200 of the others. The filter is built if it fits (BLOOM_BYTES), else history's keys are
    joined as they are; the result is the same. bloom: decide it.
    """
    fresh = drop_duplicates(new, keys, order)
    old = history.select(*keys)
    if bloom is None or bloom:
        bits = max(1 << 15, 1 << (BLOOM_BITS * max(new.count(), 1) - 1).bit_length())
        if bloom or bits // 8 <= BLOOM_BYTES:
            old = maybe_in(old, keys, bloom_filter(new, keys, bits), bits)
    known = old.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return fresh.join(known, reduce(lambda a, b: a & b, same), "left_anti")


def fill(df: DataFrame, columns: list[str], value=0) -> DataFrame:
    """Fill nulls whatever the columns' types: the value is cast to each (Spark's fillna skips
    columns of other types)."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value).cast(kinds[c])) for c in columns})


def drop_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=columns)


def between_dates(df: DataFrame, column: str, start=None, until=None) -> DataFrame:
    """start <= column < until."""
    kind = dict(df.dtypes)[column]
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast(kind))
    if until is not None:
        df = df.where(F.col(column) < F.lit(until).cast(kind))
    return df


def split_packed(df: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """Replace packed columns by typed columns KEY_Subfield. fields: column -> 'Name:int Name ...'."""
    if fields is None:
        fields = {c: C.PACKED_FIELDS[family] for c, family in C.packed_columns().items()}
    out = [F.col(c) for c in df.columns if c not in fields]
    for column, spec in fields.items():
        for i, sub in enumerate(spec.split()):
            name, _, kind = sub.partition(":")
            out.append(S.subfield(F.col(column), i, kind or "string").alias(f"{column}_{name}"))
    return df.select(*out)


def flag_quality(df: DataFrame, bad: list[str] | None = None, quality: dict[str, list[str]] | None = None) -> DataFrame:
    """Quality codes as flags, and null for the values that a bad code vouches for."""
    bad = C.BAD_QUALITY if bad is None else bad
    quality = C.quality_columns() if quality is None else quality
    new = {}
    for flag, values in quality.items():
        new[flag] = S.quality_flag(F.col(flag), bad)
        new |= {v: F.when(~F.coalesce(F.col(flag).isin(bad), F.lit(False)), F.col(v)) for v in values}
    return df.withColumns(new)


def calm_wind(df: DataFrame, kind: str = "WND_Type", speed: str = "WND_Speed", calm_speed: int = 0) -> DataFrame:
    """Wind of unknown type and no speed is calm: type C. Comes before missing codes go."""
    calm = (F.col(kind) == "9") & (F.col(speed) == calm_speed)
    return df.withColumn(kind, F.when(calm, "C").otherwise(F.col(kind)))


def null_codes(df: DataFrame, codes: dict[str, object] | None = None) -> DataFrame:
    """Null where a value is its column's code for missing."""
    codes = C.by_column(C.MISSING_CODES) if codes is None else codes
    return df.withColumns({c: S.missing_code(F.col(c), code) for c, code in codes.items()})


def average_repeated(df: DataFrame, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Replace repeated columns by the whole mean of those present."""
    if groups is None:
        groups = {}
        for family, sub, n in (("AA", "RainDepth", 4), ("AL", "SnowAccumDepth", 2), ("AA", "RainDuration", 4), ("AL", "SnowAccumDuration", 2)):
            groups[f"{family}_{sub}"] = [f"{family}{i}_{sub}" for i in range(1, n + 1)]
    used = [c for cols in groups.values() for c in cols]
    return df.withColumns({name: S.mean_of_present(*map(F.col, cols)) for name, cols in groups.items()}).drop(*used)


def merge_first(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The first value that is there, in the order of columns; replaces them."""
    return df.withColumn(name, F.coalesce(*columns)).drop(*[c for c in columns if c != name])


def key_of(df: DataFrame, columns: list[str], name: str, separator: str = "-") -> DataFrame:
    """Joined text key; null if a part is null."""
    parts = [F.col(columns[0]).cast("string")]
    for c in columns[1:]:
        parts += [F.lit(separator), F.col(c).cast("string")]
    return df.withColumn(name, F.concat(*parts))


def dtypes_split(df: DataFrame) -> tuple[list[str], list[str]]:
    """Text columns, and all others."""
    text = [c for c, kind in df.dtypes if kind == "string"]
    return text, [c for c in df.columns if c not in text]


def drop_constant(df: DataFrame, rsd: float = 0.05) -> DataFrame:
    """Without the columns that have one value (or none) throughout, found in one pass."""
    counts = df.agg(*[F.approx_count_distinct(c, rsd).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if counts[c] <= 1])


def drop_nearly_empty(df: DataFrame, most: float = 0.99) -> DataFrame:
    """Without the columns of which more than a share `most` is null, found in one pass."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if (shares[c] or 0.0) > most])


def plain_columns(df: DataFrame) -> list[str]:
    """Columns with one value, so neither vectors nor nested."""
    return [c for c, kind in df.dtypes if kind.partition("(")[0].partition("<")[0] not in ("array", "map", "struct", "vector", "udt")]


def sample(df: DataFrame, fraction: float, seed: int, key: list[str] | None = None) -> DataFrame:
    """About a fraction of the rows, chosen by a hash of key (else of all plain columns): reruns agree
    however the rows are dealt out, and rows with equal keys stay or go together."""
    return df.where(S.uniform(seed, *[F.col(c) for c in key or plain_columns(df)]) < F.lit(float(fraction)))


def split_by_month(df: DataFrame, month: str, last: int, day: str | None = None, last_day: int | None = None):
    """(train, test): up to a month (and, within it, a day), and after."""
    early = F.col(month).cast("int") <= last
    if day is not None:
        m = F.col(month).cast("int")
        early = (m < last) | ((m == last) & (F.col(day).cast("int") <= last_day))
    return df.where(early), df.where(~early)


def hub_flags(df: DataFrame, hubs: dict[str, list[str]], carrier: str = "OP_UNIQUE_CARRIER", airport: str = "ORIGIN", name: str = "is_hub") -> DataFrame:
    """1 where the airport is a hub of the carrier."""
    any_of = F.lit(False)
    for c, airports in hubs.items():
        any_of = any_of | ((F.col(carrier) == c) & F.col(airport).isin(airports))
    return df.withColumn(name, F.coalesce(any_of, F.lit(False)).cast("int"))
