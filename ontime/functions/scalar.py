"""Column expressions, all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 60_000_000


def minutes_between(later: Column, earlier: Column) -> Column:
    """Minutes as a double, for timestamps with or without a zone."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(MICROS_PER_MINUTE)


def clock(hhmm: Column) -> Column:
    """'HH:mm' from 5, 905, '0905' or 2400 (which is 00:00)."""
    padded = F.lpad(hhmm.cast("int").cast("string"), 4, "0")
    text = F.regexp_replace(padded, r"(\d\d)(\d\d)", "$1:$2")
    return F.when(text == "24:00", "00:00").otherwise(text)


def local_timestamp(date: Column, hhmm: Column, next_day_at_24: bool = True) -> Column:
    """Date and clock as a timestamp; 24:00 is the start of the next day (or, as an option, of
    the same day)."""
    ts = F.to_timestamp(F.concat_ws(" ", date.cast("string"), clock(hhmm)), "yyyy-MM-dd HH:mm")
    if next_day_at_24:
        ts = F.when(hhmm.cast("int") == 2400, ts + F.make_interval(days=F.lit(1))).otherwise(ts)
    return ts


def hours_before(ts: Column, hours: int) -> Column:
    return ts - F.make_interval(hours=F.lit(hours))


def to_utc(local: Column, zone: Column) -> Column:
    """Local time of a zone (IANA name, may be a column) as UTC; null without a zone."""
    return F.to_utc_timestamp(local, zone)


def missing_code(value: Column, code) -> Column:
    """Null where the value is the code for missing."""
    return F.nullif(value, F.lit(code))


def quality_flag(code: Column, bad: list[str]) -> Column:
    """1 for a good code, 0 for a bad one, null for none."""
    return F.when(code.isNull(), F.lit(None)).when(code.isin(bad), 0).otherwise(1).cast("int")


def mean_of_present(*values: Column) -> Column:
    """Whole mean of the values that are there; null unless their sum is above zero."""
    present = F.filter(F.array(*values), lambda x: x.isNotNull())
    total = F.aggregate(present, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(total > 0, F.try_divide(total, F.size(present))).cast("int")


def subfield(packed: Column, i: int, kind: str = "string", separator: str = ",") -> Column:
    """Subfield i of packed text; null when it isn't there or isn't of that kind."""
    return F.get(F.split(packed, separator), F.lit(i)).try_cast(kind)


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a seed and keys: the same for the same row however rows are dealt out."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def log_of(value: Column, shift: float = 1e-6) -> Column:
    return F.log(value + F.lit(shift))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def text_map(literal: Column) -> Column:
    """A map of string to int from text like {'a': 1, 'b': 2}."""
    return F.from_json(literal, "map<string,int>", {"allowSingleQuotes": "true"})
