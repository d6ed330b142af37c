"""Column functions; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS, HOUR_MS = 86_400_000, 3_600_000


def bucket_start(ts: Column, width_ms: int) -> Column:
    """Floor to the bucket, for times before the epoch too."""
    return ts - F.pmod(ts, F.lit(width_ms))


def utc(ts_ms: Column, pattern: str) -> Column:
    return F.date_format(F.timestamp_millis(ts_ms), pattern)


def event_hour(ts_ms: Column) -> Column:
    return utc(ts_ms, "yyyy-MM-dd'T'HH")


def event_date(ts_ms: Column) -> Column:
    return utc(ts_ms, "yyyy-MM-dd")


def hour_range_start(hour: Column) -> Column:
    return F.unix_millis(F.to_timestamp(hour, "yyyy-MM-dd'T'HH"))


def device_bucket(device_id: Column, buckets: int = 16) -> Column:
    """SHA-1 of the id modulo a power of two up to 2**28 (the last hex digits decide)."""
    if buckets & (buckets - 1) or not 0 < buckets <= 1 << 28:
        raise ValueError("buckets must be a power of two")
    return F.pmod(F.conv(F.right(F.sha1(device_id.cast("binary")), F.lit(7)), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def payload_hash(text: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.left(F.sha1(text.cast("binary")), F.lit(16)))


def canonical_json(fields: dict[str, Column]) -> Column:
    """The fields as compact JSON, names in order, nulls kept: what payload_hash takes. Numbers are in Spark's own text."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_DIGITS = r"\d+(_\d+)*"


def stripped(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, _ENDS, "")


def strict_cast(raw: Column, kind: str, given: str = "string") -> Column:
    """The value, or null where a strict reader would refuse it. ``given``: the type of raw, as in dtypes.

    Text becomes a float or an int only if it is written as one ("2.0" is no int), a number an int only if it is whole,
    and nothing but a boolean, "true" or "false" a bool. Ints are of 64 bits."""
    if kind not in ("float", "int", "bool"):
        return F.initcap(raw.cast("string")) if given == "boolean" else raw.cast("string")
    if given == "string":
        t = stripped(raw)
        plain = F.replace(t, F.lit("_"), F.lit(""))
        if kind == "float":
            number = t.rlike(rf"^[+-]?({_DIGITS}\.?({_DIGITS})?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$")
            named = F.lower(F.ltrim(t, F.lit("+")))
            return F.when(number, plain.try_cast("double")).when(named.rlike("^-?nan$"), float("nan")).when(named.rlike("^-?inf(inity)?$"), F.when(F.left(named, F.lit(1)) == "-", float("-inf")).otherwise(float("inf")))
        if kind == "int":
            return F.when(t.rlike(rf"^[+-]?{_DIGITS}$"), plain.try_cast("bigint"))
        return F.when(F.lower(t) == "true", True).when(F.lower(t) == "false", False)
    if kind == "bool":
        return raw if given == "boolean" else F.lit(None).cast("boolean")
    if kind == "float":
        return raw.cast("double")
    return F.when(raw.cast("double") == F.floor(raw.cast("double")), raw.try_cast("bigint")) if given in ("double", "float") else raw.try_cast("bigint")


def percent(x: Column, digits: int = 0) -> Column:
    """A share as text; n/a for null."""
    return F.coalesce(F.concat(F.format_number(100 * x, digits), F.lit("%")), F.lit("n/a"))


def half_even(x: Column) -> Column:
    return F.bround(x).cast("long")


def stats(x: Column, prefix: str = "") -> list[Column]:
    """count, min, median, p90, max and mean; null for no values."""
    p = F.percentile(x, F.array(F.lit(0.5), F.lit(0.9)))
    return [F.count(x).alias(f"{prefix}n"), F.min(x).alias(f"{prefix}min"), F.round(p[0], 6).alias(f"{prefix}median"), F.round(p[1], 6).alias(f"{prefix}p90"), F.max(x).alias(f"{prefix}max"), F.round(F.avg(x), 6).alias(f"{prefix}mean")]


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
