"""Time expressions over TIMESTAMP_NTZ columns that hold UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
BUCKET_MICROS = {"hour": 3_600_000_000, "day": 86_400_000_000}


def micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ts)


def from_micros(value: Column) -> Column:
    return F.timestamp_add("MICROSECOND", value, F.expr(EPOCH))


def plus_micros(ts: Column, value: Column) -> Column:
    return F.timestamp_add("MICROSECOND", value, ts)


def bucket(ts: Column, interval: str) -> Column:
    """UTC bucket start. ``date_trunc`` would return a zoned timestamp."""
    if interval not in BUCKET_MICROS:
        raise ValueError("Use hour or day. Buckets use UTC.")
    return plus_micros(ts, -F.pmod(micros(ts), F.lit(BUCKET_MICROS[interval])))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def at_least_zero(seconds: Column) -> Column:
    # greatest() skips nulls, so an absent age has to stay absent explicitly.
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds))


def parse_instant(text: Column) -> Column:
    """ISO-8601 with offset to a UTC instant, cut (not rounded) to microseconds; NULL when malformed."""
    shape = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)\d*(Z|[+-]\d{2}:\d{2})?$"
    cut = F.regexp_replace(text, shape, "$1$2")
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:\d{2})$"), cut).otherwise(F.concat(cut, F.lit("Z")))
    return F.when(text.rlike(shape), from_micros(F.unix_micros(zoned.try_cast("timestamp"))))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def mirror_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMM")
