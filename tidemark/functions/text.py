"""Text rules shared by validation and canonicalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_whitespace(c: Column) -> Column:
    """Strip every Unicode white space character, not only U+0020."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(trim_whitespace(c) == "", F.lit(True))


def has_control(c: Column) -> Column:
    return c.rlike(r"\p{Cc}")


def bad_label(c: Column, limit: int) -> Column:
    """Required text: present, not blank, at most ``limit`` characters, no control characters."""
    return is_blank(c) | (F.length(c) > limit) | has_control(c)


def bad_identity(c: Column, limit: int = 200) -> Column:
    """Optional text: NULL is fine, anything else follows the label rule."""
    return c.isNotNull() & bad_label(c, limit)


def error_text(kind: Column, message: Column, limit: int = 1000) -> Column:
    return F.substring(F.concat(kind, F.lit(": "), message), 1, limit)


def account_bucket(username: Column) -> Column:
    """One of 4096 account buckets: the first 12 bits of SHA-256 of the normalised name."""
    name = F.when(F.length(username) <= 60, F.lower(trim_whitespace(username))).otherwise(F.lit("invalid"))
    return F.concat(F.lit("account-"), F.substring(F.sha2(name, 256), 1, 3))
