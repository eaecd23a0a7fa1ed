"""Column functions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_match(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """First match or null."""
    return F.regexp_substr(text, F.lit(("(?i)" if ignore_case else "") + pattern))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def after_anchor(text: Column, anchor: Column) -> Column:
    """What follows the first occurrence of the lower-case ``anchor``, without white space and colons before it; null without one."""
    at = F.instr(F.lower(text), anchor)
    rest = strip(F.substring(text, at + F.length(anchor), F.length(text)))
    return F.when(at > 0, F.regexp_replace(rest, r"^:+", ""))


def mask(value: Column) -> Column:
    """First four characters and four stars; four stars for short values."""
    return F.when(F.length(value) <= 4, F.lit("****")).otherwise(F.concat(F.left(value, F.lit(4)), F.lit("****")))


def mask_display(value: Column) -> Column:
    """As ``mask``, but short values stay as they are."""
    return F.when(F.length(value) <= 4, value).otherwise(F.concat(F.left(value, F.lit(4)), F.lit("****")))


def risk_label(score: Column) -> Column:
    return F.when(score >= 60, "high").when(score >= 30, "medium").otherwise("low")


def confidence_label(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.7, "medium").otherwise("low")


def percent(x: Column) -> Column:
    return F.concat(F.bround(x * 100, 0).cast("int").cast("string"), F.lit("%"))


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Label of ``key``, or the key itself, or a dash for null."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(pairs[key], key, F.lit("—"))


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


def email_local_part(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(1))


def scan_key(*parts: Column) -> Column:
    """A stable identifier of a scan, from what makes it one: the same input gets the same key in every run."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts]), 256)
