"""Text normalisation and keys, as expressions that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that do not count in a loose key, and the informal self-references.
NOISE = r"(?U)[\s，。,.!?！？、:：;；~～'\"“”‘’（）()《》<>【】\[\]\-_]+"
SELF_REFERENCES = {"小妹": "我", "妹子": "我"}
TAG = "<[^>]+>"
PLACEHOLDER = r"\[[^\]]+\]"
LONG_DIGITS = r"(?U)\d{8,}"
BLANKS = r"(?U)\s+"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """*use* of a value that is computed once, however often *use* names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Tags out, self-references levelled, runs of blanks to one blank, ends trimmed; null gives ''."""
    out = F.regexp_replace(text_or_empty(c), TAG, "")
    for old, new in SELF_REFERENCES.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return strip(F.regexp_replace(out, BLANKS, " "))


def loose_key(c: Column) -> Column:
    """Blanks and punctuation deleted, lower case."""
    return F.lower(F.regexp_replace(text_or_empty(c), NOISE, ""))


def compact_length(c: Column) -> Column:
    return F.length(loose_key(c))


def short_hash(c: Column, length: int = 12) -> Column:
    return F.substring(F.sha1(text_or_empty(c)), 1, length)


def raw_id(index: Column, *parts: Column) -> Column:
    """raw_<six digits>_<eight hex digits of the hash of the canonical JSON>."""
    return F.format_string("raw_%06d_%s", index, F.substring(F.sha1(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})), 1, 8))


def first_filled(*cs: Column, default: str = "unknown") -> Column:
    """The first value that is neither null nor ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(default))


def wide_length(c: Column) -> Column:
    """Characters that are neither ASCII nor blank."""
    return F.length(F.regexp_replace(text_or_empty(c), r"(?U)[\x00-\x7F\s]", ""))


def key_stutters(key: Column) -> Column:
    """:func:`stutters` of a loose key."""
    return key.rlike(r"(.{3,24})\1{2}") | key.rlike(r"(.)\1{5}") | key.rlike(r"(.{2})\1{5}")


def stutters(c: Column) -> Column:
    """A span of 3-24 characters three times in a row, or of 1-2 characters six times, on the loose key."""
    return bind(loose_key(c), key_stutters)


def placeholder_count(*cs: Column) -> Column:
    return F.regexp_count(F.concat(*[text_or_empty(c) for c in cs]), F.lit(PLACEHOLDER))


def shuffle_key(seed: object, *cs: Column) -> Column:
    """Order of a seeded shuffle: reproducible in any engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cs]))


def cell(c: Column) -> Column:
    """A number with four decimals for a report cell; null gives ''."""
    return F.coalesce(F.format_string("%.4f", c.cast("double")), F.lit(""))


def percent_cell(c: Column) -> Column:
    """A share that is already times 100, with two decimals and a per cent sign; null gives ''."""
    return F.coalesce(F.format_string("%.2f%%", c.cast("double")), F.lit(""))


def number_or_null(c: Column, digits: int = 4) -> Column:
    return F.round(c.try_cast("double"), digits)
