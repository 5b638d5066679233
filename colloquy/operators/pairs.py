"""Preference pairs: loading, validation, typing, union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions.text import shuffle_key, strip, text_or_empty
from .rules import ladder


def prompt_or_last_user(prompt: Column, messages: Column) -> Column:
    """The prompt, or the last user message where it is null or ''."""
    return F.coalesce(F.nullif(text_or_empty(prompt), F.lit("")), M.last_user(messages))


def usable(df: DataFrame) -> DataFrame:
    """Rows that can be trained on: both answers filled and different, a prompt present."""
    c, r = strip(text_or_empty(F.col("chosen"))), strip(text_or_empty(F.col("rejected")))
    rows = df.withColumn("prompt", prompt_or_last_user(F.col("prompt"), F.col("messages")))
    return rows.filter((c != "") & (r != "") & (c != r) & (text_or_empty(F.col("prompt")) != ""))


def pair_fault(chosen: Column, rejected: Column, least_chosen: int = 20, least_rejected: int = 10, gap: int = 15, gap_name: str = "length_gap_too_large:") -> Column:
    """Why a pair is not valid; null if it is. Too wide a gap is named with its length.

    Augmented pairs are held to 15, 15, 25 and 'length_gap_'.
    """
    c, r = strip(text_or_empty(chosen)), strip(text_or_empty(rejected))
    wide = F.abs(F.length(c) - F.length(r))
    short = ladder([(F.length(c) < least_chosen, "chosen_too_short"), (F.length(r) < least_rejected, "rejected_too_short"), (c == r, "chosen_equals_rejected")])
    return F.coalesce(short, F.when(wide > gap, F.concat(F.lit(gap_name), wide.cast("string"))))


def typed_counts(df: DataFrame, default: str = "too_generic") -> DataFrame:
    """(scenario, error_type, n); a missing type is the default one."""
    return df.groupBy(F.coalesce(F.col("scenario"), F.lit("unknown")).alias("scenario"), F.coalesce(F.col("error_type"), F.lit(default)).alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


def union_shuffled(a: DataFrame, b: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """All rows of both with position: their place in the shuffled order as a sortable key."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn("position", shuffle_key(seed, F.col(key)))


def other_scenario(scenario: Column, every: Column, *key: Column) -> Column:
    """A scenario other than the row's own, chosen by hash."""
    rest = F.filter(every, lambda s: s != F.coalesce(scenario, F.lit("")))
    place = F.conv(F.substring(shuffle_key("other", *key), 1, 7), 16, 10).cast("int")
    return F.try_element_at(rest, F.pmod(place, F.greatest(F.size(rest), F.lit(1))) + 1)
