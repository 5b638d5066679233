"""Dialogue tables: turns in and out of sequences, expansion to samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages as M
from .joins import small


def to_turns(df: DataFrame, keys: list[str], messages: str) -> DataFrame:
    """One row per message: keys, turn (from 0), role, text."""
    return df.select(*keys, F.posexplode(F.coalesce(F.col(messages), M.none())).alias("turn", "m")).select(*keys, "turn", F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def from_turns(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Sequences of turn rows in order of turn, unknown roles and blanks left out."""
    one = F.struct("turn", M.role(F.col("role")).alias("role"), F.col("text").alias("content"))
    rows = turns.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_t"))
    made = F.transform("_t", lambda t: M.message(t["role"], t["content"]))
    return rows.select(*keys, F.filter(made, lambda m: m["role"].isNotNull() & (F.trim(F.coalesce(m["content"], F.lit(""))) != "")).alias("messages"))


def expand_turns(df: DataFrame, keys: list[str], messages: str, history: int) -> DataFrame:
    """One sample per assistant message that has a user message before it.

    context holds up to 2 * history + 1 messages before it. Built inside the array, so no message
    leaves its row and nothing is shuffled.
    """
    m = F.coalesce(F.col(messages), M.none())
    width = 2 * history + 1
    samples = F.transform(
        m,
        lambda x, i: F.struct(
            i.alias("turn"),
            x["role"].alias("role"),
            x["content"].alias("target"),
            F.slice(m, F.greatest(F.lit(1), i + 1 - width), F.least(i, F.lit(width))).alias("context"),
            F.exists(F.slice(m, F.lit(1), i), lambda y: y["role"] == M.USER).alias("asked"),
        ),
    )
    kept = F.filter(samples, lambda s: (s["role"] == M.ASSISTANT) & s["asked"])
    return df.select(*keys, F.inline(kept)).drop("role", "asked")


def rendered(c: Column) -> Column:
    """A sequence as '[role] text' lines."""
    return F.array_join(F.transform(F.coalesce(c, M.none()), lambda m: F.concat(F.lit("["), F.coalesce(m["role"], F.lit("")), F.lit("] "), F.coalesce(m["content"], F.lit("")))), "\n")


def pad_batches(df: DataFrame, batch: str, ids: str, labels: str, pad_id: int = 0) -> DataFrame:
    """Adds padded ids, mask and labels: every row as long as the longest of its batch.

    Widths are aggregated per batch and joined, so no array is shuffled while they are few.
    """
    width = df.groupBy(F.col(batch).alias("_batch")).agg(F.max(F.size(ids)).alias("_w"))
    out = df.join(small(width), F.col(batch).eqNullSafe(F.col("_batch")), "left")
    gap = (F.col("_w") - F.size(ids)).cast("int")
    return out.select(
        *df.columns,
        F.concat(F.col(ids), F.array_repeat(F.lit(pad_id), gap)).alias("padded_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), gap)).alias("mask"),
        F.concat(F.col(labels), F.array_repeat(F.lit(-100), gap)).alias("padded_labels"),
    )
