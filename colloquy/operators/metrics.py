"""Histograms, summaries and judge metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import advantage
from .joins import small

DIMENSIONS = ("need", "accurate", "helpful", "tone", "risk", "history_use")


def histogram(df: DataFrame, name: str, order: Column | None = None) -> DataFrame:
    """(name, n), most frequent first, ties by first appearance."""
    first = F.min(order) if order is not None else F.min(F.col(name))
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n"), first.alias("_first")).orderBy(F.desc("n"), "_first").drop("_first")


def row_summary(df: DataFrame, label: str, flags: str, turns: str) -> DataFrame:
    """(kind, name, n): total, rows per label, per flag and per number of history turns, in one pass.

    Every row is exploded into its few (kind, name) facts, so one partial aggregation serves all.
    """
    facts = F.concat(
        F.array(F.struct(F.lit("total").alias("kind"), F.lit("").alias("name")), F.struct(F.lit("label").alias("kind"), F.coalesce(F.col(label), F.lit("unknown")).alias("name")), F.struct(F.lit("turns").alias("kind"), F.coalesce(F.col(turns), F.lit(0)).cast("string").alias("name"))),
        F.transform(F.coalesce(F.col(flags), F.array().cast("array<string>")), lambda f: F.struct(F.lit("flag").alias("kind"), f.alias("name"))),
    )
    return df.select(F.explode(facts).alias("f")).groupBy("f.kind", "f.name").agg(F.count(F.lit(1)).alias("n"))


def judge_metrics(df: DataFrame, by: str | None = None, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Pass, auto-resolution and accuracy in per cent (not rounded) and the mean of each dimension.

    Means skip nulls and are 0 where nothing was scored; rows without a class count as unknown.
    """
    keys = [F.coalesce(F.col(by), F.lit("unknown")).alias(by)] if by else []
    share = lambda c: (F.lit(100.0) * F.count_if(c) / F.count(F.lit(1)))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce(F.col("passed"), F.lit(False))).alias("n_passed"),
        share(F.coalesce(F.col("passed"), F.lit(False))).alias("pass_rate"),
        share(F.coalesce(F.col(dims[0]), F.lit(0)) >= 3).alias("auto_rate"),
        share(F.coalesce(F.col(dims[1]), F.lit(0)) >= 3).alias("accuracy"),
        *[F.coalesce(F.avg(d), F.lit(0.0)).alias(f"mean_{d}") for d in dims],
    )


def judge_rollup(df: DataFrame, by: str) -> DataFrame:
    """Metrics per class and overall (class null) in one aggregation."""
    rows = df.withColumn(by, F.coalesce(by, F.lit("unknown")))
    return rows.rollup(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(F.col("passed"), F.lit(False))).alias("n_passed"), F.grouping(by).cast("int").alias("is_total"))


def tags(df: DataFrame, tag: str = "fail_tag") -> DataFrame:
    """Rows with a failure tag; null and the word null are none."""
    return df.filter(F.col(tag).isNotNull() & ~F.col(tag).isin("null", ""))


def top_tags(df: DataFrame, by: str, tag: str = "fail_tag", n: int = 3) -> DataFrame:
    """(by, top): the most frequent tags as 'tag:count', ties by name."""
    counts = tags(df, tag).groupBy(F.coalesce(F.col(by), F.lit("unknown")).alias(by), tag).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), tag))).filter(F.col("rank") <= n)
    one = F.struct("rank", F.concat_ws(":", tag, F.col("n").cast("string")).alias("s"))
    return ranked.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]), ", ").alias("top"))


def token_stats(df: DataFrame, tokens: str) -> DataFrame:
    """total, usable, skipped, truncated and the longest of masked token structs (null = skipped)."""
    t = F.col(tokens)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(t["input_ids"]).alias("usable"),
        F.count_if(t["input_ids"].isNull()).alias("skipped"),
        F.count_if(F.coalesce(t["truncated"], F.lit(False))).alias("truncated"),
        F.coalesce(F.max(F.size(t["input_ids"])), F.lit(0)).cast("long").alias("max_length"),
    )


def group_advantage(df: DataFrame, reward: str, group: str) -> DataFrame:
    """Adds advantage: how far a reward stands from the mean of its group, in deviations.

    Groups are aggregated, so a hot one combines before the shuffle; rows get their numbers by a join of
    one row per group.
    """
    stats = df.groupBy(F.col(group).alias("_group")).agg(F.avg(reward).alias("_mean"), F.stddev_pop(reward).alias("_deviation"))
    rows = df.join(small(stats), F.col(group).eqNullSafe(F.col("_group")), "left")
    return rows.withColumn("advantage", advantage(F.col(reward), F.col("_mean"), F.col("_deviation"))).drop("_group", "_mean", "_deviation")


def metric_points(log: DataFrame, step: str, metrics: list[str]) -> DataFrame:
    """(step, metric, value) of the numeric values of a wide, sparse log."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").try_cast("double").alias("value")) for m in metrics])
    return log.select(F.col(step).alias("step"), F.inline(F.filter(pairs, lambda p: p["value"].isNotNull())))


def running_peak(samples: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    """Adds peak: the largest value so far within *by*."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("peak", F.max(value).over(w))
