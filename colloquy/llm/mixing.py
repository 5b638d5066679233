"""Problem 7: mixing sources to target weights.

Method: Poisson replication. Each document draws how often it is used by inverting a Poisson
distribution at a hash of its id; the mean is chosen per source so that the expected use, capped at
``max_repeats``, brings the source to its share. Copies are exploded and shuffled globally by hash.

Sizes are tokens of a public tokenizer whose file is a parameter. The targets are a small table of
the caller (checked: at most ``MAX_SOURCES`` rows); counts, rates and draws are computed in Spark.

Defined results: a null or empty text has no tokens; a source that is not in the targets (a null
source too) counts in the total and is not used; a source without documents is short by its whole
target; repeated rows count each; with a null share or a null cap the target is not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

MAX_SOURCES = 100_000


def _count(model: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        for pdf in batches:
            ids = sp.encode([t or "" for t in pdf["text"]], num_threads=1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [len(i) for i in ids]})

    return run


def token_counts(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, tokens) of every row; *model* is the file of a public tokenizer, readable on all nodes."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    return rows.mapInPandas(_count(model), "doc_id long, source string, tokens long")


def capped_mean(mean: float, cap: int) -> float:
    """Expected value of min(X, cap) for a Poisson X."""
    total, p, below = 0.0, math.exp(-mean), 0.0
    for k in range(cap):
        total += k * p
        below += p
        p *= mean / (k + 1)
    return total + cap * (1 - below)


def solve_mean(rate: float, cap: int) -> float:
    """The Poisson mean whose capped expectation is *rate* (< cap), by bisection."""
    lo, hi = 0.0, 1.0
    while capped_mean(hi, cap) < rate and hi < 700:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if capped_mean(mid, cap) < rate else (lo, mid)
    return hi


def steps(mean: float, cap: int) -> list[float]:
    """P(X <= k) for k < cap: a draw u is used as often as there are steps below it."""
    out, p, below = [], math.exp(-mean), 0.0
    for k in range(cap):
        below += p
        out.append(below)
        p *= mean / (k + 1)
    return out


def mix_sources(tokens: DataFrame, targets: DataFrame, fraction: float = 0.5, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(mixed, report) for token counts as of :func:`token_counts`.

    mixed: doc_id, source, copy_no, tokens, position: every use of a document, in shuffled order of
    position. report: source, max_repeats, source_tokens, target_tokens, reached_tokens,
    target_share, reached_share, is_short; short means that the copies drawn are less than the target
    although every document of the source was drawn max_repeats times.
    """
    tokens = checkpoint(tokens)
    sums = tokens.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    total = (sums.agg(F.sum("source_tokens")).first()[0] or 0) * fraction
    wanted = targets.filter("source is not null and target_share is not null and max_repeats is not null")
    rows = wanted.join(sums, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("source_tokens", F.lit(0)).alias("have")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plan = []
    for source, share, cap, have in rows:
        target, cap = share * total, max(0, cap)
        if cap * have <= target:
            levels = [-1.0] * cap  # every draw is above: used cap times
        else:
            levels = steps(solve_mean(target / have, cap), cap)
        plan.append((source, share, cap, have, float(target), levels))
    spark = tokens.sparkSession
    schema = "source string, target_share double, max_repeats int, source_tokens long, target_tokens double, levels array<double>"
    plan_df = spark.createDataFrame(plan, schema)
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    used = (
        tokens.withColumn("u", draw)
        .join(F.broadcast(plan_df.select("source", "levels")), "source")
        .withColumn("uses", F.size(F.filter("levels", lambda x: x < F.col("u"))))
    )
    # what the draws brought is counted: a source is short if it lacks tokens although every document has all its uses
    reached = used.groupBy("source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("reached_tokens"), F.min("uses").alias("fewest"))
    report = plan_df.drop("levels").join(reached, "source", "left").withColumn("reached_tokens", F.coalesce("reached_tokens", F.lit(0)))
    spent = F.coalesce(F.col("fewest") >= F.col("max_repeats"), F.lit(True))
    report = report.withColumn("is_short", (F.col("reached_tokens") < F.col("target_tokens")) & spent).drop("fewest")
    whole = Window.partitionBy(F.lit(0))  # one row per source
    report = report.withColumn("reached_share", F.col("reached_tokens") / F.greatest(F.sum("reached_tokens").over(whole), F.lit(1)))
    mixed = (
        used.filter("uses > 0")
        .select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy_no"))
        .withColumn("position", F.xxhash64(F.lit(seed + 1), "doc_id", "copy_no"))
        .orderBy("position")
    )
    return mixed, report
