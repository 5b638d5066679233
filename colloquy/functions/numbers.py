"""Numbers of the training loops and of run reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def advantage(reward: Column, mean: Column, deviation: Column) -> Column:
    """(r - mean) / (population deviation + 1e-8) of a group."""
    return (reward - mean) / (deviation + 1e-8)


def clipped_objective(ratio: Column, advantage: Column, epsilon: float = 0.2) -> Column:
    return -F.least(ratio * advantage, F.greatest(F.lit(1 - epsilon), F.least(F.lit(1 + epsilon), ratio)) * advantage)


def advantage_loss(log_prob: Column, advantage: Column, scale: Column) -> Column:
    return -(log_prob * advantage) / scale


def masked_mean(values: Column, skip: Column) -> Column:
    """Mean of the values behind the first *skip*; 0 if none are left."""
    rest = F.slice(values, skip + 1, F.greatest(F.size(values) - skip, F.lit(0)))
    return F.aggregate(rest, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(rest), F.lit(1))


def preference_loss(chosen: Column, rejected: Column, beta: float = 0.1) -> Column:
    """-ln sigmoid(beta * (chosen - rejected)) of log-ratio differences."""
    return F.log1p(F.exp(-beta * (chosen - rejected)))


def first_nonzero(*cs: Column, default: int = 3) -> Column:
    """The first value that is neither null nor 0."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in cs], F.lit(default))


def judge_reward(*dims: Column) -> Column:
    """(sum of the dimensions - 3 each) / their number; 0 if nothing was judged."""
    total = sum((first_nonzero(d) for d in dims[1:]), first_nonzero(dims[0]))
    nothing = F.coalesce(*dims).isNull()
    return F.when(nothing, F.lit(0.0)).otherwise((total - 3 * len(dims)) / float(len(dims)))


def perplexity(loss: Column) -> Column:
    """exp of a loss under 20, else null."""
    return F.when(loss < 20, F.exp(loss))
