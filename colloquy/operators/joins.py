"""Keyed lookups, exclusions, merges and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """*df* with a broadcast hint if a bounded count shows that it is small, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def two_key_lookup(left: DataFrame, right: DataFrame, first: Column, second: Column, key: str, take: list[str]) -> DataFrame:
    """Columns *take* of *right* by the first key, else by the second; adds matched_by (1, 2 or null).

    *right* has one row per key. Both steps are left joins on the same table.
    """
    r1 = right.select(F.col(key).alias("_k1"), F.struct(*take).alias("_r1"))
    r2 = right.select(F.col(key).alias("_k2"), F.struct(*take).alias("_r2"))
    out = left.withColumn("_a", first).withColumn("_b", second).join(r1, F.col("_a") == F.col("_k1"), "left").join(r2, F.col("_b") == F.col("_k2"), "left")
    return out.select(
        *left.columns,
        *[F.coalesce(F.col(f"_r1.{c}"), F.when(F.col("_k1").isNull(), F.col(f"_r2.{c}"))).alias(c) for c in take],
        F.when(F.col("_k1").isNotNull(), 1).when(F.col("_k2").isNotNull(), 2).alias("matched_by"),
    )


def without_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not among *ids*; a null key stays."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def merge_new(base: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """*base* and the rows of *new* whose key *base* lacks; repeats inside *new* stay."""
    return base.unionByName(without_ids(new, base, key), allowMissingColumns=True)


def resume(todo: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What is still to be done: an idempotent rerun skips what the sink already holds."""
    return without_ids(todo, done, key)


def prefix_dedup(new: DataFrame, existing: DataFrame, text: str, width: int, order: list[Column]) -> DataFrame:
    """Rows of *new* whose text prefix is not in *existing*, the first of each prefix in order."""
    head = F.substring(F.col(text), 1, width)
    rows = new.withColumn("_head", head).join(existing.select(head.alias("_head")).distinct(), "_head", "left_anti")
    rank = F.row_number().over(Window.partitionBy("_head").orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "_head")


def compare(runs: DataFrame, case: str, run: str, value: list[str], names: list[str]) -> DataFrame:
    """One row per case with the values of every run as struct columns.

    The first run is the base: extra cases of others are ignored; a case a run lacks is an error.
    """
    wide = runs.groupBy(case).pivot(run, names).agg(F.first(F.struct(*value)))
    base = wide.filter(F.col(f"`{names[0]}`").isNotNull())
    lacking = F.concat_ws(",", *[F.when(F.col(f"`{n}`").isNull(), F.lit(n)) for n in names])
    checked = F.when(lacking != "", F.raise_error(F.concat(F.lit("case "), F.col(case).cast("string"), F.lit(" is missing in "), lacking)).cast("string")).otherwise(F.col(case).cast("string"))
    return base.withColumn(case, checked)


def ordinal(df: DataFrame, order: list, out: str = "ordinal") -> DataFrame:
    """Adds the place (from 1) of every row in a global order.

    The rows are sorted over all partitions and kept; only the partitions' sizes go to the driver, so
    no task holds more than its own range.
    """
    rows = checkpoint(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r[0], r[1]) for r in rows.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    base = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    return rows.withColumn("_part", part).join(F.broadcast(base), "_part").withColumn(out, (F.col("_start") + place + 1).cast("int")).drop("_id", "_part", "_start")


def ordinal_in(df: DataFrame, group: str, order: list, out: str = "ordinal") -> DataFrame:
    """Adds the place (from 1) of every row within its group: its place in the order of all rows less the
    first of the group. A group of any size is numbered by many tasks."""
    rows = checkpoint(ordinal(df, [group, *order], "_place"))
    first = rows.groupBy(F.col(group).alias("_group")).agg(F.min("_place").alias("_first"))
    rows = rows.join(small(first), F.col(group).eqNullSafe(F.col("_group")), "left")
    return rows.withColumn(out, (F.col("_place") - F.col("_first") + 1).cast("int")).drop("_place", "_first", "_group")


def positional(left: DataFrame, right: DataFrame, left_order: list, right_order: list) -> DataFrame:
    """Rows joined by their ordinal in a global order; unequal counts are an error."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows against {m}")
    return ordinal(left, left_order).join(ordinal(right, right_order), "ordinal")


def rule_lookup(rows: DataFrame, rules: DataFrame, overrides: DataFrame, key: str, index: str, default: str, take: list[str]) -> DataFrame:
    """Rule columns by key (a default row where the key has none), replaced column by column by the
    override of the row's index. Rules and overrides are small tables."""
    known = rules.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_r_{c}") for c in take])
    spare = rules.filter(F.col(key) == default).select(*take).first()
    over = overrides.select(F.col(index).alias("_index"), *[F.col(c).alias(f"_o_{c}") for c in take])
    out = rows.join(small(known), F.col(key) == F.col("_key"), "left").join(small(over), F.col(index) == F.col("_index"), "left")
    base = lambda c: F.when(F.col("_key").isNotNull(), F.col(f"_r_{c}")).otherwise(F.lit(spare[c] if spare else None))
    return out.select(*rows.columns, *[F.coalesce(F.col(f"_o_{c}"), base(c)).alias(c) for c in take])


def star(base: DataFrame, sides: dict[str, DataFrame], key: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Left joins of one-row-per-key tables, columns prefixed with the side's name, then defaults."""
    out = base
    for name, side in sides.items():
        out = out.join(side.select(F.col(key), *[F.col(c).alias(f"{name}_{c}") for c in side.columns if c != key]), key, "left")
    return out.fillna(defaults) if defaults else out
