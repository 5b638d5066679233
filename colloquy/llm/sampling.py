"""Problem 2: a sample with target category proportions.

Method: swap repair. Records are grouped by category signature; only the counts of signatures go to
the driver (checked: at most ``MAX_SIGNATURES``). A random sample that satisfies the floors is drawn
on the counts, then counts are exchanged between signatures as long as that lowers the deviation
from the targets; the final counts are materialised by hash order within each signature.

A signature may hold a third of all rows, so its rows are never sorted in one task: hash buckets are
counted, whole buckets are taken and only the boundary bucket is ranked.

Defined results: null ids are left out; rows with the same id count once; a blank or null category
falls back as the caller's expression says; categories without a target have target 0; an empty
table gives an empty sample and every target unmet.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

MAX_SIGNATURES = 200_000
BUCKETS = 4096


def trimmed(c: Column) -> Column:
    """Without blanks of any kind at both ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def draw(avail: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of *n* random rows fall to each group of *avail* rows, without replacement.

    Group after group, hypergeometric; beyond the generator's bound of 10^9 rows by the normal law with
    the same mean and variance, which differs by less than a row in that many.
    """
    out = np.zeros(len(avail), np.int64)
    left = int(avail.sum())
    for i, a in enumerate(map(int, avail)):
        if n <= 0:
            break
        others = left - a
        if a < 10**9 and others < 10**9:
            got = int(rng.hypergeometric(a, others, n)) if a else 0
        else:
            share = a / left
            spread = (n * share * (1 - share) * (left - n) / max(1, left - 1)) ** 0.5
            got = min(a, n, max(0, n - others, round(rng.normal(n * share, spread))))
        out[i] = got
        n, left = n - got, others
    return out


def repair(have: dict[tuple, int], targets: list[dict[str, float]], floors: list[dict[str, int]], size: int, seed: int) -> dict[tuple, int]:
    """Counts per signature. *targets* and *floors* are per category column, in rows.

    Starts from a random sample that takes the floors first, and every row of a category that has less
    than its target; then moves counts from one signature to another while the summed distance from the
    targets falls. One move exchanges as many rows as keep improving at the same rate, so the number of
    rounds follows the signatures, not the rows.
    """
    keys = sorted(have)
    avail = np.array([have[k] for k in keys], np.int64)
    size = int(min(size, avail.sum()))
    rng = np.random.default_rng(seed)
    take = np.zeros(len(keys), np.int64)
    least = []
    for col, t in enumerate(targets):
        there: dict[str, int] = {}
        for k, n in have.items():
            there[k[col]] = there.get(k[col], 0) + n
        least.append({c: min(there.get(c, 0), floors[col].get(c, 0) if there.get(c, 0) >= t.get(c, 0.0) else there[c]) for c in {*t, *floors[col]} if c in there})
        for c, want in sorted(least[col].items()):
            at = [n for n, k in enumerate(keys) if k[col] == c]
            if (miss := want - int(take[at].sum())) > 0:
                take[at] += draw(avail[at] - take[at], miss, rng)
    if (rest := size - int(take.sum())) > 0:
        take += draw(avail - take, rest, rng)
    dims = [sorted({k[col] for k in keys} | set(t)) for col, t in enumerate(targets)]
    where = [{c: n for n, c in enumerate(d)} for d in dims]
    goal = [np.array([t.get(c, 0.0) for c in d]) for d, t in zip(dims, targets)]
    low = [np.array([f.get(c, 0) for c in d]) for d, f in zip(dims, least)]
    got = [np.zeros(len(d), np.int64) for d in dims]
    for n, k in enumerate(keys):
        for col in range(len(dims)):
            got[col][where[col][k[col]]] += take[n]
    cat = [np.array([where[col][k[col]] for k in keys]) for col in range(len(dims))]
    # an exchange leaves the categories that both signatures share as they are; per set of shared
    # columns, the best giver and the best taker of every shared combination are put together
    masks = []
    for mask in range(1 << len(dims)):
        shared = [col for col in range(len(dims)) if mask >> col & 1]
        ident = np.zeros(len(keys), np.int64)
        for col in shared:
            ident = np.unique(ident * len(dims[col]) + cat[col], return_inverse=True)[1]
        if shared != [*range(len(dims))] or not dims:
            masks.append(([col for col in range(len(dims)) if col not in shared], ident))
    while keys:
        best = (1e-9, -1, -1)
        for free, ident in masks:
            give = sum((np.abs(got[c] - goal[c]) - np.abs(got[c] - 1 - goal[c]))[cat[c]] for c in free)
            more = sum((np.abs(got[c] - goal[c]) - np.abs(got[c] + 1 - goal[c]))[cat[c]] for c in free)
            can_give = (take > 0) & np.logical_and.reduce([(got[c] > low[c])[cat[c]] for c in free])
            give = np.where(can_give, give, -np.inf)
            more = np.where(take < avail, more, -np.inf)
            g, m = np.full(ident.max() + 1, -np.inf), np.full(ident.max() + 1, -np.inf)
            np.maximum.at(g, ident, give)
            np.maximum.at(m, ident, more)
            k = int(np.argmax(g + m))
            if g[k] + m[k] > best[0]:
                mine = ident == k
                best = (g[k] + m[k], int(np.nonzero(mine & (give == g[k]))[0][0]), int(np.nonzero(mine & (more == m[k]))[0][0]))
        _, x, y = best
        if x < 0 or x == y:
            break
        step = min(take[x], avail[y] - take[y])
        for col in range(len(dims)):
            a, b = cat[col][x], cat[col][y]
            if a != b:
                step = min(step, max(1, int(got[col][a] - goal[col][a])), max(1, int(goal[col][b] - got[col][b])), got[col][a] - low[col][a])
        step = max(1, int(step))
        take[x] -= step
        take[y] += step
        for col in range(len(dims)):
            got[col][cat[col][x]] -= step
            got[col][cat[col][y]] += step
    return {k: int(n) for k, n in zip(keys, take)}


def proportional_sample(
    df: DataFrame, id_col: str, categories: list[Column], targets: list[dict[str, tuple[float, int]]], fraction: float = 0.2, seed: int = 3
) -> tuple[DataFrame, DataFrame]:
    """(sample, report).

    *targets* holds, per category column, category -> (share, least rows). sample: id and the
    category columns c0, c1, ... report: column_no, category, available, wanted, sampled, is_short
    (fewer records exist than wanted).
    """
    names = [f"c{n}" for n in range(len(categories))]
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.struct(*[c.alias(n) for c, n in zip(categories, names)]).alias("cats"))
    rows = rows.filter("id is not null").groupBy("id").agg(F.min("cats").alias("cats")).select("id", *[F.col(f"cats.{n}").alias(n) for n in names])
    rows = checkpoint(rows.withColumn("h", F.xxhash64(F.lit(seed), "id")))
    counts = rows.groupBy(*names).count().limit(MAX_SIGNATURES + 1).collect()
    if len(counts) > MAX_SIGNATURES:
        raise ValueError(f"more than {MAX_SIGNATURES} category signatures")
    have = {tuple(r[:-1]): r[-1] for r in counts}
    ids = sum(have.values())
    size = int(ids * fraction + 1e-9)
    goal = [{c: share * size for c, (share, _) in t.items()} for t in targets]
    floors = [{c: least for c, (_, least) in t.items()} for t in targets]
    taken = repair(have, goal, floors, size, seed)

    spark = df.sparkSession
    plan = spark.createDataFrame([(*k, n) for k, n in taken.items() if n] or [], ", ".join(f"{n} string" for n in names) + ", take long")
    bucket = F.pmod(F.shiftright("h", 40), F.lit(BUCKETS)).cast("int")
    chosen = rows.withColumn("bucket", bucket).join(F.broadcast(plan), names)
    fill = chosen.groupBy(*names, "bucket").agg(F.count(F.lit(1)).alias("n"), F.first("take").alias("take"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fill = fill.withColumn("room", F.col("take") - before).filter("room > 0").select(*names, "bucket", "n", "room")
    part = chosen.drop("take").join(fill, [*names, "bucket"])
    rank = F.row_number().over(Window.partitionBy(*names, "bucket").orderBy("h", "id"))
    sample = part.filter("n <= room").select("id", *names).unionByName(part.filter("n > room").withColumn("rn", rank).filter("rn <= room").select("id", *names))

    # what the sample holds is counted in the sample: a category is short if it lacks rows although all of its rows were drawn
    goals = [(col, c, max(share * size, float(least))) for col, t in enumerate(targets) for c, (share, least) in t.items()]
    goals = spark.createDataFrame(goals, "column_no int, category string, wanted double")
    per = lambda df, n: df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("column_no"), F.col(c).alias("category")) for i, c in enumerate(names)]))).groupBy("column_no", "category").agg(F.count(F.lit(1)).alias(n))
    report = goals.join(per(rows, "available"), ["column_no", "category"], "left").join(per(sample, "sampled"), ["column_no", "category"], "left").fillna(0, ["available", "sampled"])
    short = (F.col("sampled") < F.col("wanted")) & (F.col("sampled") == F.col("available"))
    return sample, report.select("column_no", "category", "available", "wanted", "sampled", short.alias("is_short"))
