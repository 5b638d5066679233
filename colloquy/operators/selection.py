"""Deduplication, quotas, stratified choice, splits and samples.

Every order is explicit and ends with a unique column; every shuffle is an order by a keyed hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shuffle_key
from ..session import checkpoint
from .joins import small


SORTED = 100_000  # rows that one task may sort
MAX_CLASSES = 100_000
BUCKETS = 3  # hexadecimal digits of a hash key that name a bucket: 4096 of them


def running_total(df: DataFrame, by: list[str], key: str, value: str, out: str) -> DataFrame:
    """Adds the sum of *value* over the rows before, within *by* in order of the hash key *key*.

    Two levels: buckets of the key are summed and accumulated (at most 4096 rows per group), rows are
    accumulated inside their bucket only, so a group of any size is spread over all tasks.
    """
    rows = df.withColumn("_bucket", F.substring(key, 1, BUCKETS))
    sums = rows.groupBy(*by, "_bucket").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(base, [*by, "_bucket"]).withColumn(out, F.col("_base") + F.col("_own")).drop("_bucket", "_base", "_own")


def hash_rank(df: DataFrame, by: list[str], key: str, out: str) -> DataFrame:
    """Adds the place (from 1) of a row within *by* in order of the hash key, as :func:`running_total`."""
    return running_total(df.withColumn("_one", F.lit(1)), by, key, "_one", out).withColumn(out, F.col(out) + 1).drop("_one")


def top_of(quota: DataFrame, column: str = "quota") -> int:
    """The largest quota: a literal bound lets the planner limit groups before the shuffle."""
    return int(quota.agg(F.max(column)).first()[0] or 0)


def first_accepted(df: DataFrame, key: str, order: list[str], reason: str, duplicate: str = "exact_duplicate_prompt_response") -> DataFrame:
    """Adds is_duplicate and the final *reason*: a row is a duplicate if an accepted row of its key
    (reason null) comes before it; a reason already given stays.

    The first accepted row of a key comes from an aggregation, which combines a hot key before the
    shuffle; rows dropped earlier do not hide later ones. A null key is never a duplicate; rows without a
    key are spread over the join's tasks.
    """
    place = F.struct(*order)
    accepted = df.filter(F.col(key).isNotNull() & F.col(reason).isNull()).groupBy(F.col(key).alias("_key")).agg(F.min(place).alias("_first"))
    later = F.coalesce(place > F.col("_first"), F.lit(False))
    spread = F.when(F.col(key).isNull(), F.xxhash64(*order))
    accepted = accepted.withColumn("_none", F.lit(0).cast("long"))
    out = df.join(accepted, (F.col(key).eqNullSafe(F.col("_key"))) & (F.coalesce(spread, F.lit(0)) == F.col("_none")), "left").drop("_none").withColumn("is_duplicate", later).drop("_key", "_first")
    return out.withColumn(reason, F.coalesce(reason, F.when(F.col("is_duplicate"), F.lit(duplicate))))


def repeated(df: DataFrame, text: str) -> DataFrame:
    """(text, n) of the texts that stand in more than one row.

    Counted by hash, so a text that stands once is not shuffled; the texts of repeated hashes follow and
    are counted as they are.
    """
    rows = df.select(F.col(text), F.xxhash64(text).alias("_hash"))
    many = checkpoint(rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_hash"))
    return rows.join(small(many), "_hash", "left_semi").groupBy(text).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def last_wins(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the last in order. Aggregates, so a hot key combines before the shuffle."""
    names = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("row"))
    return best.select(key, *[F.col(f"row.{c}").alias(c) for c in names])


def quotas(counts: DataFrame, name: str, n: str, total: int, low: int, high: int) -> DataFrame:
    """(name, cap, quota): floors first, then one row per class and pass until *total*; in the last pass the
    least filled classes come first, ties by name. Floors are never cut.

    Works on one row per class (checked: at most ``MAX_CLASSES``); the number of whole passes is found by
    bisection, so the cost does not follow the quotas.
    """
    rows = counts.select(F.col(name), F.col(n)).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    cap = {r[0]: min(r[1], high) for r in rows}
    base = {k: min(c, low) for k, c in cap.items()}
    room = max(0, min(total, sum(cap.values())) - sum(base.values()))
    taken = lambda passes: sum(min(cap[k], base[k] + passes) - base[k] for k in cap)
    lo, hi = 0, max(cap.values(), default=0)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if taken(mid) <= room else (lo, mid - 1)
    quota = {k: min(cap[k], base[k] + lo) for k in cap}
    open_ = sorted((quota[k] / cap[k], k is not None, k or "", k) for k in cap if quota[k] < cap[k])
    for _, _, _, k in open_[: room - taken(lo)]:
        quota[k] += 1
    return counts.sparkSession.createDataFrame([(k, cap[k], quota[k]) for k in cap], "name string, cap long, quota long")


def stratified_top(df: DataFrame, stratum: str, flag: str, score: str, tie: Column, quota: DataFrame, share: float) -> DataFrame:
    """Rows chosen per stratum up to its quota: a share of those with *flag*, the rest without, missing
    places from whatever is left, best score first.

    *quota* has (name, quota), one row per stratum.
    """
    q = quota.select(F.col("name").alias(stratum), "quota")
    most = top_of(quota)
    flagged = df.groupBy(stratum).agg(F.count(F.when(F.col(flag), 1)).alias("_n"))
    rows = df.join(small(q), stratum).join(small(flagged), stratum).withColumn("_tie", tie)
    best = [F.desc(score), "_tie"]
    # no more than the largest quota of either kind can ever be chosen
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum, flag).orderBy(*best))).filter(F.col("_rank") <= most)
    rows = rows.withColumn("_want", F.bround(F.col("quota") * share).cast("long"))
    rows = rows.withColumn("_first", F.when(F.col(flag), F.col("_rank") <= F.col("_want")).otherwise(F.col("_rank") <= F.col("quota") - F.least("_want", "_n")))
    rows = rows.withColumn("_chosen", F.count(F.when(F.col("_first"), 1)).over(Window.partitionBy(stratum)))
    rows = rows.withColumn("_again", F.row_number().over(Window.partitionBy(stratum, "_first").orderBy(*best)))
    keep = F.col("_first") | (F.col("_again") <= F.col("quota") - F.col("_chosen"))
    return rows.filter(keep).drop("_tie", "_rank", "_want", "_n", "_first", "_chosen", "_again", "quota")


def group_split(df: DataFrame, stratum: str, group: str, dev: float, test: float, seed: int) -> DataFrame:
    """Adds split: whole groups go to test, then dev, then train, in shuffled order by size before them.

    Sizes are accumulated per group of rows, in hash buckets; rows get their split by a join.
    """
    sizes = df.groupBy(stratum, group).agg(F.count(F.lit(1)).alias("size")).withColumn("_order", F.concat_ws("|", shuffle_key(seed, F.col(group)), F.col(group)))
    totals = sizes.groupBy(stratum).agg(F.sum("size").alias("_total"))
    sizes = running_total(sizes, [stratum], "_order", "size", "_before").join(totals, stratum)
    sizes = sizes.withColumn("_test", F.col("_before") < F.bround(F.col("_total") * test))
    in_test = sizes.groupBy(stratum).agg(F.coalesce(F.sum(F.when(F.col("_test"), F.col("size"))), F.lit(0)).alias("_in_test"))
    split = F.when(F.col("_test"), "test").when(F.col("_before") - F.col("_in_test") < F.bround(F.col("_total") * dev), "dev").otherwise("train")
    return df.join(sizes.join(in_test, stratum).select(stratum, group, split.alias("split")), [stratum, group])


def holdout_size(n: Column, ratio: float | None = None, size: int | None = None) -> Column:
    """Rows held out: at least one, at most all but one."""
    wanted = F.lit(size).cast("long") if size else F.floor(n * ratio)
    return F.greatest(F.lit(1).cast("long"), F.least(wanted, n - 1))


def nth_key(df: DataFrame, key: Column, k: int) -> str | None:
    """The k-th smallest (from 1) of hash keys in hexadecimal digits.

    Buckets of the next digits are counted, at most 4096 of them, and only the bucket that holds the place
    is looked into, so no task sorts more than ``SORTED`` rows.
    """
    rows, prefix = df.select(key.alias("_key")), ""
    while True:
        inside = rows.filter(F.col("_key").startswith(prefix))
        counts = sorted(inside.groupBy(F.substring("_key", len(prefix) + 1, BUCKETS).alias("b")).count().collect())
        for b, n in counts:
            if k <= n:
                break
            k -= n
        else:
            return None
        prefix += b
        if n <= SORTED or not b:
            return rows.filter(F.col("_key").startswith(prefix)).orderBy("_key").limit(k).agg(F.max("_key")).first()[0] if b else prefix


def holdout(df: DataFrame, key: Column, ratio: float | None = None, size: int | None = None) -> DataFrame:
    """Adds is_eval for the first rows in order of the hash *key*."""
    n = df.count()
    if not n:
        return df.withColumn("is_eval", F.lit(False))
    edge = nth_key(df, key, max(1, min(size or int(n * (ratio or 0)), n - 1)))
    return df.withColumn("is_eval", F.coalesce(key <= F.lit(edge), F.lit(False)))


def train_eval(train: DataFrame, held: DataFrame | None, key: Column, ratio: float | None = None, size: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, evaluation, report): an explicit evaluation table as it is, else rows held out of *train*.

    report: split_source, raw_train_records, raw_eval_records.
    """
    source = "explicit_eval_file"
    if held is None:
        rows, source = holdout(train, key, ratio, size), "train_file_holdout"
        train, held = rows.filter(~F.col("is_eval")).drop("is_eval"), rows.filter("is_eval").drop("is_eval")
    n, m = train.count(), held.count()
    return train, held, train.sparkSession.createDataFrame([(source, n, m)], "split_source string, raw_train_records long, raw_eval_records long")


def keep_per_class(df: DataFrame, name: str, quota: DataFrame, key: Column) -> DataFrame:
    """Adds kept: the first rows of each class in order of the hash *key*, as many as its quota (default 0)."""
    q = quota.select(F.col("name").alias(name), "quota")
    rows = hash_rank(df.withColumn("_key", key), [name], "_key", "_rank")
    return rows.join(small(q), name, "left").withColumn("kept", F.col("_rank") <= F.coalesce("quota", F.lit(0))).drop("_key", "_rank", "quota")


def transfer_split(pool: DataFrame, train: DataFrame, dev: DataFrame, key: Column) -> DataFrame:
    """Adds split to the rows of *pool*: the first in order of the hash *key* go to train, the rest to dev,
    in proportion to the rows that *train* and *dev* have now (all to dev if they have none)."""
    have = train.agg(F.count(F.lit(1)).alias("_train")).crossJoin(dev.agg(F.count(F.lit(1)).alias("_dev")))
    ratio = F.coalesce(F.try_divide(F.col("_train"), F.col("_train") + F.col("_dev")), F.lit(0.0))
    edge = pool.agg(F.count(F.lit(1)).alias("_n")).crossJoin(have).select(F.bround(F.col("_n") * ratio).cast("long").alias("_edge"))
    rows = hash_rank(pool.withColumn("_key", key), [], "_key", "_rank").crossJoin(F.broadcast(edge))
    return rows.withColumn("split", F.when(F.col("_rank") <= F.col("_edge"), "train").otherwise("dev")).drop("_key", "_rank", "_edge")


def style_examples(df: DataFrame, messages: str, n: int, key: Column) -> DataFrame:
    """(user, assistant) of at most *n* rows whose last question and reply have a fitting length, out of the
    first 3 *n* rows in order of *key*."""
    user, assistant = F.try_element_at(messages, F.lit(-2))["content"], F.try_element_at(messages, F.lit(-1))["content"]
    rows = df.select(key.alias("_key"), F.coalesce(user, F.lit("")).alias("user"), F.coalesce(assistant, F.lit("")).alias("assistant"), F.size(messages).alias("_size"))
    fits = (F.col("_size") >= 2) & (F.length("user") > 5) & F.length("assistant").between(20, 200)
    return rows.orderBy("_key").limit(3 * n).filter(fits).orderBy("_key").limit(n).select("user", "assistant")


def shrink_targets(counts: DataFrame, name: str, n: str, target: int, floor: int) -> DataFrame:
    """(name, quota): classes shrunk in proportion with floors.

    An overshoot is cut in proportion to what a class has above its floor, largest first, at least one
    each while any is left, then one more each; an undershoot goes to the classes with most room.
    """
    one = Window.partitionBy(F.lit(1))
    t = counts.select(F.col(name).alias("name"), F.col(n).cast("long").alias("n"))
    t = t.withColumn("least", F.least(F.lit(floor).cast("long"), F.col("n")))
    raw = F.lit(float(target)) * F.col("n") / F.sum("n").over(one)
    t = t.withColumn("base", F.bround(F.least(F.greatest(raw, F.col("least").cast("double")), F.col("n").cast("double"))).cast("long"))
    t = t.withColumn("excess", F.sum("base").over(one) - target).withColumn("surplus", F.greatest(F.lit(0), F.col("base") - F.col("least")))
    share = F.greatest(F.lit(1).cast("long"), F.bround(F.col("excess") * F.col("surplus") / F.greatest(F.sum("surplus").over(one), F.lit(1))).cast("long"))
    t = t.withColumn("cut", F.when((F.col("excess") > 0) & (F.col("surplus") > 0), F.least(share, "surplus")).otherwise(0).cast("long"))
    before = one.orderBy(F.desc("surplus"), "name").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("cut", F.least(F.col("cut"), F.greatest(F.lit(0), F.col("excess") - F.coalesce(F.sum("cut").over(before), F.lit(0)))).cast("long"))
    t = t.withColumn("left", F.greatest(F.lit(0), F.col("excess") - F.sum("cut").over(one))).withColumn("more", F.col("surplus") - F.col("cut"))
    rank = F.row_number().over(one.orderBy(F.desc("more"), "name"))
    t = t.withColumn("cut", F.col("cut") + F.when((F.col("excess") > 0) & (F.col("more") > 0) & (rank <= F.col("left")), 1).otherwise(0))
    t = t.withColumn("room", F.col("n") - F.col("base"))
    roomiest = one.orderBy(F.desc("room"), "name").rowsBetween(Window.unboundedPreceding, -1)
    add = F.greatest(F.lit(0), F.least(F.col("room"), -F.col("excess") - F.coalesce(F.sum("room").over(roomiest), F.lit(0))))
    return t.withColumn("add", F.when(F.col("excess") < 0, add).otherwise(0)).select("name", (F.col("base") - F.col("cut") + F.col("add")).cast("long").alias("quota"))


def augment(pool: DataFrame, current: DataFrame, targets: DataFrame, name: str, score: str, tie: Column) -> DataFrame:
    """Rows of *pool* that fill classes up to their targets, best score first.

    *current* has (name, n), *targets* (name, target); classes without a target take nothing.
    """
    need = targets.join(small(current), "name", "left").select(F.col("name").alias(name), F.greatest(F.lit(0), F.col("target") - F.coalesce("n", F.lit(0))).alias("_need"))
    most = top_of(need, "_need")
    rank = F.row_number().over(Window.partitionBy(name).orderBy(F.desc(score), tie))
    rows = pool.join(small(need.filter("_need > 0")), name).withColumn("_rank", rank).filter(F.col("_rank") <= most)
    return rows.filter(F.col("_rank") <= F.col("_need")).drop("_rank", "_need")


def proportional(df: DataFrame, name: str, total: int, least: int, key: Column) -> DataFrame:
    """A stratified sample: each class its share of *total* but at least *least*, then cut to *total*."""
    whole = df.groupBy(name).agg(F.count(F.lit(1)).alias("_size"))
    share = whole.withColumn("_take", F.least(F.col("_size"), F.greatest(F.lit(least), F.bround(F.lit(float(total)) * F.col("_size") / F.sum("_size").over(Window.partitionBy(F.lit(1))))))).select(name, "_take")
    rows = hash_rank(df.withColumn("_key", key), [name], "_key", "_rank").join(small(share), name).filter("_rank <= _take")
    return rows.orderBy("_key").limit(total).drop("_key", "_rank", "_take")


def review_sample(df: DataFrame, name: str, n: int, key: Column) -> DataFrame:
    """The first *n* rows of each class in order of *key*."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(name).orderBy(key))).filter(F.col("_rank") <= n).drop("_rank")


def category_order(c: Column, order: list[str]) -> Column:
    """The place of a category in a fixed list, unknown ones last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), c), F.lit(0)), F.lit(99))
