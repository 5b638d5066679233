"""Problem 5: near-duplicate records with small edits.

Method: bit-sliced comparison. Every distinct text gets a 192-bit sketch (two bits of each of 96
minwise hashes). Candidate buckets come from bands of the same hashes. Inside the buckets the
sketches are stored vertically, one big integer per bit plane with one bit per lane; for every
offset d the planes are compared with themselves shifted by d, and all distances are updated at once
with carry-save counters. A block is abandoned as soon as all its lanes exceed the radius.

Exact copies are collapsed before any bucket is built (a class is a distinct folded text of a tag,
named by 64 bits of its hash), so copies never meet in a bucket. Buckets with more than ``block``
classes are cut into groups and compared group against group in separate tasks; every pair is still
compared. Which buckets are that large is estimated from the lanes of every few classes: a bucket
misjudged costs time, never a pair.

Defined results: texts under three folded characters (null and empty ones too) have no
3-sequences and belong to no class; rows with the same id count once; null ids are left out; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from . import common as C

HASHES, SEED = 96, 5
PLANES = 2 * HASHES
RADIUS = 61  # 3.5 deviations above the mean distance at a similarity of 0.6
BLOCK = 4096
HOT_BROADCAST = 50_000
CROWDED, SALTS = 1000, 16  # members from which a class is spread over salts when ids are paired
_CLASS = "tag string, id string, cls long, s0 long, s1 long, s2 long, keys array<long>"


def _class(tag: str, folded: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{tag}\0{folded}".encode("utf-8", "surrogatepass")) - (1 << 63)


def _classes(rows: int, bands: int):
    """Class, sketch and band keys of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            folded = C.fold_many(pdf["text"])
            keep = [n for n, f in enumerate(folded) if len(f) >= 3]
            if not keep:
                continue
            sig = C.minhash_many([C.grams3(folded[n]) for n in keep], HASHES, SEED)
            bits = np.packbits(np.concatenate([sig & 1, (sig >> 1) & 1], axis=1).astype(np.uint8), axis=1).view(np.int64)
            part = pdf.iloc[keep]
            yield pd.DataFrame(
                {
                    "tag": part["tag"].to_numpy(),
                    "id": part["id"].to_numpy(),
                    "cls": np.array([_class(t, folded[n]) for t, n in zip(part["tag"], keep)], np.int64),
                    **{f"s{n}": bits[:, n] for n in range(3)},
                    "keys": list(C.bands(sig[:, : rows * bands], rows)),
                }
            )

    return run


def _planes(sketches: np.ndarray) -> list[int]:
    """Bit planes of (lanes x bytes) sketches; lane n is bit n of each plane."""
    bits = np.unpackbits(sketches, axis=1)
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in packed]


def _within(a: list[int], b: list[int], lanes: int, radius: int, step: int = 16) -> int:
    """Mask of the lanes in which the distance of the planes *a* and *b* is at most *radius*.

    Carry-save: the bits of *step* planes are added into vertical counters; after every step the
    lanes beyond the radius are struck out and the block is abandoned when none is left.
    """
    alive = lanes
    counters: list[int] = []
    for n in range(0, len(a), step):
        waiting: dict[int, list[int]] = {0: [a[k] ^ b[k] for k in range(n, min(n + step, len(a)))]}
        level = 0
        while level in waiting or level < len(counters):
            bits = waiting.get(level, [])
            if level < len(counters):
                bits.append(counters[level])
            while len(bits) > 2:  # full adder: three bits of a weight give one of it and a carry
                x, y, z = bits.pop(), bits.pop(), bits.pop()
                u = x ^ y
                bits.append(u ^ z)
                waiting.setdefault(level + 1, []).append((x & y) | (u & z))
            if len(bits) == 2:
                x, y = bits
                bits = [x ^ y]
                if carry := x & y:
                    waiting.setdefault(level + 1, []).append(carry)
            if level < len(counters):
                counters[level] = bits[0] if bits else 0
            else:
                counters.append(bits[0] if bits else 0)
            level += 1
        over, equal = 0, alive
        for w in range(max(len(counters), radius.bit_length()) - 1, -1, -1):
            c = counters[w] if w < len(counters) else 0
            if radius >> w & 1:
                equal &= c
            else:
                over |= equal & c
                equal &= ~c
        alive &= ~over
        if not alive:
            return 0
    return alive


def _lanes_of(mask: int) -> np.ndarray:
    raw = mask.to_bytes((mask.bit_length() + 7) // 8, "little")
    return np.nonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little"))[0]


def _compare(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """All pairs within the radius of a frame sorted by (bucket, group)."""
    cls = pdf["cls"].to_numpy()
    run = np.concatenate(([0], np.cumsum((np.diff(pdf["key"].to_numpy()) != 0) | (np.diff(pdf["cell"].to_numpy()) != 0)))).astype(np.int64)
    side = pdf["side"].to_numpy()
    sk = np.ascontiguousarray(pdf[["s0", "s1", "s2"]].to_numpy(np.int64)).view(np.uint8)
    longest = np.bincount(run)
    order = np.argsort(longest[run], kind="stable")  # runs of like length side by side: few idle lanes
    cls, run, side, sk = cls[order], run[order], side[order], sk[order]
    size = longest[run]
    left, right = [], []
    for at in range(0, len(cls), 32768):
        # a run that starts in the block may end behind it
        end = min(len(cls), at + 32768 + int(size[min(len(cls), at + 32768) - 1]))
        planes = _planes(sk[at:end])
        r, s = run[at:end], side[at:end]
        own = min(32768, len(cls) - at)
        for d in range(1, int(size[at : at + own].max())):
            same = np.zeros(len(r), bool)
            stop = len(r) - d
            if stop <= 0:
                break
            same[:stop] = (r[:stop] == r[d:]) & ((s[:stop] == 0) | (s[:stop] != s[d:]))
            same[own:] = False
            if not same.any():
                continue
            lanes = int.from_bytes(np.packbits(same, bitorder="little").tobytes(), "little")
            mask = _within(planes, [p >> d for p in planes], lanes, radius)
            if mask:
                hit = _lanes_of(mask)
                left.append(cls[at + hit])
                right.append(cls[at + hit + d])
    if not left:
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    x, y = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _sliced(radius: int, target: int = 131072):
    """Streams a partition sorted by (key, cell); whole runs are handed on, however batches fall."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows < target:
                continue
            all_ = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            key, cell = all_["key"].to_numpy(), all_["cell"].to_numpy()
            cut = np.nonzero((key != key[-1]) | (cell != cell[-1]))[0]
            cut = int(cut[-1]) + 1 if cut.size else 0
            if cut:
                yield _compare(all_.iloc[:cut], radius)
            held = [all_.iloc[cut:]]
            rows = len(all_) - cut
        if rows:
            yield _compare(pd.concat(held, ignore_index=True), radius)

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cache: dict[str, np.ndarray] = {}
            sim = np.zeros(len(pdf))
            for n, (ta, tb) in enumerate(zip(pdf["text_a"], pdf["text_b"])):
                for t in (ta, tb):
                    if t not in cache:
                        cache[t] = C.grams3(t)
                x, y = cache[ta], cache[tb]
                k = C.common(x, y)
                sim[n] = k / (x.size + y.size - k)
            out = pdf[["tag", "rep_a", "rep_b"]].assign(similarity=sim)
            yield out[sim >= threshold]

    return run


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        folded = C.fold_many(pdf["text"])
        yield pd.DataFrame({"cls": np.array([_class(t, f) for t, f in zip(pdf["tag"], folded)], np.int64), "text": folded})


def near_duplicate_pairs(
    df: DataFrame,
    id_col: str = "id",
    text_col: str = "text",
    tag_col: str | None = None,
    threshold: float = 0.55,
    radius: int = RADIUS,
    block: int = BLOCK,
    rows_per_band: int = 3,
    bands: int = 24,
) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): links between different texts and the class every id belongs to.

    pairs: tag, rep_a, rep_b, similarity, one row per two classes whose 3-sequences in common are at
    least *threshold* of those in either. members: tag, id, rep; rep is the least id of the class.
    Rows are compared within the same *tag_col* value only. *rows_per_band* times *bands* is at most
    HASHES; more rows thin out chance meetings, more bands find more pairs near the threshold.
    """
    if rows_per_band * bands > HASHES:
        raise ValueError(f"more than {HASHES} hashes")
    spark = df.sparkSession
    tag = F.col(tag_col).cast("string") if tag_col else F.lit("")
    rows = df.select(tag.alias("tag"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("id is not null and tag is not null")
    made = checkpoint(rows.mapInPandas(_classes(rows_per_band, bands), _CLASS))
    reps = checkpoint(made.groupBy("cls").agg(F.min(F.struct("id", "tag", "s0", "s1", "s2", "keys")).alias("x")).select("cls", F.col("x.id").alias("rep"), "x.tag", "x.s0", "x.s1", "x.s2", "x.keys"))
    members = made.select("cls", "id").distinct().join(reps.select("cls", "tag", "rep"), "cls").select("tag", "id", "rep")

    # the band number is mixed into its key; tags do not meet
    lanes = reps.select(F.explode("keys").alias("key"), F.xxhash64("tag").alias("t"), "cls", "s0", "s1", "s2").select(F.col("key").bitwiseXOR(F.col("t")).alias("key"), "cls", "s0", "s1", "s2")
    every = max(1, min(64, block // 64))
    sizes = lanes.filter(F.pmod(F.xxhash64("cls"), F.lit(every)) == 0).groupBy("key").agg((F.count(F.lit(1)) * every).alias("n")).filter(F.col("n") > block)
    hot = checkpoint(sizes.select("key", F.ceil(F.col("n") / block).cast("int").alias("groups")))
    if hot.limit(HOT_BROADCAST + 1).count() <= HOT_BROADCAST:
        hot = F.broadcast(hot)
    lanes = lanes.join(hot, "key", "left").withColumn("g", F.when(F.col("groups").isNull(), 0).otherwise(F.pmod("cls", F.coalesce("groups", F.lit(1)))).cast("int"))
    # cell (i, j), i <= j: side 0 marks rows compared with all that follow, side 1 and 2 only with each other
    n = F.coalesce("groups", F.lit(1))
    cells = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda k: F.struct(
            (F.least(F.col("g"), k) * n + F.greatest(F.col("g"), k)).cast("int").alias("cell"),
            F.when(F.col("g") == k, 0).when(F.col("g") < k, 1).otherwise(2).cast("int").alias("side"),
        ),
    )
    lanes = lanes.select("key", "cls", "s0", "s1", "s2", F.explode(cells).alias("c")).select("key", "cls", "s0", "s1", "s2", "c.cell", "c.side")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    lanes = lanes.repartition(parts, "key", "cell").sortWithinPartitions("key", "cell", "side")
    found = checkpoint(lanes.mapInPandas(_sliced(radius), "a long, b long").distinct())

    wanted = found.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(reps.select("cls", "tag", "rep"), "cls")
    texts = rows.join(wanted.select("tag", F.col("rep").alias("id")).distinct(), ["tag", "id"], "left_semi").select("tag", "text")
    # a representative delivered with another text too brings a class that nobody asked for
    texts = checkpoint(texts.mapInPandas(_texts, "cls long, text string").distinct().join(wanted, "cls"))
    side = lambda x: texts.select(F.col("cls").alias(x), F.col("tag").alias(f"tag_{x}"), F.col("rep").alias(f"rep_{x}"), F.col("text").alias(f"text_{x}"))
    full = found.join(side("a"), "a").join(side("b"), "b").filter("tag_a = tag_b and rep_a != rep_b")
    ahead = F.col("rep_a") < F.col("rep_b")
    full = full.select(F.col("tag_a").alias("tag"), F.when(ahead, F.col("rep_a")).otherwise(F.col("rep_b")).alias("rep_a"), F.when(ahead, F.col("rep_b")).otherwise(F.col("rep_a")).alias("rep_b"), "text_a", "text_b")
    return full.mapInPandas(_verify(threshold), "tag string, rep_a string, rep_b string, similarity double"), members


def expand_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of ids (tag, id_a, id_b), id_a < id_b: linked classes and copies within a class.

    One side of a class with more than ``CROWDED`` members is spread over salts, the other repeated for
    them, so no task holds all pairs of a class.
    """
    sizes = members.groupBy("tag", "rep").agg(F.count(F.lit(1)).alias("n"))
    known = members.join(sizes, ["tag", "rep"])
    spread = F.when(F.col("n") > CROWDED, F.lit(SALTS)).otherwise(F.lit(1))
    left = known.select("tag", F.col("rep").alias("rep_a"), F.col("id").alias("x"), "n", F.pmod(F.xxhash64("id"), spread).cast("int").alias("salt"))
    linked = links.join(sizes.withColumnRenamed("rep", "rep_a"), ["tag", "rep_a"]).select("tag", "rep_a", "rep_b", F.explode(F.sequence(F.lit(0), spread - 1)).alias("salt"))
    right = members.select("tag", F.col("rep").alias("rep_b"), F.col("id").alias("y"))
    across = linked.join(right, ["tag", "rep_b"]).join(left, ["tag", "rep_a", "salt"]).select("tag", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    copies = known.filter("n > 1").select("tag", F.col("rep").alias("rep_a"), F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), spread - 1)).alias("salt"))
    inside = left.filter("n > 1").join(copies, ["tag", "rep_a", "salt"]).filter("x < y").select("tag", F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return across.filter("id_a != id_b").unionByName(inside).distinct()


def groups(links: DataFrame, members: DataFrame, rounds: int = 30) -> DataFrame:
    """One row per id: tag, id, group_id (least id of its group), n_links to other classes.

    Connected components over class representatives by repeated minimum labels with pointer jumping;
    only classes that have a link take part. Each round is cut with a checkpoint and the loop ends
    when no label changes.
    """
    edges = checkpoint(links.select("tag", F.col("rep_a").alias("u"), F.col("rep_b").alias("v")).unionByName(links.select("tag", F.col("rep_b").alias("u"), F.col("rep_a").alias("v"))))
    labels = checkpoint(edges.select("tag", "u").distinct().withColumn("label", F.col("u")))
    for _ in range(rounds):
        best = edges.join(labels.withColumnRenamed("u", "v"), ["tag", "v"]).groupBy("tag", "u").agg(F.min("label").alias("near"))
        new = labels.join(best, ["tag", "u"]).select("tag", "u", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = new.select("tag", F.col("u").alias("label"), F.col("label").alias("next"))
        new = new.join(jump, ["tag", "label"], "left").select("tag", "u", F.coalesce("next", "label").alias("label"), "old")
        new = checkpoint(new)
        labels = new.select("tag", "u", "label")
        if new.filter("label != old").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    degree = edges.groupBy("tag", "u").agg(F.count(F.lit(1)).alias("n_links"))
    known = labels.join(degree, ["tag", "u"]).withColumnRenamed("u", "rep")
    return members.join(known, ["tag", "rep"], "left").select(
        "tag", "id", F.coalesce("label", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
