"""Problem 1: records of evaluation splits that also stand in the training split.

Method: minwise hash shingles with banded buckets; only buckets holding both sides give candidates;
candidates are verified on the exact sets of 3-sequences; confirmed pairs are counted by split and
source.

A training record may hold an evaluation record inside a longer dialogue, with other message borders
or inside one message, so what is signed is neither the record nor the message: it is windows of the
folded record text. A window stands around every anchor, a 3-sequence whose hash is the least of its
``REACH`` neighbours on either side, so both records cut the same windows wherever they agree. Each
window gives ``BANDS`` bucket keys of its anchor and ``ROWS`` minwise hashes of its 3-sequences. An
evaluation record smaller than two windows has few of them inside a longer text, so short messages
are signed once more by themselves and small evaluation records look for those too.

Every row of a bucket also carries 512 bits of its record: a bit per 3-sequence. A pair stays only
while the bits that the training record lacks are what a pair at the limit may lack, two deviations
allowed for. So chance meetings end inside the bucket join, before anything is written: their number
grows with the square of the records, what leaves the join does not.

Training rows whose key no evaluation record has are left out before the shuffle by a bit map of the
evaluation keys; its size follows their number up to ``MOST_BITS``. It may keep a row too many, never
one too few.

Skew. No key is left out. Keys that many evaluation records have are salted: the training rows of the
key are spread over as many tasks as there are ``SPREAD`` evaluation rows, which meet them in each.

Defined results: a null or empty message list, null contents and records under three folded
characters have no 3-sequences and never form a pair; rows with the same id count once; null ids are
left out; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from . import common as C

ROWS, BANDS, SEED = 2, 2, 11
REACH, HALF = 8, 24  # neighbours an anchor is the least of; 3-sequences of a window on either side of it
WORDS = 8  # 64-bit words of a record sketch
LEAST_BITS, MOST_BITS, BLOCK = 1 << 20, 1 << 28, 1 << 13  # bits of the map of evaluation keys; 64-bit words of a part of it
SPREAD, MOST_SALTS = 1000, 256
SMALL = 2 * HALF  # characters of a message that is signed by itself, and of a record that looks for such messages
HOT_BROADCAST = 50_000
FEW = 1_000_000  # ids of paired records that travel to the texts; more are shuffled with them
_SKETCH = [f"s{i}" for i in range(WORDS)]
_LANES = f"rid long, key long, bits int, {', '.join(f'{c} long' for c in _SKETCH)}"


def _least_near(h: np.ndarray, reach: int) -> np.ndarray:
    """The least value within *reach* places of every place."""
    width, out, have = 2 * reach + 1, h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _grams(folded: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, mixed 3-sequence) of all places of many texts of at least three characters."""
    c = C.codes("".join(folded))
    row = np.repeat(np.arange(len(folded)), np.fromiter((len(f) - 2 for f in folded), np.int64, len(folded)))
    at = np.arange(row.size) + 2 * row  # every text has two places fewer than characters
    return row, C.mix((c[at] << np.uint64(42)) | (c[at + 1] << np.uint64(21)) | c[at + 2])


def windows(folded: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of all windows of many texts of at least three characters."""
    row, grams = _grams(folded)
    order = (C.mix(grams ^ np.uint64(SEED)) >> np.uint64(32)).astype(np.uint32)
    padded = np.full(row.size + REACH * (len(folded) + 1), np.iinfo(np.uint32).max, np.uint32)
    place = np.arange(row.size) + REACH * (row + 1)
    padded[place] = order
    anchor = np.nonzero(order == _least_near(padded, REACH)[place - REACH])[0]

    sizes = np.bincount(row, minlength=len(folded))
    start = np.cumsum(sizes) - sizes
    edge = np.empty(2 * anchor.size, np.int64)
    edge[0::2] = np.maximum(anchor - HALF, start[row[anchor]])
    edge[1::2] = np.minimum(anchor + HALF + 1, (start + sizes)[row[anchor]])
    a, b = C.permutations(ROWS * BANDS, SEED)
    keys = []
    for band in range(BANDS):
        key = grams[anchor] ^ np.uint64(band)
        for i in range(band * ROWS, (band + 1) * ROWS):
            h = np.append(((grams * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32), np.uint32(0))
            key = C.mix((key * C._MIX) ^ np.minimum.reduceat(h, edge)[0::2].astype(np.uint64))
        keys.append(key.view(np.int64))
    return np.tile(row[anchor], BANDS), np.concatenate(keys)


def sketches(folded: list[str]) -> np.ndarray:
    """``WORDS`` 64-bit words of every text: a bit per 3-sequence."""
    row, grams = _grams(folded)
    out = np.zeros((len(folded), 64 * WORDS), bool)
    out[row, (C.mix(grams ^ np.uint64(SEED + 1)) % np.uint64(64 * WORDS)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.int64)


def _lanes(small_only: bool, known: np.ndarray | None = None):
    """Bucket rows of records: windows of the whole text and of short messages by themselves; with
    *small_only* the latter of small records only. *known* is a bit map of the keys that matter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n in range(0, len(pdf), 2000):
                parts = [list(p) for p in pdf["parts"].iloc[n : n + 2000]]
                whole = C.fold_many("".join(p) for p in parts)
                keep = [k for k, f in enumerate(whole) if len(f) >= 3]
                if not keep:
                    continue
                asked = [k for k in keep if len(parts[k]) > 1 and not (small_only and len(whole[k]) > SMALL)]
                single = [(k, m) for k in asked for m in set(parts[k]) if len(m) <= SMALL]
                units = [whole[k] for k in keep] + C.fold_many(m for _, m in single)
                owner = np.array(keep + [k for k, _ in single])
                fit = [u for u, f in enumerate(units) if 3 <= len(f) <= SMALL or u < len(keep)]
                row, key = windows([units[u] for u in fit])
                row = owner[fit][row]
                if known is not None:
                    bit = key & np.int64(64 * known.size - 1)
                    some = (known[bit >> 6] >> (bit & 63)) & 1 == 1
                    row, key = row[some], key[some]
                sort = np.lexsort((key, row))
                row, key = row[sort], key[sort]
                first = np.ones(row.size, bool)
                first[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
                row, key = row[first], key[first]
                sk = np.zeros((len(parts), WORDS), np.int64)
                sk[keep] = sketches([whole[k] for k in keep])
                bits = np.bitwise_count(sk.view(np.uint64)).sum(axis=1, dtype=np.int32)
                yield pd.DataFrame({"rid": pdf["rid"].to_numpy()[n : n + 2000][row], "key": key, "bits": bits[row], **{c: sk[row, i] for i, c in enumerate(_SKETCH)}})

    return run


def _records(df: DataFrame, id_col: str, messages: str) -> DataFrame:
    parts = F.transform(F.coalesce(F.col(messages), F.array()), lambda m: F.coalesce(m["content"], F.lit("")))
    return df.select(F.col(id_col).cast("string").alias("id"), parts.alias("parts")).filter("id is not null")


def _part(pdf: pd.DataFrame) -> pd.DataFrame:
    words = np.zeros(BLOCK, np.int64)
    words[pdf["word"] % BLOCK] = pdf["bits"]
    return pd.DataFrame({"part": [pdf["word"].iloc[0] // BLOCK], "words": [words.tobytes()]})


def _bit_map(keys: DataFrame) -> np.ndarray:
    """A bit per key, as 64-bit words; eight bits a key as far as ``MOST_BITS`` goes."""
    size = LEAST_BITS
    most = 8 * keys.count()
    while size < min(most, MOST_BITS):
        size *= 2
    bit = keys.select(F.col("key").bitwiseAND(F.lit(size - 1)).alias("b"))
    words = bit.groupBy(F.shiftright("b", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("bits"))
    out = np.zeros(size // 64, np.int64)
    for part, data in words.groupBy(F.floor(F.col("word") / BLOCK)).applyInPandas(_part, "part long, words binary").collect():  # at most MOST_BITS / 64 / BLOCK rows
        out[part * BLOCK : (part + 1) * BLOCK] = np.frombuffer(data, np.int64)
    return out


def _salted(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt: training rows of a hot key are spread, evaluation rows repeated for them."""
    hot = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SPREAD)
    hot = checkpoint(hot.select("key", F.least(F.ceil(F.col("n") / SPREAD), F.lit(MOST_SALTS)).cast("int").alias("salts")))
    n = hot.limit(HOT_BROADCAST + 1).count()
    if not n:
        return left.withColumn("salt", F.lit(0)), right.withColumn("salt", F.lit(0))
    if n <= HOT_BROADCAST:
        hot = F.broadcast(hot)
    salts = F.coalesce("salts", F.lit(1))
    left = left.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return left, right.join(hot, "key", "left").withColumn("salt", F.pmod("rid", salts).cast("int")).drop("salts")


def _may_hold(limit: float) -> Column:
    """Whether the training sketch (s0, ...) may hold *limit* of the evaluation sketch (e0, ...)."""
    lacking = sum((F.bit_count(F.col(f"e{i}").bitwiseAND(F.bitwise_not(F.col(f"s{i}")))) for i in range(WORDS)), F.lit(0))
    expected = (1 - limit) * F.col("ebits") * (1 - F.col("bits") / F.lit(64.0 * WORDS))
    return F.sqrt(lacking) <= F.sqrt(expected) + 1  # lacking <= expected + 2 * sqrt(expected) + 1


def _of(texts: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The texts of found records; the rest is not shuffled."""
    ids = found.select(key).distinct()
    return texts.join(F.broadcast(ids), key, "left_semi") if ids.limit(FEW + 1).count() <= FEW else texts


def _verify(limit: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cache: dict[str, np.ndarray] = {}
            rows, text, y = [], None, None
            for split, a, b, ta, tb in zip(pdf["split_name"], pdf["eval_id"], pdf["train_id"], pdf["eval_text"], pdf["train_text"]):
                x = cache.get(ta)
                if x is None:
                    x = cache[ta] = C.grams3(C.fold(ta))
                if tb != text:
                    text, y = tb, C.grams3(C.fold(tb))
                n = C.common(x, y)
                if x.size and n >= limit * x.size:
                    rows.append((split, a, b, n / x.size, n / (x.size + y.size - n)))
            yield pd.DataFrame(rows, columns=["split_name", "eval_id", "train_id", "containment", "jaccard"])

    return run


def cross_split_overlaps(splits: dict[str, DataFrame], train: DataFrame, id_col: str = "id", messages: str = "messages", limit: float = 0.7) -> DataFrame:
    """Confirmed pairs (split_name, eval_id, train_id, containment, jaccard).

    A pair is confirmed when the training record holds at least *limit* of the 3-sequences of the
    evaluation record.
    """
    tr = _records(train, id_col, messages).withColumn("rid", F.xxhash64("id"))
    ev = None
    for name, df in splits.items():
        one = _records(df, id_col, messages).withColumn("split_name", F.lit(name))
        ev = one if ev is None else ev.unionByName(one)
    ev = ev.withColumn("rid", F.xxhash64("split_name", "id"))

    left = ev.select("rid", "parts").mapInPandas(_lanes(True), _LANES)
    left = checkpoint(left.select(F.col("rid").alias("erid"), "key", F.col("bits").alias("ebits"), *(F.col(c).alias(f"e{i}") for i, c in enumerate(_SKETCH))))
    left, right = _salted(left, tr.select("rid", "parts").mapInPandas(_lanes(False, _bit_map(left)), _LANES))
    found = checkpoint(left.join(right, ["key", "salt"]).filter(_may_hold(limit)).select("erid", "rid").distinct())

    evals = ev.select(F.col("rid").alias("erid"), "split_name", F.col("id").alias("eval_id"), F.array_join("parts", "").alias("eval_text"))
    trains = tr.select("rid", F.col("id").alias("train_id"), F.array_join("parts", "").alias("train_text"))
    pairs = found.join(_of(evals, found, "erid"), "erid").join(_of(trains, found, "rid"), "rid")
    done = pairs.select("split_name", "eval_id", "train_id", "eval_text", "train_text").mapInPandas(
        _verify(limit), "split_name string, eval_id string, train_id string, containment double, jaccard double"
    )
    return done.groupBy("split_name", "eval_id", "train_id").agg(F.max("containment").alias("containment"), F.max("jaccard").alias("jaccard"))


def overlap_report(pairs: DataFrame, train: DataFrame, id_col: str = "id", source: str = "meta.source") -> DataFrame:
    """Counts per split and source: pairs, evaluation records and training records concerned.

    A null source counts as 'unknown'.
    """
    sources = train.select(F.col(id_col).alias("train_id"), F.coalesce(F.col(source), F.lit("unknown")).alias("source")).groupBy("train_id").agg(F.min("source").alias("source"))
    return (
        pairs.join(sources, "train_id")
        .groupBy("split_name", "source")
        .agg(
            F.count(F.lit(1)).alias("n_pairs"),
            F.countDistinct("eval_id").alias("n_eval"),
            F.countDistinct("train_id").alias("n_train"),
        )
    )
