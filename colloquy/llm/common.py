"""Folding, shingles and sketches used by several operators."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DROP = re.compile(r"[\W_]+")
_SLOW = np.uint32(0xFFFFFFFF)
_MASK = np.uint64(0x1FFFFF)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fold(text: str | None) -> str:
    """Unicode compatibility form, lower case, letters and digits only; null gives ''."""
    if not text:
        return ""
    return _DROP.sub("", unicodedata.normalize("NFKC", text).lower())


@cache
def _folding() -> np.ndarray:
    """What a character of the basic plane folds to by itself: a character, 0 for nothing, or _SLOW where
    its neighbours or several characters come into it. The last place stands for all other planes."""
    out = np.zeros(0x10001, np.uint32)
    out[0x10000] = _SLOW
    for c in range(0x10000):
        form = unicodedata.normalize("NFKC", chr(c))
        if any(unicodedata.category(x)[0] == "M" or 0x1160 <= ord(x) <= 0x11FF for x in form) or form == "Σ" or 0xD800 <= c < 0xE000:
            out[c] = _SLOW
        elif left := _DROP.sub("", form.lower()):
            out[c] = ord(left) if len(left) == 1 else _SLOW
    return out


def fold_many(texts: Iterable[str | None]) -> list[str]:
    """:func:`fold` of many texts at once, by table for those whose characters fold one by one."""
    texts = [t or "" for t in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    to = _folding()[np.minimum(c, 0x10000)]
    to[(c >= 0x1F300) & (c < 0x1FB00)] = 0  # pictographs
    ends = np.cumsum(sizes)
    slow = np.flatnonzero(to == _SLOW)
    slow = np.searchsorted(slow, ends) > np.searchsorted(slow, ends - sizes)
    at = np.flatnonzero(to)
    kept = np.searchsorted(at, ends)
    whole = to[at]
    whole[whole == _SLOW] = 0x20
    whole = whole.tobytes().decode("utf-32-le", "surrogatepass")
    return [fold(t) if s else whole[a:b] for t, s, a, b in zip(texts, slow, np.append(0, kept), kept)]


def codes(folded: str) -> np.ndarray:
    return np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def grams3(folded: str) -> np.ndarray:
    """Distinct runs of three characters, each packed without loss into 63 bits."""
    c = codes(folded)
    if c.size < 3:
        return np.empty(0, np.uint64)
    return np.unique((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])


def record_text(messages: Column) -> Column:
    """All message contents in order without a separator; a null content counts as ''."""
    return F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), "")


def hash_sample(df: DataFrame, keys: list[Column], rows: int) -> DataFrame:
    """About *rows* rows (all if there are no more), those with the smallest hashes of *keys*.

    A threshold on the hash, set from a count: tasks send only what is taken, however many there are.
    """
    n = df.count()
    if n <= rows:
        return df
    part = F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / float(1 << 53)
    return df.filter(part < rows / n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), wraps silently."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def permutations(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, size=k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, size=k, dtype=np.uint64)


def minhash_many(sets: list[np.ndarray], k: int, seed: int) -> np.ndarray:
    """Signatures (rows x k, uint32) of many non-empty sets at once.

    Each permutation is a multiply-add on mixed 64-bit shingles; the upper 32 bits are kept and the
    minimum is taken per set with one ``reduceat`` over the concatenated sets.
    """
    if not sets:
        return np.empty((0, k), np.uint32)
    sizes = np.fromiter((s.size for s in sets), np.int64, len(sets))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    x = mix(np.concatenate(sets))
    a, b = permutations(k, seed)
    out = np.empty((len(sets), k), np.uint32)
    for i in range(k):
        h = ((x * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32)
        out[:, i] = np.minimum.reduceat(h, starts)
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of *rows* columns (rows x bands, int64); the band number is mixed in."""
    n, k = signature.shape
    count = k // rows
    key = np.zeros((n, count), np.uint64)
    part = signature[:, : count * rows].reshape(n, count, rows).astype(np.uint64)
    for r in range(rows):
        key = mix((key * _MIX) ^ part[:, :, r])
    return mix(key ^ (np.arange(count, dtype=np.uint64) * _MIX)[None, :]).view(np.int64)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if a.size == 0 or b.size == 0:
        return 0
    if a.size > b.size:
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == b.size] = 0
    return int(np.count_nonzero(b[at] == a))
