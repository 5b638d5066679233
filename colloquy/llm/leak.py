"""Problem 6: passages of held-out items inside a corpus.

Method: pigeonhole edit matching. Items are cut into overlapping pieces of eight folded characters,
one at every ``STEP``-th place. A passage, a piece with ``SIDE`` characters on either side, that stands
in a document with at most ``BUDGET`` edits outside the piece holds the piece unchanged. Exact piece hits
are found by rolling hashes of the whole document against the pieces of all items; around a hit the
passage is verified with Myers' bit-parallel distance. Documents with a verified passage are then
measured exactly: the share of the item's 8-sequences they hold.

Nothing that reaches the limit of 40 % is lost where texts are copied, edited, cut and rearranged: an
edit or a cut removes seven or more neighbouring 8-sequences, so if two of five are left, some run of
them is at least three long, that is ten verbatim characters. Ten characters hold a piece at every
place mod 3, and leave at most BUDGET = 4 of the passage's 14 characters open. No part of an item is
favoured and passages may stand in any order, anywhere in the document.

The items travel to the workers when they have at most ``broadcast_chars`` characters (checked). A
larger set is joined: a bit map of fixed size (``BLOOM`` bits, however many items) keeps the document
runs that may be pieces, and only those are shuffled, spread over salts; documents and items meet
where enough pieces agree. Both give the same rows.

Defined results: null and empty texts leak nothing and are leaked by nothing; items under eight folded
characters have no 8-sequences and are left out; repeated document ids give one row; extra columns are
ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from . import common as C

SEQ, STEP, SIDE, BUDGET = 8, 3, 3, 4
BLOOM = 1 << 26
SALTS = 8
_POWERS = C.permutations(SEQ, 6)[0]


def seqs(folded: str, k: int = SEQ) -> set[str]:
    return {folded[i : i + k] for i in range(len(folded) - k + 1)}


def runs(folded: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of all runs of eight characters of many texts."""
    sizes = np.fromiter((max(0, len(f) - SEQ + 1) for f in folded), np.int64, len(folded))
    text = np.repeat(np.arange(len(folded)), sizes)
    place = np.arange(text.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    c = C.codes("".join(folded))
    lengths = np.fromiter(map(len, folded), np.int64, len(folded))
    at = place + np.repeat(np.cumsum(lengths) - lengths, sizes)
    if not text.size:
        return text, place, np.empty(0, np.uint64)
    whole = np.zeros(c.size - SEQ + 1, np.uint64)
    for j in range(SEQ):
        whole += c[j : j + whole.size] * _POWERS[j]
    return text, place, C.mix(whole[at])


def pieces(folded: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, place, hash) of the pieces of many items; of small items every place is one."""
    item, place, key = runs(folded)
    small = np.fromiter((len(f) < SEQ + 9 for f in folded), bool, len(folded))
    keep = (place % STEP == 0) | small[item]
    return item[keep], place[keep], key[keep]


def myers(pattern: str, text: str, budget: int) -> bool:
    """Whether *pattern* stands in some part of *text* with at most *budget* edits.

    Column-wise bit-parallel distance: one word of vertical differences, updated per character.
    """
    m = len(pattern)
    if m <= budget:
        return True
    peq: dict[str, int] = defaultdict(int)
    for i, ch in enumerate(pattern):
        peq[ch] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for ch in text:
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        if score <= budget:
            return True
        ph = ph << 1
        mh = mh << 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return False


class Matcher:
    """Items prepared for matching; built once in a worker."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, f) for i, f in zip((i for i, _ in items), C.fold_many(t for _, t in items)) if i is not None and len(f) >= SEQ]
        item, place, key = pieces([f for _, f in self.items])
        order = np.argsort(key, kind="stable")
        self.item, self.place, self.key = item[order], place[order], key[order]
        bits = min(26, max(12, (64 * key.size).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[key >> self.shift] = True
        self.seqs = lru_cache(4096)(lambda n: frozenset(seqs(self.items[n][1])))

    def passage_stands(self, n: int, off: int, folded: str, at: int) -> bool:
        """Whether the passage around the piece at *off* of item *n* stands in the text around *at*."""
        item = self.items[n][1]
        lo, hi = max(0, off - SIDE), min(len(item), off + SEQ + SIDE)
        start = at - (off - lo)
        if start >= 0 and folded.startswith(item[lo:hi], start):
            return True
        budget = min(BUDGET, hi - lo - SEQ)
        return myers(item[lo:hi], folded[max(0, start - budget) : start + (hi - lo) + budget], budget)

    def find(self, folded: list[str], limit: float) -> Iterator[tuple[int, int, float]]:
        """(text, item, share) where a passage stands in a text and the share reaches the limit."""
        text, at, key = runs(folded)
        some = np.flatnonzero(self.table[key >> self.shift])
        lo = np.searchsorted(self.key, key[some])
        hi = np.searchsorted(self.key, key[some], side="right")
        verified: dict[int, set[int]] = defaultdict(set)
        for t, p, a, b in zip(text[some].tolist(), at[some].tolist(), lo.tolist(), hi.tolist()):
            for k in range(a, b):
                n = int(self.item[k])
                if n not in verified[t] and self.passage_stands(n, int(self.place[k]), folded[t], p):
                    verified[t].add(n)
        for t, found in verified.items():
            own = seqs(folded[t]) if found else set()
            for n in sorted(found):
                want = self.seqs(n)
                share = len(want & own) / len(want)
                if share >= limit:
                    yield t, self.items[n][0], share


_SCHEMA = "doc_id long, item_id long, share double"


def _search(items: list[tuple[int, str]], limit: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(items)
        for pdf in batches:
            docs = pdf["doc_id"].to_numpy()
            rows = []
            for n in range(0, len(pdf), 1000):
                rows += [(docs[n + t], i, s) for t, i, s in matcher.find(C.fold_many(pdf["text"].iloc[n : n + 1000]), limit)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share"])

    return run


def _item_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        item, _, key = pieces(C.fold_many(pdf["item_text"]))
        made = pd.DataFrame({"item_id": pdf["item_id"].to_numpy()[item], "key": key.view(np.int64)}).drop_duplicates()
        yield made.assign(least=np.maximum(1, made.groupby("item_id")["key"].transform("size") // 10 - 1).astype(np.int64))


def _known_runs(words: np.ndarray):
    """Distinct runs of documents whose bit is set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n in range(0, len(pdf), 1000):
                text, _, key = runs(C.fold_many(pdf["text"].iloc[n : n + 1000]))
                bit = (key % np.uint64(BLOOM)).astype(np.int64)
                known = (words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
                ids = pdf["doc_id"].to_numpy()[n : n + 1000]
                yield pd.DataFrame({"doc_id": ids[text[known]], "key": key[known].view(np.int64)}).drop_duplicates()

    return run


def _pairwise(limit: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = lru_cache(1024)(lambda item, text: Matcher([(item, text)]))
        for pdf in batches:
            folded = C.fold_many(pdf["text"])
            rows = [(doc, i, s) for doc, text, item, known in zip(pdf["doc_id"], folded, pdf["item_id"], pdf["item_text"]) for _, i, s in matcher(item, known).find([text], limit)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share"])

    return run


def _joined(docs: DataFrame, held: DataFrame, limit: float) -> DataFrame:
    """Documents and items that share pieces, by a shuffle of the runs that may be pieces."""
    known = checkpoint(held.mapInPandas(_item_pieces, "item_id long, key long, least long"))
    bits = known.select(F.col("key").bitwiseAND(F.lit(BLOOM - 1)).alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("bits"))
    words = np.zeros(BLOOM // 64, np.uint64)
    for word, value in bits.collect():  # at most BLOOM / 64 rows
        words[word] = np.uint64(value & 0xFFFFFFFFFFFFFFFF)
    hits = docs.mapInPandas(_known_runs(words), "doc_id long, key long").withColumn("salt", F.pmod("doc_id", F.lit(SALTS)).cast("int"))
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = hits.join(spread, ["key", "salt"]).groupBy("doc_id", "item_id").agg(F.countDistinct("key").alias("n"), F.min("least").alias("least"))
    both = checkpoint(both.filter("n >= least").select("doc_id", "item_id"))
    return both.join(docs, "doc_id").join(held, "item_id").select("doc_id", "text", "item_id", "item_text").mapInPandas(_pairwise(limit), _SCHEMA)


def leaked_passages(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    limit: float = 0.4,
    broadcast_chars: int = 4_000_000,
) -> DataFrame:
    """(doc_id, item_id, share): documents holding a passage of an item within the edit budget and at
    least *limit* of its 8-sequences."""
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    held = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item_text")).filter("item_id is not null and item_text is not null")
    n, chars = held.select(F.count(F.lit(1)), F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()
    if n <= broadcast_chars and chars <= broadcast_chars:
        known = [(r[0], r[1]) for r in held.collect()]
        out = docs.mapInPandas(_search(known, limit), _SCHEMA)
    else:
        out = _joined(docs, held, limit)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def leak_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: suite, number of documents that leak it and the largest share."""
    known = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("suite", F.lit("unknown")).alias("suite")).groupBy("item_id").agg(F.min("suite").alias("suite"))
    return leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("share").alias("max_share")).join(known, "item_id")
