"""Problem 8: texts that look the same and differ in their characters.

Method: tokens are looked up in tries of the corpus vocabulary by a weighted edit automaton in which
look-alike letters and ignorable characters cost nothing. The spelling it reaches becomes the canonical
one; a token that reaches none is normalised by table (composed, ignorables out, letters as they are)
and joins the trie, so later look-alikes of it reach it. Which letters look alike is known to the
automaton only: without it "p\u0430per" stays as it is and meets no other text.
Characters outside tokens (blanks, width forms, compatibility ideographs) have one counterpart each
and are replaced by table. Tables and the words of the vocabulary are read from arrays of the
characters of many texts at once, as regular expressions over every character cost several times more;
those cut only the few texts that hold a suspicious character.

Only tokens that hold a suspicious character are looked up. Tokens and vocabulary meet in shards by
length and first letters of the skeleton, so no vocabulary is ever held in one place. Of the spellings
of a shard the plain ones of the corpus (without suspicious characters, never changed) come first, then
those of one script, then the more frequent; what looks alike therefore gets one spelling.

What counts as alike: full-width and half-width forms, single blanks of any kind, composed and
decomposed accents, ignorable characters, look-alike Greek and Cyrillic letters, compatibility
ideographs and radicals. Case, accents as such, line breaks, simplified and traditional characters,
and any visible character more or less stay different.

Defined results: a null text stays null and looks like no other; an empty text stays empty; extra
columns are ignored; repeated rows are kept once per (id, text).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint

# Letters of other scripts that look like a Latin letter, and the Latin letter.
LOOKALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ν": "v", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    # Latin letters of phonetic notation
    "ɑ": "a", "ɡ": "g",
}


@cache
def ignorables() -> str:
    """Format characters, variation selectors and fillers that show nothing."""
    fixed = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10)]
    shown = {0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2}
    found = [c for c in range(0x10000) if unicodedata.category(chr(c)) == "Cf" and c not in shown]
    return "".join(map(chr, sorted({*fixed, *found})))


@cache
def plain_table() -> dict[str, str]:
    """Characters with exactly one counterpart: blanks, width forms, compatibility ideographs, radicals, hyphens."""
    out = {"‐": "-", "‑": "-"}
    for c in range(0x10000):
        ch = chr(c)
        if unicodedata.category(ch) == "Zs" and c != 0x20:
            out[ch] = " "
            continue
        how = unicodedata.decomposition(ch)
        wide = how.startswith(("<wide>", "<narrow>"))
        ideograph = 0xF900 <= c <= 0xFAFF or 0x2E80 <= c <= 0x2FDF
        if (wide or ideograph) and len(to := unicodedata.normalize("NFKC", ch)) == 1 and to != ch:
            out[ch] = to
    out.update({"ﾞ": "゙", "ﾟ": "゚"})  # half-width voicing marks join the kana before them
    return {k: v for k, v in out.items() if k not in ignorables()}


@cache
def ignorable_set() -> frozenset[str]:
    return frozenset(ignorables())


def look(ch: str) -> str:
    """The letter that a decomposed character looks like."""
    return LOOKALIKES.get(ch, ch)


def by_table(token: str) -> str:
    """A token composed, without ignorables; its letters stay."""
    return unicodedata.normalize("NFC", "".join(c for c in token if c not in ignorable_set()))


def skeleton(token: str) -> str:
    """What all spellings that look like a token have in common; it names the shard in which they meet."""
    return unicodedata.normalize("NFC", "".join(look(c) for c in unicodedata.normalize("NFD", token) if c not in ignorable_set()))


def _class(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in chars)


@cache
def _patterns() -> tuple[str, str]:
    """Java patterns: segments (runs of kana, of other token characters, or of the rest), and what makes one suspicious."""
    kana = "\\p{IsHiragana}\\p{IsKatakana}\\x{30fc}\\x{3099}\\x{309a}"
    inside = f"[\\p{{L}}\\p{{N}}\\p{{M}}{_class(ignorables())}&&[^\\p{{IsHan}}{kana}]]"
    outside = f"[[^\\p{{L}}\\p{{N}}\\p{{M}}{_class(ignorables())}]\\p{{IsHan}}]"
    # besides marks and other scripts, what has a canonical equivalent: Korean letters, polytonic Greek, three signs
    suspicious = f"[\\p{{M}}\\x{{370}}-\\x{{52f}}\\x{{1100}}-\\x{{11ff}}\\x{{1f00}}-\\x{{1fff}}\\x{{2126}}\\x{{212a}}\\x{{212b}}{_class(ignorables())}{_class(''.join(LOOKALIKES))}]"
    return f"(?s)[{kana}{_class(ignorables())}]+|{inside}+|{outside}+", suspicious


# Wide punctuation of everyday text, replaced by plain search and replace.
EVERYDAY = {"，": ",", "：": ":", "（": "(", "）": ")", "？": "?", "！": "!", "；": ";", "～": "~"}
# Characters that need nothing but EVERYDAY: few ranges, so that the search stays cheap on every character.
ORDINARY = r"\t\n\r\x20-\x7e\xa1-\xac\xae-\x{24f}\x{2018}-\x{201d}\x{2026}\x{3001}-\x{3029}\x{3041}-\x{3096}\x{309d}-\x{30ff}\x{4e00}-\x{9fff}\x{1f300}-\x{1faff}" + "".join(EVERYDAY)

# What a token of an ordinary text is made of: its letters and digits that are neither ideographs nor kana.
LATIN = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\x{24f}"
ORDINARY_REST = r"0-9\x{3006}\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe"
# Such a token with a Latin letter, looked for only where a token begins; most characters fail the first range.
ORDINARY_WORD = f"(?=[0-\\x{{24f}}\\x{{3006}}])(?<![{LATIN}{ORDINARY_REST}])[{ORDINARY_REST}]*+[{LATIN}][{LATIN}{ORDINARY_REST}]*+"


def unusual(text: Column) -> Column:
    """Whether a text holds a character that the full table or the tokens must see to."""
    return F.coalesce(text.rlike(f"[^{ORDINARY}]"), F.lit(False))


# What the numpy table knows of a character.
IN_TOKEN, HAS_LATIN, SUSPICIOUS, IGNORED = 1, 2, 4, 8


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: its counterpart, and what it is (bits)."""
    to, kinds = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, np.uint8)
    for k, v in plain_table().items():
        to[ord(k)] = ord(v)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LNM":
            kinds[c] = IN_TOKEN | SUSPICIOUS if kind == "M" else IN_TOKEN
    han = [range(0x3021, 0x302A), range(0x3038, 0x303C), range(0x3400, 0x4DC0), range(0x4E00, 0xA000), range(0xF900, 0xFB00), range(0x16FF0, 0x16FF2), range(0x20000, 0x40000)]
    kana = [range(0x3041, 0x3097), range(0x309D, 0x30A0), range(0x30A1, 0x30FB), range(0x30FC, 0x3100), range(0x31F0, 0x3200), range(0xFF66, 0xFF70), range(0xFF71, 0xFF9E), range(0x1AFF0, 0x1B170)]
    for c in (0x2E80, 0x3005, 0x3007, 0x3099, 0x309A, 0x16FE2, *(c for r in (*han, *kana) for c in r)):
        kinds[c] &= 0xFF ^ IN_TOKEN
    for first, last in ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F)):
        kinds[first : last + 1] |= HAS_LATIN
    for first, last in ((0x370, 0x52F), (0x1100, 0x11FF), (0x1F00, 0x1FFF), (0x2126, 0x2126), (0x212A, 0x212B)):
        kinds[first : last + 1] |= SUSPICIOUS
    for ch in LOOKALIKES:
        kinds[ord(ch)] |= SUSPICIOUS
    for ch in ignorables():
        kinds[ord(ch)] |= SUSPICIOUS | IGNORED
    return to, kinds


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of many texts with a line break after each, characters with one counterpart replaced; the places where texts end."""
    to = _tables()[0]
    c = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return to[c], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))


def _steps(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Texts with characters of one counterpart replaced, and whether they hold a suspicious one."""
    if not texts:
        return [], np.zeros(0, bool)
    c, ends = _points(texts)
    begins = ends - np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    whole = c.tobytes().decode("utf-32-le", "surrogatepass")
    odd = np.bitwise_or.reduceat(_tables()[1][c], begins) & SUSPICIOUS > 0
    return [whole[a : b - 1] for a, b in zip(begins, ends)], odd


def plain_words(texts: list[str]) -> list[str]:
    """Distinct tokens with a Latin letter and no suspicious character."""
    if not texts:
        return []
    c, _ = _points(texts)
    kinds = _tables()[1][c]
    inside = kinds & IN_TOKEN > 0
    ignored = np.flatnonzero(kinds & IGNORED)
    if ignored.size:  # goes with a token before it, else with what is no token
        inside[ignored] = False
        place = np.where(kinds & IGNORED, -1, np.arange(c.size))
        before = np.maximum.accumulate(place)[ignored]
        inside[ignored] = (before >= 0) & inside[before]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))  # the last character is a line break
    if not edge.size:
        return []
    seen = np.bitwise_or.reduceat(kinds, edge)[0::2]
    some = (seen & HAS_LATIN > 0) & (seen & SUSPICIOUS == 0)
    whole = c.tobytes().decode("utf-32-le", "surrogatepass")
    return list({whole[a:b] for a, b in zip(edge[0::2][some].tolist(), edge[1::2][some].tolist())})


def _batches(batches: Iterator[pd.DataFrame], rows: int = 2000, chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Smaller batches: so many rows, fewer where texts are long."""
    for pdf in batches:
        sizes = pdf["text"].map(lambda t: len(t or "")).to_numpy(np.int64)
        part = np.maximum(np.cumsum(sizes) // chars, 0) + np.arange(len(pdf)) // rows
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(pdf)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield pdf.iloc[a:b]


def _scan(wanted: bool):
    """Rows whose text holds a suspicious character (or none of them), with the text as the table leaves it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _batches(batches):
            null = pdf["text"].isna().to_numpy()
            steps, odd = _steps(pdf["text"].where(~null, "").tolist())
            out = pdf.assign(step=pd.Series(steps, pdf.index, object).where(~null, None))
            yield out[odd == wanted]

    return run


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in _batches(batches):
        yield pd.DataFrame({"token": plain_words(pdf["text"].dropna().tolist())}, dtype=object)


class Trie:
    """Spellings of a vocabulary, decomposed, with a weighted edit automaton walking them."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, spelling: str | None = None) -> None:
        """A word and the spelling it stands for (itself); the first one of a walk stays."""
        node = self.root
        for ch in unicodedata.normalize("NFD", word):
            node = node.setdefault(ch, {})
        node.setdefault("", word if spelling is None else spelling)

    def match(self, token: str, budget: int = 0) -> tuple[int, str] | None:
        """The least (cost, spelling) within *budget*.

        States are (node, position) with the least cost at which they are reached. Free moves: the same
        character, look-alikes either way, skipped ignorables on either side. Any other replacement,
        omission or insertion costs one.
        """
        token, skip = unicodedata.normalize("NFD", token), ignorable_set()
        best: tuple[int, str] | None = None
        seen: dict[tuple[int, int], int] = {}
        todo = [(self.root, 0, 0)]
        while todo:
            node, at, cost = todo.pop()
            if seen.get((id(node), at), budget + 1) <= cost:
                continue
            seen[id(node), at] = cost
            here = token[at] if at < len(token) else None
            if here in skip:
                todo.append((node, at + 1, cost))
                continue
            if here is None and "" in node:
                best = min(best or (cost, node[""]), (cost, node[""]))
            for ch, child in node.items():
                if not ch:
                    continue
                if ch in skip:
                    todo.append((child, at, cost))
                elif here is not None and (ch == here or look(ch) == look(here)):
                    todo.append((child, at + 1, cost))
                elif here is not None and cost < budget:
                    todo.append((child, at + 1, cost + 1))
                if cost < budget:
                    todo.append((child, at, cost + 1))
            if here is not None and cost < budget:
                todo.append((node, at + 1, cost + 1))
        return best


def _scripts(token: str) -> int:
    """How many of Latin, Greek and Cyrillic the letters of a token come from."""
    return len({n for c in token if (n := unicodedata.name(c, "").split(" ")[0]) in ("LATIN", "GREEK", "CYRILLIC")})


def _shard(pdf: pd.DataFrame, budget: int) -> Iterator[tuple[str, str]]:
    """Canonical spellings of the suspicious tokens of one shard."""
    rows = list(zip(pdf["token"], pdf["n"], pdf["suspicious"]))
    trie = Trie()
    for token, _, look_up in rows:
        if not look_up:
            trie.add(token)
    for _, _, token in sorted((_scripts(t) > 1 or t != by_table(t), -int(n), t) for t, n, look_up in rows if look_up):
        if hit := trie.match(token, budget):
            yield token, hit[1]
        else:
            yield token, by_table(token)
            trie.add(token, by_table(token))


def _spell(budget: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for pdf in batches:  # sorted by shard: one is whole once the next begins
            held = pd.concat([held, pdf], ignore_index=True)
            cut = held.index[held["shard"] != held["shard"].iloc[-1]]
            if len(cut):
                yield pd.DataFrame([x for _, part in held.iloc[: cut[-1] + 1].groupby("shard") for x in _shard(part, budget)], columns=["token", "canonical"])
                held = held.iloc[cut[-1] + 1 :]
        if len(held):
            yield pd.DataFrame([x for _, part in held.groupby("shard") for x in _shard(part, budget)], columns=["token", "canonical"])

    return run


@F.pandas_udf(T.StringType())
def _skeleton(tokens: pd.Series) -> pd.Series:
    return tokens.map(skeleton)


def _shard_of(skeleton: Column) -> Column:
    return F.concat_ws("|", F.length(skeleton).cast("string"), F.substring(skeleton, 1, 3))


def canonical_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 0) -> DataFrame:
    """(doc_id, text, canonical): every text in one consistent form; texts that look the same are equal in it."""
    segments, suspicious = _patterns()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([*rows.schema.fields, T.StructField("step", T.StringType())])

    dirty = rows.mapInPandas(_scan(True), schema)
    dirty = checkpoint(dirty.withColumn("row", F.xxhash64("doc_id", "text")).dropDuplicates(["row", "doc_id"]))
    parts = checkpoint(dirty.select("row", F.posexplode(F.regexp_extract_all("step", F.lit(segments), F.lit(0))).alias("pos", "token")))
    wanted = parts.filter(F.col("token").rlike(suspicious)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    wanted = checkpoint(wanted.withColumn("shard", _shard_of(_skeleton("token"))))

    # vocabulary: the plain tokens with a Latin letter, cut as the suspicious ones are
    vocabulary = rows.select("text").mapInPandas(_words, "token string").groupBy("token").agg(F.lit(1).cast("long").alias("n"))
    vocabulary = vocabulary.withColumn("shard", _shard_of(F.col("token"))).join(wanted.select("shard").distinct(), "shard", "left_semi")
    meet = wanted.select("shard", "token", "n", F.lit(True).alias("suspicious")).unionByName(vocabulary.select("shard", "token", "n", F.lit(False).alias("suspicious")))
    spelled = meet.repartition("shard").sortWithinPartitions("shard", "token").mapInPandas(_spell(budget), "token string, canonical string")

    joined = parts.join(spelled, "token", "left").select("row", F.struct("pos", F.coalesce("canonical", "token").alias("s")).alias("p"))
    mended = joined.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "").alias("canonical"))
    cleaned = dirty.join(mended, "row", "left").select("doc_id", "text", F.coalesce("canonical", "step").alias("canonical"))
    clean = rows.mapInPandas(_scan(False), schema).select("doc_id", "text", F.col("step").alias("canonical"))
    return clean.unionByName(cleaned)


def look_alike_pairs(canonical: DataFrame) -> DataFrame:
    """(doc_a, doc_b): different stored texts with one canonical form, doc_a < doc_b.

    Stored texts are classes: classes of a form meet each other, documents of two classes meet in
    turn, so copies of one stored text never meet among themselves.
    """
    keyed = checkpoint(canonical.filter("text is not null").select("doc_id", F.md5("canonical").alias("form"), F.md5("text").alias("stored")))
    forms = keyed.groupBy("form").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).filter("lo != hi").select("form")
    some = checkpoint(keyed.join(forms, "form", "left_semi").distinct())
    stored = some.select("form", "stored").distinct()
    classes = stored.join(stored.withColumnRenamed("stored", "stored_b"), "form").filter("stored < stored_b")
    a = some.select("form", "stored", F.col("doc_id").alias("x"))
    b = some.select("form", F.col("stored").alias("stored_b"), F.col("doc_id").alias("y"))
    pairs = classes.join(a, ["form", "stored"]).join(b, ["form", "stored_b"])
    return pairs.filter("x != y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()
