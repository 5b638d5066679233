"""Overlaps, near duplicates and leaks against brute force on small made texts."""

import random
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.llm import common as C
from colloquy.llm import leak, neardup, overlap

WORDS = "订单 物流 退款 发票 尺寸 颜色 质量 客服 地址 电话 优惠 活动 安装 保修 维修 快递 包装 说明 价格 时间 order parcel refund colour size batch serial help".split()
MESSAGES = "array<struct<role:string,content:string>>"


def sentence(r, n):
    return "".join(r.choice(WORDS) + str(r.randrange(1000)) for _ in range(n))


def edit(r, text, n):
    chars = list(text)
    for _ in range(n):
        i = r.randrange(len(chars))
        chars[i] = r.choice("改换增删xyz")
    return "".join(chars)


def grams(text, k=3):
    f = "".join(c for c in unicodedata.normalize("NFKC", text or "").lower() if c.isalnum())
    return {f[i : i + k] for i in range(len(f) - k + 1)}


def test_fold():
    assert C.fold("Ａb，c！ ①é") == "abc1é"
    assert C.fold(None) == "" and C.fold("。。") == ""
    odd = ["Ａb，c！ ①é", None, "", "。。", "½℡ｱﾞ", "e\u0301", "ΑΣ", "İǅ", "한ᄒ", "😀a", "𝐀", "a…b"]
    assert C.fold_many(odd) == [C.fold(t) for t in odd] and C.fold_many([]) == []
    every = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    assert C.fold_many(every) == [C.fold(t) for t in every]
    assert set(map(int, C.grams3("abcabc"))) == set(map(int, C.grams3("abcab")))


@pytest.fixture(scope="module")
def dialogues():
    r = random.Random(4)
    train = {f"t{n}": [sentence(r, 6), sentence(r, 8), sentence(r, 6), sentence(r, 8)] for n in range(150)}
    dev = {f"d{n}": [sentence(r, 6), sentence(r, 8)] for n in range(20)}
    for n in range(0, 10):  # contained, some with edits
        dev[f"d{n}"] = [edit(r, m, n % 3) for m in train[f"t{n}"][: 2 + 2 * (n % 2)]]
    for n in range(60):  # a hot message
        train[f"t{n + 60}"][0] = "您好，请问有什么可以帮到您的，请您稍等片刻"
    dev["d15"][0] = "您好，请问有什么可以帮到您的，请您稍等片刻"
    dev["only_hot"] = ["您好，请问有什么可以帮到您的，请您稍等片刻"]
    dev["short"] = ["在吗"]
    train["short"] = ["在吗", "在的"]
    return train, dev


def to_df(spark, records, extra=()):
    rows = [(k, [{"role": "user" if i % 2 == 0 else "assistant", "content": m} for i, m in enumerate(ms)], "x") for k, ms in records.items()]
    return spark.createDataFrame(rows + list(extra), f"id string, messages {MESSAGES}, content string")


@pytest.mark.parametrize("spread", [100, 1])
def test_overlaps_equal_brute_force(spark, dialogues, spread, monkeypatch):
    monkeypatch.setattr(overlap, "SPREAD", spread)
    train, dev = dialogues
    expected = set()
    for d, ms in dev.items():
        a = grams("".join(ms))
        expected |= {(d, t) for t, mt in train.items() if a and len(a & grams("".join(mt))) >= 0.7 * len(a)}
    extra = [(None, None, "y"), ("n1", None, "y"), ("n2", [], "y"), ("n3", [{"role": "user", "content": None}], "y")]
    tr, dv = to_df(spark, train, extra + [("t0", [{"role": "user", "content": m} for m in train["t0"]], "again")]), to_df(spark, dev, extra)
    got = overlap.cross_split_overlaps({"dev": dv, "none": dv.limit(0)}, tr).collect()
    assert len(got) == len({(r["eval_id"], r["train_id"]) for r in got})
    assert {(r["eval_id"], r["train_id"]) for r in got if r["eval_id"] != "short"} == expected - {("short", "short")}
    assert {r["split_name"] for r in got} == {"dev"}


def test_overlap_in_short_and_hot_messages(spark, monkeypatch):
    """Short turns (45 %) and a canned closing (30 %) stand verbatim, the rest is rewritten."""
    r = random.Random(31)
    word = lambda k: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(k))
    closing, turns = word(60), [word(9) for _ in range(10)]
    train = {"hit": [*turns, word(50), closing]} | {f"t{n:02}": [word(80), closing] for n in range(30)}
    dev = {"both": [*turns, word(50), closing], "hot": [closing, word(20)], "rest": [word(150), word(20)]}
    train["far"] = [dev["rest"][0], word(30)]
    expected = {(d, t) for d, m in dev.items() for t, mt in train.items() if len(grams("".join(m)) & grams("".join(mt))) >= 0.7 * len(grams("".join(m)))}
    assert ("both", "hit") in expected and len(expected) == 33
    monkeypatch.setattr(overlap, "SPREAD", 1)
    got = overlap.cross_split_overlaps({"dev": to_df(spark, dev)}, to_df(spark, train)).collect()
    assert {(x["eval_id"], x["train_id"]) for x in got} == expected


def scattered(r, text, share):
    return "".join(chr(r.randrange(0x4E00, 0x9000)) if r.random() < share else c for c in text)


@pytest.mark.parametrize("kind", ["quoted", "other borders", "half of the long one", "evenly edited"])
def test_overlaps_across_messages(spark, kind):
    """Pairs that hold at least 70 % of the 3-sequences, with no message in common."""
    r = random.Random(33)
    word = lambda k: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(k))
    dev, train = {}, {}
    for n in range(60):
        e = [word(40), word(60)]
        if kind == "quoted":
            t = [word(50), word(80) + "".join(e) + word(80)]
        elif kind == "other borders":
            whole = "".join(e)
            t = [whole[:25], whole[25:55], whole[55:]]
        elif kind == "half of the long one":
            e = [word(7) for _ in range(8)] + [word(80)]
            t = e[:-1] + [e[-1][:44] + word(40)]
        else:
            t = [scattered(r, m, 0.08) for m in e]
        dev[f"d{n}"], train[f"t{n}"] = e, t
    expected = {(d, t) for d, m in dev.items() for t, mt in train.items() if len(grams("".join(m)) & grams("".join(mt))) >= 0.7 * len(grams("".join(m)))}
    assert len(expected) >= 30
    got = {(x["eval_id"], x["train_id"]) for x in overlap.cross_split_overlaps({"dev": to_df(spark, dev)}, to_df(spark, train)).collect()}
    assert got <= expected and len(got) >= 0.93 * len(expected)


def test_chance_meetings_end_in_the_bucket_join(spark):
    """Records of one template hold a third of each other; the sketches let hardly one such pair pass, and every pair at the limit."""
    r = random.Random(35)
    word = lambda k: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(k))
    template = [word(25) for _ in range(6)]
    dev = [C.fold("".join(t + word(45) for t in template[:2])) for _ in range(40)]
    train = [C.fold("".join(t + word(45) for t in template)) for _ in range(40)]
    train += [d[:30] + word(30) + d[60:] + word(250) for d in dev]
    e, s = overlap.sketches(dev), overlap.sketches(train)
    rows = [(a, b, *(int(x) for x in e[a]), *(int(x) for x in s[b])) for a in range(len(dev)) for b in range(len(train))]
    columns = [f"e{i}" for i in range(e.shape[1])] + [f"s{i}" for i in range(s.shape[1])]
    df = spark.createDataFrame(rows, "a int, b int, " + ", ".join(f"{c} long" for c in columns))
    ones = lambda side: sum((F.bit_count(c) for c in columns if c[0] == side), F.lit(0))
    left = {(x["a"], x["b"]) for x in df.withColumns({"ebits": ones("e"), "bits": ones("s")}).filter(overlap._may_hold(0.7)).collect()}
    share = lambda a, b: len(grams(dev[a]) & grams(train[b])) / len(grams(dev[a]))
    assert all(0.25 < share(a, b) < 0.45 for a in range(40) for b in range(40)) and all(share(n, 40 + n) >= 0.7 for n in range(40))
    assert {(n, 40 + n) for n in range(40)} <= left
    assert sum(b < 40 for _, b in left) <= 16  # of 1,600


def test_training_rows_without_an_evaluation_key_stay_at_home(spark):
    r = random.Random(36)
    word = lambda k: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(k))
    own = [word(200) for _ in range(50)]
    pdf = pd.DataFrame({"rid": range(100), "parts": [[t] for t in [*own, *(word(200) for _ in own)]]})
    every = pd.concat(overlap._lanes(False)(iter([pdf])))
    asked = sorted(set(every["key"][every["rid"] < 50]))
    known = overlap._bit_map(spark.createDataFrame([(int(k),) for k in asked], "key long"))
    some = pd.concat(overlap._lanes(False, known)(iter([pdf])))
    assert set(asked) <= set(some["key"]) and (some["rid"] >= 50).sum() <= 20 < (every["rid"] >= 50).sum()


def test_overlap_of_empty_tables(spark, dialogues):
    empty = to_df(spark, dialogues[0]).limit(0)
    assert overlap.cross_split_overlaps({"dev": empty}, empty).count() == 0


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    out = {f"a{n:03}": sentence(r, 25) for n in range(120)}
    for n in range(0, 40):
        out[f"b{n:03}"] = edit(r, out[f"a{n:03}"], n % 6)
    for n in range(6):
        out[f"c{n:03}"] = out["a000"]
    return out


def brute(texts, limit=0.55):
    ids, g = sorted(texts), {k: grams(v) for k, v in texts.items()}
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if g[a] and g[b] and len(g[a] & g[b]) >= limit * len(g[a] | g[b])}


@pytest.mark.parametrize("block", [4096, 2])
def test_near_duplicates_equal_brute_force(spark, texts, block):
    rows = [(k, v, "t") for k, v in texts.items()] + [("n", None, "t"), ("e", "", "t"), (None, "x" * 50, "t"), ("a000", texts["a000"], "t"), ("other", texts["a001"], "u")]
    df = spark.createDataFrame(rows, "id string, text string, tag string").withColumn("rep", F.lit(1))
    links, members = neardup.near_duplicate_pairs(df, tag_col="tag", block=block)
    got = [(r["id_a"], r["id_b"]) for r in neardup.expand_pairs(links, members).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts)


def test_groups_are_components(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    links, members = neardup.near_duplicate_pairs(df)
    got = {r["id"]: (r["group_id"], r["n_links"]) for r in neardup.groups(links, members).collect()}
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(texts):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {k: v[0] for k, v in got.items()} == {k: root(k) for k in texts}
    assert got["c000"][0] == "a000"


def test_near_duplicates_of_an_empty_table(spark):
    links, members = neardup.near_duplicate_pairs(spark.createDataFrame([], "id string, text string"))
    assert links.count() == 0 and members.count() == 0 and neardup.groups(links, members).count() == 0


def test_bit_sliced_distances_are_exact():
    import numpy as np

    rng = np.random.default_rng(0)
    base = rng.integers(0, 256, (64, neardup.PLANES // 8), dtype=np.uint8)
    sk = np.concatenate([base, base ^ (rng.random(base.shape) < 0.1) * np.uint8(1)])
    planes = neardup._planes(sk)
    for d in (1, 3, 64):
        for radius in (0, 5, neardup.RADIUS, 90):
            lanes = (1 << (len(sk) - d)) - 1
            mask = neardup._within(planes, [p >> d for p in planes], lanes, radius)
            want = [int(np.unpackbits(sk[i] ^ sk[i + d]).sum()) <= radius for i in range(len(sk) - d)]
            assert [bool(mask >> i & 1) for i in range(len(sk) - d)] == want


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(2)
    items = {n: sentence(r, 18) for n in range(12)}
    docs = {n: sentence(r, 30) for n in range(60)}
    for n in range(12):
        half = items[n][: len(items[n]) * 2 // 3]
        docs[100 + n] = sentence(r, 10) + edit(r, half if n % 2 else items[n], n % 4) + sentence(r, 10)
    docs[200] = items[0] + items[1]
    return items, docs


def frames(spark, items, docs):
    i = spark.createDataFrame([*items.items(), (None, "x" * 40), (90, None), (91, ""), (92, "短")], "item_id long, text string").withColumn("suite", F.lit("s"))
    d = spark.createDataFrame([*docs.items(), (None, "x" * 40), (300, None), (301, ""), (200, docs[200])], "doc_id long, text string").withColumn("item_text", F.lit(0))
    return d, i


@pytest.mark.parametrize("bound", [4_000_000, 0])
def test_leaks_equal_brute_force(spark, corpus, bound):
    items, docs = corpus
    d, i = frames(spark, items, docs)
    expected = {(k, n) for k, t in docs.items() for n, s in items.items() if len(grams(t, 8) & grams(s, 8)) >= 0.4 * len(grams(s, 8))}
    got = leak.leaked_passages(d, i, broadcast_chars=bound).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == expected and len(got) == len(expected) and len(expected) >= 12
    assert leak.leaked_passages(d.limit(0), i, broadcast_chars=bound).count() == 0
    assert leak.leaked_passages(d, i.limit(0), broadcast_chars=bound).count() == 0


@pytest.mark.parametrize("bound", [4_000_000, 0])
def test_scattered_passages(spark, bound):
    """Blocks between foreign text, blocks in another order, and evenly edited copies are all found."""
    r = random.Random(12)
    word = lambda k: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(k))
    items, docs = {n: word(r.choice([17, 30, 80, 200])) for n in range(40)}, {}
    for n, t in items.items():
        blocks = [t[i : i + 20] for i in range(0, len(t), 20)]
        docs[n * 10] = "".join(b + word(30) for b in blocks)
        docs[n * 10 + 1] = "".join(b + word(3) for b in r.sample(blocks, len(blocks)))
        docs[n * 10 + 2] = word(40) + "".join(word(1) if i % r.choice([13, 14]) == 5 else c for i, c in enumerate(t)) + word(40)
        docs[n * 10 + 3] = word(100) + t[: 3 + len(t) // 2] + word(100)
        docs[n * 10 + 4] = word(100) + t[:9] + word(50)
    expected = {(k, n) for k, t in docs.items() for n, s in items.items() if len(grams(t, 8) & grams(s, 8)) >= 0.4 * len(grams(s, 8))}
    assert len(expected) > 100
    d, i = frames(spark, items, {**docs, 200: docs[200]})
    assert {(x["doc_id"], x["item_id"]) for x in leak.leaked_passages(d, i, broadcast_chars=bound).collect()} == expected


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers_is_the_edit_distance():
    r = random.Random(3)
    for _ in range(400):
        pattern = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
        text = "".join(r.choice("abc") for _ in range(r.randint(0, 20)))
        for budget in (0, 1, 3):
            assert leak.myers(pattern, text, budget) == (distance(pattern, text) <= budget)
