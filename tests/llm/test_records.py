"""Sampling, personal information, broken answers, mixing and look-alikes."""

import itertools
import random
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.llm import defects, lookalike, mixing, pii, queries, sampling


# -- sampling -------------------------------------------------------------------------------------
def test_repair_meets_reachable_targets():
    have = {("a",): 1000, ("b",): 300, ("c",): 40, ("d",): 2}
    got = sampling.repair(have, [{"a": 50.0, "b": 50.0, "c": 50.0, "d": 50.0}], [{"c": 10, "d": 5}], 200, 1)
    assert sum(got.values()) == 200 and got[("d",)] == 2 and got[("c",)] == 40
    assert abs(got[("a",)] - got[("b",)]) <= 60  # the rest of c and d is shared out


def test_repair_with_two_categories():
    have = dict(zip(itertools.product("ab", "xy"), (400, 100, 100, 400)))
    goal = [{"a": 100.0, "b": 100.0}, {"x": 50.0, "y": 150.0}]
    got = sampling.repair(have, goal, [{}, {"x": 20}], 200, 2)
    for col, t in enumerate(goal):
        for c, want in t.items():
            assert abs(sum(n for k, n in got.items() if k[col] == c) - want) <= 1
    assert sampling.repair({}, [{}], [{}], 10, 1) == {}


def test_sample_of_a_hot_category(spark):
    rows = [(f"i{n}", "hot" if n % 3 else " b ") for n in range(3000)] + [("i1", "hot"), (None, "hot"), ("u", None), ("v", "　")]
    df = spark.createDataFrame(rows, "id string, c string").withColumn("take", F.lit(1))
    cat = F.coalesce(sampling.trimmed(F.col("c")), F.lit("unknown"))
    sample, report = sampling.proportional_sample(df, "id", [cat], [{"hot": (0.3, 1), "b": (0.7, 5), "rare": (0.0, 3)}], 0.2)
    got = {r["c0"]: r["n"] for r in sample.groupBy("c0").agg(F.countDistinct("id").alias("n")).collect()}
    r = {x["category"]: x for x in report.collect()}
    assert got == {k: v["sampled"] for k, v in r.items() if v["sampled"]} and sum(got.values()) == 600
    assert got == {"hot": 180, "b": 420} and r["rare"]["is_short"] and not r["hot"]["is_short"]
    assert sample.count() == sample.distinct().count()


def test_sample_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id string, c string")
    sample, report = sampling.proportional_sample(df, "id", [F.col("c")], [{"a": (1.0, 2)}])
    assert sample.count() == 0 and report.first()["is_short"]


def test_draws_beyond_the_generators_bound():
    import numpy as np

    rng = np.random.default_rng(1)
    avail = np.array([3 * 10**9, 10**9, 5, 0, 10**6])
    got = sampling.draw(avail, 10**9, rng)
    assert got.sum() == 10**9 and (got <= avail).all() and (got >= 0).all() and abs(got[0] / got[1] - 3) < 0.01
    have = {("a",): 3 * 10**9, ("b",): 10**9, ("c",): 100}
    got = sampling.repair(have, [{"a": 4e8, "b": 4e8, "c": 1e3}], [{}], 800_001_000, 1)
    assert got[("c",)] == 100 and abs(got[("a",)] - 4e8) <= 1000 and sum(got.values()) == 800_001_000


def test_short_categories_give_all_rows_and_the_sample_is_counted(spark, monkeypatch):
    rows = [(f"i{n}", "big") for n in range(200)] + [(f"s{n}", "small") for n in range(9)] + [(f"m{n}", "mid") for n in range(30)]
    df = spark.createDataFrame(rows, "id string, c string")
    goal = {"big": (0.2, 25), "small": (0.4, 2), "mid": (0.4, 22)}
    r = {x["category"]: x for x in sampling.proportional_sample(df, "id", [F.col("c")], [goal])[1].collect()}
    assert r["small"]["is_short"] and r["small"]["sampled"] == 9 and not r["big"]["is_short"] and not r["mid"]["is_short"]
    monkeypatch.setattr(sampling, "repair", lambda have, *_: {k: n // 2 for k, n in have.items()})
    r = {x["category"]: x for x in sampling.proportional_sample(df, "id", [F.col("c")], [goal])[1].collect()}
    assert r["small"]["sampled"] == 4 and not r["small"]["is_short"]


# -- personal information -------------------------------------------------------------------------
FOUND = [
    ("请发到 a.b-1@mail.example 谢谢", "email"),
    ("邮箱ａｂ１２＠mail.example", "email"),
    ("mizhou at post dot test 是我的邮箱", "email"),
    ("write to x_1(at)corp.example.org please", "email"),
    ("电话13800833020", "phone"),
    ("手机179-0092-5705", "phone"),
    ("幺五二零零八五幺三幺五，到了打这个", "phone"),
    ("手机0755-55509669", "phone"),
    ("my number is +1 (555) 010-0118", "phone"),
    ("１５５００４７１１７２，到了打这个", "phone"),
    ("item/910983872726959388 165.0064.8309，打不通就发短信", "phone"),
    ("证件号是619909 19570107 1337", "id_number"),
    ("清关证件护照E38333028需重传", "id_number"),
    ("my id: SSN 666-35-6845", "id_number"),
    ("寄到星砾市槐安区鹿鸣里264号27栋1002室", "address"),
    ("住雁回市禾苑新村八栋三楼东户", "address"),
    ("改成枕溪街72弄5号1406", "address"),
    ("I live at 131 Old Tannery Road, Port Alder", "address"),
    ("收件人：何翊衍，请确认", "name"),
    ("郑恬筠收，15700289887", "name"),
    ("this is Marit Quillfeather. Two clips broke", "name"),
]
NOT_FOUND = [
    "订单8613806157564里的加湿器几号能到",
    "打过热线400-000-330没人接",
    "显示的是1280****0013",
    "订单861706-1323824，运费谁出",
    "单号959015481114738696买的",
    "序列号W0493-810QX，批次P6598-953SV",
    "想改寄到枫桥湾市那边",
    "客服阿澜说今天回电",
    "谢谢，高兴",
    "the desk lamp stays at 832.28. Write back any time",
]


@pytest.mark.parametrize("text, kind", FOUND)
def test_spans_propose(text, kind):
    votes = [(s[0], s[3]) for s in pii.spans(text)]
    assert kind in [k for k, v in votes], votes


def test_untrained_model_decides(spark):
    texts = [t for t, _ in FOUND] + NOT_FOUND
    rows = [(f"r{n}", "content", 0, t) for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "record_id string, field_name string, turn_no int, text string")
    got = {(r["record_id"], r["pii_type"]) for r in pii.find(df).collect()}
    assert {f"r{n}" for n in range(len(FOUND), len(texts))}.isdisjoint({r for r, _ in got})
    missing = [FOUND[n] for n in range(len(FOUND)) if (f"r{n}", FOUND[n][1]) not in got]
    assert not missing


def test_redaction_keeps_the_rest(spark):
    rows = [("1", "content", 0, "请发到 a.b@mail.example，电话13800833020。"), ("2", "content", 0, "没有什么"), ("1", "content", 0, "请发到 a.b@mail.example，电话13800833020。")]
    df = spark.createDataFrame(rows, "record_id string, field_name string, turn_no int, text string")
    got = {r["record_id"]: r["redacted"] for r in pii.redact(df, pii.find(df)).collect()}
    assert got == {"1": "请发到 [EMAIL]，电话[PHONE]。", "2": "没有什么"}


def test_overlapping_spans_are_one():
    assert pii.cut("0123456789abcdef!", [(0, 8, "phone"), (5, 15, "id_number")]) == "[ID_NUMBER]f!"
    assert pii.cut("0123456789", [(2, 4, "name"), (4, 6, "phone"), (2, 4, "name")]) == "01[NAME][PHONE]6789"
    assert pii.cut("abc", []) == "abc"


def test_each_delivery_is_cut_by_its_own_spans(spark):
    rows = [("1", "content", 0, "电话13800833020。"), ("1", "content", 0, "请发到 a.b@mail.example，电话13800833021。")]
    df = spark.createDataFrame(rows, "record_id string, field_name string, turn_no int, text string")
    assert sorted(r["redacted"] for r in pii.redact(df, pii.find(df)).collect()) == ["电话[PHONE]。", "请发到 [EMAIL]，电话[PHONE]。"]


def test_fields_of_odd_records(spark):
    schema = "id string, meta struct<source_prompt:string,source_response:string>, messages array<struct<role:string,content:string>>"
    rows = [("1", ("p", None), [("user", "a"), ("assistant", None)]), ("2", None, None), (None, ("x", "y"), [])]
    got = sorted(tuple(r) for r in pii.fields(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", "content", 0, "a"), ("1", "source_prompt", -1, "p")]
    assert pii.find(pii.fields(spark.createDataFrame([], schema))).count() == 0


def test_em_finds_a_bad_labeler():
    import numpy as np

    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.5
    good = lambda p: np.where(rng.random(4000) < p, truth, ~truth).astype(int)
    votes = np.stack([good(0.95), good(0.9), good(0.5), good(0.9), good(0.85), good(0.9), good(0.9)], axis=1)
    share, hit, false = pii.fit_labelers(votes, "name")
    assert 0.4 < share < 0.6 and hit[2] - false[2] < 0.15 and hit[0] - false[0] > 0.7
    assert ((pii.posterior(votes, share, hit, false) > 0.5) == truth).mean() > 0.95


# -- broken answers -------------------------------------------------------------------------------
QUESTIONS = ["订单{n}的加湿器{c}什么时候能发货？", "加湿器{c}只退了{n}元，剩下的呢？", "请问加湿器{c}怎么安装，说明书看不懂？", "The parcel {n} for my {c} lamp is stuck, please chase it?"]
ANSWERS = ["订单{n}预计3天内出库，发出后会有短信通知到您。", "退款{n}元已经提交，原路退回，一般5个工作日到账。", "先长按加湿器{c}的按键5秒，听到提示音后再松手即可。", "We have asked the depot to chase parcel {n} and will ring you before Friday."]


@pytest.fixture(scope="module")
def classifier():
    r = random.Random(6)
    pairs = []
    for _ in range(900):
        k = r.randrange(4)
        v = {"n": r.randrange(10**9), "c": f"{r.choice('ABC')}{r.randrange(10**4)}"}
        a = ANSWERS[k].format(**v)
        if k < 3 and r.random() < 0.5:
            a += r.choice(["如有异常请当场拒收，方便我们核实。", "给您添麻烦了，感谢您的耐心等待。"])
        pairs.append((QUESTIONS[k].format(**v), a))
    return defects.fit(pairs), pairs


def test_held_out_accuracy(classifier):
    model, pairs = classifier
    made, labels = defects.synthesise(pairs[:250], 99)
    said = model.decide(made)
    hits = {lab: [s == (lab or None) for s, x in zip(said, labels) if x == lab] for lab in set(labels)}
    assert {k for k, v in hits.items() if sum(v) / len(v) < 0.85} == set(), {k: sum(v) / len(v) for k, v in hits.items()}


@pytest.mark.parametrize(
    "answer, label",
    [(None, "empty"), ("", "empty"), ("　\n", "empty"), ("……", "empty"), ("<br/>", "empty"), ("N/A", "empty"), ("无", "empty"), ("[placeholder]", "empty"),
     ("订单12345预计3天内出库，发出后会有短信通知到您", None), ("订单12345预计3天内出库，发出后会有短", "truncated"), ("订单12345的加湿器A100什么时候能发货？", "copy"),
     ("很抱歉，我不能回答这个问题。", "refusal"), ("We have asked the depot to chase parcel 5 and will ring you before Friday.", "other_language")],
)
def test_single_answers(classifier, answer, label):
    assert classifier[0].decide([("订单12345的加湿器A100什么时候能发货？", answer)]) == [label]


def test_null_questions_and_empty_tables(spark, classifier):
    assert classifier[0].decide([(None, "退款5元已经提交，原路退回，一般5个工作日到账。"), ("", "")]) == [None, "empty"]
    schema = "table_name string, record_id string, field_name string, question string, answer string"
    assert defects.broken_answers(spark.createDataFrame([], schema)).count() == 0
    rows = [("t", "1", "f", None, None), ("t", "1", "f", None, None), ("t", None, "f", "q", "a")]
    assert [tuple(r) for r in defects.broken_answers(spark.createDataFrame(rows, schema)).collect()] == [("t", "1", "f", "empty")]


def test_question_falls_back_to_the_last_user(spark):
    m = "array<struct<role:string,content:string>>"
    rows = [("1", " 　", [("user", "u1"), ("assistant", "a"), ("user", "u2")], "c", None), ("2", "p", None, "c", "r"), ("3", None, None, "c", "r")]
    df = spark.createDataFrame(rows, f"id string, prompt string, messages {m}, chosen string, rejected string")
    got = {(r["record_id"], r["field_name"]): r["question"] for r in defects.preference_answers(df).collect()}
    assert got[("1", "chosen")] == "u2" and got[("2", "rejected")] == "p" and got[("3", "chosen")] is None


# -- mixing ---------------------------------------------------------------------------------------
@pytest.mark.parametrize("cap", [1, 2, 4, 9])
@pytest.mark.parametrize("share", [0.1, 0.5, 0.9, 0.99])
def test_means_invert(cap, share):
    rate = cap * share
    assert mixing.capped_mean(mixing.solve_mean(rate, cap), cap) == pytest.approx(rate, rel=1e-6)


def test_mix_reaches_its_shares(spark):
    rows = [(n, "big" if n % 10 else "small", 10 + n % 7) for n in range(20000)] + [(99999, None, 500), (99998, "extra", 5)]
    tokens = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 1), ("none", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix_sources(tokens, targets)
    r = {x["source"]: x for x in report.collect()}
    assert r["none"]["is_short"] and r["small"]["is_short"] and not r["big"]["is_short"]
    assert abs(r["big"]["reached_tokens"] / r["big"]["target_tokens"] - 1) < 0.03
    assert r["small"]["reached_tokens"] == r["small"]["source_tokens"]
    uses = mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("copy_no").alias("m")).filter("n != m or n > 3")
    assert uses.count() == 0 and mixed.filter("source is null or source = 'extra'").count() == 0
    positions = [x["position"] for x in mixed.collect()]
    assert positions == sorted(positions)


def test_short_sources_follow_the_draws(spark, monkeypatch):
    tokens = spark.createDataFrame([(n, "a", 10) for n in range(50)] + [(n, "b", 10) for n in range(50, 150)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1)], "source string, target_share double, max_repeats int")
    assert {x["source"]: x["is_short"] for x in mixing.mix_sources(tokens, targets)[1].collect()} == {"a": True, "b": False}
    monkeypatch.setattr(mixing, "steps", lambda mean, cap: [-1.0] * cap)  # every document all its uses
    r = {x["source"]: x for x in mixing.mix_sources(tokens, targets)[1].collect()}
    assert r["b"]["reached_tokens"] == 1000 and not r["b"]["is_short"]


def test_tokens_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "hello 世界 " * 3000, None)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["tokens"] for r in mixing.token_counts(df, queries.TOKENIZER).collect()}
    assert got[1] == got[2] == 0 and got[3] > 5000
    _, report = mixing.mix_sources(mixing.token_counts(df.limit(0), queries.TOKENIZER), spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int"))
    assert report.first()["reached_tokens"] == 0


# -- look-alikes ----------------------------------------------------------------------------------
SAME = [
    ("order A1, ok?", "ｏｒｄｅｒ　Ａ１， ok？".replace("， ", ", ")),
    ("paper case", "рареr саsе"),
    ("café au lait", "café au lait"),
    ("zero​width", "zerowidth"),
    ("soft­hyphen", "softhyphen"),
    ("a b", "a b"),
    ("不量", "不量"),
    ("⼀⽇", "一日"),
    ("ｶﾞｷﾞ", "ガギ"),
    ("schön", "schӧn"),
    ("Москва", "Mocквa"),
]
OTHER = [("a  b", "a b"), ("Paper", "paper"), ("cafe", "café"), ("a\nb", "a b"), ("国", "國"), ("ab", "abc"), ("l1", "I1")]


def canon(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["canonical"] for r in lookalike.canonical_texts(df).collect()}


def test_looks(spark):
    texts = [t for p in SAME + OTHER for t in p]
    got = canon(spark, texts)
    for n in range(len(SAME)):
        assert got[2 * n] == got[2 * n + 1], SAME[n]
    for n in range(len(SAME), len(SAME) + len(OTHER)):
        assert got[2 * n] != got[2 * n + 1], OTHER[n - len(SAME)]


@pytest.mark.parametrize("word", ["ещё", "ёлка", "её", "йод", "όλος", "ό", "ὀδός", "한국어", "Ångström", "café"])
def test_canonical_equivalents_meet(spark, word):
    nfc, nfd = (unicodedata.normalize(f, word) for f in ("NFC", "NFD"))
    assert nfc != nfd and lookalike.skeleton(nfc) == lookalike.skeleton(nfd)
    got = canon(spark, [f"a {nfc} b", f"a {nfd} b", f"a {nfd.replace('A' + chr(0x30A), chr(0x212B))} b"])
    assert len(set(got.values())) == 1
    assert len(set(canon(spark, [f"a {nfd} b", f"a {nfc} b c"]).values())) == 2


def test_stressed_letter_meets_its_latin_look(spark):
    got = canon(spark, ["жа\u0301р", "жáр", "жа\u0301р!"])
    assert got[0] == got[1]


def test_native_words_keep_their_letters(spark):
    got = canon(spark, ["Москва и Москва", "Mocквa", "рaper", "paper"])
    assert got[0] == "Москва и Москва" and got[1] == "Москва" and got[2] == "paper"


def test_pairs_and_defined_results(spark):
    rows = [(1, "pay now"), (2, "рay now"), (3, "pay now"), (4, None), (5, None), (6, ""), (7, "other"), (2, "рay now"), (8, "pay​ now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("canonical", F.lit(1)).withColumn("row", F.lit(2))
    got = [(r["doc_a"], r["doc_b"]) for r in lookalike.look_alike_pairs(lookalike.canonical_texts(df)).collect()]
    assert sorted(got) == [(1, 2), (1, 8), (2, 3), (2, 8), (3, 8)]
    assert lookalike.look_alike_pairs(lookalike.canonical_texts(df.limit(0))).count() == 0


def test_trie_automaton():
    t = lookalike.Trie()
    for w in ("paper", "pager", "café"):
        t.add(w)
    assert t.match("рареr") == (0, "paper") and t.match("pa\u200bper") == (0, "paper")
    assert t.match("cafe\u0301") == (0, "café") and t.match("papr") is None
    assert t.match("papr", 1) == (1, "paper") and t.match("", 0) is None


def test_the_automaton_decides(spark, monkeypatch):
    texts = ["pay now", "р\u0430y now", "カメラcamera 1", "カメラ\u0441amera 1", "Москва", "Mocквa", "ра", "pа"]
    got = canon(spark, texts)
    assert got[0] == got[1] and got[2] == got[3] == texts[2] and got[4] == got[5] == "Москва" and got[6] == got[7]
    monkeypatch.setattr(lookalike.Trie, "match", lambda *_: None)
    shard = lambda: dict(lookalike._shard(pd.DataFrame([("pay", 1, False), ("рау", 1, True), ("p\u200bay", 1, True)], columns=["token", "n", "suspicious"]), 0))
    assert shard() == {"рау": "рау", "p\u200bay": "pay"}
    monkeypatch.undo()
    assert shard() == {"рау": "pay", "p\u200bay": "pay"}


def test_ordinary_tokens_are_cut_like_all_others(spark):
    """The cheap pattern of ordinary texts and the general one cut the same tokens."""
    every = "".join(map(chr, [*range(0x20, 0x7F), *range(0xA1, 0x250), *range(0x3001, 0x302A), *range(0x3041, 0x3097), *range(0x309D, 0x3100), 0x4E00, 0x9FA5, 0x2019, 0x2026, 0x1F600]))
    text = "".join(f"{c}a{c}{c} b" for c in every if c != "\xad")
    segments, suspicious = lookalike._patterns()
    df = spark.createDataFrame([(text,)], "text string").select(
        F.regexp_extract_all("text", F.lit(lookalike.ORDINARY_WORD), F.lit(0)).alias("a"),
        F.filter(F.regexp_extract_all("text", F.lit(segments), F.lit(0)), lambda w: w.rlike(f"[{lookalike.LATIN}]")).alias("b"),
        lookalike.unusual(F.col("text")).alias("u"),
    )
    row = df.first()
    assert not row["u"] and row["a"] == row["b"]


def test_words_and_steps_of_arrays_are_those_of_the_patterns(spark):
    """Every character Java knows, in words: the arrays cut the tokens that the patterns cut, and see to the same characters."""
    every = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x20000), 0x20000, 0x2FA1D, 0xE0100, 0xE0001)]
    rows = [(f"{c} a{c}b {c}x ア{c}y z", c) for c in every]
    rows += [(t, "") for t in ("\u200bab cd", "ab\u200b cd", "ab\u200bcd ef", "ア\u200bab", "\u200b\u200bab", "-\u200bab\u200b", "", "日本abｱﾞ Ａｂｃ 　x", "p\u0430y pay")]
    segments, suspicious = lookalike._patterns()
    t = lookalike.plain_table()
    step = F.translate("text", "".join(t), "".join(t.values()))
    words = F.filter(F.regexp_extract_all("step", F.lit(segments), F.lit(0)), lambda w: w.rlike(f"[{lookalike.LATIN}]") & ~w.rlike(suspicious))
    df = spark.createDataFrame(rows, "text string, c string").filter(r"not rlike(c, '\\p{Cn}')").withColumn("step", step)
    got = df.select("text", "step", words.alias("w"), F.col("step").rlike(suspicious).alias("odd")).collect()
    assert len(got) > 60_000
    steps, odd = lookalike._steps([r["text"] for r in got])
    assert steps == [r["step"] for r in got] and odd.tolist() == [r["odd"] for r in got]
    wrong = [r["text"] for r in got if set(lookalike.plain_words([r["text"]])) != set(r["w"])]
    assert not wrong, (len(wrong), [hex(ord(w[0])) for w in wrong[:40]])
    assert set(lookalike.plain_words([r["text"] for r in got[-500:]])) == {w for r in got[-500:] for w in r["w"]}
    assert lookalike.plain_words([]) == [] and lookalike._steps([])[0] == []


# -- all queries ----------------------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, small, name):
    df = queries.queries()[name](spark, small)
    assert df.count() >= 0 and df.columns


COLUMNS = {
    "p1_found": ["split_name", "eval_id", "train_id"],
    "p2_found": ["scenario"],
    "p3_found": ["record_id", "field_name", "turn_no", "pii_type"],
    "p4_found": ["table_name", "record_id", "field_name", "defect"],
    "p5_found": ["table_name", "id_a", "id_b"],
    "p6_found": ["doc_id", "item_id"],
    "p7_found": ["source"],
    "p8_found": ["doc_a", "doc_b"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_of_found(spark, small, name):
    assert queries.queries()[name](spark, small).columns == COLUMNS[name]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, small, name):
    import duckdb

    c = duckdb.connect()
    for t in ("sft_train", "sft_dev", "eval_test", "scenario_targets", "documents", "heldout_items", "mix_targets", "dpo_preference_pairs", "post_train_test_generations"):
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = queries.queries()[name](spark, small)
    rel = c.execute(queries.oracle_sql()[name])
    assert [x[0] for x in rel.description] == df.columns
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(rel.fetchall()) and (got or name in ("p1_found", "p8_found", "p6_found"))
