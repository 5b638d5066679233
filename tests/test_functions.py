"""Hand-written expectations for text, replies, messages and numbers."""

import math

import pytest
from pyspark.sql import functions as F

from colloquy.functions import messages as M
from colloquy.functions import numbers as N
from colloquy.functions import replies as R
from colloquy.functions import text as T
from colloquy.operators import metrics


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string'}" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "raw, clean", [("<b>a</b>　 b ", "a b"), (None, ""), ("", ""), ("小妹帮您", "我帮您"), ("a  b", "a b"), ("  ", "")]
)
def test_clean(spark, raw, clean):
    assert one(spark, T.clean(F.col("t")), t=raw) == clean


@pytest.mark.parametrize("raw, key", [("Ab，c！", "abc"), ("😀ab", "😀ab"), (None, ""), ("【A】-_b", "ab")])
def test_loose_key(spark, raw, key):
    assert one(spark, T.loose_key(F.col("t")), t=raw) == key


@pytest.mark.parametrize(
    "raw, hit", [("哈" * 6, True), ("哈" * 5, False), ("好的" * 6, True), ("好的" * 5, False), ("abc" * 3, True), ("abc" * 2, False), ("", False), (None, False)]
)
def test_stutters(spark, raw, hit):
    assert one(spark, T.stutters(F.col("t")), t=raw) is hit


@pytest.mark.parametrize(
    "raw, k",
    [('{"k": 1}', 1), ('```json\n{"k": 2}\n```', 2), ('so: {"k": 3} ok', 3), ('{"k": 4', None), (None, None), ("", None), ("[1]", None)],
)
def test_lenient_json(spark, raw, k):
    got = one(spark, R.lenient_json(F.col("t"), "k int"), t=raw)
    assert (got and got["k"]) == k


def test_reply_parsing(spark):
    two = "分类：物流\n回复：“好的，已处理”"
    assert one(spark, R.intent_of(F.col("t")), t=two) == "物流"
    assert one(spark, R.clean_reply(F.col("t")), t=two) == "好的，已处理"
    assert one(spark, R.intent_of(F.col("t")), t="只有正文") is None
    assert one(spark, R.reply_of(F.col("t")), t="只有正文") is None
    given = lambda t, i, r: tuple(spark.createDataFrame([(t, i, r)], "t string, i string, r string").select(R.split_generated(F.col("t"), F.col("i"), F.col("r")).alias("x")).first()[0])
    assert given("只有正文", None, "") == (None, None) and given(two, None, None) == ("物流", "“好的，已处理”") and given(two, " 退款 ", "嗯") == ("退款", "嗯")


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("分类：物流\n好的\n分类：不是标签", "好的\n分类：不是标签"),
        ("回复：回复：好的", "好的"),
        ("前言\n回复: 分类：甲\n  回复：\"好\"", "好"),
        ("'「好」'", "「好」"),
        ("分类：只有一行", ""),
        ("正文\n分类：乙", "正文\n分类：乙"),
        (None, ""),
    ],
)
def test_clean_reply(spark, raw, clean):
    assert one(spark, R.clean_reply(F.col("t")), t=raw) == clean


def test_generated_text_is_cut(spark):
    assert one(spark, R.cut_generation(F.col("t")), t="<think>x</think> 答案<|im_end|>多余") == "答案"


def seq(spark, pairs, f):
    rows = [([{"role": r, "content": c} for r, c in pairs] if pairs is not None else None,)]
    return spark.createDataFrame(rows, f"m array<{M.MESSAGE}>").select(f(F.col("m")).alias("x")).first()[0]


def flat(ms):
    return [(m["role"], m["content"]) for m in ms]


def test_normalized(spark):
    pairs = [("system", "s1"), ("human", "a"), ("user", "b"), ("客服", "c"), ("user", "d"), ("bot?", "x"), ("gpt", " ")]
    assert flat(seq(spark, pairs, M.normalized)) == [("user", "a\nb"), ("assistant", "c")]
    assert seq(spark, [("system", "s1"), ("system", "s2"), ("user", "a")], M.system_of) == "s2"
    assert seq(spark, [("system", "s"), ("user", "a")], M.normalized) == []
    assert flat(seq(spark, [("assistant", "x"), ("user", "a"), ("assistant", "b")], M.normalized)) == [("user", "a"), ("assistant", "b")]
    assert seq(spark, None, M.normalized) == [] and seq(spark, [], M.normalized) == []


def test_for_generation(spark):
    pairs = [("assistant", "x"), ("user", "a"), ("user", "b"), ("assistant", "c"), ("user", "d"), ("assistant", "e")]
    assert flat(seq(spark, pairs, M.for_generation)) == [("user", "a"), ("user", "b"), ("assistant", "c"), ("user", "d")]
    assert seq(spark, [("assistant", "x")], M.for_generation) == []


def test_role_fault(spark):
    assert seq(spark, [("user", "a"), ("user", "b"), ("assistant", "c")], M.role_fault) == "bad_role_at_1"
    assert seq(spark, [("user", "a"), ("assistant", "b"), ("user", "c")], M.role_fault) == "bad_role_at_2"
    assert seq(spark, [("user", "a"), ("assistant", " ")], M.role_fault) == "empty_content_at_1"
    assert seq(spark, [("user", "a"), ("assistant", "b")], M.role_fault) is None
    assert seq(spark, [], M.role_fault) == "empty_final_reply" and seq(spark, None, M.role_fault) == "bad_messages_type"


def test_last_pairs_slices_before_it_filters(spark):
    rows = [([["u1", "a1"], ["u2", "a2"], [" ", "a3"], ["u4", "a4"], ["u5", "a5"]],)]
    df = spark.createDataFrame(rows, "h array<array<string>>")
    got = df.select(M.last_pairs(F.col("h"), 4, T.clean).alias("x")).first()[0]
    assert [p["user"] for p in got] == ["u2", "u4", "u5"]


@pytest.mark.parametrize("s, t, room, out", [(3, 4, 10, (3, 4)), (8, 4, 10, (6, 4)), (3, 12, 10, (0, 10)), (3, 4, 0, (0, 0)), (0, 0, 5, (0, 0))])
def test_budget(spark, s, t, room, out):
    got = spark.range(1).select(M.budget(F.lit(s), F.lit(t), F.lit(room)).alias("x")).first()[0]
    assert tuple(got) == out


def reference_mask(turns, limit, last_only):
    ids, labels, cut = [], [], False
    for n, (s, t) in enumerate(reversed(turns) if last_only else turns):
        room = limit - len(ids)
        if room <= 0:
            cut = True
            break
        a, b = [ord(c) for c in s], [ord(c) for c in t]
        kt = min(len(b), room)
        ks = min(len(a), room - kt)
        cut = cut or ks < len(a) or kt < len(b)
        a, b = a[len(a) - ks :], b[:kt]
        lab = [-100] * len(a) + ([-100] * len(b) if last_only and n else b)
        ids, labels = (a + b + ids, lab + labels) if last_only else (ids + a + b, labels + lab)
    return ids, labels, cut


@pytest.mark.parametrize("last_only", [False, True])
@pytest.mark.parametrize("limit", [1, 3, 5, 8, 40])
def test_masked_tokens(spark, limit, last_only):
    turns = [("abc", "de"), ("f", "ghij"), ("kl", "m")]
    df = spark.createDataFrame([([{"source": s, "target": t} for s, t in turns],)], "t array<struct<source:string,target:string>>")
    got = df.select(M.masked_tokens(F.col("t"), limit, last_only).alias("x")).first()[0]
    assert (list(got["input_ids"]), list(got["labels"]), got["truncated"]) == reference_mask(turns, limit, last_only)


def test_masked_tokens_reject_and_plug(spark):
    schema = "t array<struct<source:string,target:string>>"
    df = spark.createDataFrame([([],), ([{"source": "ab", "target": ""}],), ([{"source": "ab", "target": "c"}],)], schema)
    got = [r[0] for r in df.select(M.masked_tokens(F.col("t"), 5).alias("x")).collect()]
    assert [g["input_ids"] is None and g["labels"] is None for g in got] == [True, True, False]
    stats = metrics.token_stats(df.select(M.masked_tokens(F.col("t"), 5).alias("t")), "t").first()
    assert (stats["total"], stats["usable"], stats["skipped"], stats["max_length"]) == (3, 1, 2, 3)
    by_word = lambda c: F.transform(F.filter(F.split(c, " "), lambda w: w != ""), F.length)
    words = spark.createDataFrame([([{"source": "one three", "target": "seven"}],)], schema)
    got = words.select(M.masked_tokens(F.col("t"), 5, tokenizer=by_word, train_on_prompt=True).alias("x")).first()[0]
    assert list(got["input_ids"]) == [3, 5, 5] == list(got["labels"])


def test_record_forms(spark):
    fv = "array<struct<from:string,value:string>>"
    rows = [(None, [("human", "q"), ("gpt", "a")], None, "p", "r"), ([], None, [[" h ", "k"], ["only"], ["", "x"]], " p ", "r"), ([("user", "u"), ("assistant", "v")], [("human", "q")], None, None, None), (None, None, None, "p", " ")]
    df = spark.createDataFrame(rows, f"messages array<{M.MESSAGE}>, conversations {fv}, history array<array<string>>, prompt string, response string")
    got = [[tuple(m) for m in r[0]] for r in df.select(M.of_record(df.schema)).collect()]
    assert got == [[("human", "q"), ("gpt", "a")], [("user", "h"), ("assistant", "k"), ("user", "p"), ("assistant", "r")], [("user", "u"), ("assistant", "v")], []]
    with pytest.raises(ValueError):
        M.of_record(spark.createDataFrame([], "messages array<struct<a:string>>").schema)


def test_record_prompts(spark):
    u = lambda s: f"<|im_start|>user\n{s}<|im_end|>\n<|im_start|>assistant\n"
    two = [("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", "d"), ("user", "e")]
    df = spark.createDataFrame([(two, "q", "k", None), (None, "q", " k ", "S"), ([], "q", "", "S")], f"messages array<{M.MESSAGE}>, query string, context string, system string")
    got = [r[0] for r in df.select(M.record_prompt(df.schema)).collect()]
    s = "<|im_start|>system\nS<|im_end|>\n"
    assert got == [u("a") + u("b") + "c<|im_end|>\n" + u("e"), s + u("用户问题：q\n业务背景：k"), s + u("q")]
    df = spark.createDataFrame([([["h", "k"]], "p"), (None, None)], "history array<array<string>>, prompt string")
    assert [r[0] for r in df.select(M.record_prompt(df.schema)).collect()] == [u("h") + "k<|im_end|>\n" + u("p"), ""]


def test_numbers(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 1.0)], "g string, r double")
    assert all(abs(r["advantage"]) < 1e-9 for r in metrics.group_advantage(df, "r", "g").collect())
    df = spark.createDataFrame([(None, 1.0, "x"), (None, 3.0, "x"), ("g", 5.0, "x")], "g string, r double, _n string")
    assert sorted(round(r["advantage"], 6) for r in metrics.group_advantage(df, "r", "g").collect()) == [-1.0, 0.0, 1.0]
    row = spark.range(1).select(
        N.clipped_objective(F.lit(1.5), F.lit(2.0)).alias("a"),
        N.masked_mean(F.array(F.lit(9.0), F.lit(1.0), F.lit(3.0)), F.lit(1)).alias("b"),
        N.masked_mean(F.array(F.lit(9.0)), F.lit(1)).alias("c"),
        N.judge_reward(F.lit(None).cast("int"), F.lit(None).cast("int")).alias("d"),
        N.judge_reward(F.lit(5), F.lit(0)).alias("e"),
        N.perplexity(F.lit(1.4574)).alias("f"),
        N.preference_loss(F.lit(0.0), F.lit(0.0)).alias("g"),
    ).first()
    assert row["a"] == pytest.approx(-2.4) and row["b"] == 2.0 and row["c"] == 0.0 and row["d"] == 0.0
    assert row["e"] == 1.0 and round(row["f"], 2) == 4.29 and row["g"] == pytest.approx(math.log(2))
