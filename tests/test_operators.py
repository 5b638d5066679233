"""Operators against plain loops, and their defined results on nulls, ties and empty tables."""

import hashlib
import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.functions.text import shuffle_key
from colloquy.operators import annotation, dialogue, joins, metrics, pairs, records, rewriting, rules, selection, transport


def test_first_accepted(spark):
    rows = [(1, "k", "bad"), (2, "k", None), (3, "k", None), (4, "k", "bad"), (5, "z", None), (6, None, None), (7, None, None)]
    df = spark.createDataFrame(rows, "i int, k string, reason string")
    got = {r["i"]: (r["reason"], r["is_duplicate"]) for r in selection.first_accepted(df, "k", ["i"], "reason", "dup").collect()}
    assert got == {1: ("bad", False), 2: (None, False), 3: ("dup", True), 4: ("bad", True), 5: (None, False), 6: (None, False), 7: (None, False)}


def loop_quota(counts, total, low, high):
    caps = {k: min(v, high) for k, v in counts.items()}
    total = min(total, sum(caps.values()))
    out = {k: min(caps[k], low) for k in caps}
    while sum(out.values()) < total:
        moved = False
        for k in sorted(caps, key=lambda n: (out[n] / max(caps[n], 1), n)):
            if out[k] < caps[k] and sum(out.values()) < total:
                out[k] += 1
                moved = True
        if not moved:
            break
    return out


def pass_quota(counts, total, low, high):
    """The closed form in plain code: slots by pass, fill before the slot, name."""
    caps = {k: min(v, high) for k, v in counts.items()}
    floor = {k: min(c, low) for k, c in caps.items()}
    room = max(0, min(total, sum(caps.values())) - sum(floor.values()))
    slots = sorted((p, (floor[k] + p - 1) / max(caps[k], 1), k) for k in caps for p in range(1, caps[k] - floor[k] + 1))[:room]
    return {k: floor[k] + sum(s[2] == k for s in slots) for k in caps}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 30), min_size=1), st.integers(0, 90), st.integers(0, 5), st.integers(1, 20))
def test_quota_closed_form_is_the_loop(counts, total, low, high):
    a, b = loop_quota(counts, total, low, high), pass_quota(counts, total, low, high)
    assert a == b


def test_quotas(spark):
    counts = {"a": 30, "b": 3, "c": 11}
    df = spark.createDataFrame(list(counts.items()), "name string, n long")
    got = {r["name"]: r["quota"] for r in selection.quotas(df, "name", "n", 25, 4, 20).collect()}
    assert got == pass_quota(counts, 25, 4, 20)
    assert selection.quotas(df.limit(0), "name", "n", 25, 4, 20).count() == 0


def test_floors_are_never_cut(spark):
    df = spark.createDataFrame([("a", 9), ("b", 9)], "name string, n long")
    assert {r["quota"] for r in selection.quotas(df, "name", "n", 5, 4, 20).collect()} == {4}


def test_shrink_targets_keep_floors(spark):
    df = spark.createDataFrame([("a", 80), ("b", 6), ("c", 2), ("d", 40)], "name string, n long")
    got = {r["name"]: r["quota"] for r in selection.shrink_targets(df, "name", "n", 60, 5).collect()}
    assert got["b"] >= 5 and got["c"] == 2 and sum(got.values()) == 60


def test_group_split_keeps_groups_together(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(i, f"s{i % 3}", f"g{r.randrange(40)}") for i in range(300)], "i int, s string, g string")
    got = selection.group_split(df, "s", "g", 0.2, 0.2, 7)
    assert got.count() == 300
    assert got.groupBy("s", "g").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert {x["split"] for x in got.select("split").distinct().collect()} == {"train", "dev", "test"}


def test_results_do_not_depend_on_partitions(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 4).cast("string").alias("s"))
    a = sorted(map(tuple, selection.review_sample(df, "s", 3, shuffle_key(1, F.col("id"))).collect()))
    b = sorted(map(tuple, selection.review_sample(df.repartition(13), "s", 3, shuffle_key(1, F.col("id"))).collect()))
    assert a == b and len(a) == 12


@pytest.mark.parametrize("n", [0, 1, 2, 25])
def test_holdout_clamps(spark, n):
    got = selection.holdout(spark.range(n), shuffle_key(1, F.col("id")), ratio=0.1)
    assert got.filter("is_eval").count() == (0 if n == 0 else 1 if n < 20 else 2)


def test_merge_new_keeps_repeats_of_the_batch(spark):
    a = spark.createDataFrame([("1",), ("2",)], "id string")
    b = spark.createDataFrame([("2",), ("3",), ("3",)], "id string")
    assert sorted(r["id"] for r in joins.merge_new(a, b).collect()) == ["1", "2", "3", "3"]


def test_compare_raises_on_a_missing_case(spark):
    rows = [("1", "x", "a"), ("1", "y", "b"), ("2", "x", "c"), ("9", "y", "d")]
    df = spark.createDataFrame(rows, "id string, run string, v string")
    wide = joins.compare(df.filter("id = '1' or id = '9'"), "id", "run", ["v"], ["x", "y"])
    assert [(r["id"], r["x"]["v"], r["y"]["v"]) for r in wide.collect()] == [("1", "a", "b")]
    with pytest.raises(Exception, match="missing in y"):
        joins.compare(df, "id", "run", ["v"], ["x", "y"]).collect()


def test_positional_needs_equal_counts(spark):
    with pytest.raises(ValueError):
        joins.positional(spark.range(2), spark.range(3), ["id"], ["id"])


def test_classifier_rules(spark):
    rows = [("我要退款，也要退货", "好"), ("换个颜色", ""), ("今天天气", "晴"), (None, None), ("催一下快递", "发票")]
    df = spark.createDataFrame(rows, "p string, r string")
    got = [(x["label"], x["score"]) for x in df.select(rules.classify(F.col("p"), F.col("r")).alias("c")).select("c.*").collect()]
    assert got[:4] == [("退款-取消价保", 100), ("售后-退换维修", 101), ("unknown", 0), ("unknown", 0)]
    assert got[4] == ("物流-查件催发", 6)


def test_gate_keeps_flags_up_to_the_exit(spark):
    rows = [("今天天气怎么样", "哈" * 700, False, "unknown"), ("", "x", False, "a"), ("问题", "答案就在这里哦朋友们", True, "a")]
    df = spark.createDataFrame(rows, "p string, r string, h boolean, l string")
    got = [(x["reason"], list(x["flags"])) for x in df.select(rules.quality(F.col("p"), F.col("r"), F.col("h"), F.col("l")).alias("q")).select("q.*").collect()]
    assert got == [("too_long_reply_hard", ["unknown_intent"]), ("empty_prompt_or_response", []), (None, ["short_reply_rewrite", "has_history"])]


@pytest.mark.parametrize("c, r, fault", [("a" * 30, "b" * 15, None), ("a" * 31, "b" * 15, "length_gap_too_large:16"), ("a" * 19, "b" * 15, "chosen_too_short"), (None, "b", "chosen_too_short"), ("a" * 20, " ", "rejected_too_short"), ("a" * 20, "a" * 20, "chosen_equals_rejected")])
def test_pair_fault(spark, c, r, fault):
    assert spark.createDataFrame([(c, r)], "c string, r string").select(pairs.pair_fault(F.col("c"), F.col("r"))).first()[0] == fault


def test_augmented_pair_fault(spark):
    df = spark.createDataFrame([("a" * 15, "b" * 15), ("a" * 14, "b" * 15), ("a" * 15, "b" * 14), ("a" * 41, "b" * 15)], "c string, r string")
    got = [x[0] for x in df.select(pairs.pair_fault(F.col("c"), F.col("r"), 15, 15, 25, "length_gap_")).collect()]
    assert got == [None, "chosen_too_short", "rejected_too_short", "length_gap_26"]


@pytest.mark.parametrize(
    "label, said, fault",
    [
        (" a ", ["q", "答"], None),
        ("z", ["q", "答"], "invalid_scenario:z"),
        ("a", None, "bad_messages_type"),
        ("a", [], "empty_final_reply"),
        ("a", ["q"], "bad_role_at_0"),
        ("a", ["q", " "], "empty_content_at_1"),
        ("a", ["q", "分类：物流"], "empty_final_reply"),
        ("a", ["电话13800000000", "答"], "long_digit_leak"),
        ("a", ["[商品]", "答"], "placeholder_leak"),
        ("a", ["q", "分类：[x]\n回复：答"], None),
    ],
)
def test_record_fault(spark, label, said, fault):
    messages = None if said is None else [{"role": "user" if i % 2 == 0 else "assistant", "content": c} for i, c in enumerate(said)]
    df = spark.createDataFrame([(label, messages)], "l string, m array<struct<role:string,content:string>>")
    if fault == "bad_role_at_0":
        df = df.withColumn("m", F.transform("m", lambda x: F.struct(F.lit("assistant").alias("role"), x["content"].alias("content"))))
    assert df.select(rules.record_fault(F.col("l"), F.col("m"), ["a"])).first()[0] == fault


def test_nth_key_and_ordinals(spark, monkeypatch):
    monkeypatch.setattr(selection, "SORTED", 3)
    keys = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("k"))
    keys = keys.unionAll(keys.limit(40)).unionAll(spark.range(9).select(F.lit("f" * 32).alias("k")))
    every = sorted(r["k"] for r in keys.collect())
    for k in (1, 2, 250, 539, 540, 545, len(every)):
        assert selection.nth_key(keys, F.col("k"), k) == every[k - 1]
    df = spark.createDataFrame([("b", 2), ("a", 9), (None, 1), ("a", 3), ("b", 1), (None, 0)], "g string, o int")
    got = sorted((str(r["g"]), r["o"], r["n"]) for r in joins.ordinal_in(df, "g", ["o"], "n").collect())
    assert got == [("None", 0, 1), ("None", 1, 2), ("a", 3, 1), ("a", 9, 2), ("b", 1, 1), ("b", 2, 2)]


def test_source_record(spark):
    rows = [("<b>退款</b>多久到", "您好，预计三个工作日原路退回，请留意", [["在吗", "在的"], ["", "x"], ["尺寸", "大"]], 7), (None, "x", None, 8)]
    df = spark.createDataFrame(rows, "p string, r string, h array<array<string>>, i int")
    got = [r[0] for r in df.select(records.source_record(F.col("p"), F.col("r"), F.col("h"), F.col("i"), "s", 2)).collect()]
    body = '{"prompt":"退款多久到","response":"您好，预计三个工作日原路退回，请留意","history":[["尺寸","大"]]}'
    assert got[0]["id"] == "raw_000007_" + hashlib.sha1(body.encode()).hexdigest()[:8]
    assert got[0]["meta"]["scenario"] == "退款-取消价保" and got[0]["meta"]["history_turns"] == 1 and len(got[0]["messages"]) == 4
    assert got[1]["reason"] == "empty_prompt_or_response" and got[1]["meta"]["source"] == "s"


def test_error_prompt_names_another_scenario(spark):
    rows = [(str(n), rewriting.SCENARIOS[n % 12], [{"role": "user", "content": "q"}, {"role": "assistant", "content": "答案"}]) for n in range(40)]
    df = spark.createDataFrame(rows, "id string, s string, m array<struct<role:string,content:string>>")
    got = df.select("s", rewriting.error_prompt(F.col("m"), F.col("s"), F.lit("wrong_intent"), F.col("id")).alias("p")).collect()
    named = [r["p"].split("请假装这是'")[1].split("'")[0] for r in got]
    assert all(n in rewriting.SCENARIOS and n != r["s"] for n, r in zip(named, got)) and len(set(named)) > 5
    assert got[0]["p"].startswith("场景类别：" + got[0]["s"] + "\n\n用户最后提问：q\n原始正确回复（2字）：答案\n\n")


def test_train_eval_takes_an_explicit_table(spark):
    train, held, report = selection.train_eval(spark.range(10), spark.range(3), F.col("id").cast("string"))
    assert (train.count(), held.count()) == (10, 3) and tuple(report.first()) == ("explicit_eval_file", 10, 3)


def test_expand_turns(spark):
    m = [{"role": r, "content": str(n)} for n, r in enumerate(["user", "assistant", "user", "assistant"])]
    df = spark.createDataFrame([("1", m), ("2", []), ("3", None)], "id string, messages array<struct<role:string,content:string>>")
    got = dialogue.expand_turns(df, ["id"], "messages", 1).collect()
    assert [(r["turn"], [x["content"] for x in r["context"]], r["target"]) for r in got] == [(1, ["0"], "1"), (3, ["0", "1", "2"], "3")]
    back = dialogue.from_turns(dialogue.to_turns(df, ["id"], "messages"), ["id"]).collect()
    assert [x["content"] for x in back[0]["messages"]] == ["0", "1", "2", "3"]


def test_judge_metrics_without_history(spark):
    rows = [("a", 5, 4, 4, 4, 4, None, True, "null"), (None, 2, None, 3, 3, 3, None, None, "off_topic")]
    df = spark.createDataFrame(rows, "scenario string, need int, accurate int, helpful int, tone int, risk int, history_use int, passed boolean, fail_tag string")
    m = metrics.judge_metrics(df).first()
    assert (m["total"], m["n_passed"], m["pass_rate"], m["auto_rate"], m["accuracy"], m["mean_history_use"]) == (2, 1, 50.0, 50.0, 50.0, 0.0)
    assert [tuple(r) for r in metrics.histogram(metrics.tags(df), "fail_tag").collect()] == [("off_topic", 1)]
    assert {r["scenario"] for r in metrics.judge_metrics(df, "scenario").collect()} == {"a", "unknown"}


def test_sheet_roundtrip(spark):
    df = spark.createDataFrame([(1, "x", "id1", "[user] 你好\n[assistant] 在", ["a", "b"], [])], "n int, i string, l string, d string, m array<string>, a array<string>")
    sheet = df.select(annotation.section(F.col("n"), F.col("i"), F.col("l"), F.col("d"), F.col("m"), F.col("a")).alias("value"))
    r = annotation.parse_sheet(sheet).first()
    assert (r["number"], r["intent"], r["label"], r["dialogue"], list(r["must"]), list(r["avoid"])) == (1, "x", "id1", "[user] 你好\n[assistant] 在", ["a", "b"], [])
    c = annotation.checklist_counts(sheet).first()
    assert (c["filled"], c["empty"]) == (2, 4)


def test_sheet_of_more_than_a_thousand_sections(spark):
    rows = [(n, "x", f"id{n}", f"[user] {n}", ["a"], ["b"]) for n in range(1, 1203)]
    df = spark.createDataFrame(rows, "n int, i string, l string, d string, m array<string>, a array<string>")
    one = F.struct("n", annotation.section(F.col("n"), F.col("i"), F.col("l"), F.col("d"), F.col("m"), F.col("a")).alias("s"))
    sheet = df.groupBy("i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]), "\n").alias("value"))
    got = sorted(tuple(r) for r in annotation.parse_sheet(sheet).select("number", "label", "dialogue", "must", "avoid").collect())
    assert got == [(n, label, text, must, avoid) for n, _, label, text, must, avoid in rows]


def test_transport_audits_every_call(spark):
    df = spark.createDataFrame([(str(n), f"p{n}") for n in range(40)] + [("x", None)], "id string, prompt string")
    audit = transport.call_all(df, "id", "prompt", transport.Echo(fail_every=5), transport.Retry(attempts=2), sleep=lambda s: None).collect()
    assert len(audit) == 41
    bad = [r for r in audit if r["error"]]
    assert all(r["result"] is None for r in bad) and {r["attempts"] for r in bad} == {0, 2}
    done = spark.createDataFrame([(r["id"],) for r in audit if not r["error"]], "id string")
    assert joins.resume(df, done).count() == len(bad)
    assert transport.Retry().wait(10) == 30.0


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 9)), max_size=20))
def test_running_peak(spark, rows):
    df = spark.createDataFrame([(k, n, v) for n, (k, v) in enumerate(rows)], "k string, n int, v int")
    got = {r["n"]: r["peak"] for r in metrics.running_peak(df, "v", ["n"], ["k"]).collect()}
    assert got == {n: max(v for m, (k2, v) in enumerate(rows) if m <= n and k2 == k) for n, (k, _) in enumerate(rows)}


@pytest.mark.parametrize("n_train, n_dev, n_pool, edge", [(90, 10, 50, 45), (1, 1, 5, 2), (3, 0, 4, 4), (0, 0, 4, 0), (5, 5, 0, 0)])
def test_transfer_split_in_proportion(spark, n_train, n_dev, n_pool, edge):
    pool = spark.range(n_pool).withColumn("o", shuffle_key(10, F.col("id")))
    got = selection.transfer_split(pool, spark.range(n_train), spark.range(n_dev), F.col("o")).collect()
    order = sorted((r["o"], r["split"]) for r in got)
    assert [s for _, s in order] == ["train"] * edge + ["dev"] * (n_pool - edge)


def test_substantive_answers(spark):
    rows = [("您好，建议您在订单详情页申请售后，等待客服审核通过即可寄回商品", True), ("您好，请稍等，正在查看，可以的哦亲", False), ("今天的天气真的非常非常好我们出去走走看看风景吧", False), (None, False)]
    df = spark.createDataFrame(rows, "r string, ok boolean")
    assert all(x["ok"] == x["got"] for x in df.withColumn("got", rules.substantive(F.col("r"))).collect())


def test_style_examples(spark):
    m = lambda u, a: [{"role": "user", "content": u}, {"role": "assistant", "content": a}]
    rows = [(0, m("问" * 5, "答" * 50)), (1, m("问" * 6, "答" * 19)), (2, m("问" * 6, "答" * 20)), (3, m("问" * 9, "答" * 200)), (4, m("问" * 9, "答" * 201)), (5, m("问" * 9, "答" * 50)), (6, m("问" * 9, "答" * 60)), (7, None)]
    df = spark.createDataFrame(rows, "n int, messages array<struct<role:string,content:string>>")
    assert [len(r["assistant"]) for r in selection.style_examples(df, "messages", 2, F.col("n")).collect()] == [20, 200]
    assert [len(r["assistant"]) for r in selection.style_examples(df, "messages", 9, F.col("n")).collect()] == [20, 200, 50, 60]


def test_rewrite_payload(spark):
    rows = [("1", "闲聊-礼貌收尾", ["has_history"], True, [["a", "b"], ["c"]], "p", "r"), ("2", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, s string, f array<string>, h boolean, t array<array<string>>, p string, r string")
    a, b = (json.loads(x[0]) for x in df.orderBy("id").select(rewriting.rewrite_payload(*map(F.col, df.columns))).collect())
    assert a["target_scenario"] == "闲聊-礼貌收尾" and a["scenario_definition"] == rewriting.GUIDE["闲聊-礼貌收尾"] and a["source_quality_flags"] == ["has_history"]
    assert a["raw_dialogue"] == {"history": [{"user": "a", "assistant": "b"}], "current_user": "p", "current_assistant": "r"} and a["output_schema"]["id"] == "1"
    assert b["target_scenario"] == rewriting.CHOOSE and b["scenario_definition"] == rewriting.BY_NAME and b["raw_dialogue"]["history"] == [] and b["history_required"] is False
    assert list(a) == ["task", "target_scenario", "allowed_scenarios", "scenario_definition", "source_quality_flags", "history_required", "raw_dialogue", "output_schema", "requirements"]
    assert len(a["requirements"]) == 4 and a["allowed_scenarios"] == sorted(rules.INTENTS) and len(a["output_schema"]["messages"]) == 2
