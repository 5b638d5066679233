"""Queries of the training-data operators over whole tables, and the SQL they are checked against."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import common, defects, leak, lookalike, mixing, neardup, overlap, pii, sampling

# The tokenizer of the mixing queries; its folder is a parameter of the installation.
TOKENIZER = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d).select("split_name", "eval_id", "train_id")


def _p1(spark: SparkSession, d: str) -> DataFrame:
    splits = {"sft_dev": table(spark, d, "sft_dev"), "eval_test": table(spark, d, "eval_test")}
    return overlap.cross_split_overlaps(splits, table(spark, d, "sft_train"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(_p1(spark, d), table(spark, d, "sft_train"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = pii.find(pii.fields(table(spark, d, "sft_train")))
    return found.select("record_id", "field_name", "turn_no", "pii_type").distinct()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    texts = pii.fields(table(spark, d, "sft_train"))
    return pii.redact(texts, pii.find(texts))


def _p4(spark: SparkSession, d: str) -> DataFrame:
    answers = defects.preference_answers(table(spark, d, "dpo_preference_pairs"))
    return defects.broken_answers(answers.unionByName(defects.generation_answers(table(spark, d, "post_train_test_generations"))))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d)


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return defects.defect_report(_p4(spark, d))


def _p5(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    train = table(spark, d, "sft_train").select("id", common.record_text(F.coalesce("messages", F.array())).alias("text"), F.lit("sft_train").alias("table_name"))
    pairs = table(spark, d, "dpo_preference_pairs").select("id", F.col("prompt").alias("text"), F.lit("dpo_preference_pairs").alias("table_name"))
    return neardup.near_duplicate_pairs(train.unionByName(pairs), tag_col="table_name")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.expand_pairs(*_p5(spark, d)).select(F.col("tag").alias("table_name"), "id_a", "id_b")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(*_p5(spark, d)).withColumnRenamed("tag", "table_name")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d).select("doc_id", "item_id")


def _p6(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_passages(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return leak.leak_report(_p6(spark, d), table(spark, d, "heldout_items"))


def _p2(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    scenario = F.coalesce(sampling.trimmed(F.col("meta.scenario")), sampling.trimmed(F.col("meta.intent")), F.lit("unknown"))
    goals = table(spark, d, "scenario_targets").filter("scenario is not null").limit(sampling.MAX_SIGNATURES + 1).collect()
    if len(goals) > sampling.MAX_SIGNATURES:
        raise ValueError(f"more than {sampling.MAX_SIGNATURES} scenarios")
    targets = {r["scenario"]: (r["target_share"] or 0.0, r["min_rows"] or 0) for r in goals}
    return sampling.proportional_sample(table(spark, d, "sft_train"), "id", [scenario], [targets])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d)[1].filter("is_short").select(F.col("category").alias("scenario"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d)[1].select(F.col("category").alias("scenario"), "available", "wanted", "sampled", "is_short")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d)[0].withColumnRenamed("c0", "scenario")


def _p7(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix_sources(mixing.token_counts(table(spark, d, "documents"), TOKENIZER), table(spark, d, "mix_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d)[1].filter("is_short").select("source")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d)[1]


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d)[0]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_pairs(lookalike.canonical_texts(table(spark, d, "documents")))


def p8_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_texts(table(spark, d, "documents")).select("doc_id", "canonical")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


_P2 = """
with r as (select id, coalesce(nullif(regexp_replace(meta.scenario, '^[\\s\\x0b\\p{Z}]+|[\\s\\x0b\\p{Z}]+$', '', 'g'), ''), nullif(regexp_replace(meta.intent, '^[\\s\\x0b\\p{Z}]+|[\\s\\x0b\\p{Z}]+$', '', 'g'), ''), 'unknown') as s from sft_train where id is not null),
 i as (select id, min(s) as s from r group by id), n as (select floor(count(*) * 0.2 + 1e-9) as n from i), c as (select s, count(*) as have from i group by s),
 w as (select scenario, coalesce(have, 0)::bigint as available, greatest(target_share * n, min_rows)::double as wanted from scenario_targets left join c on s = scenario, n)
"""


def _translate(x: str, table: dict[str, str]) -> str:
    """translate() of SQL; characters that map to '' are deleted."""
    order = sorted(table, key=lambda k: (table[k] == "", k))
    quote = lambda t: t.replace("'", "''")
    return f"translate({x}, '{quote(''.join(order))}', '{quote(''.join(table[k] for k in order))}')"


def _fold_sql(x: str) -> str:
    """Folded text: characters with one compatibility form by table, which is all the data hold."""
    table = {}
    for c in range(0x80, 0x10000):
        form = "" if 0xD800 <= c < 0xE000 else unicodedata.normalize("NFKC", chr(c))
        if len(form) == 1 and form != chr(c) and form.isalnum() and unicodedata.normalize("NFC", chr(c)) == chr(c):
            table[chr(c)] = form
    return f"regexp_replace(lower(nfc_normalize({_translate(x, table)})), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _sets(name: str, rows: str, k: int) -> str:
    """CTEs name(id, f), name_n(id, n) and name_g(id, g): folded texts, numbers of and distinct k-sequences."""
    return f"""{name} as ({rows}), {name}_g as (select distinct id, unnest(list_transform(range(1, length(f) - {k - 2}), lambda i: substr(f, i, {k}))) as g from {name} where length(f) >= {k}),
 {name}_n as (select id, count(*) as n from {name}_g group by 1)"""


def oracle_sql() -> dict[str, str]:
    record = _fold_sql("array_to_string(list_transform(coalesce(messages, []), lambda m: coalesce(m.content, '')), '')")
    once = lambda t: f"select id, any_value({record}) as f from {t} where id is not null group by id"
    held = lambda t, split: f"select '{split}' as split_name, a.id as eval_id, b.id as train_id from {t}_g a join tr_g b using (g) join {t}_n n on n.id = a.id group by a.id, b.id, n.n having count(*) >= 0.7 * n.n"
    like = lambda t, name: f"select '{name}' as table_name, a.id as id_a, b.id as id_b from {t}_g a join {t}_g b on a.g = b.g and a.id < b.id join {t}_n n on n.id = a.id join {t}_n m on m.id = b.id group by a.id, b.id, n.n, m.n having count(*) >= 0.55 * (n.n + m.n - count(*))"
    prompts = f"select id, any_value({_fold_sql('prompt')}) as f from dpo_preference_pairs where id is not null and prompt is not null group by id"
    looks = {**lookalike.LOOKALIKES, **{c: "" for c in lookalike.ignorables()}}
    canonical = f"nfc_normalize({_translate(_translate('text', lookalike.plain_table()), looks)})"
    return {
        "p1_found": f"with {_sets('tr', once('sft_train'), 3)}, {_sets('dv', once('sft_dev'), 3)}, {_sets('et', once('eval_test'), 3)} {held('dv', 'sft_dev')} union all {held('et', 'eval_test')}",
        "p2_found": _P2 + "select scenario from w where available < wanted",
        "p5_found": f"with {_sets('tr', once('sft_train'), 3)}, {_sets('pp', prompts, 3)} {like('tr', 'sft_train')} union all {like('pp', 'dpo_preference_pairs')}",
        "p6_found": f"""with {_sets('d', f"select doc_id as id, {_fold_sql('text')} as f from documents where text is not null", 8)}, {_sets('i', f"select item_id as id, {_fold_sql('text')} as f from heldout_items where text is not null", 8)}
select d_g.id as doc_id, i_g.id as item_id from i_g join d_g using (g) join i_n on i_n.id = i_g.id group by 1, 2, i_n.n having count(*) >= 0.4 * i_n.n""",
        "p8_found": f"with c as (select doc_id, text, {canonical} as form from documents where text is not null) select a.doc_id as doc_a, b.doc_id as doc_b from c a join c b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text",
    }
