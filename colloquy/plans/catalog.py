"""All registered queries and the SQL they are checked against.

Every query runs over its whole tables. A query and its SQL stand together; SQL is left out where a
plain engine cannot say it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions import numbers as N
from ..functions import replies as R
from ..functions import text as T
from ..operators import annotation, dialogue, joins, metrics, pairs, records, reports, rewriting, rules, selection
from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# -- building blocks of the SQL side -------------------------------------------------------------
WS = r"[\s\x0b\p{Z}]"
NOISE_SQL = quoted(T.NOISE.replace("(?U)", "").replace(r"\s", r"\s\x0b\p{Z}"))


def sql_key(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x}, ''), {NOISE_SQL}, '', 'g'))"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_clean(x: str) -> str:
    inner = f"regexp_replace(coalesce({x}, ''), '<[^>]+>', '', 'g')"
    for old, new in T.SELF_REFERENCES.items():
        inner = f"replace({inner}, '{old}', '{new}')"
    return sql_strip(f"regexp_replace({inner}, '{WS}+', ' ', 'g')")


def sql_intent(x: str = "meta") -> str:
    return f"coalesce(nullif({x}.scenario, ''), nullif({x}.intent, ''), 'unknown')"


def intent() -> object:
    return T.first_filled(F.col("meta.scenario"), F.col("meta.intent"))


def train(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sft_train")


def latest(spark: SparkSession, d: str, name: str, *columns) -> DataFrame:
    """One row per id with the chosen columns: the first delivery. Only these columns are read and shuffled."""
    rows = table(spark, d, name).select("id", "ingested_at", *columns)
    return selection.last_wins(rows, "id", [-F.unix_micros(F.col("ingested_at").cast("timestamp"))])


FIRST = "(select * from {t} qualify row_number() over (partition by id order by ingested_at) = 1)"


# -- text -----------------------------------------------------------------------------------------
@query(f"select id, {sql_clean('meta.source_prompt')} as text, length({sql_clean('meta.source_prompt')})::bigint as n from sft_train")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return train(spark, d).select("id", T.clean(F.col("meta.source_prompt")).alias("text")).withColumn("n", F.length("text").cast("long"))


@query(f"select id, {sql_key('prompt')} as key, length({sql_key('prompt')})::bigint as n, substr(sha1({sql_key('prompt')}), 1, 12) as hash from dpo_preference_pairs")
def dedup_key(spark: SparkSession, d: str) -> DataFrame:
    key = T.loose_key(F.col("prompt"))
    return table(spark, d, "dpo_preference_pairs").select("id", key.alias("key"), F.length(key).cast("long").alias("n"), T.short_hash(key).alias("hash"))


@query("""
select id, 'raw_' || printf('%06d', meta.source_index) || '_' ||
  substr(sha1(to_json({'prompt': meta.source_prompt, 'response': meta.source_response})::varchar), 1, 8) as raw_id
from sft_train where meta.source_index is not null""")
def source_id(spark: SparkSession, d: str) -> DataFrame:
    rows = train(spark, d).filter("meta.source_index is not null")
    return rows.select("id", T.raw_id(F.col("meta.source_index"), F.col("meta.source_prompt").alias("prompt"), F.col("meta.source_response").alias("response")).alias("raw_id"))


@query(f"select {sql_key('text')} as key, count(*)::bigint as n from documents group by 1 having count(*) > 1")
def repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    return selection.repeated(table(spark, d, "documents").select(T.loose_key(F.col("text")).alias("key")), "key")


@query(f"select {sql_intent()} as intent, count(*)::bigint as n from sft_train group by 1")
def intent_accessor(spark: SparkSession, d: str) -> DataFrame:
    return train(spark, d).groupBy(intent().alias("intent")).agg(F.count(F.lit(1)).alias("n"))


@query(r"select doc_id, length(regexp_replace(coalesce(text, ''), '[\x00-\x7F\s\p{Z}]', '', 'g'))::bigint as wide, len(regexp_extract_all(coalesce(text, ''), '\[[^\]]+\]'))::bigint as placeholders from documents")
def text_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.wide_length(F.col("text")).cast("long").alias("wide"), T.placeholder_count(F.col("text")).cast("long").alias("placeholders"))


@query("select id, case when need is null then '' else printf('%.4f', need / 3.0::double) end as cell, case when risk is null then '' else printf('%.2f', risk * 10.0::double) || '%' end as percent from judge_results")
def report_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "judge_results").select("id", T.cell(F.col("need") / 3.0).alias("cell"), T.percent_cell(F.col("risk") * 10.0).alias("percent"))


# -- rules ----------------------------------------------------------------------------------------
_WORDS = ", ".join(f"({n}, {quoted(k)}, {quoted(w)})" for n, (k, v) in enumerate(rules.INTENTS.items()) for w in v)
_PRIORITY = " ".join(f"when regexp_matches(p, {quoted(pattern)}) then {{'label': {quoted(label)}, 'score': {score}}}" for pattern, label, score in rules.PRIORITY)


def classify_sql(rows: str) -> str:
    """CTEs up to done(hit) for rows with rid, p (prompt) and o (everything else)."""
    return f"""
with words(rank, label, word) as (values {_WORDS}),
 rows as ({rows}),
 points as (select rid, rank, label, sum(case when contains(p, word) then 3 when contains(p || ' ' || o, word) then 1 else 0 end) as score from rows, words group by all),
 best as (select rid, first({{'label': label, 'score': score}} order by score desc, rank) as b from points where score > 0 group by rid),
 done as (select rows.*, case {_PRIORITY} else {{'label': b.label, 'score': b.score}} end as hit from rows left join best using (rid))
"""


CLASSIFY_SQL = classify_sql("select row_number() over () as rid, id, coalesce(meta.source_prompt, '') as p, coalesce(meta.source_response, '') as r, coalesce(meta.source_response, '') as o from sft_train")


_PAIRS_SQL = f"""list_filter(list_slice(list_transform(range(1, greatest(1, len(messages) // 2)), lambda i: [{sql_clean('messages[2 * i - 1].content')}, {sql_clean('messages[2 * i].content')}]), -2, -1), lambda t: t[1] <> '' and t[2] <> '')"""
_SOURCE_SQL = classify_sql(f"""select *, r || ' ' || array_to_string(list_transform(h, lambda t: t[1] || ' ' || t[2]), ' ') as o from (
 select row_number() over () as rid, id, meta.source_index as i, {sql_clean('meta.source_prompt')} as p, {sql_clean('meta.source_response')} as r, {_PAIRS_SQL} as h from sft_train where meta.source_index is not null)""")


@query(_SOURCE_SQL + f"""select id, 'raw_' || printf('%06d', i) || '_' || substr(sha1(to_json({{'prompt': p, 'response': r, 'history': h}})::varchar), 1, 8) as raw_id,
 coalesce(hit.label, 'unknown') as label, coalesce(hit.score, 0)::bigint as score, len(h)::bigint as turns, {sql_key('p || r')} as pair_key, 2 * len(h) + 2 as n_messages from done""")
def source_records(spark: SparkSession, d: str) -> DataFrame:
    """Raw dialogues projected to records: the last two earlier pairs are the history."""
    m = F.col("messages")
    earlier = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(m) / 2).cast("int") - 2, F.lit(0))), lambda i: F.array(F.get(m, 2 * i)["content"], F.get(m, 2 * i + 1)["content"]))
    history = F.when(F.size(m) >= 4, earlier)
    rows = train(spark, d).filter("meta.source_index is not null")
    r = records.source_record(F.col("meta.source_prompt"), F.col("meta.source_response"), history, F.col("meta.source_index"), "raw", 2)
    rows = rows.select("id", r.alias("r")).select("id", F.col("r.id").alias("raw"), "r.messages", "r.meta")
    label = F.col("meta.scenario")
    score = F.coalesce(F.try_element_at("meta.intent_scores", label), F.lit(0)).cast("long")
    return rows.select(F.col("id"), F.col("raw"), label.alias("label"), score.alias("score"), F.col("meta.history_turns").cast("long").alias("turns"), F.col("meta.source_pair_key").alias("pair_key"), F.size("messages").cast("long").alias("n_messages")).withColumnRenamed("raw", "raw_id")


def classified(spark: SparkSession, d: str) -> DataFrame:
    p, r = F.col("meta.source_prompt"), F.col("meta.source_response")
    return train(spark, d).select("id", p.alias("p"), r.alias("r"), F.size("messages").alias("m"), rules.classify(p, r).alias("hit"))


@query(CLASSIFY_SQL + "select id, coalesce(hit.label, 'unknown') as label, coalesce(hit.score, 0)::bigint as score from done")
def rule_classify(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select("id", "hit.label", F.col("hit.score").cast("long").alias("score"))


def sql_stutter(k: str) -> str:
    return f"""exists (select 1 from (select unnest(range(1, length({k}) + 1)) as i) a, (select unnest(range(1, 25)) as w) b
 where (w >= 3 and substr({k}, i, w) = substr({k}, i + w, w) and substr({k}, i, w) = substr({k}, i + 2 * w, w) and i + 3 * w - 1 <= length({k}))
 or (w <= 2 and i + 6 * w - 1 <= length({k}) and repeat(substr({k}, i, w), 6) = substr({k}, i, 6 * w)))"""


@query(f"select id, {sql_stutter('k')} as stutters from (select id, {sql_key('prompt')} as k from dpo_preference_pairs)")
def stutter_detect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dpo_preference_pairs").select("id", T.stutters(F.col("prompt")).alias("stutters"))


def _quality_sql(tail: str) -> str:
    lp, lr = f"length({sql_key('p')})", f"length({sql_key('r')})"
    both = lambda pattern: f"(regexp_matches(p, {quoted(pattern)}) or regexp_matches(r, {quoted(pattern)}))"
    return (
        CLASSIFY_SQL
        + f""", steps as (select d.*, coalesce(hit.label, 'unknown') as label, {lp} as lp, {lr} as lr, {sql_key('p')} as kp, {sql_key('r')} as kr, len(s.messages) as m from done d join (select row_number() over () as rid, messages from sft_train) s using (rid)),
 stuck as (select *, {sql_stutter('kp')} or {sql_stutter('kr')} as stutters from steps),
 gate as (select *, case when p = '' or r = '' then 'empty_prompt_or_response' when lp < 2 then 'too_short_prompt' when lr < 6 then 'too_short_reply_hard' when lr > 600 then 'too_long_reply_hard' end as reason from stuck),
 flagged as (select *, list_filter([
  case when not (p = '' or r = '') and label = 'unknown' then 'unknown_intent' end,
  case when not (p = '' or r = '' or lp < 2 or lr < 6) and lr < 15 then 'short_reply_rewrite' end,
  case when reason is null and lr > 220 then 'long_reply_rewrite' end,
  case when reason is null and {both(T.PLACEHOLDER)} then 'placeholder_rewrite' end,
  case when reason is null and {both(T.LONG_DIGITS.replace('(?U)', '').replace(chr(92) + 'd', '[' + chr(92) + 'p{Nd}]'))} then 'long_digit_rewrite' end,
  case when reason is null and regexp_matches(r, {quoted(rules.BOILERPLATE)}) then 'boilerplate_rewrite' end,
  case when reason is null and regexp_matches(r, {quoted(rules.OVERPROMISE)}) then 'overpromise_rewrite' end,
  case when reason is null and regexp_matches(r, {quoted(rules.PRIVATE)}) then 'privacy_or_private_info_rewrite' end,
  case when reason is null and regexp_matches({sql_key('r')}, {quoted(rules.CONFLICT)}) then 'possible_conflict_rewrite' end,
  case when reason is null and stutters then 'stutter_rewrite' end,
  case when reason is null and m > 2 then 'has_history' end], lambda x: x is not null) as flags from gate)
"""
        + tail
    )


def judged(spark: SparkSession, d: str) -> DataFrame:
    rows = classified(spark, d)
    q = rules.quality(F.col("p"), F.col("r"), F.col("m") > 2, F.col("hit.label"))
    return rows.withColumn("q", q).withColumn("flags", F.col("q.flags"))


@query(_quality_sql("select id, reason, array_to_string(flags, ',') as flags from flagged"))
def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("id", "q.reason", F.array_join("flags", ",").alias("flags"))


@query(_quality_sql("select coalesce(reason, 'kept') as reason, count(*)::bigint as n from flagged group by 1"))
def drop_reason_hist(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(judged(spark, d).select(F.coalesce("q.reason", F.lit("kept")).alias("reason")), "reason")


_COSTS = " ".join(f"when {quoted(k)} then {v}" for k, v in {**rules.PENALTIES, "unknown_intent": 1.0}.items())


@query(_quality_sql(f"""select id, round((case when lp between 6 and 80 then 3 else 0 end + case when lr between 18 and 180 then 4 else 0 end + case when m > 2 then 1 else 0 end
 - coalesce(list_sum(list_transform(flags, lambda f: (case f {_COSTS} else 0 end)::double)), 0))::double, 6) as score from flagged"""))
def candidate_score(spark: SparkSession, d: str) -> DataFrame:
    rows = judged(spark, d)
    score = rules.candidate_score(T.compact_length(F.col("p")), T.compact_length(F.col("r")), F.col("m") > 2, F.col("flags"))
    return rows.select("id", F.round(score, 6).alias("score"))


_WIDE_SQL = r"length(regexp_replace(coalesce({}, ''), '[\x00-\x7F\s\p{{Z}}]', '', 'g'))"
_AUGMENT_COSTS = " ".join(f"when {quoted(k)} then {v}" for k, v in {**rules.PENALTIES, "unknown_intent": 2.0}.items())


@query(f"""select id, round((case when {_WIDE_SQL.format('meta.source_prompt')} between 6 and 80 then 3 else 0 end + case when {_WIDE_SQL.format('meta.source_response')} between 18 and 180 then 4 else 0 end + case when len(messages) > 2 then 1 else 0 end
 - coalesce(list_sum(list_transform(list_distinct(coalesce(meta.quality_flags, [])), lambda f: (case f {_AUGMENT_COSTS} else 0 end)::double)), 0))::double, 6) as score from sft_train""")
def augment_score(spark: SparkSession, d: str) -> DataFrame:
    """Score of the pool for rare classes: other lengths and a higher price of an unknown label."""
    wide = lambda c: T.wide_length(F.col(c))
    score = rules.candidate_score(wide("meta.source_prompt"), wide("meta.source_response"), F.size("messages") > 2, F.col("meta.quality_flags"), 2.0)
    return train(spark, d).select("id", F.round(score, 6).alias("score"))


_LEFT_SQL = "coalesce(meta.source_response, '')"
for _pattern in (rules.PREVIOUS_OR_OTHER, rules.WAITING, rules.BOILERPLATE, rules.FILLER):
    _LEFT_SQL = f"regexp_replace({_LEFT_SQL}, {quoted(_pattern)}, '', 'g')"


@query(f"select id, length({sql_key('x')}) >= 18 and regexp_matches(x, {quoted(rules.ACTION)}) as substantive from (select id, {_LEFT_SQL} as x from sft_train)")
def substantive_answers(spark: SparkSession, d: str) -> DataFrame:
    return train(spark, d).select("id", rules.substantive(F.col("meta.source_response")).alias("substantive"))


@query("select coalesce(meta.rewrite_selection_reject_reason, 'selected') as reason, count(*)::bigint as n from sft_train group by 1")
def reject_reason_hist(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(train(spark, d).select(F.coalesce("meta.rewrite_selection_reject_reason", F.lit("selected")).alias("reason")), "reason")


# -- deduplication and selection ------------------------------------------------------------------
@query(f"""
with rows as (select id, ingested_at, meta.source_pair_key as k, meta.source_index as i, case when length({sql_key('meta.source_response')}) < 40 then 'too_short_reply_hard' end as reason from sft_train),
 x as (select *, row_number() over (partition by k order by i, id, ingested_at) as place from rows),
 f as (select *, min(case when reason is null then place end) over (partition by k) as first_ok from x)
select id, coalesce(reason, case when k is not null and place > first_ok then 'exact_duplicate_prompt_response' end) as reason, coalesce(k is not null and place > first_ok, false) as is_duplicate from f""")
def dedup_first_accepted(spark: SparkSession, d: str) -> DataFrame:
    rows = train(spark, d).select("id", "ingested_at", F.col("meta.source_pair_key").alias("k"), F.col("meta.source_index").alias("i"), F.when(T.compact_length(F.col("meta.source_response")) < 40, "too_short_reply_hard").alias("reason"))
    return selection.first_accepted(rows, "k", ["i", "id", "ingested_at"], "reason").select("id", "reason", "is_duplicate")


@query("select id, scenario, need::bigint as need, passed from judge_results qualify row_number() over (partition by id order by judged_at desc) = 1")
def last_judgement(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "judge_results")
    return selection.last_wins(rows, "id", [F.col("judged_at")]).select("id", "scenario", F.col("need").cast("long").alias("need"), "passed")


QUOTA_SQL = """
with c as (select {intent} as name, least(count(*), 250)::bigint as cap from sft_train group by 1), b as (select *, least(cap, 8) as low from c),
 s as (select name, cap, low, unnest(range(1, cap - low + 1)) as pass from b where cap > low),
 r as (select *, row_number() over (order by pass, (low + pass - 1) / cap::double, name) as rank from s),
 q as (select name, cap, (low + (select count(*) from r where r.name = b.name and rank <= greatest(0, least(700, (select sum(cap) from b)) - (select sum(low) from b))))::bigint as quota from b)
"""


def intent_counts(spark: SparkSession, d: str, name: str = "sft_train") -> DataFrame:
    return table(spark, d, name).groupBy(intent().alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(QUOTA_SQL.format(intent=sql_intent()) + "select name, cap, quota from q")
def quota_allocate(spark: SparkSession, d: str) -> DataFrame:
    return selection.quotas(intent_counts(spark, d), "name", "n", 700, 8, 250)


@query(QUOTA_SQL.format(intent=sql_intent()) + """
, rows as (select id, any_value(i) as i, any_value(h) as h, any_value(score) as score from (select id, {intent} as i, len(messages) > 2 as h, meta.selection_score as score from sft_train) group by id),
 a as (select rows.*, quota, round_even(quota * 0.3, 0)::bigint as want, md5('11|' || id) as tie, count(*) filter (where h) over (partition by i) as nh from rows join q on i = name),
 k as (select *, row_number() over (partition by i, h order by score desc, tie) as rk from a),
 f as (select *, case when h then rk <= want else rk <= quota - least(want, nh) end as first_pick from k),
 g as (select *, count(*) filter (where first_pick) over (partition by i) as chosen, row_number() over (partition by i, first_pick order by score desc, tie) as again from f)
select id, i as intent, h as has_history from g where first_pick or again <= quota - chosen""".replace("{intent}", sql_intent()))
def stratified_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = train(spark, d).select("id", intent().alias("intent"), (F.size("messages") > 2).alias("has_history"), F.col("meta.selection_score").alias("score"))
    rows = rows.groupBy("id").agg(F.first("intent").alias("intent"), F.first("has_history").alias("has_history"), F.first("score").alias("score"))
    got = selection.stratified_top(rows, "intent", "has_history", "score", T.shuffle_key(11, F.col("id")), quota_allocate(spark, d), 0.3)
    return got.select("id", "intent", "has_history")


SPLIT_SQL = f"""
with rows as (select id, {sql_intent()} as i, coalesce(meta.source_prompt_key, id) as g from sft_train),
 s as (select i, g, count(*) as size, md5('5|' || g) as o from rows group by 1, 2),
 t as (select *, sum(size) over (partition by i) as total, coalesce(sum(size) over (partition by i order by o || chr(124) || g rows between unbounded preceding and 1 preceding), 0) as before from s),
 u as (select *, before < round_even(total * 0.1, 0) as is_test from t),
 v as (select *, coalesce(sum(size) filter (where is_test) over (partition by i), 0) as in_test from u),
 w as (select i, g, case when is_test then 'test' when before - in_test < round_even(total * 0.1, 0) then 'dev' else 'train' end as split from v)
"""


@query(SPLIT_SQL + "select id, i as intent, split from rows join w using (i, g)")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    rows = train(spark, d).select("id", intent().alias("intent"), F.coalesce("meta.source_prompt_key", "id").alias("g"))
    return selection.group_split(rows, "intent", "g", 0.1, 0.1, 5).select("id", "intent", "split")


@query("select doc_id, md5('3|' || doc_id) <= (select max(k) from (select md5('3|' || doc_id) as k from documents order by 1 limit (select greatest(1, least(floor(count(*) * 0.1), count(*) - 1))::bigint from documents))) as is_eval from documents")
def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    return selection.holdout(docs, T.shuffle_key(3, F.col("doc_id")), ratio=0.1)


@query("select 'train_file_holdout' as split_source, (count(*) - greatest(1, least(floor(count(*) * 0.1), count(*) - 1)))::bigint as raw_train_records, greatest(1, least(floor(count(*) * 0.1), count(*) - 1))::bigint as raw_eval_records from documents")
def train_eval_report(spark: SparkSession, d: str) -> DataFrame:
    return selection.train_eval(table(spark, d, "documents").select("doc_id"), None, T.shuffle_key(3, F.col("doc_id")), ratio=0.1)[2]


SHRINK_SQL = f"""
with c as (select {sql_intent()} as name, count(*)::bigint as n from eval_test group by 1), p as (select (select sum(n) from c) as total, ((select sum(n) from c) * 2 // 3)::bigint as target),
 b as (select name, n, least(4, n) as low, target, round_even(least(greatest(target::double * n / total, least(4, n)::double), n::double), 0)::bigint as base from c, p),
 e as (select *, sum(base) over () - target as excess, greatest(0, base - low) as surplus from b),
 k as (select *, case when excess > 0 and surplus > 0 then least(greatest(1, round_even(excess * surplus / greatest(sum(surplus) over (), 1)::double, 0)::bigint), surplus) else 0 end as want from e),
 l as (select *, least(want, greatest(0, excess - coalesce(sum(want) over (order by surplus desc, name rows between unbounded preceding and 1 preceding), 0))) as cut from k),
 m as (select *, greatest(0, excess - sum(cut) over ()) as rest, surplus - cut as more from l),
 o as (select *, cut + case when excess > 0 and more > 0 and row_number() over (order by more desc, name) <= rest then 1 else 0 end as cut2, n - base as room from m)
select name, (base - cut2 + case when excess < 0 then greatest(0, least(room, -excess - coalesce(sum(room) over (order by room desc, name rows between unbounded preceding and 1 preceding), 0))) else 0 end)::bigint as quota from o
"""


def shrink(spark: SparkSession, d: str) -> DataFrame:
    counts = intent_counts(spark, d, "eval_test")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return selection.shrink_targets(counts, "name", "n", total * 2 // 3, 4)


@query(SHRINK_SQL)
def shrink_eval(spark: SparkSession, d: str) -> DataFrame:
    return shrink(spark, d)


@query(f"""
with q as ({SHRINK_SQL}), rows as (select id, {sql_intent()} as i, md5('9|' || id || '|' || strftime(ingested_at, '%Y-%m-%d %H:%M:%S')) as o from eval_test),
 r as (select *, row_number() over (partition by i order by o) as k from rows)
select id, i as intent, k <= coalesce(quota, 0) as kept from r left join q on i = name""")
def keep_and_transfer(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_test").select("id", intent().alias("intent"), T.shuffle_key(9, F.col("id"), F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss")).alias("o"))
    return selection.keep_per_class(rows, "intent", shrink(spark, d), F.col("o")).select("id", "intent", "kept")


@query(f"""
with q as ({SHRINK_SQL}), rows as (select id, {sql_intent()} as i, id || '|' || strftime(ingested_at, '%Y-%m-%d %H:%M:%S') as o from eval_test),
 r as (select *, row_number() over (partition by i order by md5('9|' || o)) as k from rows),
 d as (select id, i, o, k <= coalesce(quota, 0) as kept from r left join q on i = name),
 e as (select round_even((select count(*) from d where not kept) * ((select count(*) from sft_train)::double / ((select count(*) from sft_train) + (select count(*) from sft_dev))), 0) as edge)
select id, i as intent, case when kept then 'eval' when row_number() over (partition by kept order by md5('10|' || o)) <= edge then 'train' else 'dev' end as split from d, e""")
def transfer_split(spark: SparkSession, d: str) -> DataFrame:
    """Where every row of the shrunk evaluation split goes: it stays, or moves to train or dev."""
    day = F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss")
    rows = table(spark, d, "eval_test").select("id", intent().alias("intent"), T.shuffle_key(9, F.col("id"), day).alias("o"), T.shuffle_key(10, F.col("id"), day).alias("move"))
    rows = selection.keep_per_class(rows, "intent", shrink(spark, d), F.col("o"))
    moved = selection.transfer_split(rows.filter(~F.col("kept")), table(spark, d, "sft_train"), table(spark, d, "sft_dev"), F.col("move"))
    return rows.filter("kept").select("id", "intent", F.lit("eval").alias("split")).unionByName(moved.select("id", "intent", "split"))


@query(f"""
with pool as (select id, any_value(i) as i, any_value(s) as s from (select id, {sql_intent()} as i, meta.selection_score as s from sft_train) group by id),
 cur as (select {sql_intent()} as name, count(*)::bigint as n from sft_dev group by 1),
 need as (select scenario as name, greatest(0, 40 - coalesce(n, 0)) as need from scenario_targets left join cur on scenario = name),
 r as (select id, i, s, need, row_number() over (partition by i order by s desc, id) as k from pool join need on i = name where need > 0)
select id, i as intent from r where k <= need""")
def augment_topk(spark: SparkSession, d: str) -> DataFrame:
    pool = train(spark, d).select("id", intent().alias("intent"), F.col("meta.selection_score").alias("s")).groupBy("id").agg(F.first("intent").alias("intent"), F.first("s").alias("s"))
    targets = table(spark, d, "scenario_targets").select(F.col("scenario").alias("name"), F.lit(40).alias("target"))
    return selection.augment(pool, intent_counts(spark, d, "sft_dev"), targets, "intent", "s", F.col("id")).select("id", "intent")


@query("""
with s as (select source, count(*) as size from documents group by 1), t as (select source, least(size, greatest(15, round_even(300.0::double * size / sum(size) over (), 0))) as take from s),
 r as (select doc_id, source, md5('21|' || doc_id) as o, row_number() over (partition by source order by md5('21|' || doc_id)) as k from documents)
select doc_id, source from r join t using (source) where k <= take order by o limit 300""")
def proportional_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    return selection.proportional(docs, "source", 300, 15, T.shuffle_key(21, F.col("doc_id"))).select("doc_id", "source")


@query("select doc_id, source from documents qualify row_number() over (partition by source order by md5('1|' || doc_id)) <= 5")
def review_sample(spark: SparkSession, d: str) -> DataFrame:
    return selection.review_sample(table(spark, d, "documents").select("doc_id", "source"), "source", 5, T.shuffle_key(1, F.col("doc_id")))


@query("select doc_id, md5('2|' || doc_id) as position from documents")
def seeded_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.shuffle_key(2, F.col("doc_id")).alias("position")).orderBy("position")


# -- joins and sets -------------------------------------------------------------------------------
@query("select id, error_type from dpo_preference_pairs where id not in (select id from sft_train)")
def anti_join_ids(spark: SparkSession, d: str) -> DataFrame:
    return joins.without_ids(table(spark, d, "dpo_preference_pairs").select("id", "error_type"), train(spark, d))


@query("select id, shop_id from sft_dev union all select id, shop_id from eval_test where id not in (select id from sft_dev)")
def merge_new_ids(spark: SparkSession, d: str) -> DataFrame:
    return joins.merge_new(table(spark, d, "sft_dev").select("id", "shop_id"), table(spark, d, "eval_test").select("id", "shop_id"))


@query("""
with x as (select id, prompt, substr(prompt, 1, 12) as h, error_type, ingested_at from dpo_preference_pairs where error_type is not null and prompt is not null)
select id, prompt from x where h not in (select substr(prompt, 1, 12) from dpo_preference_pairs where error_type is null and prompt is not null)
qualify row_number() over (partition by h order by error_type, id, ingested_at) = 1""")
def prefix_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dpo_preference_pairs").filter("prompt is not null")
    got = joins.prefix_dedup(rows.filter("error_type is not null"), rows.filter("error_type is null"), "prompt", 12, [F.col("error_type"), F.col("id"), F.col("ingested_at")])
    return got.select("id", "prompt")


@query(f"""
with a as (select id as k, {sql_intent()} as scenario from {FIRST.format(t='eval_test')}), b as (select id as k2, {sql_intent()} as scenario2 from {FIRST.format(t='eval_test')})
select g.id, coalesce(a.scenario, case when a.k is null then b.scenario2 end) as expected, case when a.k is not null then 1 when b.k2 is not null then 2 end as matched_by
from post_train_test_generations g left join a on g.id = a.k left join b on g.source_record.id = b.k2""")
def two_key_join(spark: SparkSession, d: str) -> DataFrame:
    right = latest(spark, d, "eval_test", intent().alias("expected")).select("id", "expected")
    left = table(spark, d, "post_train_test_generations").select("id", F.col("source_record.id").alias("other"))
    return joins.two_key_lookup(left, right, F.col("id"), F.col("other"), "id", ["expected"]).select("id", "expected", "matched_by")


@query(f"select id, length(chosen)::bigint as chosen_length, length(rejected)::bigint as rejected_length from {FIRST.format(t='dpo_preference_pairs')}")
def model_compare(spark: SparkSession, d: str) -> DataFrame:
    rows = latest(spark, d, "dpo_preference_pairs", "chosen", "rejected").select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("run"), F.col(n).alias("reply")) for n in ("chosen", "rejected")])).alias("x")).select("id", "x.*")
    wide = joins.compare(rows, "id", "run", ["reply"], ["chosen", "rejected"])
    return wide.select("id", F.length("chosen.reply").cast("long").alias("chosen_length"), F.length("rejected.reply").cast("long").alias("rejected_length"))


@query("""
with a as (select scenario, row_number() over (order by scenario) as o from scenario_targets), b as (select source, row_number() over (order by source) as o from mix_targets)
select o::int as ordinal, scenario, source from a join b using (o)""")
def positional_join(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "scenario_targets").select("scenario"), table(spark, d, "mix_targets").select("source")
    return joins.positional(a, b, ["scenario"], ["source"]).select("ordinal", "scenario", "source")


_OVER = [(1, 0.5), (7, 0.25), (30, 0.75)]


@query(f"""
with rows as (select id, {sql_intent()} as s, row_number() over (order by id) as i from {FIRST.format(t='sft_dev')}), o(i, share) as (values {', '.join(map(str, _OVER))}),
 dflt as (select target_share, min_rows from scenario_targets where scenario = '闲聊-礼貌收尾')
select id, coalesce(o.share, t.target_share, dflt.target_share)::double as target_share, coalesce(t.min_rows, dflt.min_rows)::int as min_rows
from rows left join scenario_targets t on s = t.scenario left join o using (i), dflt""")
def rule_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = joins.ordinal(latest(spark, d, "sft_dev", intent().alias("scenario")).select("id", "scenario"), ["id"], "i")
    over = spark.createDataFrame([(i, s, None) for i, s in _OVER], "i int, target_share double, min_rows int")
    return joins.rule_lookup(rows, table(spark, d, "scenario_targets"), over, "scenario", "i", "闲聊-礼貌收尾", ["target_share", "min_rows"]).select("id", "target_share", "min_rows")


@query("""
select m.source, coalesce(n, 0)::bigint as docs_n, coalesce(chars, 0)::bigint as docs_chars, coalesce(zh, 0)::bigint as langs_zh
from mix_targets m left join (select source, count(*) as n, sum(length(text)) as chars from documents group by 1) a using (source)
left join (select source, count(*) as zh from documents where lang = 'zh' group by 1) b using (source)""")
def summary_star(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    sides = {
        "docs": docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars")),
        "langs": docs.filter("lang = 'zh'").groupBy("source").agg(F.count(F.lit(1)).alias("zh")),
    }
    base = table(spark, d, "mix_targets").select("source")
    return joins.star(base, sides, "source", {"docs_n": 0, "docs_chars": 0, "langs_zh": 0})


@query("select id, len(coalesce(messages, []))::bigint as n, meta.scenario as scenario, false as rewritten, 'source_fallback' as finalize_source from sft_dev")
def source_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = records.fallback(table(spark, d, "sft_dev"))
    return rows.select("id", F.size("messages").cast("long").alias("n"), "meta.scenario", "meta.rewritten", "meta.finalize_source")


@query("select shop_id from sft_train except select shop_id from documents")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return train(spark, d).select("shop_id").subtract(table(spark, d, "documents").select("shop_id"))


@query("select id, len(list_intersect(coalesce(meta.quality_flags, []), ['has_history', 'short_reply_rewrite']))::bigint as n from sft_train")
def flag_intersection(spark: SparkSession, d: str) -> DataFrame:
    flags = F.coalesce("meta.quality_flags", F.array().cast("array<string>"))
    return train(spark, d).select("id", F.size(F.array_intersect(flags, F.array(F.lit("has_history"), F.lit("short_reply_rewrite")))).cast("long").alias("n"))


@query("select id from post_train_test_generations where id not in (select id from judge_results)")
def resume_unjudged(spark: SparkSession, d: str) -> DataFrame:
    return joins.resume(table(spark, d, "post_train_test_generations").select("id"), table(spark, d, "judge_results"))


# -- dialogue -------------------------------------------------------------------------------------
FOLD_SQL = f"""
with r as (select row_number() over () as rid, id, messages from sft_train), m as (select rid, id, unnest(messages) as m, unnest(range(1, len(messages) + 1)) as pos from r),
 k as (select rid, id, pos, m.role as role, {sql_strip("coalesce(m.content, '')")} as content from m where m.role in ('user', 'assistant') and {sql_strip("coalesce(m.content, '')")} <> ''),
 g as (select *, case when role = lag(role) over w then 0 else 1 end as fresh from k window w as (partition by rid order by pos)),
 i as (select *, sum(fresh) over (partition by rid order by pos) as isle from g),
 f as (select rid, id, isle, first(role order by pos) as role, string_agg(content, chr(10) order by pos) as content from i group by all),
 n as (select *, max(isle) over (partition by rid) as last_isle from f),
 t as (select * from n where not (isle = 1 and role = 'assistant') and not (isle = last_isle and role = 'user')),
 u as (select rid, id, count(*) as n, string_agg('[' || role || '] ' || content, chr(10) order by isle) as text from t group by all having count(*) >= 2)
"""


@query(FOLD_SQL + "select r.id, coalesce(u.n, 0)::bigint as n, coalesce(u.text, '') as text from r left join u using (rid)")
def normalize_messages(spark: SparkSession, d: str) -> DataFrame:
    m = M.normalized(F.col("messages"))
    return train(spark, d).select("id", m.alias("m")).select("id", F.size("m").cast("long").alias("n"), dialogue.rendered(F.col("m")).alias("text"))


@query(FOLD_SQL + "select r.id, coalesce(u.n, 0)::bigint as n, coalesce(u.text, '') as text from r left join u using (rid)")
def message_variants(spark: SparkSession, d: str) -> DataFrame:
    """The same messages told as conversations with from and value in a third of the records, as history,
    prompt and response in another; read back from whichever form a record has."""
    rows = train(spark, d).select("id", M.normalized(F.col("messages")).alias("m")).withColumn("kind", F.pmod(F.xxhash64("id"), F.lit(3)))
    pairs_of = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("m") / 2).cast("int") - 2, F.lit(0))), lambda i: F.array(F.get("m", 2 * i)["content"], F.get("m", 2 * i + 1)["content"]))
    told = rows.select(
        "id",
        F.when(F.col("kind") == 0, F.col("m")).alias("messages"),
        F.when(F.col("kind") == 1, F.transform("m", lambda x: F.struct(F.when(x["role"] == M.USER, "human").otherwise("gpt").alias("from"), x["content"].alias("value")))).alias("conversations"),
        F.when((F.col("kind") == 2) & (F.size("m") > 2), pairs_of).alias("history"),
        F.when(F.col("kind") == 2, F.try_element_at("m", F.lit(-2))["content"]).alias("prompt"),
        F.when(F.col("kind") == 2, F.try_element_at("m", F.lit(-1))["content"]).alias("response"),
    )
    m = M.normalized(M.of_record(told.schema))
    return told.select("id", m.alias("m")).select("id", F.size("m").cast("long").alias("n"), dialogue.rendered(F.col("m")).alias("text"))


_PAST_SQL = f"list_filter(coalesce(history, []), lambda p: len(p) = 2 and {sql_strip("coalesce(p[1], '')")} <> '' and {sql_strip("coalesce(p[2], '')")} <> '')"


@query(f"""with x as (select id, {_PAST_SQL} as h, {sql_strip("coalesce(prompt, '')")} as p, {sql_strip("coalesce(generated_reply, '')")} as r from post_train_test_generations)
select id, case when p = '' or r = '' then '' else array_to_string(list_concat(list_transform(h, lambda q: '[user] ' || {sql_strip('q[1]')} || chr(10) || '[assistant] ' || {sql_strip('q[2]')}), ['[user] ' || p, '[assistant] ' || r]), chr(10)) end as text from x""")
def history_messages(spark: SparkSession, d: str) -> DataFrame:
    m = M.from_history(F.col("history"), F.col("prompt"), F.col("generated_reply"))
    return table(spark, d, "post_train_test_generations").select("id", dialogue.rendered(m).alias("text"))


_USER_SQL = "'<|im_start|>user' || chr(10) || {} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"


@query(f"""with x as (select id, {_PAST_SQL} as h, {sql_strip("coalesce(prompt, '')")} as p from post_train_test_generations)
select id, case when len(h) > 0 or p <> '' then '<|im_start|>system' || chr(10) || 'S' || '<|im_end|>' || chr(10) else '' end
 || array_to_string(list_transform(h, lambda q: {_USER_SQL.format(sql_strip('q[1]'))} || {sql_strip('q[2]')} || '<|im_end|>' || chr(10)), '') || case when p = '' then '' else {_USER_SQL.format('p')} end as text from x""")
def record_prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "post_train_test_generations").select("id", "history", "prompt")
    return rows.select("id", M.record_prompt(rows.schema, "S").alias("text"))


def _join_sql(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda m: '[' || coalesce(m.role, '') || '] ' || coalesce(m.content, '')), chr(10))"


@query(f"select id, {_join_sql('case when len(messages) <= 2 then messages else list_slice(messages, greatest(1, len(messages) - 3), len(messages)) end')} as text from sft_train")
def trim_history(spark: SparkSession, d: str) -> DataFrame:
    return train(spark, d).select("id", dialogue.rendered(M.trim_turns(F.col("messages"), 1)).alias("text"))


@query(f"""
with r as (select id, messages, unnest(range(1, len(messages) + 1)) as pos from {FIRST.format(t='sft_train')})
select id, (pos - 1)::int as turn, messages[pos].content as target, {_join_sql('list_slice(messages, greatest(1, pos - 3), pos - 1)')} as context
from r where messages[pos].role = 'assistant' and len(list_filter(list_slice(messages, 1, pos - 1), lambda m: m.role = 'user')) > 0""")
def expand_turns(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.expand_turns(latest(spark, d, "sft_train", "messages"), ["id"], "messages", 1).select("id", "turn", "target", dialogue.rendered(F.col("context")).alias("context"))


@query("select id, unnest(range(0, len(messages)))::int as turn, unnest(list_transform(messages, lambda m: m.role)) as role, unnest(list_transform(messages, lambda m: length(m.content)))::bigint as n from eval_test")
def message_turns(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.to_turns(table(spark, d, "eval_test"), ["id"], "messages").select("id", "turn", "role", F.length("text").cast("long").alias("n"))


@query("select id, coalesce(nullif(prompt, ''), list_filter(messages, lambda m: m.role = 'user')[-1].content) as prompt from dpo_preference_pairs")
def last_user_prompt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dpo_preference_pairs").select("id", pairs.prompt_or_last_user(F.col("prompt"), F.col("messages")).alias("prompt"))


_SEG = "'<|im_start|>user' || chr(10) || messages[2 * i - 1].content || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || messages[2 * i].content || '<|im_end|>' || chr(10)"


@query(f"select id, '<|im_start|>system' || chr(10) || 'S' || '<|im_end|>' || chr(10) || array_to_string(list_transform(range(1, len(messages) // 2 + 1), lambda i: {_SEG}), '') as text from sft_train")
def chatml_render(spark: SparkSession, d: str) -> DataFrame:
    t = M.turns(F.col("messages"), F.lit("S"))
    return train(spark, d).select("id", F.array_join(F.transform(t, lambda x: F.concat(x["source"], x["target"])), "").alias("text"))


@query("""select id, array_to_string(list_transform(messages, lambda m: '<|im_start|>' || case when m.role = 'user' then 'user' else 'assistant' end || chr(10) || coalesce(m.content, '') || '<|im_end|>' || chr(10)), '')
 || '<|im_start|>assistant' || chr(10) as text from dpo_preference_pairs""")
def two_role_prompt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dpo_preference_pairs").select("id", M.two_role_prompt(F.col("messages")).alias("text"))


@query(f"""
with r as (select id, list_filter(list_transform(messages, lambda m: {{'role': m.role, 'content': {sql_strip("coalesce(m.content, '')")}}}), lambda m: m.content <> '') as ms from sft_train),
 c as (select id, list_slice(ms, 1, len(ms) - list_position(list_reverse(list_transform(ms, lambda m: m.role)), 'user') + 1) as ms from r)
select id, array_to_string(list_transform(ms, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), '') || '<|im_start|>assistant' || chr(10) as text from c""")
def generation_prompt(spark: SparkSession, d: str) -> DataFrame:
    return train(spark, d).select("id", M.generation_prompt(M.for_generation(F.col("messages")), F.lit(None).cast("string")).alias("text"))


_LIMIT = 400
_TOTAL = "list_sum(list_transform(range(1, len(messages) // 2 + 1), lambda i: length(" + _SEG + ")))"


@query(f"""with x as (select coalesce({_TOTAL}, 0) as n from sft_train)
select count(*)::bigint as total, count(*) filter (where n > 0)::bigint as usable, count(*) filter (where n = 0)::bigint as skipped, count(*) filter (where n > {_LIMIT})::bigint as truncated, coalesce(max(least(n, {_LIMIT})), 0)::bigint as max_length from x""")
def token_mask_stats(spark: SparkSession, d: str) -> DataFrame:
    t = M.masked_tokens(M.turns(F.col("messages"), F.lit(None).cast("string")), _LIMIT)
    return metrics.token_stats(train(spark, d).select(t.alias("t")), "t")


@query(f"""with x as (select id, length(coalesce(prompt, ''))::int as s, length(coalesce(chosen, ''))::int as t from dpo_preference_pairs)
select id, (case when s + t <= 120 then s when t >= 120 then 0 else 120 - t end)::int as source, (case when s + t <= 120 then t when t >= 120 then 120 else t end)::int as target from x""")
def length_budget(spark: SparkSession, d: str) -> DataFrame:
    b = M.budget(F.length(T.text_or_empty(F.col("prompt"))), F.length(T.text_or_empty(F.col("chosen"))), F.lit(120))
    return table(spark, d, "dpo_preference_pairs").select("id", b.alias("b")).select("id", "b.source", "b.target")


@query("""with x as (select id, scenario, length(prompt) as n from dpo_preference_pairs where prompt is not null)
select id, max(n) over (partition by scenario)::bigint as width, n::bigint as own from x""")
def pad_widths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dpo_preference_pairs").filter("prompt is not null").select("id", "scenario", M.codes(F.col("prompt")).alias("ids"))
    padded = dialogue.pad_batches(rows.withColumn("labels", F.col("ids")), "scenario", "ids", "labels")
    return padded.select("id", F.size("padded_labels").cast("long").alias("width"), F.aggregate("mask", F.lit(0), lambda s, x: s + x).cast("long").alias("own"))


@query(f"""with r as (select row_number() over () as rid, id, messages from sft_dev), m as (select rid, unnest(messages) as m, unnest(range(0, len(messages))) as i from r),
 f as (select rid, i, case when coalesce(m.role, '') <> case when i % 2 = 0 then 'user' else 'assistant' end then 'bad_role_at_' || i when {sql_strip("coalesce(m.content, '')")} = '' then 'empty_content_at_' || i end as fault from m)
select id, case when messages is null then 'bad_messages_type' when len(messages) = 0 then 'empty_final_reply' else coalesce((select first(fault order by i) from f where f.rid = r.rid and fault is not null), case when len(messages) % 2 = 1 then 'bad_role_at_' || (len(messages) - 1) end) end as fault from r""")
def role_faults(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sft_dev").select("id", M.role_fault(F.col("messages")).alias("fault"))


@query("""
with r as (select row_number() over () as rid, id, history from post_train_test_generations), p as (select rid, unnest(history) as p, unnest(range(1, len(history) + 1)) as i from r),
 s as (select rid, i * 2 as o, p[1] as t from p union all select rid, i * 2 + 1, p[2] from p)
select id, (select count(*) from s where s.rid = r.rid and coalesce(t, '') <> '')::bigint as n, coalesce((select string_agg(t, '|' order by o) from s where s.rid = r.rid and coalesce(t, '') <> ''), '') as text from r""")
def flat_history(spark: SparkSession, d: str) -> DataFrame:
    m = M.flat_history(F.col("history"))
    return table(spark, d, "post_train_test_generations").select("id", m.alias("m")).select("id", F.size("m").cast("long").alias("n"), F.array_join(F.transform("m", lambda x: x["content"]), "|").alias("text"))


# -- replies and pairs ----------------------------------------------------------------------------
_INTENT_OF = sql_strip(r"regexp_extract(coalesce(generated_response, ''), '分类[:：]\s*(.+?)(?:\n|$)', 1)")
_WHOLE = sql_strip("coalesce(generated_response, '')")
_REPLY_OF = sql_strip(r"regexp_extract(coalesce(generated_response, ''), '(?s)回复[:：]\s*(.+)', 1)")


@query(f"select id, nullif({_INTENT_OF}, '') as intent, nullif({_REPLY_OF}, '') as reply from post_train_test_generations")
def parse_reply(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("generated_response")
    return table(spark, d, "post_train_test_generations").select("id", R.intent_of(c).alias("intent"), R.reply_of(c).alias("reply"))


@query(f"""select id, case when coalesce(generated_intent, '') <> '' then {sql_strip('generated_intent')} else nullif({_INTENT_OF}, '') end as intent,
 case when coalesce(generated_reply, '') <> '' then {sql_strip('generated_reply')} else nullif({_REPLY_OF}, '') end as reply from post_train_test_generations""")
def split_generated(spark: SparkSession, d: str) -> DataFrame:
    s = R.split_generated(F.col("generated_response"), F.col("generated_intent"), F.col("generated_reply"))
    return table(spark, d, "post_train_test_generations").select("id", s.alias("s")).select("id", "s.intent", "s.reply")


@query("select id, case when len(messages) >= 2 then coalesce(messages[-2].content, '') else '' end as user, coalesce(messages[-1].content, '') as assistant from eval_test")
def last_pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_test").select("id", M.last_pair(F.col("messages")).alias("p")).select("id", "p.user", "p.assistant")


@query("select id, to_json(list_transform(list_filter(coalesce(history, []), lambda p: len(p) >= 2), lambda p: {'user': coalesce(p[1], ''), 'assistant': coalesce(p[2], '')}))::varchar as text from post_train_test_generations")
def history_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "post_train_test_generations").select("id", M.history_json(F.col("history")).alias("text"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as int) as k from events")
def lenient_json(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.concat(F.lit("result:\n```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, d, "events").select("event_id", R.lenient_json(wrapped, "k int")["k"].alias("k"))


_EDGES = "[ \\n\\t\"''“”]+"


def sql_clean_reply(x: str) -> str:
    whole = sql_strip(f"coalesce({x}, '')")
    found = sql_strip(f"regexp_extract({whole}, '(?s)回复[:：]\\s*(.+)', 1)")
    one = sql_strip(f"regexp_replace(coalesce(nullif({found}, ''), {whole}), '(?s)^分类[:：].*?(?:\\n|$)', '')")
    two = sql_strip(f"regexp_replace({one}, '^回复[:：]\\s*', '')")
    return f"regexp_replace({two}, '^{_EDGES}|{_EDGES}$', '', 'g')"


_WRAPPED = ("generated_response", "chr(10) || '分类：甲' || chr(10) || coalesce(generated_reply, '')", "'回复：分类：乙' || chr(10) || '回复：“' || coalesce(generated_reply, '') || '”'")


@query("select id, " + ", ".join(f"{sql_clean_reply(x)} as reply{n}" for n, x in enumerate(_WRAPPED)) + " from post_train_test_generations")
def clean_reply(spark: SparkSession, d: str) -> DataFrame:
    """The response as it is, and the reply behind a label line and inside labels and quotes."""
    said = T.text_or_empty(F.col("generated_reply"))
    forms = (F.col("generated_response"), F.concat(F.lit("\n分类：甲\n"), said), F.concat(F.lit("回复：分类：乙\n回复：“"), said, F.lit("”")))
    return table(spark, d, "post_train_test_generations").select("id", *[R.clean_reply(c).alias(f"reply{n}") for n, c in enumerate(forms)])


_DOMAIN = ", ".join(quoted(k) for k in rules.INTENTS)


@query(f"""with r as (select row_number() over () as rid, id, {sql_strip(sql_intent())} as s, messages, {sql_clean_reply('messages[-1].content')} as last from sft_train), m as (select rid, unnest(messages) as m, unnest(range(0, len(messages))) as i from r),
 f as (select rid, first(fault order by i) as fault from (select rid, i, case when coalesce(m.role, '') <> case when i % 2 = 0 then 'user' else 'assistant' end then 'bad_role_at_' || i when {sql_strip("coalesce(m.content, '')")} = '' then 'empty_content_at_' || i end as fault from m) where fault is not null group by rid)
select id, case when s not in ({_DOMAIN}) then 'invalid_scenario:' || s when messages is null then 'bad_messages_type' when len(messages) = 0 then 'empty_final_reply' when fault is not null then fault
 when len(messages) % 2 = 1 then 'bad_role_at_' || (len(messages) - 1) when last = '' then 'empty_final_reply' when regexp_matches(every, '\\[[^\\]]+\\]') then 'placeholder_leak' when regexp_matches(every, '[\\p{{Nd}}]{{8,}}') then 'long_digit_leak' end as fault
 from (select *, array_to_string(list_append(list_transform(list_slice(messages, 1, len(messages) - 1), lambda m: {sql_strip("coalesce(m.content, '')")}), last), chr(10)) as every from r) left join f using (rid)""")
def record_validate(spark: SparkSession, d: str) -> DataFrame:
    return train(spark, d).select("id", rules.record_fault(intent(), F.col("messages"), list(rules.INTENTS)).alias("fault"))


@query(f"select {sql_intent()} as intent, count(*)::bigint as total, count(*) filter (where len(messages) > 2)::bigint as with_history, count(*) filter (where len(messages) <= 2)::bigint as single from sft_train group by 1")
def selection_counts(spark: SparkSession, d: str) -> DataFrame:
    return train(spark, d).groupBy(intent().alias("intent")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("messages") > 2).alias("with_history"), F.count_if(F.size("messages") <= 2).alias("single"))


@query(f"""with x as (select id, coalesce({_TOTAL}, 0) as n, length(messages[-1].content || '<|im_end|>' || chr(10)) as t from sft_dev)
select id, least(n, {_LIMIT})::bigint as n_ids, least(t, {_LIMIT})::bigint as n_labels from x""")
def token_preview(spark: SparkSession, d: str) -> DataFrame:
    """Lengths and visible labels when only the last answer is trained on."""
    t = M.masked_tokens(M.turns(F.col("messages"), F.lit(None).cast("string")), _LIMIT, last_only=True)
    rows = table(spark, d, "sft_dev").select("id", t.alias("t"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return rows.select("id", n(F.col("t.input_ids")).alias("n_ids"), n(F.filter("t.labels", lambda x: x != -100)).alias("n_labels"))


def sql_past(m: str) -> str:
    return f"array_to_string(list_transform(list_slice({m}, 1, len({m}) - 2), lambda m: case when m.role = 'user' then '用户：' else '客服：' end || coalesce(m.content, '')), chr(10))"


_HEADED = f"case when len(messages) > 2 then '历史对话：' || chr(10) || {sql_past('messages')} || chr(10) || chr(10) else '' end"
_ASKED = "case when len(messages) >= 2 then coalesce(messages[-2].content, '') else '' end"


@query(f"select id, {_HEADED} || '场景类别：' || coalesce(meta.scenario, '{rewriting.NO_SCENARIO}') || chr(10) || '客户最后提问：' || {_ASKED} || chr(10) || chr(10) || '{rewriting.WANT_PAIR}' as prompt from sft_dev")
def pair_prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sft_dev").select("id", rewriting.pair_prompt(F.col("messages"), F.col("meta.scenario")).alias("prompt"))


@query(f"""with r as (select id, messages, coalesce(meta.scenario, '{rewriting.NO_SCENARIO}') as s, unnest(['missing_action', 'history_ignored']) as error from sft_dev)
select id, error, '场景类别：' || s || chr(10) || case when error = 'history_ignored' and len(messages) > 2 then chr(10) || '历史对话：' || chr(10) || {sql_past('messages')} || chr(10) else '' end || chr(10) || '用户最后提问：' || {_ASKED} || chr(10)
 || '原始正确回复（' || length(coalesce(messages[-1].content, '')) || '字）：' || coalesce(messages[-1].content, '') || chr(10) || chr(10) || case error when 'missing_action' then '{rewriting.ERRORS['missing_action']}' else '{rewriting.ERRORS['history_ignored']}' end as prompt from r""")
def error_prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sft_dev").select("id", "messages", "meta.scenario", F.explode(F.array(F.lit("missing_action"), F.lit("history_ignored"))).alias("error"))
    return rows.select("id", "error", rewriting.error_prompt(F.col("messages"), F.col("scenario"), F.col("error"), F.col("id")).alias("prompt"))


@query(f"""with a as (select id, messages, meta.scenario as s from {FIRST.format(t='eval_test')})
select g.id, '场景类别：' || coalesce(s, '') || chr(10) || '对话类型：' || case when len(messages) > 2 then '多轮' else '单轮' end || chr(10) || chr(10) || case when len(messages) > 2 then {_HEADED} else '' end
 || '用户最后问题：' || case when len(messages) >= 2 then {_ASKED} else coalesce(g.prompt, '') end || chr(10) || chr(10) || 'AI客服回复：' || coalesce(nullif(g.generated_reply, ''), g.generated_response, '') || chr(10) || chr(10)
 || '人工预期标准：' || coalesce(g.source_record.reference_reply, '') || chr(10) || '关键参考词：' || chr(10) || chr(10) || {quoted(chr(10).join(rewriting.SCORES))} as prompt from post_train_test_generations g left join a on g.id = a.id""")
def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The judge's prompts: generations with the dialogue and the scenario of their evaluation record."""
    known = latest(spark, d, "eval_test", F.col("messages").alias("said"), F.col("meta.scenario").alias("s")).select(F.col("id").alias("key"), "said", "s")
    rows = table(spark, d, "post_train_test_generations").join(known, F.col("id") == F.col("key"), "left")
    prompt = rewriting.judge_prompt(F.col("said"), F.col("prompt"), F.col("generated_reply"), F.col("generated_response"), F.col("s"), F.col("source_record.reference_reply"), F.lit(None))
    return rows.select("id", prompt.alias("prompt"))


@query("""with t as (select id, list_filter(messages, lambda m: m.role = 'user')[-1].content as prompt from sft_train where id not in (select id from sft_dev) and id not in (select id from eval_test))
select distinct id, prompt, md5('13|' || id) as position from t where prompt is not null""")
def training_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts for the preference loops: evaluation ids left out, shuffled by seed."""
    rows = joins.without_ids(joins.without_ids(train(spark, d), table(spark, d, "sft_dev")), table(spark, d, "eval_test"))
    return rows.select("id", M.last_user(F.col("messages")).alias("prompt"), T.shuffle_key(13, F.col("id")).alias("position")).filter("prompt is not null").distinct()


_PAIR = {"c": sql_strip("coalesce(chosen, '')"), "r": sql_strip("coalesce(rejected, '')")}
_FAULT = "case when length(c) < {} then 'chosen_too_short' when length(r) < {} then 'rejected_too_short' when c = r then 'chosen_equals_rejected' when abs(length(c) - length(r)) > {} then '{}' || abs(length(c) - length(r)) end"
_FAULT, _FAULT_AUGMENTED = _FAULT.format(20, 10, 15, "length_gap_too_large:"), _FAULT.format(15, 15, 25, "length_gap_")


@query(f"with x as (select id, {_PAIR['c']} as c, {_PAIR['r']} as r from dpo_preference_pairs) select id, {_FAULT} as fault from x")
def pair_validate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dpo_preference_pairs").select("id", pairs.pair_fault(F.col("chosen"), F.col("rejected")).alias("fault"))


@query(f"with x as (select id, {_PAIR['c']} as c, {_PAIR['r']} as r from dpo_preference_pairs where error_type is not null) select id, {_FAULT_AUGMENTED} as fault from x")
def pair_validate_augmented(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dpo_preference_pairs").filter("error_type is not null")
    return rows.select("id", pairs.pair_fault(F.col("chosen"), F.col("rejected"), 15, 15, 25, "length_gap_").alias("fault"))


@query(f"with x as (select coalesce(error_type, 'too_generic') as error_type, {_PAIR['c']} as c, {_PAIR['r']} as r from dpo_preference_pairs) select error_type, coalesce({_FAULT}, 'accepted') as verdict, count(*)::bigint as n from x group by 1, 2")
def pair_tally(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dpo_preference_pairs")
    return rows.groupBy(F.coalesce("error_type", F.lit("too_generic")).alias("error_type"), F.coalesce(pairs.pair_fault(F.col("chosen"), F.col("rejected")), F.lit("accepted")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with x as (select id, {_PAIR['c']} as c, {_PAIR['r']} as r, coalesce(nullif(prompt, ''), list_filter(messages, lambda m: m.role = 'user')[-1].content, '') as p from dpo_preference_pairs)
select id, p as prompt from x where c <> '' and r <> '' and c <> r and p <> ''""")
def pair_load(spark: SparkSession, d: str) -> DataFrame:
    return pairs.usable(table(spark, d, "dpo_preference_pairs")).select("id", "prompt")


@query("select coalesce(scenario, 'unknown') as scenario, coalesce(error_type, 'too_generic') as error_type, count(*)::bigint as n from dpo_preference_pairs group by 1, 2")
def pair_hist(spark: SparkSession, d: str) -> DataFrame:
    return pairs.typed_counts(table(spark, d, "dpo_preference_pairs"))


@query("select id, error_type, md5('17|' || id) as position from dpo_preference_pairs")
def pair_union_shuffle(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dpo_preference_pairs")
    return pairs.union_shuffled(rows.filter("error_type is null").select("id"), rows.filter("error_type is not null").select("id", "error_type"), 17).select("id", "error_type", "position")


# -- metrics --------------------------------------------------------------------------------------
_METRICS = """count(*)::bigint as total, count(*) filter (where passed)::bigint as n_passed, 100.0::double * count(*) filter (where passed) / count(*) as pass_rate,
 100.0::double * count(*) filter (where need >= 3) / count(*) as auto_rate, 100.0::double * count(*) filter (where accurate >= 3) / count(*) as accuracy, """ + ", ".join(
    f"coalesce(avg({x}), 0)::double as mean_{x}" for x in metrics.DIMENSIONS
)


@query(f"select {_METRICS} from judge_results")
def judge_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.judge_metrics(table(spark, d, "judge_results"))


@query(f"select coalesce(scenario, 'unknown') as scenario, {_METRICS} from judge_results group by 1")
def judge_by_scenario(spark: SparkSession, d: str) -> DataFrame:
    return metrics.judge_metrics(table(spark, d, "judge_results"), "scenario")


@query("select s as scenario, count(*)::bigint as total, count(*) filter (where passed)::bigint as n_passed, grouping(s)::int as is_total from (select coalesce(scenario, 'unknown') as s, passed from judge_results) group by rollup (s)")
def judge_rollup(spark: SparkSession, d: str) -> DataFrame:
    return metrics.judge_rollup(table(spark, d, "judge_results"), "scenario")


@query("select fail_tag, count(*)::bigint as n from judge_results where fail_tag is not null and fail_tag not in ('null', '') group by 1")
def tag_hist(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(metrics.tags(table(spark, d, "judge_results")), "fail_tag", F.col("judged_at"))


@query("""with c as (select coalesce(scenario, 'unknown') as scenario, fail_tag, count(*) as n from judge_results where fail_tag is not null and fail_tag not in ('null', '') group by 1, 2),
 r as (select *, row_number() over (partition by scenario order by n desc, fail_tag) as k from c)
select scenario, string_agg(fail_tag || ':' || n, ', ' order by k) as top from r where k <= 3 group by 1""")
def top_tags(spark: SparkSession, d: str) -> DataFrame:
    return metrics.top_tags(table(spark, d, "judge_results"), "scenario")


@query("""
select 'total' as kind, '' as name, count(*)::bigint as n from sft_train having count(*) > 0
union all select 'label', coalesce(meta.intent, 'unknown'), count(*) from sft_train group by 2
union all select 'turns', coalesce(meta.history_turns, 0)::varchar, count(*) from sft_train group by 2
union all select 'flag', f, count(*) from (select unnest(meta.quality_flags) as f from sft_train) group by 2""")
def row_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = train(spark, d).select(F.col("meta.intent").alias("label"), F.col("meta.quality_flags").alias("flags"), F.col("meta.history_turns").alias("turns"))
    return metrics.row_summary(rows, "label", "flags", "turns")


@query(f"""select split, i as intent, count(*)::bigint as n from (select 'sft_train' as split, {sql_intent()} as i from sft_train union all select 'sft_dev', {sql_intent()} from sft_dev union all select 'eval_test', {sql_intent()} from eval_test)
group by rollup (split, i)""")
def split_distribution(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, n).select(F.lit(n).alias("split"), intent().alias("intent")) for n in ("sft_train", "sft_dev", "eval_test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).rollup("split", "intent").agg(F.count(F.lit(1)).alias("n"))


@query("select event_id as step, 'value' as metric, value from events where value is not null union all select event_id, 'user_id', user_id::double from events where user_id is not null")
def metric_points(spark: SparkSession, d: str) -> DataFrame:
    return metrics.metric_points(table(spark, d, "events"), "event_id", ["value", "user_id"])


@query("select event_id, round(exp(value), 4) as perplexity from events where value < 20")
def perplexity_points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("value < 20").select("event_id", F.round(N.perplexity(F.col("value")), 4).alias("perplexity"))


@query("select event_id, max(value) over (partition by event_type, user_id order by ts, event_id rows unbounded preceding) as peak from events")
def running_peak(spark: SparkSession, d: str) -> DataFrame:
    return metrics.running_peak(table(spark, d, "events"), "value", ["ts", "event_id"], ["event_type", "user_id"]).select("event_id", "peak")


@query("select time_bucket(interval 10 minutes, ts) as window_start, event_type, count(*)::bigint as n, round(sum(value), 4) as value_sum from events group by 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "events").groupBy(F.window("ts", "10 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value_sum"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n", "value_sum")


# -- numbers of the training loops ----------------------------------------------------------------
_REWARD = "case when coalesce(need, accurate, helpful, tone, risk) is null then 0 else (" + " + ".join(f"coalesce(nullif({x}, 0), 3)" for x in metrics.DIMENSIONS[:5]) + " - 15) / 5.0::double end"


@query(f"select id, ({_REWARD})::double as reward from judge_results")
def judge_reward(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "judge_results").select("id", N.judge_reward(*[F.col(x) for x in metrics.DIMENSIONS[:5]]).alias("reward"))


@query(f"""with x as (select id, judged_at, coalesce(scenario, 'unknown') as s, ({_REWARD})::double as r from judge_results)
select id, round((r - avg(r) over (partition by s)) / (stddev_pop(r) over (partition by s) + 1e-8) + 0.0, 5) as advantage from x""")
def group_advantage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "judge_results").select("id", F.coalesce("scenario", F.lit("unknown")).alias("s"), N.judge_reward(*[F.col(x) for x in metrics.DIMENSIONS[:5]]).alias("r"))
    return metrics.group_advantage(rows, "r", "s").select("id", F.round(F.col("advantage") + 0.0, 5).alias("advantage"))


@query("""with x as (select event_id, exp((value - 10) / 20) as ratio, (event_id % 7 - 3)::double as a from events)
select event_id, round(-least(ratio * a, greatest(0.8::double, least(1.2::double, ratio)) * a), 6) + 0.0 as loss from x""")
def clipped_objective(spark: SparkSession, d: str) -> DataFrame:
    ratio, a = F.exp((F.col("value") - 10) / 20), (F.col("event_id") % 7 - 3).cast("double")
    return table(spark, d, "events").select("event_id", (F.round(N.clipped_objective(ratio, a), 6) + 0.0).alias("loss"))


@query("select vec_id, round(list_sum(list_transform(list_slice(embedding, 4, len(embedding)), lambda x: x::double)) / greatest(1, len(embedding) - 3), 6) + 0.0 as mean from embeddings")
def masked_mean(spark: SparkSession, d: str) -> DataFrame:
    values = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", (F.round(N.masked_mean(values, F.lit(3)), 6) + 0.0).alias("mean"))


@query("select id, round(ln(1 + exp(-0.1 * (length(chosen) - length(rejected)))), 6) as loss from dpo_preference_pairs where chosen is not null and rejected is not null")
def preference_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dpo_preference_pairs").filter("chosen is not null and rejected is not null")
    return rows.select("id", F.round(N.preference_loss(F.length("chosen").cast("double"), F.length("rejected").cast("double")), 6).alias("loss"))


@query("select event_type, count(*)::bigint as n, round(avg(value), 6) as mean_value from events group by 1")
def step_metrics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("select event_id, round(-(value * (event_id % 7 - 3)) / 20.0::double, 6) + 0.0 as loss from events")
def advantage_loss(spark: SparkSession, d: str) -> DataFrame:
    loss = N.advantage_loss(F.col("value"), (F.col("event_id") % 7 - 3).cast("double"), F.lit(20.0))
    return table(spark, d, "events").select("event_id", (F.round(loss, 6) + 0.0).alias("loss"))


@query("select id, round(try_cast(shop_id as double), 4) as shop, round(try_cast(need::varchar as double) / 7, 4) as need from (select id, fail_tag as shop_id, need from judge_results)")
def numbers_or_null(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "judge_results").select("id", T.number_or_null(F.col("fail_tag")).alias("shop"), F.round(T.number_or_null(F.col("need").cast("string")) / 7, 4).alias("need"))


@query("select source, count(*)::bigint as n, greatest(1, least(floor(count(*) * 0.1)::bigint, count(*) - 1))::bigint as held from documents group by 1")
def holdout_sizes(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("source", "n", selection.holdout_size(F.col("n"), 0.1).alias("held"))


_FIRST = list(rules.INTENTS)[:5]


@query(f"select scenario, coalesce(nullif(list_position([{', '.join(map(quoted, _FIRST))}], scenario), 0), 99)::int as place from scenario_targets")
def category_places(spark: SparkSession, d: str) -> DataFrame:
    """Categories in a fixed order, unknown ones last."""
    place = selection.category_order(F.col("scenario"), _FIRST).cast("int")
    return table(spark, d, "scenario_targets").select("scenario", place.alias("place"))


# -- annotation and reports -----------------------------------------------------------------------
def sheets(spark: SparkSession, d: str) -> DataFrame:
    """(intent, number, value): the sections of the sheet of each scenario of the development split."""
    rows = latest(spark, d, "sft_dev", intent().alias("intent"), "messages").select("id", "intent", "messages")
    rows = joins.ordinal_in(rows, "intent", ["id"], "number")
    body = annotation.section(F.col("number"), F.col("intent"), F.col("id"), dialogue.rendered(F.col("messages")), F.array(F.lit("a"), F.col("intent")), F.array().cast("array<string>"))
    return rows.select("intent", "number", body.alias("value"))


@query(f"""with x as (select id, {sql_intent()} as intent, messages from {FIRST.format(t='sft_dev')}), n as (select *, row_number() over (partition by intent order by id) as number from x)
select number::int as number, intent, id as label, {_join_sql('messages')} as dialogue, 2::bigint as n_must, 0::bigint as n_avoid from n""")
def annotation_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    got = annotation.parse_sheet(sheets(spark, d))
    return got.select("number", "intent", "label", "dialogue", F.size("must").cast("long").alias("n_must"), F.size("avoid").cast("long").alias("n_avoid"))


@query("select (2 * count(distinct id))::bigint as filled, (4 * count(distinct id))::bigint as empty from sft_dev")
def checklist_counts(spark: SparkSession, d: str) -> DataFrame:
    return annotation.checklist_counts(sheets(spark, d))


@query("""select '# sources' || chr(10) || chr(10) || string_agg('- ' || source || ': ' || n, chr(10) order by n desc, source) as value from (select source, count(*) as n from documents where source is not null group by 1)""")
def source_report(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "documents").filter("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return annotation.report(counts, [-F.col("n"), F.col("source")], F.concat(F.lit("- "), F.col("source"), F.lit(": "), F.col("n").cast("string")), "sources")


@query("""with m as (select coalesce(scenario, 'unknown') as s, count(*) as n, count(*) filter (where passed) as k from judge_results group by 1)
select 0 as part, unnest(['# judge', '', '| scenario | total | passed |', '| --- | --- | --- |']) as line union all select 1, '| ' || s || ' | ' || n || ' | ' || k || ' |' from m""")
def judge_report(spark: SparkSession, d: str) -> DataFrame:
    """The judge's table by scenario as lines of Markdown."""
    rows = metrics.judge_metrics(table(spark, d, "judge_results"), "scenario")
    return reports.table_lines(rows, {"scenario": F.col("scenario"), "total": F.col("total"), "passed": F.col("n_passed")}, [-F.col("total"), F.col("scenario")], "judge")


@query("""select id, '## ' || id || chr(10) || chr(10) || array_to_string(list_filter(['- **tag**: ' || nullif(fail_tag, ''), '- **explanation**: ' || nullif(explanation, '')], lambda x: x is not null), chr(10)) as line from judge_results where not coalesce(passed, false)""")
def failed_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "judge_results").filter(~F.coalesce("passed", F.lit(False)))
    return reports.section_lines(rows, F.col("id"), {"tag": F.col("fail_tag"), "explanation": F.col("explanation")}).select("id", "line")


@query(_quality_sql("""select id, '## ' || id || ' | ' || reason || ' | ' || label || chr(10) || chr(10) || '```text' || chr(10) || '[用户] ' || p || chr(10) || '[客服] ' || r || chr(10) || '```' || chr(10) as line
 from (select distinct id, reason, label, p, r from flagged where reason is not null) order by md5('19|' || id || '|' || p || '|' || r) limit 20"""))
def removed_sample(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a sample of the rows that the quality gate removes."""
    rows = judged(spark, d).filter("q.reason is not null").select("id", "q.reason", "hit.label", T.text_or_empty(F.col("p")).alias("p"), T.text_or_empty(F.col("r")).alias("r")).distinct()
    rows = rows.orderBy(T.shuffle_key(19, F.col("id"), F.col("p"), F.col("r"))).limit(20)
    said = F.concat(F.lit("\n\n```text\n[用户] "), F.col("p"), F.lit("\n[客服] "), F.col("r"), F.lit("\n```\n"))
    return rows.select("id", F.concat(F.lit("## "), F.concat_ws(" | ", "id", "reason", "label"), said).alias("line"))


# -- flagship -------------------------------------------------------------------------------------
@query(f"""
with r as (select id, messages, unnest(range(1, len(messages) + 1)) as pos from {FIRST.format(t='sft_train')}),
 s as (select id, pos, {sql_clean('messages[pos].content')} as target, least(pos - 1, 5)::int as n_context from r where messages[pos].role = 'assistant' and pos > 1),
 k as (select *, {sql_key('target')} as key from s),
 f as (select * from k qualify row_number() over (partition by key order by id, pos) = 1)
select n_context, count(*)::bigint as n_samples, sum(length(target))::bigint as n_chars from f group by 1""")
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    """Records to samples: expand turns, clean targets, keep the first of each key, summarise by context."""
    samples = dialogue.expand_turns(latest(spark, d, "sft_train", "messages"), ["id"], "messages", 2)
    rows = samples.select("id", "turn", F.size("context").alias("n_context"), T.clean(F.col("target")).alias("target"))
    rows = rows.withColumn("key", T.loose_key(F.col("target")))
    # 128 bits of hash stand for the key
    first = rows.groupBy(F.xxhash64("key"), F.xxhash64(F.lit(1), "key")).agg(F.min_by(F.struct("n_context", F.length("target").alias("n")), F.struct("id", "turn")).alias("x"))
    return first.groupBy("x.n_context").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("x.n").cast("long").alias("n_chars"))
