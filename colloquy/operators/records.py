"""Source records: raw prompt, response and history to a classified record with keys and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions import text as T
from . import rules


def history_text(pairs: Column, last: int = 2) -> Column:
    """The last pairs of (user, assistant) structs as one text, for the classifier."""
    tail = F.slice(pairs, F.greatest(F.lit(1), F.size(pairs) - last + 1), last)
    return F.array_join(F.transform(tail, lambda p: F.concat_ws(" ", p["user"], p["assistant"])), " ")


def fallback(df: DataFrame) -> DataFrame:
    """Source records that were not rewritten as training records: (id, messages, meta), marked as such."""
    marked = F.col("meta").withField("rewritten", F.lit(False)).withField("finalize_source", F.lit("source_fallback"))
    return df.select("id", F.coalesce("messages", M.none()).alias("messages"), marked.alias("meta"))


def source_record(prompt: Column, response: Column, history: Column, index: Column, source: str, turns: int = 3, pack: rules.Pack = rules.Pack(), gate: rules.Gate = rules.Gate()) -> Column:
    """struct(id, prompt, response, history, messages, reason, meta) of a raw dialogue.

    Texts are cleaned and the history is cut to its last *turns* pairs first; id, label, flags and keys are
    those of the cleaned texts. reason says why a row is dropped, null if it is kept. *history* is an array of
    [user, assistant] arrays; null texts count as ''.
    """
    texts = F.struct(T.clean(prompt).alias("prompt"), T.clean(response).alias("response"), M.last_pairs(history, turns, T.clean).alias("pairs"))

    def labelled(x: Column) -> Column:
        others = F.concat_ws(" ", x["response"], history_text(x["pairs"]))
        return T.bind(rules.classify(x["prompt"], others, pack), lambda hit: judged(x, hit))

    def judged(x: Column, hit: Column) -> Column:
        turned = F.size(x["pairs"]) > 0
        return T.bind(rules.quality(x["prompt"], x["response"], turned, hit["label"], gate), lambda q: made(x, hit, q))

    def made(x: Column, hit: Column, q: Column) -> Column:
        p, r = x["prompt"], x["response"]
        pairs = F.transform(x["pairs"], lambda t: F.array(t["user"], t["assistant"]))
        meta = F.struct(
            hit["label"].alias("scenario"),
            hit["label"].alias("intent"),
            F.map_from_entries(hit["scores"]).alias("intent_scores"),
            index.alias("source_index"),
            F.lit(source).alias("source"),
            T.loose_key(p).alias("source_prompt_key"),
            T.loose_key(F.concat(p, r)).alias("source_pair_key"),
            F.size(pairs).alias("history_turns"),
            (F.size(pairs) > 0).alias("history_required"),
            q["flags"].alias("quality_flags"),
            (F.size(q["flags"]) > 0).alias("needs_rewrite"),
        )
        told = F.flatten(F.transform(x["pairs"], lambda t: F.array(M.message(M.USER, t["user"]), M.message(M.ASSISTANT, t["assistant"]))))
        messages = F.concat(told, F.array(M.message(M.USER, p), M.message(M.ASSISTANT, r)))
        record_id = T.raw_id(index, p.alias("prompt"), r.alias("response"), pairs.alias("history"))
        return F.struct(record_id.alias("id"), p.alias("prompt"), r.alias("response"), pairs.alias("history"), messages.alias("messages"), q["reason"].alias("reason"), meta.alias("meta"))

    return T.bind(texts, labelled)
