"""Message sequences: mapping, folding, trimming and rendering, as higher-order expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import bind, strip, text_or_empty

MESSAGE = "struct<role:string,content:string>"
# Role names of common formats.
ROLES = {
    "human": "user", "user": "user", "customer": "user", "buyer": "user", "顾客": "user", "用户": "user", "客户": "user", "买家": "user",
    "gpt": "assistant", "assistant": "assistant", "agent": "assistant", "service": "assistant", "客服": "assistant", "商家": "assistant", "seller": "assistant", "卖家": "assistant",
    "system": "system",
}
SYSTEM, USER, ASSISTANT = "system", "user", "assistant"
START, STOP = "<|im_start|>", "<|im_end|>"


def none() -> Column:
    """An empty message sequence."""
    return F.array().cast(f"array<{MESSAGE}>")


def role(c: Column) -> Column:
    """user, assistant, system, or null for an unknown name; the exact name first, then in lower case."""
    table = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    name = strip(text_or_empty(c))
    return F.coalesce(F.try_element_at(table, name), F.try_element_at(table, F.lower(name)))


def message(r: Column | str, content: Column) -> Column:
    return F.struct((F.lit(r) if isinstance(r, str) else r).alias("role"), content.alias("content"))


def known(c: Column) -> Column:
    """Messages with a known role and a text, trimmed."""
    mapped = F.transform(F.coalesce(c, none()), lambda m: message(role(m["role"]), strip(text_or_empty(m["content"]))))
    return F.filter(mapped, lambda m: m["role"].isNotNull() & (m["content"] != ""))


def system_of(c: Column) -> Column:
    """The text of the last system message; null if there is none."""
    return F.try_element_at(F.filter(known(c), lambda m: m["role"] == SYSTEM), F.lit(-1))["content"]


def fold_turns(c: Column) -> Column:
    """Neighbours of one role merged with a line break."""

    def step(done: Column, m: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        merged = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(message(last["role"], F.concat_ws("\n", last["content"], m["content"]))))
        return F.when((F.size(done) > 0) & (last["role"] == m["role"]), merged).otherwise(F.concat(done, F.array(m)))

    return F.aggregate(c, none(), step)


def normalized(c: Column) -> Column:
    """A sequence for training: system messages out, neighbours merged, no assistant first, no user
    last; empty if fewer than two messages are left."""
    turns = fold_turns(F.filter(known(c), lambda m: m["role"] != SYSTEM))
    head = F.when((F.size(turns) > 0) & (F.try_element_at(turns, F.lit(1))["role"] == ASSISTANT), 1).otherwise(0)
    tail = F.when((F.size(turns) > 0) & (F.try_element_at(turns, F.lit(-1))["role"] == USER), 1).otherwise(0)
    cut = F.slice(turns, head + 1, F.greatest(F.size(turns) - head - tail, F.lit(0)))
    return F.when(F.size(cut) >= 2, cut).otherwise(none())


def for_generation(c: Column) -> Column:
    """A sequence to be answered: nothing merged, trailing assistants and leading assistants out."""
    turns = F.filter(known(c), lambda m: m["role"] != SYSTEM)
    users = F.transform(turns, lambda m: m["role"] == USER)
    first = F.array_position(users, True)
    back = F.array_position(F.reverse(users), True)
    return F.when(first > 0, F.slice(turns, first.cast("int"), (F.size(turns) - back + 1 - first + 1).cast("int"))).otherwise(none())


def trim_turns(c: Column, history: int) -> Column:
    """The last history + 1 pairs; a negative number or at most two messages leave all."""
    if history < 0:
        return c
    keep = 2 * (history + 1)
    return F.when(F.size(c) <= 2, c).otherwise(F.slice(c, F.greatest(F.lit(1), F.size(c) - keep + 1), keep))


def past(history: Column) -> Column:
    """The complete pairs of a history as messages, trimmed; pairs that lack a side are skipped."""
    said = lambda p, n: strip(text_or_empty(F.get(p, n)))
    pairs = F.filter(F.coalesce(history, F.array().cast("array<array<string>>")), lambda p: (F.size(p) == 2) & (said(p, 0) != "") & (said(p, 1) != ""))
    return F.flatten(F.transform(pairs, lambda p: F.array(message(USER, said(p, 0)), message(ASSISTANT, said(p, 1))))).cast(f"array<{MESSAGE}>")


def from_history(history: Column, prompt: Column, response: Column) -> Column:
    """Pairs, then prompt and response, trimmed; a blank prompt or response gives nothing."""
    p, r = strip(text_or_empty(prompt)), strip(text_or_empty(response))
    whole = F.concat(past(history), F.array(message(USER, p), message(ASSISTANT, r)))
    return F.when((p != "") & (r != ""), whole).otherwise(none())


def variant(c: Column, role_field: str, content_field: str) -> Column:
    """Messages whose fields have other names, such as from and value."""
    return F.transform(c, lambda m: message(m[role_field], m[content_field].cast("string")))


def of_record(schema: T.StructType) -> Column:
    """The messages of a record in any of the usual forms: messages, else conversations (each with role and
    content or from and value), else history, prompt and response; null where the record has none of them.

    The forms are told from the schema; a null or empty sequence passes on to the next form.
    """
    found = []
    for name in ("messages", "conversations"):
        if name in schema.names:
            fields = schema[name].dataType.elementType.names
            c = F.col(name)
            if "role" in fields and "content" in fields:
                c = variant(c, "role", "content")
            elif "from" in fields and "value" in fields:
                c = variant(c, "from", "value")
            else:
                raise ValueError(f"{name} has neither role and content nor from and value")
            found.append(F.when(F.size(c) > 0, c))
    if "prompt" in schema.names and "response" in schema.names:
        history = F.col("history") if "history" in schema.names else F.lit(None).cast("array<array<string>>")
        found.append(from_history(history, F.col("prompt"), F.col("response")))
    return F.coalesce(*found) if found else F.lit(None).cast(f"array<{MESSAGE}>")


def last_pairs(history: Column, limit: int, clean) -> Column:
    """The last *limit* pairs, then without those that lack a side; texts go through *clean*."""
    h = F.coalesce(history, F.array())
    tail = F.slice(h, F.greatest(F.lit(1), F.size(h) - limit + 1), limit)
    mapped = F.transform(F.filter(tail, lambda p: F.size(p) >= 2), lambda p: F.struct(clean(F.get(p, 0)).alias("user"), clean(F.get(p, 1)).alias("assistant")))
    return F.filter(mapped, lambda p: (p["user"] != "") & (p["assistant"] != ""))


def flat_history(history: Column) -> Column:
    """Pairs as messages; a side that is missing is left out, the other stays."""
    both = F.transform(F.coalesce(history, F.array()), lambda p: F.array(message(USER, text_or_empty(F.get(p, 0))), message(ASSISTANT, text_or_empty(F.get(p, 1)))))
    return F.filter(F.flatten(both), lambda m: m["content"] != "")


def last_user(c: Column) -> Column:
    return F.try_element_at(F.filter(F.coalesce(c, none()), lambda m: m["role"] == USER), F.lit(-1))["content"]


def last_pair(c: Column) -> Column:
    """struct(user, assistant): the last two contents; '' where a sequence is too short."""
    at = lambda n: text_or_empty(F.try_element_at(F.coalesce(c, none()), F.lit(n))["content"])
    return F.struct(F.when(F.size(c) >= 2, at(-2)).otherwise("").alias("user"), at(-1).alias("assistant"))


def history_json(history: Column) -> Column:
    """Pairs as a JSON list of objects with user and assistant; shorter pairs are left out."""
    pairs = F.filter(F.coalesce(history, F.array().cast("array<array<string>>")), lambda p: F.size(p) >= 2)
    return F.to_json(F.transform(pairs, lambda p: F.struct(text_or_empty(F.get(p, 0)).alias("user"), text_or_empty(F.get(p, 1)).alias("assistant"))))


def user_segment(content: Column, system: Column | None = None) -> Column:
    body = F.concat(F.lit(f"{START}user\n"), content, F.lit(f"{STOP}\n{START}assistant\n"))
    return body if system is None else F.concat(F.when(F.coalesce(system, F.lit("")) != "", F.concat(F.lit(f"{START}system\n"), system, F.lit(f"{STOP}\n"))).otherwise(""), body)


def assistant_segment(content: Column) -> Column:
    return F.concat(content, F.lit(f"{STOP}\n"))


def turns(c: Column, system: Column) -> Column:
    """(source, target) per pair of an alternating sequence; the system text stands in the first only."""
    n = F.floor(F.size(c) / 2).cast("int")
    made = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.struct(
            user_segment(F.get(c, 2 * i - 2)["content"], F.when(i == 1, system)).alias("source"),
            assistant_segment(F.get(c, 2 * i - 1)["content"]).alias("target"),
        ),
    )
    return F.when(n > 0, made).otherwise(F.array().cast("array<struct<source:string,target:string>>"))


def generation_prompt(c: Column, system: Column) -> Column:
    """Messages rendered, open for the assistant; the system text stands before the first user.

    Every user message opens a turn, an assistant message closes the open one; an assistant message
    without an open turn is left out, a sequence without users gives ''.
    """
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("open"), F.lit(True).alias("first"))
    opened = lambda a: F.concat(a["text"], user_segment(a["open"], F.when(a["first"], system)))

    def step(a: Column, m: Column) -> Column:
        waits = a["open"].isNotNull()
        asks = F.struct(F.when(waits, opened(a)).otherwise(a["text"]).alias("text"), m["content"].alias("open"), (a["first"] & ~waits).alias("first"))
        ends = F.struct(F.concat(opened(a), assistant_segment(m["content"])).alias("text"), F.lit(None).cast("string").alias("open"), F.lit(False).alias("first"))
        return F.when(m["role"] == USER, asks).when((m["role"] == ASSISTANT) & waits, ends).otherwise(a)

    return F.aggregate(c, start, step, lambda a: F.when(a["open"].isNotNull(), opened(a)).otherwise(a["text"]))


def record_prompt(schema: T.StructType, default_system: str = "") -> Column:
    """The prompt of a record in any of the usual forms: messages or conversations, else query and context,
    else history and prompt. A column system goes before *default_system*."""
    own = strip(text_or_empty(F.col("system"))) if "system" in schema.names else F.lit("")
    base = F.when(own != "", own).otherwise(F.lit(default_system))
    forms = [n for n in ("messages", "conversations") if n in schema.names]
    tried = F.lit(None).cast("string")
    if forms:
        c = of_record(T.StructType([schema[n] for n in forms]))
        tried = F.when(c.isNotNull(), generation_prompt(for_generation(c), F.coalesce(system_of(c), base)))
    if "query" in schema.names:
        query = strip(text_or_empty(F.col("query")))
        context = strip(text_or_empty(F.col("context"))) if "context" in schema.names else F.lit("")
        asked = F.when(context != "", F.concat(F.lit("用户问题："), query, F.lit("\n业务背景："), context)).otherwise(query)
        return F.coalesce(tried, user_segment(asked, base))
    prompt = strip(text_or_empty(F.col("prompt"))) if "prompt" in schema.names else F.lit("")
    before = past(F.col("history")) if "history" in schema.names else none()
    return F.coalesce(tried, generation_prompt(F.concat(before, F.filter(F.array(message(USER, prompt)), lambda m: m["content"] != "")), base))


def two_role_prompt(c: Column) -> Column:
    """Rendering of the preference loops: any role but user counts as assistant."""
    one = lambda m: F.concat(F.lit(START), F.when(m["role"] == USER, USER).otherwise(ASSISTANT), F.lit("\n"), text_or_empty(m["content"]), F.lit(f"{STOP}\n"))
    return F.concat(F.array_join(F.transform(F.coalesce(c, none()), one), ""), F.lit(f"{START}assistant\n"))


def role_fault(c: Column) -> Column:
    """Why a sequence is not user, assistant, ... with texts, ending with the assistant; null if it is.

    A null sequence, a null message and a last message of the user are faults too.
    """
    checked = F.transform(
        F.coalesce(c, none()),
        lambda m, i: F.when(m.isNull(), "bad_message_item")
        .when(F.coalesce(m["role"], F.lit("")) != F.when(i % 2 == 0, USER).otherwise(ASSISTANT), F.concat(F.lit("bad_role_at_"), i))
        .when(strip(text_or_empty(m["content"])) == "", F.concat(F.lit("empty_content_at_"), i)),
    )
    first = F.try_element_at(F.filter(checked, lambda x: x.isNotNull()), F.lit(1))
    size = F.size(F.coalesce(c, none()))
    return F.when(c.isNull(), "bad_messages_type").when(size == 0, "empty_final_reply").when(first.isNotNull(), first).when(size % 2 == 1, F.concat(F.lit("bad_role_at_"), size - 1))


def budget(source: Column, target: Column, room: Column) -> Column:
    """struct(source, target): lengths kept within *room*, the target first."""
    fits = source + target <= room
    return F.struct(
        F.when(fits, source).when(room <= 0, 0).when(target >= room, 0).otherwise(room - target).alias("source"),
        F.when(fits, target).when(room <= 0, 0).when(target >= room, room).otherwise(target).alias("target"),
    )


def codes(c: Column) -> Column:
    """The built-in tokenizer: one id per character."""
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))


def masked_tokens(t: Column, limit: int, last_only: bool = False, train_on_prompt: bool = False, tokenizer: Callable[[Column], Column] = codes) -> Column:
    """struct(input_ids, labels, truncated) of (source, target) turns.

    Each turn takes what room is left, the target first; source labels are -100 unless
    *train_on_prompt*. With *last_only* turns are taken from the last backwards and only the last target
    keeps its labels. A sample without tokens or without a visible label is rejected: its ids and labels
    are null. *tokenizer* maps a text column to an array of ids.
    """
    coded = F.transform(F.reverse(t) if last_only else t, lambda turn: F.struct(tokenizer(turn["source"]).alias("s"), tokenizer(turn["target"]).alias("g")))
    start = F.struct(F.array().cast("array<int>").alias("ids"), F.array().cast("array<int>").alias("labels"), F.lit(False).alias("cut"), F.lit(0).alias("n"))

    def step(acc: Column, turn: Column) -> Column:
        s, g = turn["s"], turn["g"]
        room = F.lit(limit) - F.size(acc["ids"])

        def join(keep: Column) -> Column:
            kept_s = F.slice(s, F.size(s) - keep["source"] + 1, keep["source"])
            kept_t = F.slice(g, F.lit(1), keep["target"])
            shown = F.when(acc["n"] > 0, F.array_repeat(F.lit(-100), keep["target"])).otherwise(kept_t) if last_only else kept_t
            both, marks = F.concat(kept_s, kept_t), F.concat(kept_s if train_on_prompt else F.array_repeat(F.lit(-100), keep["source"]), shown)
            cut = acc["cut"] | (room <= 0) | (keep["source"] < F.size(s)) | (keep["target"] < F.size(g))
            return F.struct(
                (F.concat(both, acc["ids"]) if last_only else F.concat(acc["ids"], both)).alias("ids"),
                (F.concat(marks, acc["labels"]) if last_only else F.concat(acc["labels"], marks)).alias("labels"),
                cut.alias("cut"),
                (acc["n"] + 1).alias("n"),
            )

        return bind(budget(F.size(s), F.size(g), room), join)

    def finished(d: Column) -> Column:
        usable = F.exists(d["labels"], lambda x: x != -100)
        return F.struct(F.when(usable, d["ids"]).alias("input_ids"), F.when(usable, d["labels"]).alias("labels"), d["cut"].alias("truncated"))

    return bind(F.aggregate(coded, start, step), finished)
