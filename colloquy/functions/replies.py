"""Cleaning and parsing of generated replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, strip, text_or_empty

# The markers that end a generation, in the order in which they are cut.
END_MARKERS = ("<|im_end|>", "<|endoftext|>", "<|im_start|>")
# What is stripped from both ends of a cleaned reply.
EDGES = " \\n\\t\"'“”"


def cut_generation(c: Column) -> Column:
    """Reasoning block out, text before the first end marker."""
    out = F.regexp_replace(text_or_empty(c), r"(?s)<think>.*?</think>\s*", "")
    for marker in END_MARKERS:
        out = F.substring_index(out, marker, 1)
    return strip(out)


def intent_of(c: Column) -> Column:
    """The label of a two-line reply; null if there is none."""
    return F.nullif(strip(F.regexp_extract(text_or_empty(c), r"分类[:：]\s*(.+?)(?:\n|$)", 1)), F.lit(""))


def reply_of(c: Column) -> Column:
    """The reply of a two-line reply; null if it has no reply line."""
    return F.nullif(strip(F.regexp_extract(text_or_empty(c), r"(?s)回复[:：]\s*(.+)", 1)), F.lit(""))


def split_generated(response: Column, intent: Column, reply: Column) -> Column:
    """struct(intent, reply): given fields first, else parsed from the response; null where neither has it."""
    given = lambda c, parsed: F.when(text_or_empty(c) != "", strip(text_or_empty(c))).otherwise(parsed(strip(text_or_empty(response))))
    return F.struct(given(intent, intent_of).alias("intent"), given(reply, reply_of).alias("reply"))


def clean_reply(c: Column) -> Column:
    """The text behind a reply label, without one label line and one more reply label at its beginning and
    without quotes and blanks around it; a text without labels stays."""
    whole = strip(text_or_empty(c))
    out = bind(whole, lambda x: F.coalesce(reply_of(x), x))
    out = strip(F.regexp_replace(out, r"(?s)^分类[:：].*?(?:\n|$)", ""))
    out = strip(F.regexp_replace(out, r"^回复[:：]\s*", ""))
    return F.regexp_replace(out, f"^[{EDGES}]+|[{EDGES}]+\\z", "")


def lenient_json(c: Column, schema: str) -> Column:
    """from_json of a text that may stand in a fence or between other words; null if nothing parses."""
    body = strip(text_or_empty(c))
    body = F.when(body.startswith("```"), F.regexp_replace(body, r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")).otherwise(body)
    cut = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    fits = lambda x: F.try_parse_json(x).isNotNull() & x.rlike(r"(?s)^\s*\{.*\}\s*$")
    text = F.when(fits(body), body).when((cut != "") & fits(cut), cut)
    return F.from_json(text, schema)
