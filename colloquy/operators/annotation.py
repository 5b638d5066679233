"""Annotation sheets: rendering to Markdown sections and parsing them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = "- [ ] "


def checklist(items: Column, least: int = 3) -> Column:
    """Lines of a checklist, padded with empty ones."""
    filled = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.concat(F.lit(BOX), x))
    return F.concat(filled, F.array_repeat(F.lit(BOX), F.greatest(F.lit(0), F.lit(least) - F.size(filled)).cast("int")))


def section(number: Column, intent: Column, label: Column, dialogue: Column, must: Column, avoid: Column) -> Column:
    """One section of the sheet."""
    return F.array_join(
        F.concat(
            F.array(F.concat(F.lit("### "), F.format_string("eval_%03d", number), F.lit(" | "), intent, F.lit(" | "), F.coalesce(label, F.lit(""))), F.lit("```"), dialogue, F.lit("```"), F.lit("**must:**")),
            checklist(must),
            F.array(F.lit("**avoid:**")),
            checklist(avoid),
        ),
        "\n",
    )


def parse_sheet(sheets: DataFrame, text: str = "value") -> DataFrame:
    """(number, intent, label, dialogue, must, avoid) of every section of whole-text rows."""
    parts = sheets.select(F.explode(F.split(F.col(text), r"\n(?=### eval_\d{3,} \|)")).alias("s")).filter(F.col("s").rlike(r"^### eval_\d{3,} \|"))
    s = F.col("s")
    boxes = lambda block: F.filter(F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^- \[ \] ?(.*)$"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    return parts.select(
        F.regexp_extract(s, r"^### eval_(\d{3,}) \|", 1).cast("int").alias("number"),
        F.regexp_extract(s, r"^### eval_\d{3,} \| ([^|\n]*?) \|", 1).alias("intent"),
        F.regexp_extract(s, r"^### eval_\d{3,} \| [^|\n]*? \| ?(.*)", 1).alias("label"),
        F.regexp_extract(s, r"(?s)```\n(.*?)\n```", 1).alias("dialogue"),
        boxes(F.regexp_extract(s, r"(?s)\*\*must:\*\*\n(.*?)(?:\*\*avoid:\*\*|$)", 1)).alias("must"),
        boxes(F.regexp_extract(s, r"(?s)\*\*avoid:\*\*\n(.*)$", 1)).alias("avoid"),
    )


def checklist_counts(sheets: DataFrame, text: str = "value") -> DataFrame:
    """Filled and empty checklist lines over all sheets."""
    lines = sheets.select(F.explode(F.split(F.col(text), "\n")).alias("line"))
    return lines.agg(
        F.count_if(F.col("line").startswith(BOX) & (F.trim(F.substring("line", len(BOX) + 1, 10_000)) != "")).alias("filled"),
        F.count_if(F.col("line").startswith(BOX.rstrip()) & (F.trim(F.substring("line", len(BOX), 10_000)) == "")).alias("empty"),
    )


def report(df: DataFrame, order: list, line: Column, title: str) -> DataFrame:
    """One row, one column value: a Markdown document of lines in order."""
    lines = df.select(F.struct(*[c.alias(f"o{n}") for n, c in enumerate(order)], line.alias("line")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    return lines.agg(F.concat(F.lit(f"# {title}\n\n"), body).alias("value"))
