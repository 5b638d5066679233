"""Markdown reports as ordered lines: one row per line, so a report of any length is a plain table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_or_empty


def table_lines(df: DataFrame, columns: dict[str, Column], order: list[Column], title: str) -> DataFrame:
    """(part, place, line): title, header and one line per row in *order*; place counts within a part.

    Bars and line breaks inside cells become blanks.
    """
    spark = df.sparkSession
    head = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    cells = [F.regexp_replace(text_or_empty(c), r"[|\\r\\n]+", " ") for c in columns.values()]
    body = df.select(F.lit(1).alias("part"), F.struct(*[c.alias(f"o{n}") for n, c in enumerate(order)]).alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    top = spark.createDataFrame([(0, n, line) for n, line in enumerate(head)], "part int, n int, line string")
    empty = F.lit(None).cast(body.schema["place"].dataType)
    return top.select("part", "n", empty.alias("place"), "line").unionByName(body.select("part", F.lit(0).alias("n"), "place", "line")).orderBy("part", "n", "place").select("part", "line")


def section_lines(df: DataFrame, title: Column, fields: dict[str, Column]) -> DataFrame:
    """Adds line: a section with a title and one bullet per field that is filled; the cases of a judge or of
    a list of removed rows."""
    bullets = [F.when(text_or_empty(c) != "", F.concat(F.lit(f"- **{k}**: "), c.cast("string"))) for k, c in fields.items()]
    return df.withColumn("line", F.concat(F.lit("## "), title, F.lit("\n\n"), F.concat_ws("\n", *bullets)))
