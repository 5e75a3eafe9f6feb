"""Rows as markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown_rows(df: DataFrame, order: str) -> DataFrame:
    """(order, line): each row as a markdown table row; cells up to 100 characters, nulls as a blank."""
    cells = [F.coalesce(F.substring(F.col(c).cast("string"), 1, 100), F.lit(" ")) for c in df.columns]
    return df.select(F.col(order).alias(order), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_head(columns: list[str]) -> list[str]:
    return ["| " + " | ".join(str(c)[:50] for c in columns) + " |", "|" + "---|" * len(columns)]


def markdown_table(header: list[str], rows: list[list]) -> str:
    cell = lambda v: " " if v is None or v == "" else str(v)[:100]
    return "\n".join([*markdown_head(header), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])
