"""Structural splitting: strategy, markdown and word-style sections, paragraphs, short neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running
from ..functions.text import WS, any_match, java, lines, strip
from ..rules import SHORT_ROW, WORD_HEADINGS

MARKDOWN = r"^(#{1,6})\s+(.+)$"


def strategy(text: Column, source: Column) -> Column:
    """'markdown' where the text has a hash sign anywhere; 'word' for word-processor files and for at least two headings
    in the first 20 lines; else 'paragraph'. A null text has no strategy."""
    heads = F.size(F.filter(F.slice(lines(text), 1, 20), lambda x: any_match(strip(x), WORD_HEADINGS)))
    word = F.lower(F.coalesce(source, F.lit(""))).rlike(r"\.(docx|doc)$") | (heads >= 2)
    return F.when(text.isNull(), None).when(F.contains(text, F.lit("#")), "markdown").when(word, "word").otherwise("paragraph")


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, paragraph_index, paragraph): stripped non-empty paragraphs; the index counts empty ones."""
    parts = df.select(key, F.posexplode(F.split(text, f"\n{WS}*\n|\n", -1)).alias("paragraph_index", "p"))
    return parts.select(key, "paragraph_index", strip(F.col("p")).alias("paragraph")).filter("paragraph <> ''")


def word_heading(line: Column) -> tuple[Column, Column, Column]:
    """(is heading, level, title) of a stripped line: dotted numbers have as many levels as parts, bracketed ones two."""
    num = F.regexp_extract(line, java(WORD_HEADINGS[0]), 1)
    hit = [line.rlike(java(p)) for p in WORD_HEADINGS]
    level = F.when(hit[0], F.length(num) - F.length(F.replace(num, F.lit("."), F.lit(""))) + 1).when(hit[1] | hit[2], 1).when(hit[3], 2)
    title = F.coalesce(*[F.when(h, strip(line)) for h in hit])
    return hit[0] | hit[1] | hit[2] | hit[3], level.cast("int"), title


def markdown_heading(line: Column) -> tuple[Column, Column, Column]:
    return line.rlike(java(MARKDOWN)), F.length(F.regexp_extract(line, java(MARKDOWN), 1)).cast("int"), strip(F.regexp_extract(line, java(MARKDOWN), 2))


def sections(df: DataFrame, key: str, text: str, heading) -> DataFrame:
    """(key, section_index, section_level, section_title, section): a heading starts a section, text before the first is
    level 0 without title. Empty sections give no row but count in the index. Null texts give nothing; repeated keys give
    theirs each. Each text is cut where it is: no line crosses a shuffle."""
    rows = df.select(key, lines(F.col(text)).alias("ls"))
    spots = F.filter(F.transform("ls", lambda x, i: F.when(F.coalesce(heading(strip(x))[0], F.lit(False)), i + 1)), lambda p: p.isNotNull())
    # The first line starts a section in any case.
    rows = rows.withColumn("at", spots).withColumn("at", F.when(F.get("at", F.lit(0)) == 1, F.col("at")).otherwise(F.concat(F.array(F.lit(1)), "at")))
    until = lambda k: F.coalesce(F.get("at", k + 1), F.size("ls") + 1)
    cut = F.transform("at", lambda p, k: F.struct(F.get("ls", p - 1).alias("first"), F.array_join(F.slice("ls", p, until(k) - p), "\n").alias("body")))
    parts = rows.select(key, F.posexplode(cut).alias("section_index", "c")).select(key, "section_index", strip(F.col("c.first")).alias("s"), strip(F.col("c.body")).alias("section"))
    is_head, level, title = heading(F.col("s"))
    head = F.coalesce(is_head, F.lit(False))
    return parts.select(key, "section_index", F.when(head, level).otherwise(0).alias("section_level"), F.when(head, title).otherwise("").alias("section_title"), "section").filter("section <> ''")


def merge_short(df: DataFrame, order: str, text: str, meta: list[str], least: int = SHORT_ROW, part: str | None = None) -> DataFrame:
    """(first_<order>, text, *meta): a row shorter than least joins the row before it, across sources unless part is given.

    Texts are joined by an empty line, each metadata column keeps its last value that isn't null. A running count of
    rows that start a group is carried over blocks, so no task sees the whole order. Null texts count as empty."""
    own = df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    starts = F.when(F.length(text) >= least, 1).otherwise(0)
    grouped = running(own, order, part, sums={"__g": starts})
    # Rows before the first long one belong to the group that the very first row starts.
    keys = ["__g"] + ([part] if part else [])
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x[c]), "\n\n")
    return grouped.groupBy(*keys).agg(F.min(order).alias(f"first_{order}"), ordered(text).alias(text), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in meta if c != part]).drop("__g")
