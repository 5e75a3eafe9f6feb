"""Cleaning: line filters, region state machines, deduplication and length filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_match, dedup_key, lines, strip
from ..rules import APPROVAL_STARTS, METADATA_LINES, PAGE_LINES, REAL_HEADINGS, SEPARATORS, SHORT_DOC, TOC_ENTRIES, TOC_LINES, TOC_STARTS, WATERMARK_LINES


def classified(text: Column) -> Column:
    """What each line is by itself, every pattern matched once: the state machines read these flags alone."""

    def flags(x):
        return F.struct(
            (x == "").alias("blank"),
            any_match(x, METADATA_LINES).alias("meta"),
            any_match(x, REAL_HEADINGS).alias("head"),
            any_match(x, TOC_STARTS).alias("toc"),
            any_match(x, TOC_ENTRIES).alias("entry"),
            any_match(x, APPROVAL_STARTS).alias("approval"),
            any_match(x, SEPARATORS).alias("rule"),
            any_match(x, PAGE_LINES).alias("page"),
            any_match(x, WATERMARK_LINES).alias("mark"),
            x.startswith("|").alias("bar"),
            (x.startswith("|") & x.endswith("|")).alias("row"),
            F.contains(x, F.lit("---")).alias("dashes"),
        )

    return F.transform(F.transform(lines(text), strip), flags)


# A state machine: its fields with their first values, and a step from (state, line) to (new fields, whether the line stays).
Machine = tuple[dict[str, Column], Callable[[Column, Column], tuple[dict[str, Column], Column]]]


def _fold(text: Column, machines: list[Machine], also: Callable[[Column], Column] | None = None) -> Column:
    """The text's lines that all machines keep, in one pass: a line that one drops is not seen by those after it.

    The fold only notes a sign a line, so its state stays small however many lines there are."""
    start = F.struct(*[v.alias(k) for fields, _ in machines for k, v in fields.items()], F.lit("").alias("kept"))

    def step(s, e):
        alive, fields = F.lit(True), []
        for _, machine in machines:
            new, keep = machine(s, e)
            fields += [F.when(alive, v).otherwise(s[k]).alias(k) for k, v in new.items()]
            alive = alive & keep
        alive = alive & also(e) if also is not None else alive
        return F.struct(*fields, F.concat(s["kept"], F.when(alive, "1").otherwise("0")).alias("kept"))

    kept = F.aggregate(classified(text), start, step)["kept"]
    # Zipped, so that the fold is evaluated once a text; inside a lambda it would be once a line.
    signed = F.zip_with(lines(text), F.split(kept, ""), lambda x, k: F.when(k == "1", x))
    return F.array_join(F.filter(signed, lambda x: x.isNotNull()), "\n")


def _metadata() -> Machine:
    def step(s, e):
        blanks = F.when(e["meta"], 0).when(s["meta"] & e["blank"], s["blanks"] + 1).otherwise(s["blanks"])
        leaves = s["meta"] & ~e["meta"] & ((e["blank"] & (s["blanks"] >= 1)) | (~e["blank"] & e["head"]))
        skip = F.when(e["meta"], True).when(leaves, False).otherwise(s["meta"])
        return {"meta": skip, "blanks": F.when(leaves, 0).otherwise(blanks).cast("int")}, ~e["meta"] & (~s["meta"] | leaves)

    return {"meta": F.lit(False), "blanks": F.lit(0)}, step


def _toc() -> Machine:
    def step(s, e):
        begins = ~s["toc"] & e["toc"]
        leaves = s["toc"] & ((s["n"] + 1 > TOC_LINES) | (~e["blank"] & ~e["entry"]))
        return {"toc": begins | (s["toc"] & ~leaves), "n": F.when(s["toc"], s["n"] + 1).otherwise(0).cast("int")}, (~s["toc"] & ~begins) | leaves

    return {"toc": F.lit(False), "n": F.lit(0)}, step


def _approval() -> Machine:
    def step(s, e):
        skip = F.when(e["approval"], True).when(e["head"], False).otherwise(s["approval"])
        return {"approval": skip}, ~skip

    return {"approval": F.lit(False)}, step


def _separators() -> Machine:
    def step(s, e):
        kept = e["row"] | (s["table"] & (e["bar"] | e["dashes"]))
        ends = s["table"] & ~e["blank"] & ~e["bar"]
        return {"table": F.when(kept, True).when(ends, False).otherwise(s["table"])}, kept | ~e["rule"]

    return {"table": F.lit(False)}, step


def _unmatched(text: Column, patterns) -> Column:
    return F.array_join(F.filter(lines(text), lambda x: ~any_match(strip(x), patterns)), "\n")


def without_page_lines(text: Column) -> Column:
    """The text without the lines that only hold a page number."""
    return _unmatched(text, PAGE_LINES)


def without_watermarks(text: Column) -> Column:
    return _unmatched(text, WATERMARK_LINES)


def without_metadata(text: Column) -> Column:
    """Skip from a metadata line to a real heading or to the second blank line since (which is kept)."""
    return _fold(text, [_metadata()])


def without_toc(text: Column) -> Column:
    """Skip a table of contents: its start, its entries and blanks, until a line that is none (kept) or the limit."""
    return _fold(text, [_toc()])


def without_approval(text: Column) -> Column:
    """Skip from an approval line to the next real heading (kept)."""
    return _fold(text, [_approval()])


def without_separators(text: Column) -> Column:
    """Drop drawn rules outside markdown tables; a rule right after a table's rows is kept, blank lines don't end it."""
    return _fold(text, [_separators()])


def cleaned(text: Column) -> Column:
    """All line and region filters, in their order; the lines are classified once and folded once."""
    return _fold(text, [_metadata(), _toc(), _approval(), _separators()], lambda e: ~e["page"] & ~e["mark"])


def deduplicated(df: DataFrame, order: str, text: str) -> DataFrame:
    """First row of each text, white space and letter case ignored; null texts are dropped. Pre-aggregated: a text that a third
    of all rows share costs its shuffle one row a partition."""
    first = df.filter(F.col(text).isNotNull()).groupBy(F.md5(dedup_key(F.col(text))).alias("__k")).agg(F.min(order).alias(order))
    return df.join(first.select(order), order, "left_semi")


def long_enough(df: DataFrame, text: str, least: int = SHORT_DOC) -> DataFrame:
    return df.filter(F.length(strip(F.col(text))) >= least)
