"""Version lists, version expressions and document-name tests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import NAME_SUFFIXES, VERSION_WORDS


def versions(df: DataFrame, name_part: str | None = None) -> DataFrame:
    """Distinct versions, newest first; of files whose source contains name_part if it is given. Nulls are left out."""
    own = df.filter(F.contains("source", F.lit(name_part))) if name_part is not None else df
    return own.filter("version is not null").select("version").distinct().orderBy(F.desc("version"))


def nth_newest(df: DataFrame, n: int, part: str | None = None) -> DataFrame:
    """Rows of the n-th newest version, over all rows or within each value of part."""
    seen = df.filter("version is not null").select(*([part] if part else []), "version").distinct()
    rank = F.dense_rank().over((Window.partitionBy(part) if part else Window.partitionBy()).orderBy(F.desc("version")))
    keys = ([part] if part else []) + ["version"]
    return df.join(seen.withColumn("__r", rank).filter(F.col("__r") == n).drop("__r"), keys, "left_semi")


def is_document_name(c: Column) -> Column:
    """Is a text a document name, not a version? A digit with 5 to 19 of '-_0-9' behind it, and 4 to 8 digits, are versions."""
    return F.when(c.isNull() | (c == ""), False).when(c.rlike(r"^\d[_\-\d]{5,19}$"), False).when(F.lower(c).isin(*NAME_SUFFIXES), True).when(c.rlike(r"^\d{4,8}$"), False).otherwise(True)


def resolve(df: DataFrame, wanted: str | None, strict: bool = False) -> list[str]:
    """Versions that an expression stands for, newest first; the first rule that hits decides.

    Blank: the newest. A version: itself. Part of a source: that file's versions. A keyword: newest, oldest, second, third (the
    newest where there are too few). 'N个' or '前N个': the newest N. Part of a version: all such. Else none.
    The distinct versions (one a build) come to the driver, the rows don't."""
    every = [r.version for r in versions(df).collect()]
    text = (wanted or "").strip()
    if not text:
        return every[:1]
    if not every:
        return []
    if text in every:
        return [text]
    named = [r.version for r in versions(df, text).collect()]
    if named:
        return named
    low = text.lower()
    for k, word in enumerate(("first", "second", "third")):
        if low in VERSION_WORDS[word]:
            return every[k : k + 1] or every[:1]
    if low in VERSION_WORDS["last"]:
        return every[-1:]
    if m := re.match(r"前?(\d+)个", low):
        return every[: int(m.group(1))]
    return [v for v in every if text in v]


def requested(df: DataFrame, wanted: str | None) -> tuple[list[str], str | None]:
    """(versions, document name) that a comma-separated request stands for: each part a version expression, but the last part
    that is a document's name and no version keyword. Versions come newest first, each once."""
    parts = [x.strip() for x in (wanted or "").split(",") if x.strip()]
    keywords = tuple(w for words in VERSION_WORDS.values() for w in words) + ("前",)
    found, name = set(), None
    for part in parts:
        if not part.lower().startswith(keywords) and _is_name(part):
            name = part
        else:
            found |= set(resolve(df, part))
    return sorted(found, reverse=True), name


def _is_name(text: str) -> bool:
    """is_document_name of one text, on the driver."""
    if re.fullmatch(r"\d[_\-\d]{5,19}", text):
        return False
    return text.lower() in NAME_SUFFIXES or not re.fullmatch(r"\d{4,8}", text)


def of_versions(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows of any of the versions; none wanted, none found."""
    return df.filter(F.col("version").isin(*wanted)) if wanted else df.limit(0)


def filtered(df: DataFrame, wanted: str | None, strict: bool = False) -> DataFrame:
    """Rows of the newest version that an expression stands for. One that matches nothing filters nothing, unless strict."""
    hit = resolve(df, wanted)
    return df.filter(F.col("version") == hit[0]) if hit else df.limit(0) if strict else df
