"""Problem 3: lines repeated across the documents of one source.

Method: distributed PrefixSpan over line-identifier sequences per source.
Level 1 counts single lines; longer sequences grow by joining each record's
projected position with its later frequent lines. Occurrences of frequent
sequences are then deleted. Every line of a frequent sequence is itself
frequent (its support is at least the sequence's), so the lines to delete are
those of level 1; longer sequences are what the report adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .neardup import bounded

# Frequent lines a source can have: with a support of 30 % of its records, lines per record / 0.3.


def line_ids(source: Column, text: Column) -> Column:
    """Identifiers of a text's lines: 64-bit hashes of source and lower-cased letters; null for a line without letters."""
    letters = F.transform(F.split(F.lower(text), "\n"), lambda x: F.regexp_replace(x, r"[^\p{L}]+", ""))
    return F.transform(letters, lambda x: F.when(x != "", F.xxhash64(source, x)))


def identified(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, s, ids) of the records with text and source; s is the source's 64-bit identifier."""
    own = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source")).filter("text is not null and source is not null")
    return own.select("key", F.xxhash64("source").alias("s"), line_ids(F.col("source"), F.col("text")).alias("ids"))


def frequent_lines(records: DataFrame, least_records: int, least_share: float) -> DataFrame:
    """(s, id, support, bar) of the single lines with enough support; bar is what the source asks for."""
    support = records.select("s", F.explode(F.array_distinct(F.filter("ids", lambda x: x.isNotNull()))).alias("id")).groupBy("s", "id").agg(F.count("*").alias("support"))
    # Few lines reach the fixed bar, so the sources' totals join with those alone.
    totals = records.groupBy("s").agg(F.count("*").alias("records"))
    bar = F.greatest(F.lit(least_records), F.ceil(F.col("records") * least_share - 1e-9)).alias("bar")
    return support.filter(F.col("support") >= least_records).join(totals.filter(F.col("records") >= least_records).select("s", bar), "s").filter("support >= bar")


def repeated_lines(df: DataFrame, key: str, text: str, source: str, least_records: int = 10, least_share: float = 0.3) -> DataFrame:
    """(key, line_no) of every occurrence of a line that a frequent sequence of its source contains.

    Lines are split at the newline and numbered from 0; lines of one source are equal if their lower-cased letters are.
    Null texts and null sources give nothing and don't count as records; repeated rows count each; an empty table gives
    no rows."""
    records = identified(df, key, text, source)
    lines = cut(frequent_lines(records, least_records, least_share))
    by_source = cut(lines.groupBy("s").agg(F.collect_set("id").alias("frequent")))
    hit = records.join(bounded(by_source), "s").select("key", F.posexplode(F.transform("ids", lambda x: F.array_contains("frequent", x))).alias("line_no", "hit"))
    return hit.filter("hit").select(F.col("key").alias(key), "line_no")


def frequent_sequences(df: DataFrame, key: str, text: str, source: str, least_records: int = 10, least_share: float = 0.3, longest: int | None = None) -> DataFrame:
    """(source, length, lines, support): the frequent sequences of lines of every source, gaps allowed, as long as there are
    any; longest: up to so many lines only.

    lines joins the letters of the sequence's lines by ' | '. Support is the number of distinct records."""
    records = identified(df, key, text, source)
    lines = cut(frequent_lines(records, least_records, least_share))
    spots = (
        records.select("key", "s", F.posexplode("ids").alias("at", "id"))
        .filter("id is not null")
        .join(bounded(lines.select("id", "bar")), "id")  # an id tells its source
    )
    # A row identifier stands in for the key, so repeated keys stay distinct records.
    spots = cut(spots.select("s", "key", "id", "at", "bar"))
    grown = spots.groupBy("s", "key", "bar", F.array("id").alias("ids")).agg(F.min("at").alias("at"))
    found = lines.select("s", F.array("id").alias("ids"), "support")
    later = spots.select("s", "key", F.col("id").alias("next"), F.col("at").alias("then"))
    length = 1
    while longest is None or length < longest:
        length += 1
        wider = grown.join(later, ["s", "key"]).filter("then > at").groupBy("s", "key", "bar", F.concat("ids", F.array("next")).alias("ids")).agg(F.min("then").alias("at"))
        wider = cut(wider)
        support = cut(wider.groupBy("s", "ids", "bar").agg(F.count("*").alias("support")).filter("support >= bar").select("s", "ids", "support"))
        if support.isEmpty():
            break
        found = found.unionByName(support)
        grown = wider.join(bounded(support.select("s", "ids")), ["s", "ids"], "left_semi")
    named = df.select(F.col(source).alias("source"), F.explode(F.split(F.lower(F.col(text)), "\n")).alias("line")).withColumn("letters", F.regexp_replace("line", r"[^\p{L}]+", ""))
    words = named.withColumn("id", F.xxhash64("source", "letters")).join(bounded(lines.select("id")), "id", "left_semi").groupBy("id").agg(F.min("source").alias("source"), F.min("letters").alias("letters"))
    words = cut(words)
    parts = found.select("s", "ids", "support", F.posexplode("ids").alias("k", "id")).join(bounded(words), "id")
    joined = parts.groupBy("s", "ids", "support").agg(F.min("source").alias("source"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "letters"))), lambda x: x["letters"]), " | ").alias("lines"))
    return joined.select("source", F.size("ids").alias("length"), "lines", "support")


def without_repeated_lines(df: DataFrame, key: str, text: str, source: str, least_records: int = 10, least_share: float = 0.3) -> DataFrame:
    """(key, text) of all rows, the repeated lines taken out of the texts; rows without text or source stay as they are.

    Texts never cross a shuffle while the frequent lines are few enough to be broadcast (see bounded)."""
    lines = cut(frequent_lines(identified(df, key, text, source), least_records, least_share))
    by_source = cut(lines.groupBy("s").agg(F.collect_set("id").alias("frequent")))
    own = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(source).alias("s"), line_ids(F.col(source), F.col(text)).alias("ids"))
    kept = F.filter(F.arrays_zip(F.split("text", "\n").alias("line"), F.col("ids").alias("id")), lambda x: ~F.coalesce(F.array_contains("frequent", x["id"]), F.lit(False)))
    clean = F.when(F.col("frequent").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    return own.join(bounded(by_source), "s", "left").select(F.col("key").alias(key), clean.alias(text))
