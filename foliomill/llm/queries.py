"""Queries of the training-data problems, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    from .neardup import group_pairs, near_duplicates

    members, _ = near_duplicates(table(spark, sf, "kb_document"), "record_id", "page_content", 0.6, "chars", 5)
    return group_pairs(members)


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per record in a group: its class, and its links to other texts."""
    from .neardup import near_duplicates

    members, _ = near_duplicates(table(spark, sf, "kb_document"), "record_id", "page_content", 0.6, "chars", 5)
    return members.withColumnRenamed("key", "record_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    from .history import batch_duplicates

    kb, new = table(spark, sf, "kb_document"), table(spark, sf, "incoming_document")
    return batch_duplicates(kb, new, "record_id", "page_content", "batch_no", 0.6, "chars", 5).select("record_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    from .houselines import repeated_lines

    return repeated_lines(table(spark, sf, "kb_document"), "record_id", "page_content", "source", 10, 0.3)


def p3_sequences(spark: SparkSession, sf: str) -> DataFrame:
    from .houselines import frequent_sequences

    return frequent_sequences(table(spark, sf, "kb_document"), "record_id", "page_content", "source", 10, 0.3)


def p3_clean(spark: SparkSession, sf: str) -> DataFrame:
    from .houselines import without_repeated_lines

    return without_repeated_lines(table(spark, sf, "kb_document"), "record_id", "page_content", "source", 10, 0.3)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    from .truncation import truncated

    return truncated(table(spark, sf, "case_row"), "seq", ["step", "expected"], "source").select("seq", "field")


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    from .truncation import truncation_report

    return truncation_report(table(spark, sf, "case_row"), "seq", ["step", "expected"], "source")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    from .scans import scan_noise

    return scan_noise(table(spark, sf, "kb_document"), "record_id", "page_content", "source")


def p6_repaired(spark: SparkSession, sf: str) -> DataFrame:
    from .scans import repaired

    return repaired(table(spark, sf, "kb_document"), "record_id", "page_content", "source")


def p7_pieces(spark: SparkSession, sf: str) -> DataFrame:
    from .chop import split_oversized

    return split_oversized(table(spark, sf, "kb_document"), "record_id", "page_content", 1500, 300)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Records that the splitter cuts: every second piece is preceded by a first."""
    return p7_pieces(spark, sf).filter("piece_no = 1").select("record_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    from .leak import leaked_items

    return leaked_items(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_item"), "item_id", "text", 120).select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, sf: str) -> DataFrame:
    """Report by item: how many documents hold a passage of it."""
    return p8_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("documents"))


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from .mixing import mixed, public_ranks

    return mixed(table(spark, sf, "documents"), "doc_id", "text", "source", table(spark, sf, "mix_target"), *public_ranks())


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1]


def p10_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    from .perplexity import perplexity_bands

    return perplexity_bands(table(spark, sf, "documents"), "doc_id", "text")


def p10_share(spark: SparkSession, sf: str) -> DataFrame:
    from .repeats import repeated_share

    return repeated_share(table(spark, sf, "documents"), "doc_id", "text", 20)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_share(spark, sf).filter("share >= 0.3").select("doc_id")


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}
