"""The manifest of processed files: latest state, change detection, upsert, build status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .incremental import plain_path


def change_hash(modified: Column, length: Column, content: Column) -> Column:
    """Cheap hash of a file: time, size and its first 1,024 bytes."""
    return F.md5(F.concat(modified.cast("string"), F.lit("_"), length.cast("string"), F.md5(F.substring(content, 1, 1024))))


def latest(state: DataFrame) -> DataFrame:
    """One row a path: the one processed last; of equal times the greater hash."""
    row = F.max(F.struct("processed_at", "hash", "size", "image_processed")).alias("r")
    return state.filter("path is not null").groupBy(plain_path(F.col("path")).alias("path")).agg(row).select("path", "r.*")


def changed(files: DataFrame, state: DataFrame, images: bool = False) -> DataFrame:
    """Files (path, hash) that are new, have another hash, or, with images on, were processed without."""
    known = latest(state).select("path", F.col("hash").alias("known"), "image_processed")
    other = F.col("known").isNull() | (F.col("known") != F.col("hash"))
    if images:
        other = other | ~F.coalesce("image_processed", F.lit(False))
    return files.join(known, "path", "left").filter(other).select(*files.columns)


def upserted(state: DataFrame, new: DataFrame) -> DataFrame:
    """The manifest with the rows of new in place of theirs."""
    return state.join(new.select("path"), "path", "left_anti").unionByName(new)


def without_source(chunks: DataFrame, source: str) -> DataFrame:
    """Chunks but for those of one file: explicit deletion, also of superseded versions."""
    return chunks.filter(~F.coalesce(F.col("source") == source, F.lit(False)))


def build_status(files: DataFrame, state: DataFrame) -> DataFrame:
    """(files, indexed, status): 'empty' without files, 'none', 'partial' or 'built'."""
    a = files.agg(F.countDistinct("path").alias("files"))
    b = state.filter("path is not null").agg(F.countDistinct("path").alias("indexed"))
    status = F.when(F.col("files") == 0, "empty").when(F.col("indexed") == 0, "none").when(F.col("indexed") < F.col("files"), "partial").otherwise("built")
    return a.crossJoin(b).withColumn("status", status)  # one row each
