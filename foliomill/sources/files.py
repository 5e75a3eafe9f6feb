"""Documents from a directory tree: binaryFile scan, suffix routing, decoding and office parsers."""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename
from ..plugins import VisionClient
from ..rules import DECODERS, SUFFIXES
from ..session import ship
from . import office

SCHEMA = "source string, file_hash string, size long, modified_at timestamp, type string, part int, page_content string, table_count int, error string"
# Formats that need software not bundled here; a parser registered in office.PARSERS takes them over.
UNSUPPORTED = (".doc", ".xls", ".ppt", ".vsd", ".pdf")


def scan(spark: SparkSession, path: str | list[str], suffixes=SUFFIXES) -> DataFrame:
    """Files below a path, or of a list of paths, by lower-cased suffix, with their bytes; reading only other columns doesn't load them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract(basename(F.col("path")), r"(\.[^.]+)$", 1))
    return files.withColumn("suffix", suffix).filter(F.col("suffix").isin(*suffixes))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, size, modified), newest first."""
    return scan(spark, path).select(basename(F.col("path")).alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "path")


def decode(content: bytes) -> str:
    for name in DECODERS:
        try:
            return content.decode(name).removeprefix("﻿")
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


def parts_of(suffix: str, content: bytes) -> list[dict]:
    """The documents of one file: one, or for CSV one a row."""
    if suffix in office.PARSERS:
        return [office.PARSERS[suffix](content)]
    if suffix in UNSUPPORTED:
        raise ValueError(f"no parser for {suffix}")
    text = decode(content)
    if suffix == ".csv":
        rows = csv.DictReader(io.StringIO(text))
        return [{"text": "\n".join(f"{k}: {v}" for k, v in r.items() if k is not None), "type": "csv", "table_count": 0} for r in rows]
    return [{"text": text, "type": suffix[1:], "table_count": 0}]


def load_documents(spark: SparkSession, path: str | list[str], version: str | None = None, only: DataFrame | None = None, vision: VisionClient | None = None) -> DataFrame:
    """A row a document part: source, file_hash (MD5 of the content), version, text. A file that can't be parsed gives one row
    with the error and a null text; nothing stops the others. only: (path) of the files wanted. vision describes the
    images of a document; each gets a numbered line behind its text."""
    ship(spark)

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                base = {"source": r["path"], "file_hash": r["file_hash"], "size": r["length"], "modified_at": r["modificationTime"]}
                try:
                    for k, d in enumerate(parts_of(r["suffix"], r["content"])):
                        if vision is not None and r["suffix"] == ".docx":
                            d["text"] += office.image_block([vision.describe(image) for _, image in office.docx_images(r["content"])])
                        rows.append(base | {"type": d["type"], "part": k, "page_content": d["text"], "table_count": d["table_count"], "error": None})
                except Exception as x:  # noqa: BLE001 - any damage of a file is reported as its row
                    rows.append(base | {"type": r["suffix"][1:], "part": 0, "page_content": None, "table_count": 0, "error": f"{type(x).__name__}: {x}"[:200]})
            kinds = {"source": pa.string(), "file_hash": pa.string(), "size": pa.int64(), "modified_at": pa.timestamp("us", "UTC"), "type": pa.string(), "part": pa.int32(), "page_content": pa.string(), "table_count": pa.int32(), "error": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in kinds.items()], names=list(kinds))

    found = scan(spark, path)
    found = found.join(only, "path", "left_semi") if only is not None else found
    files = found.withColumn("file_hash", F.md5("content")).select("path", "file_hash", "length", "modificationTime", "suffix", "content")
    stamp = F.lit(version) if version else F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")
    return files.mapInArrow(run, SCHEMA).withColumn("version", stamp)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files in the JVM alone: (source, page_content)."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("page_content"))
