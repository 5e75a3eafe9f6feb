"""Problem 10: repetition inside one document.

repeated_share measures it exactly: a letter is repeated if it lies in a run of
letters of a given width that also starts earlier in the same text. The method
named for the problem, n-gram perplexity, is in perplexity.py; it rates how
usual a text is for its language and can't tell this share, so the share is
measured here (see README).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import kept, passes, windows


def repeated_letters(h: np.ndarray, n: int, width: int) -> int:
    """How many of n letters lie in a window (hashes h) that equals an earlier one."""
    if len(h) < 2:
        return 0
    order = np.sort(h)
    if not (order[1:] == order[:-1]).any():
        return 0
    at = np.argsort(h, kind="stable")
    again = at[1:][h[at][1:] == h[at][:-1]]
    edge = np.zeros(n + 1, np.int32)
    edge[again] += 1
    np.subtract.at(edge, again + width, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def repeated_share(df: DataFrame, key: str, text: str, width: int = 20) -> DataFrame:
    """(key, letters, repeated, share) of every row with a text that isn't null.

    Letters are those of the lower-cased text, all else is ignored. A text without letters has share 0;
    rows with null texts are left out; equal rows each give theirs."""

    def run(batches):
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in passes(texts):
                cp, off = kept(texts[lo:hi], "L")
                h, hoff = windows(cp, off, width)
                n = np.diff(off)
                again = [repeated_letters(h[hoff[i] : hoff[i + 1]], int(n[i]), width) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(again, pa.int64()), pa.array(np.array(again) / np.maximum(1, n), pa.float64())],
                    names=["key", "letters", "repeated", "share"],
                )

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("letters", T.LongType()), T.StructField("repeated", T.LongType()), T.StructField("share", T.DoubleType())])
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null").mapInArrow(run, schema).withColumnRenamed("key", key)
