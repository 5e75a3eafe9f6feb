"""Problem 7: cut oversized texts into pieces at natural boundaries, with an exact overlap.

Method: pointer doubling. Every boundary of a text is joined to its farthest
legal successor (the end of the next piece, overlap included); squaring that
successor table marks all greedy cuts in log(pieces) passes. Each text has its own
table, texts are handled where they are and never cross a shuffle.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import codes, passes

# Characters after which a sentence, and after which a clause or word, ends.
SENTENCE_ENDS = "\n。！？!?；;…"
CLAUSE_ENDS = " ，、,:：)）]】”’\t　"


@lru_cache(maxsize=1)
def boundary_table() -> np.ndarray:
    """By code point: 2 behind a sentence, 1 behind a clause or word, else 0."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    out[[ord(c) for c in CLAUSE_ENDS]] = 1
    out[[ord(c) for c in SENTENCE_ENDS]] = 2
    return out


def successors(nodes: np.ndarray, strong: np.ndarray, step: int) -> np.ndarray:
    """Index of each node's successor within (position, position + step]: the farthest strong
    boundary, else the farthest weak one. Nodes are sorted and no two neighbours lie more than step apart."""
    last = np.searchsorted(nodes, nodes + step, "right") - 1
    prior = np.maximum.accumulate(np.where(strong, np.arange(len(nodes)), -1))
    best = prior[last]
    return np.where(best > np.arange(len(nodes)), best, last)


def cuts(cp: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """Ends of the pieces of one text of code points, the last end being its length."""
    n, step = len(cp), limit - overlap
    if n <= limit:
        return np.array([n])
    kind = boundary_table()[cp]
    # A boundary lies behind its character; positions up to the overlap can't end a piece.
    # A full stop ends a sentence only before white space, so numbers and names stay whole.
    dot = np.zeros(n, bool)
    dot[:-1] = (cp[:-1] == ord(".")) & (cp[1:] <= 32)
    s = np.flatnonzero((kind == 2) | dot) + 1
    w = np.flatnonzero(kind == 1) + 1
    natural = np.union1d(s, w)
    natural = natural[(natural > overlap) & (natural < n)]
    marks = np.concatenate([[overlap], natural, [n]])
    # Where no boundary lies within one step, cut hard: nodes every step from the gap's start.
    gap = (np.diff(marks) - 1) // step
    owner = np.repeat(np.arange(len(gap)), gap)
    hard = marks[owner] + step * (np.arange(len(owner)) - np.repeat(np.cumsum(gap) - gap, gap) + 1)
    nodes = np.union1d(marks, hard)
    strong = np.isin(nodes, s) | (nodes == n)
    jump = successors(nodes, strong, step)
    reached = np.zeros(len(nodes), bool)
    reached[0] = True
    while not reached[-1]:  # reached holds all cuts fewer than 2^k pieces from the start
        reached[jump[reached]] = True
        jump = jump[jump]
    reached[0] = False
    return nodes[reached]


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 1500, overlap: int = 300) -> DataFrame:
    """Pieces (key, piece_no, start, end, piece) of the texts longer than limit code points.

    Each piece has at most limit code points, the next one starts overlap before
    its end, and cuts fall behind the last sentence end in reach, else behind the last clause or
    word end, else at the limit. Null, empty and short texts give no piece; repeated rows give their pieces each.
    Needs 0 <= overlap < limit."""
    if not 0 <= overlap < limit:
        raise ValueError("0 <= overlap < limit is needed")

    def run(batches):
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in passes(texts):
                rows, no, start, end, piece = [], [], [], [], []
                cp, off = codes(texts[lo:hi])
                for i in range(hi - lo):
                    own = cp[off[i] : off[i + 1]]
                    ends = cuts(own, limit, overlap)
                    if len(ends) < 2:
                        continue
                    t = texts[lo + i]
                    for k, e in enumerate(ends.tolist()):
                        at = 0 if not k else int(ends[k - 1]) - overlap
                        rows.append(lo + i)
                        no.append(k)
                        start.append(at)
                        end.append(e)
                        piece.append(t[at:e])
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(piece, pa.string())],
                    names=["key", "piece_no", "start", "end", "piece"],
                )

    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("piece_no", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("piece", T.StringType())])
    long = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") > limit)
    return long.mapInArrow(run, schema).withColumnRenamed("key", key)
