"""Problem 8: evaluation texts inside a training corpus.

Method: q-gram lemma filtering. The q-grams of the evaluation texts, in blocks
of bounded size, go to all executors; every corpus text is scanned once a
block. Shared q-grams are counted in overlapping diagonal bands, regions that
meet the bound of the edit budget are kept and verified by banded alignment.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import U, kept, passes, windows

# Characters of evaluation text held by one block: its index takes about 24 bytes a character.
BLOCK_CHARS = 4_000_000
BITS = 24


class Index:
    """Sorted q-gram hashes of a block of items, with item and position of each, behind a bitmap."""

    def __init__(self, ids: list, texts: list[str], q: int):
        self.ids = ids
        self.cp, self.off = kept(texts, "LN")
        h, hoff = windows(self.cp, self.off, q)
        item = np.repeat(np.arange(len(ids)), np.diff(hoff))
        pos = np.arange(len(h)) - hoff[:-1][item]
        self.own, self.hoff = h, hoff
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.pos = h[order], item[order].astype(np.int32), pos[order].astype(np.int32)
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[self.h >> U(64 - BITS)] = True

        # How many q-grams equal each entry: a common one is the last to be looked up.
        first = np.searchsorted(self.h, self.h, "left")
        self.count = np.bincount(first, minlength=len(self.h))[first].astype(np.int32) if len(self.h) else np.zeros(0, np.int32)

    def rank(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first entry, number of entries) of each q-gram; 0 entries where the index lacks it."""
        at, n = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        if not len(self.h):
            return at, n
        near = np.flatnonzero(self.bitmap[h >> U(64 - BITS)])
        lo = np.minimum(np.searchsorted(self.h, h[near], "left"), len(self.h) - 1)
        hit = self.h[lo] == h[near]
        at[near[hit]], n[near[hit]] = lo[hit], self.count[lo[hit]]
        return at, n

    def candidates(self, h: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
        """(item, diagonal) of the places where `run` q-grams in a row of h may equal those of an item, each once.

        Any such run holds a whole block of half its length. Of a block all of whose q-grams the index knows, the rarest
        alone is looked up: text that many items share, or that repeats one character, is never expanded gram by gram."""
        at, n = self.rank(h)
        size = max(1, (run + 1) // 2)
        blocks = len(h) // size
        if not blocks:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        grid = n[: blocks * size].reshape(blocks, size)
        whole = np.flatnonzero((grid > 0).all(axis=1))
        spot = whole * size + grid[whole].argmin(axis=1)
        src = np.repeat(spot, n[spot])
        k = np.arange(len(src)) - np.repeat(np.cumsum(n[spot]) - n[spot], n[spot]) + np.repeat(at[spot], n[spot])
        both = np.unique(np.stack([self.item[k].astype(np.int64), src - self.pos[k]]), axis=1)
        return both[0], both[1]

    def grams(self, i: int) -> np.ndarray:
        """The q-grams of an item, in order of position."""
        return self.own[self.hoff[i] : self.hoff[i + 1]]


def longest_run(x: np.ndarray, y: np.ndarray) -> int:
    """Longest common unbroken run of two equally long arrays, position by position."""
    miss = np.flatnonzero(np.concatenate([[True], x != y, [True]]))
    return int(np.diff(miss).max() - 1) if len(miss) > 1 else 0


def aligned(x: np.ndarray, y: np.ndarray, shift: int, width: int, least: int, edits: int) -> bool:
    """Banded alignment: has x a stretch of at least `least` characters that turns into one of y with at
    most `edits` edits, on diagonals shift .. shift + width - 1 (position in x minus position in y)?

    Row by row over x, far[d, e] is the length of the longest stretch of x that ends here, on diagonal
    shift + d, with e edits."""
    far = np.zeros((width, edits + 1), np.int32)
    lanes = np.arange(width)
    for i in range(len(x)):
        j = i - (shift + lanes)
        inside = (j >= 0) & (j < len(y))
        same = inside & (y[np.clip(j, 0, len(y) - 1)] == x[i])
        new = np.zeros_like(far)
        new[same] = far[same] + 1
        if edits:
            miss = inside & ~same
            new[miss, 1:] = far[miss, :-1] + (far[miss, :-1] > 0)  # substitution
            drop = np.where(far[:-1, :-1] > 0, far[:-1, :-1] + 1, 0)  # a character of x alone: to the next diagonal
            new[1:, 1:] = np.maximum(new[1:, 1:], drop)
            for e in range(1, edits + 1):  # a character of y alone: to the diagonal before, once an edit
                np.maximum(new[:-1, e], new[1:, e - 1], out=new[:-1, e])
            np.maximum.accumulate(new, axis=1, out=new)
        far = new
        if far.max() >= least:
            return True
    return False


def regions(index: Index, cp: np.ndarray, h: np.ndarray, q: int, least: int, edits: int) -> list[tuple[int, int]]:
    """(item, q-grams shared in its best verified band) of one text.

    A stretch with at most `edits` edits has a part without any, of a length that is known; those parts give the diagonals.
    Around each the shared q-grams are counted in the band of diagonals that the edits can reach, bands with fewer than
    the lemma's bound are dropped, and the rest is verified."""
    need = max(1, least - q + 1 - q * edits)
    clear = (least - edits) // (edits + 1) - q + 1
    items, diags = index.candidates(h, clear)
    found: dict[int, int] = {}
    last = (-1, 0)
    for i, d in zip(items.tolist(), diags.tolist(), strict=True):
        if i in found or (edits and last[0] == i and d - last[1] < edits):
            continue  # bands overlap: the next starts before this one's reach ends
        last = (i, d)
        own = index.grams(i)
        # Diagonals d - edits .. d + 2 * edits: all that a stretch through d, or through a diagonal skipped above, can use.
        low, width = d - edits, 3 * edits + 1
        shared = np.zeros(len(h), np.int64)
        for k in range(low, low + width):
            lo, hi = max(0, k), min(len(h), k + len(own))
            if hi > lo:
                shared[lo:hi] += h[lo:hi] == own[lo - k : hi - k]
        if shared.sum() < need:
            continue
        y = index.cp[index.off[i] : index.off[i + 1]]
        if not edits:
            lo, hi = max(0, d), min(len(cp), d + len(y))
            ok = longest_run(cp[lo:hi], y[lo - d : hi - d]) >= least
        else:
            spots = np.flatnonzero(shared)
            lo, hi = max(0, int(spots[0]) - least - edits), min(len(cp), int(spots[-1]) + least + edits + q)
            ok = aligned(cp[lo:hi], y, low - lo, width, least, edits)
        if ok:
            found[i] = int(shared.sum())
    return list(found.items())


def item_blocks(items: DataFrame, key: str, text: str):
    """The evaluation set in blocks whose index has a bounded size, streamed to the driver one by one."""
    ids, texts, size = [], [], 0
    rows = items.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").toLocalIterator()
    for r in rows:
        if texts and size + len(r.t) > BLOCK_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.k)
        texts.append(r.t)
        size += len(r.t)
    if texts:
        yield ids, texts


def leaked_items(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, least: int = 120, edits: int = 0, q: int | None = None) -> DataFrame:
    """(doc key, item key, shared) for every document and item that share a stretch of at least `least` letters and
    digits (lower-cased, all else ignored) with at most `edits` edits; shared counts the q-grams of the best band.

    q is 24, or smaller where the edit budget asks for it, so that the lemma's bound stays above 0 and an unedited part holds a q-gram. Items and documents
    with null, empty or shorter texts never match; an item key that is null or repeated is reported as it is;
    an empty item table gives no rows."""
    q = q or max(4, min(24, least // (edits + 2)))
    if least - q + 1 - q * edits < 1 or (least - edits) // (edits + 1) < q:
        raise ValueError("the edit budget leaves no q-gram to count: choose a smaller q")
    spark = docs.sparkSession
    kinds = [docs.schema[doc_key].dataType, items.schema[item_key].dataType]
    schema = T.StructType([T.StructField("doc", kinds[0]), T.StructField("item", kinds[1]), T.StructField("shared", T.LongType())])
    source = docs.select(F.col(doc_key).alias("doc"), F.col(doc_text).alias("text")).filter(F.length("text") >= least - edits)
    out = None
    for ids, texts in item_blocks(items, item_key, item_text):
        block = spark.sparkContext.broadcast((ids, texts))
        part = source.mapInArrow(scanner(block, uuid.uuid4().hex, q, least, edits, pa_type(kinds[1])), schema)
        out = part if out is None else out.unionAll(part)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.withColumnsRenamed({"doc": doc_key, "item": item_key})


def pa_type(kind: T.DataType) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kind.simpleString()]


_INDEX: dict = {}


def scanner(block, name: str, q: int, least: int, edits: int, item_type: pa.DataType):
    def run(batches):
        if name not in _INDEX:
            _INDEX.clear()
            _INDEX[name] = Index(*block.value, q)
        index = _INDEX[name]
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in passes(texts):
                cp, off = kept(texts[lo:hi], "LN")
                h, hoff = windows(cp, off, q)
                hit = index.bitmap[h >> U(64 - BITS)]
                before = np.zeros(len(h) + 1, np.int64)
                np.cumsum(hit, out=before[1:])
                need = max(1, least - q + 1 - q * edits)
                rows, items, shared = [], [], []
                for i in np.flatnonzero(before[hoff[1:]] - before[hoff[:-1]] >= need):
                    for item, n in regions(index, cp[off[i] : off[i + 1]], h[hoff[i] : hoff[i + 1]], q, least, edits):
                        rows.append(lo + int(i))
                        items.append(index.ids[item])
                        shared.append(n)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), pa.array(items, item_type), pa.array(shared, pa.int64())], names=["doc", "item", "shared"])

    return run
