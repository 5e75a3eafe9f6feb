"""Problem 10, the method named: n-gram perplexity with language-specific bands.

A character trigram model with modified Kneser-Ney smoothing. Spark counts all
texts; a trigram of code points packs into one 63-bit number, so counts, contexts
and continuations are bit arithmetic on longs. The model is stored in sorted
arrays and looked up by binary search. Documents whose perplexity leaves the
band of their language are rejected: below it they repeat or copy, above it they are noise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .kernel import codes, passes

# Bits of a code point, and masks of the last one and two of a packed n-gram.
BITS = 21
LAST, LAST2 = (1 << BITS) - 1, (1 << 2 * BITS) - 1
# N-grams of either order that the stored model may have (12 and 16 bytes each when broadcast); contexts and
# ends of kept trigrams stay beside them. All texts are counted. Beyond this the rarest are left to the lower order, and the back-off weights
# are computed anew, so every distribution still sums to 1. Unigrams are at most the characters of Unicode.
MOST_TRIGRAMS, MOST_BIGRAMS = 4_000_000, 2_000_000
SPACE, DIGIT = ord(" "), ord("0")


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points with ASCII digits as 0 and white space as blanks."""
    cp, off = codes([t.lower() for t in texts])
    cp = cp.astype(np.int64)
    cp[(cp >= 48) & (cp <= 57)] = DIGIT
    cp[cp <= 32] = SPACE
    return cp, off


def trigrams(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed trigrams inside the texts, and their offsets by text."""
    n = np.maximum(0, np.diff(off) - 2)
    new = np.zeros(len(off), np.int64)
    np.cumsum(n, out=new[1:])
    if not new[-1]:
        return np.zeros(0, np.int64), new
    g = (cp[:-2] << 2 * BITS) | (cp[1:-1] << BITS) | cp[2:]
    return g[np.arange(new[-1]) + np.repeat(off[:-1] - new[:-1], n)], new


def trigram_counts(df: DataFrame, text: str) -> DataFrame:
    """(g, n) over all texts; each pass is summed before it leaves its worker."""

    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in passes(texts):
                g, n = np.unique(trigrams(*normal(texts[lo:hi]))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], names=["g", "n"])

    return df.select(F.col(text).alias("t")).filter("t is not null").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame, n: str) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney, from the counts of counts 1 to 4."""
    c = {r[0]: r[1] for r in counts.filter(F.col(n) <= 4).groupBy(n).count().collect()}
    c = [c.get(i, 0) for i in range(1, 5)]
    if not all(c):
        return 0.5, 0.75, 0.9  # too few texts to estimate
    y = c[0] / (c[0] + 2 * c[1])
    return tuple(min(i - 1e-3, max(0.05, i - (i + 1) * y * c[i] / c[i - 1])) for i in (1, 2, 3))


def smoothed(grams: DataFrame, lower: DataFrame, d: tuple[float, float, float], lower_bits: int) -> DataFrame:
    """(g, n, ctx, lp, lp_low): interpolated log probabilities of n-grams (g, n), and those of their ends in the lower order."""
    disc = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    own = grams.withColumns({"ctx": F.shiftright("g", BITS), "low": F.col("g").bitwiseAND(F.lit(lower_bits))})
    ctx = own.groupBy("ctx").agg(F.sum("n").alias("s"), F.sum(disc).alias("freed")).select("ctx", "s", (F.col("freed") / F.col("s")).alias("back"))
    lp = F.log((F.col("n") - disc) / F.col("s") + F.col("back") * F.exp("lp_low"))
    return own.join(ctx, "ctx").join(lower.select(F.col("g").alias("low"), F.col("lp").alias("lp_low")), "low").select("g", "n", "ctx", lp.alias("lp"), "lp_low")


def most_frequent(grams: DataFrame, most: int) -> DataFrame:
    """The n-grams with the greatest n, at most `most` of them; those of the last count that fits in part are drawn by their hash."""
    total = grams.count()
    if total <= most:
        return grams
    # The least count whose n-grams all fit, by bisection: one number a pass comes to the driver.
    low, high = 1, int(grams.agg(F.max("n")).first()[0]) + 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if grams.filter(F.col("n") >= mid).count() <= most else (mid, high)
    room = most - grams.filter(F.col("n") >= high).count()
    return grams.filter(F.col("n") >= high).unionByName(grams.filter(F.col("n") == low).orderBy(F.xxhash64("g"), "g").limit(room))


def back_off(kept: DataFrame) -> DataFrame:
    """(g, lb): log weights with which the contexts g of kept n-grams (ctx, lp, lp_low) leave what they don't hold to the lower order."""
    left = lambda c: F.greatest(1 - F.sum(F.exp(c)), F.lit(1e-9))
    return kept.groupBy(F.col("ctx").alias("g")).agg(F.log(left("lp") / left("lp_low")).alias("lb"))


class Model:
    """Sorted arrays of a trigram model; picklable, so it is broadcast once."""

    def __init__(self, tri: pa.Table, bi: pa.Table, uni: pa.Table, unseen: float):
        col = lambda t, c: t.column(c).to_numpy()
        self.g3, self.p3 = self._sorted(col(tri, "g"), col(tri, "lp"))
        self.g2, self.p2, self.b3 = self._sorted(col(bi, "g"), col(bi, "lp"), np.nan_to_num(col(bi, "lb")))
        self.g1, self.p1, self.b2 = self._sorted(col(uni, "g"), col(uni, "lp"), np.nan_to_num(col(uni, "lb")))
        self.unseen = unseen

    @staticmethod
    def _sorted(g, *values):
        order = np.argsort(g)
        return [np.ascontiguousarray(g[order]), *(v[order].astype(np.float32) for v in values)]

    @staticmethod
    def _at(g, values, wanted, default):
        if not len(g):
            return np.full(len(wanted), default, np.float32), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(g, wanted), len(g) - 1)
        hit = g[at] == wanted
        return np.where(hit, values[at], np.float32(default)), hit

    def log_p(self, g: np.ndarray) -> np.ndarray:
        lp, hit = self._at(self.g3, self.p3, g, 0)
        miss = np.flatnonzero(~hit)
        if len(miss):
            m = g[miss]
            back, _ = self._at(self.g2, self.b3, m >> BITS, 0)
            p2, hit2 = self._at(self.g2, self.p2, m & LAST2, 0)
            p1, _ = self._at(self.g1, self.p1, m & LAST, self.unseen)
            b2, _ = self._at(self.g1, self.b2, (m >> BITS) & LAST, 0)
            lp[miss] = back + np.where(hit2, p2, b2 + p1)
        return lp


def train(df: DataFrame, text: str) -> Model:
    """Count all texts and smooth. The driver receives the finished model alone, of bounded size."""
    tri = cut(trigram_counts(df, text))
    bi = cut(tri.groupBy(F.col("g").bitwiseAND(F.lit(LAST2)).alias("g")).agg(F.count("*").alias("n")))
    uni = cut(bi.groupBy(F.col("g").bitwiseAND(F.lit(LAST)).alias("g")).agg(F.count("*").alias("n")))
    total = uni.agg(F.sum("n"), F.count("*")).first()
    if not total[0]:
        empty = pa.table({"g": pa.array([], pa.int64()), "lp": pa.array([], pa.float64()), "lb": pa.array([], pa.float64())})
        return Model(empty, empty, empty, 0.0)
    lp1 = uni.select("g", F.log(F.col("n") / F.lit(float(total[0]))).alias("lp"))
    two = cut(smoothed(bi, lp1, discounts(bi, "n"), LAST))
    three = cut(most_frequent(cut(smoothed(tri, two, discounts(tri, "n"), LAST2)), MOST_TRIGRAMS))
    lb3 = cut(back_off(three))
    # Contexts and ends of the kept trigrams stay, so that their weights and lower orders are those the model looks up.
    ends = three.select(F.col("g").bitwiseAND(F.lit(LAST2)).alias("g"))
    often = cut(most_frequent(two, MOST_BIGRAMS).select("g").unionByName(lb3.select("g")).unionByName(ends).distinct())
    two_kept = cut(two.join(often.hint("merge"), "g", "left_semi"))
    stored = two_kept.join(lb3, "g", "left").select("g", "lp", "lb")
    return Model(three.select("g", "lp").toArrow(), stored.toArrow(), lp1.join(back_off(two_kept), "g", "left").toArrow(), float(-np.log(2.0 * total[0])))


def perplexities(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, language, perplexity) of the rows with text. language is 'han' where a third of the letters are Han, else
    'latin' (the column lang is at times wrong). A text of fewer than 3 characters has a null perplexity."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in passes(texts):
                cp, off = normal(texts[lo:hi])
                g, goff = trigrams(cp, off)
                total = np.concatenate([[0.0], np.cumsum(sent.value.log_p(g), dtype=np.float64)])
                n = np.diff(goff)
                with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                    ppl = np.exp(-(total[goff[1:]] - total[goff[:-1]]) / n)
                count = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[off])
                han = count((cp >= 0x3400) & (cp <= 0x9FFF))
                other = count((cp >= 97) & (cp <= 122))
                lang = np.where(han * 2 >= np.maximum(1, other), "han", "latin")
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), pa.array(lang), pa.array(ppl, mask=n == 0)], names=["key", "language", "perplexity"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("language", T.StringType()), T.StructField("perplexity", T.DoubleType())])
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null").mapInArrow(run, schema).withColumnRenamed("key", key)


def perplexity_bands(df: DataFrame, key: str, text: str, spread: float = 4.0) -> DataFrame:
    """(key, language, perplexity, low, high, verdict): verdict is 'low', 'high' or 'kept'.

    A language's band is its median log perplexity plus and minus spread times the median absolute deviation (as a
    standard deviation). Null texts give no row, texts without a trigram and an undefined perplexity are 'kept'."""
    rated = cut(perplexities(df, key, text, train(df, text)))
    lp = F.log("perplexity")
    mid = rated.groupBy("language").agg(F.percentile_approx(lp, 0.5, 10000).alias("mid"))
    with_mid = rated.join(F.broadcast(mid), "language")  # a row a language
    dev = with_mid.groupBy("language").agg((F.percentile_approx(F.abs(lp - F.col("mid")), 0.5, 10000) * 1.4826).alias("dev"))
    out = with_mid.join(F.broadcast(dev), "language").withColumns({"low": F.exp(F.col("mid") - spread * F.col("dev")), "high": F.exp(F.col("mid") + spread * F.col("dev"))})
    verdict = F.when(F.col("perplexity") < F.col("low"), "low").when(F.col("perplexity") > F.col("high"), "high").otherwise("kept")
    return out.select(key, "language", "perplexity", "low", "high", verdict.alias("verdict"))
