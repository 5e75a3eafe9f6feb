"""Sketches of piece sets and covering locality-sensitive keys over them."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U, kept, mix, passes, windows, word_windows

# One covering code: 7 slots, one for each non-zero 3-bit vector m; the mask of a non-zero 3-bit vector v holds the
# slots with <m, v> = 1. For any 2 slots there is a v orthogonal to both: its mask of 4 slots doesn't see them. So two
# rows of slots that differ in at most 2 places agree on all slots of some mask.
RADIUS, SLOTS = 2, 7
VECTORS = range(1, 1 << (RADIUS + 1))
MASKS = [[m - 1 for m in VECTORS if (m & v).bit_count() % 2] for v in VECTORS]
# One-bit sketch that weighs candidates before texts are fetched: bins, and its bytes.
BINS = 256
# Standard deviations below the threshold at which an estimate rules a pair out (about 1 in 10^8 of pairs at the threshold).
SIGMAS = 5.6


def multipliers(n: int, seed: int = 0x5EED) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def piece_windows(texts: list[str], pieces: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """pieces 'chars': runs of width letters and digits; 'words': runs of width words. Lower-cased."""
    return windows(*kept(texts, "LN"), width) if pieces == "chars" else word_windows(texts, width)


def min_slots(h: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """Min-hash rows (texts x n, 32 bits each) of texts that each have at least one piece."""
    out = np.empty((len(off) - 1, n), np.uint32)
    if len(out):
        short = (h >> U(32)).astype(np.uint32)
        with np.errstate(over="ignore"):
            for k, m in enumerate(multipliers(n)):
                out[:, k] = np.minimum.reduceat(short * m, off[:-1])
    return out


def one_bit(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One-permutation sketch: of each of BINS bins a bit of its least hash, and whether the bin is filled (texts x BINS / 4 bytes)."""
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    least = np.full(n * BINS, ~U(0))
    np.minimum.at(least, doc * BINS + (h & U(BINS - 1)).astype(np.int64), h >> U(8))
    full = (least != ~U(0)).reshape(n, BINS)
    bit = ((mix(least) & U(1)) == 1).reshape(n, BINS) & full
    return np.concatenate([np.packbits(bit, axis=1), np.packbits(full, axis=1)], axis=1)


def sketches(df: DataFrame, key: str, text: str, pieces: str, width: int, slots: int, pack: bool = False) -> DataFrame:
    """(key, digest, slots, bits, and packed if asked for: the compressed text) of the rows whose text has a piece; digest is of the letters and digits (or words),
    so rows with one digest have equal piece sets."""

    def run(batches):
        import xxhash

        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in passes(texts):
                part = texts[lo:hi]
                h, off = piece_windows(part, pieces, width)
                own = np.flatnonzero(np.diff(off))
                bounds = np.append(off[own], off[-1])
                digest = [xxhash.xxh3_128_digest(h[a:z].tobytes()) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
                rows = min_slots(h, bounds, slots)
                bits = one_bit(h, bounds)
                columns = {"key": keys.take(pa.array(own + lo)), "digest": pa.array(digest, pa.binary())}
                columns |= {c: pa.array([r.tobytes() for r in x], pa.binary()) for c, x in (("slots", rows), ("bits", bits))}
                if pack:
                    columns["packed"] = pa.array([compressed(part[i]) for i in own], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter("text is not null and text != ''").mapInArrow(run, "key long, digest binary, slots binary, bits binary" + ", packed binary" * pack)


def covering_keys(df: DataFrame, rounds: int) -> DataFrame:
    """(bucket, key): 7 covering keys for each of `rounds` codes of 7 slots; df has key and slots."""
    need = rounds * SLOTS

    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                n = len(b)
                if not n:
                    continue
                rows = np.frombuffer(b"".join(b.column("slots").to_pylist()), np.uint32).reshape(n, -1)[:, :need].astype(U)
                out = table_keys(rows, rounds)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.concat_arrays([b.column("key")] * len(out))], names=["bucket", "key"])

    return df.select("key", "slots").mapInArrow(run, "bucket long, key long")


def table_keys(rows: np.ndarray, rounds: int) -> list[np.ndarray]:
    """The covering keys of rows of slots, in order of round and mask."""
    out = []
    for r in range(rounds):
        for v, mask in enumerate(MASKS):
            x = np.full(len(rows), U(r * len(MASKS) + v + 1))
            for s in mask:
                x = mix(x * U(0xD6E8FEB86659FD93) + rows[:, r * SLOTS + s])
            out.append(x)
    return out


def likely(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Do the one-bit sketches (... x 2 x BINS / 64, 64 bits each) leave the threshold possible? Few filled bins widen the margin."""
    p = (1 + threshold) / 2
    both = x[..., 1, :] & y[..., 1, :]
    filled = np.bitwise_count(both).sum(axis=-1, dtype=np.int64)
    same = filled - np.bitwise_count((x[..., 0, :] ^ y[..., 0, :]) & both).sum(axis=-1, dtype=np.int64)
    # Bins that only one side fills lower the estimate of small sets, they never raise it: left out on both sides.
    return same >= filled * p - SIGMAS * np.sqrt(np.maximum(filled, 1) * p * (1 - p)) - 1


def grid(bits: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bits), U).reshape(len(bits), 2, BINS // 64)


def compared(df: DataFrame, rounds: int, threshold: float) -> DataFrame:
    """(a, b), a < b: the pairs of parts i and j of each bucket that the sketch does not rule out, only in the first bucket
    that both texts share. df: (bucket, i, j, part, key, slots, bits), a group for any two parts."""
    need = rounds * SLOTS

    def run(t):
        key, part = t.column("key").to_numpy(), t.column("part").to_numpy()
        bits = grid(t.column("bits").to_pylist())
        rows = np.frombuffer(b"".join(t.column("slots").to_pylist()), np.uint32).reshape(len(t), -1)[:, :need].astype(U)
        with np.errstate(over="ignore"):
            keys = np.stack(table_keys(rows, rounds), axis=1)
        bucket, i, j = (t.column(c)[0].as_py() for c in ("bucket", "i", "j"))
        bucket = np.array([bucket], np.int64).view(U)[0]
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        out = [np.zeros((2, 0), np.int64)]
        for lo in range(0, len(left), 64):
            x, y = np.nonzero(likely(bits[left[lo : lo + 64], None], bits[None, right], threshold))
            x, y = left[lo + x], right[y]
            if i == j:
                x, y = x[key[x] < key[y]], y[key[x] < key[y]]
            if not len(x):
                continue
            first = np.argmax(keys[x] == keys[y], axis=1)
            own = keys[x, first] == bucket
            a, b = key[x[own]], key[y[own]]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
        a, b = np.concatenate(out, axis=1)
        return pa.table({"a": a, "b": b})

    return df.select("bucket", "i", "j", "part", "key", "slots", "bits").groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def window_pairs(df: DataFrame, threshold: float) -> DataFrame:
    """(a, b): of each group (k, part) the pairs of an entry (side 0 old, side 1 of the batch) and an asking record (side 2)
    that the sketches leave possible; an entry of the batch must have the smaller key. df: (k, part, key, side, bits)."""

    def run(t):
        key, side = t.column("key").to_numpy(), t.column("side").to_numpy()
        bits = grid(t.column("bits").to_pylist())
        entries, asking = np.flatnonzero(side < 2), np.flatnonzero(side == 2)
        out = [np.zeros((2, 0), np.int64)]
        for lo in range(0, len(asking), 64):
            x, y = np.nonzero(likely(bits[asking[lo : lo + 64], None], bits[None, entries], threshold))
            a, b = entries[y], asking[lo + x]
            ok = (side[a] == 0) | (key[a] < key[b])
            out.append(np.stack([key[a[ok]], key[b[ok]]]))
        a, b = np.concatenate(out, axis=1)
        return pa.table({"a": a, "b": b})

    return df.select("k", "part", "key", "side", "bits").groupBy("k", "part").applyInArrow(run, "a long, b long")


def plausible(pairs: DataFrame, threshold: float, left: str = "bits_a", right: str = "bits_b") -> DataFrame:
    """Drop the pairs whose one-bit sketches rule the threshold out."""

    def run(batches):
        for b in batches:
            if not len(b):
                yield b.drop_columns([left, right])
                continue
            ok = likely(grid(b.column(left).to_pylist()), grid(b.column(right).to_pylist()), threshold)
            yield b.drop_columns([left, right]).filter(pa.array(ok))

    names = [f for f in pairs.schema.fields if f.name not in (left, right)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)
    ordered = pairs.select(*[f.name for f in names], left, right)
    return ordered.mapInArrow(run, schema)


def compressed(text: str) -> bytes:
    return zlib.compress(text.encode("utf-8", "surrogatepass"), 1)


def packed_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, packed): the texts compressed, for rows that must cross a shuffle."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([compressed(t) for t in b.column(1).to_pylist()], pa.binary())], names=["key", "packed"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter("text is not null").mapInArrow(run, "key long, packed binary")


def verified(pairs: DataFrame, pieces: str, width: int, threshold: float | None = None) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b, packed_a, packed_b): exact Jaccard of their piece sets; with a
    threshold only those that reach it."""

    def run(batches):
        known: dict[bytes, np.ndarray] = {}

        def sets(packed: list[bytes]) -> list[np.ndarray]:
            new = [p for p in dict.fromkeys(packed) if p not in known]
            if len(known) + len(new) > 4000:
                known.clear()
                new = list(dict.fromkeys(packed))
            texts = [zlib.decompress(p).decode("utf-8", "surrogatepass") for p in new]
            for lo, hi in passes(texts):
                h, off = piece_windows(texts[lo:hi], pieces, width)
                for i in range(hi - lo):
                    known[new[lo + i]] = np.unique(h[off[i] : off[i + 1]])
            return [known[p] for p in packed]

        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.slice(lo, 500)
                n = len(part)
                both = sets(part.column("packed_a").to_pylist() + part.column("packed_b").to_pylist())
                sim = np.zeros(n)
                for i, (x, y) in enumerate(zip(both[:n], both[n:], strict=True)):
                    if min(len(x), len(y)) >= (threshold or 0) * max(len(x), len(y)):
                        common = np.count_nonzero(np.diff(np.sort(np.concatenate([x, y]), kind='stable')) == 0)
                        sim[i] = common / max(1, len(x) + len(y) - common)
                out = pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(sim)], names=["a", "b", "similarity"])
                yield out if threshold is None else out.filter(pa.array(sim >= threshold))

    return pairs.select("a", "b", "packed_a", "packed_b").mapInArrow(run, "a long, b long, similarity double")
