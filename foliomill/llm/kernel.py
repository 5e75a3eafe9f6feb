"""Vectorised text kernels shared by the operators of this subpackage.

Texts of one Arrow batch are laid end to end as code points, so hashing,
window scans and per-document reductions run as whole-array numpy calls.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
# Characters handled by one numpy pass: bounds the memory of a Python worker whatever the length of texts.
PASS_CHARS = 1_500_000


@lru_cache(maxsize=4)
def category_table(kinds: str) -> np.ndarray:
    """Boolean table by code point: is the general category one of kinds (L letters, N numbers)?"""
    out = np.zeros(sys.maxunicode + 1, bool)
    # Letters and numbers are assigned in planes 0 to 3 only.
    out[:0x40000] = [unicodedata.category(chr(c))[0] in kinds for c in range(0x40000)]
    return out


@lru_cache(maxsize=1)
def wide_table() -> np.ndarray:
    """Columns by code point: 2 for wide and full-width characters, else 1."""
    out = np.ones(sys.maxunicode + 1, np.uint8)
    out[:0x40000] = [1 + (unicodedata.east_asian_width(chr(c)) in "WF") for c in range(0x40000)]
    return out


def passes(texts: list, weight=len) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most PASS_CHARS characters each (one text may exceed it alone)."""
    start = size = 0
    for i, t in enumerate(texts):
        n = 0 if t is None else weight(t)
        if i > start and size + n > PASS_CHARS:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the n + 1 offsets of the texts."""
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), off


def kept(texts: list[str], kinds: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of the characters of the given categories, and the offsets."""
    cp, off = codes([t.lower() for t in texts])
    mask = category_table(kinds)[cp]
    before = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(mask, out=before[1:])
    return cp[mask], before[off]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(29))
    h = h * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def window_hashes(cp: np.ndarray, width: int) -> np.ndarray:
    """Hash of the width characters from each position; combines powers of two, so log(width) passes."""
    h = mix((cp.astype(U) + U(1)) * BASE)
    out, done, power = None, 0, U(1)
    block, size, base = h, 1, BASE
    with np.errstate(over="ignore"):
        left = width
        while left:
            if left & 1:
                # out covers the first `done` characters of the window, block the next `size`
                out = block if out is None else out[: len(block) - done] * base + block[done:] if len(block) > done else block[:0]
                done += size
            left >>= 1
            if left:
                block = block[: max(0, len(block) - size)] * base + block[size:]
                size, base = size * 2, base * base
    return mix(out[: max(0, len(cp) - width + 1)])


def windows(cp: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes that stay inside their text, and their offsets by text."""
    n = np.maximum(0, np.diff(off) - width + 1)
    new = np.zeros(len(off), np.int64)
    np.cumsum(n, out=new[1:])
    if not len(cp) or not new[-1]:
        return np.zeros(0, U), new
    h = window_hashes(cp, width)
    at = np.arange(new[-1]) + np.repeat(off[:-1] - new[:-1], n)
    return h[at], new


def word_windows(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Like windows, over lower-cased words: runs of letters and digits, each CJK character a word of its own."""
    import regex

    pat = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[\p{L}\p{N}]+?(?=[\p{Han}\p{Hiragana}\p{Katakana}]|[^\p{L}\p{N}]|$)")
    words = [pat.findall(t.lower()) for t in texts]
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=off[1:])
    flat = [x for w in words for x in w]
    if not flat:
        return np.zeros(0, U), off * 0
    h = np.fromiter((stable_hash(x) for x in flat), U, len(flat))
    n = np.maximum(0, np.diff(off) - width + 1)
    new = np.zeros(len(off), np.int64)
    np.cumsum(n, out=new[1:])
    if not new[-1]:
        return np.zeros(0, U), new
    out = h[: len(h) - width + 1].copy()
    with np.errstate(over="ignore"):
        for j in range(1, width):
            out = out * BASE + h[j : len(h) - width + 1 + j]
    at = np.arange(new[-1]) + np.repeat(off[:-1] - new[:-1], n)
    return mix(out[at]), new


@lru_cache(maxsize=200_000)
def stable_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
