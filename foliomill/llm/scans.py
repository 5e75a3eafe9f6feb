"""Problem 6: noise in text from scanned pages.

Method: pages of scanned sources are found by their hard-wrapped lines. Two
boosted line-pair classifiers handle joins and furniture: one tells which lines
continue one another and where a word is divided, one which edge lines are
titles or page numbers. Both are trained on clean texts of the same corpus,
wrapped and dressed as pages; fixed patterns are among their features. Words
and characters that clean text never shows get correction candidates through
inverted joins on character q-grams; a boosted ranker, trained on clean units
and on clean units damaged with the confusions mined from the corpus itself,
accepts or rejects them.

Counts, candidates and decisions cover all pages. Only the classifiers' training
is bounded: by TEXTS, SAMPLE and CONFUSIONS below.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .boost import Booster
from .kernel import codes, passes, stable_hash, wide_table
from .neardup import bounded

# Signs that divide a word at a line's end, marks that end a sentence, and forms of page numbers.
DIVIDERS = "-‐‑¬­"
STOPS = "。！？!?；;：:.”\"）)|"
NUMBER = r"[\dOolI]{1,4}"
PAGE_NUMBER = re.compile(rf"^(?:page|p|pg|no|seite)?[\s.]*{NUMBER}(?:\s*(?:of|/)\s*{NUMBER})?$|^[-–—·\[(（【~*|]+\s*{NUMBER}\s*[-–—·\])）】~*|]+$|^第\s*{NUMBER}\s*页(?:\s*[,，/]?\s*共\s*{NUMBER}\s*页)?$", re.I)
NUMBER_FORMS = ("{}", "- {} -", "[{}]", "·{}·", "Page {}", "P.{}", "p. {}", "Page {} of {}", "{} / {}", "第 {} 页", "第{}页 共{}页")
WORD = re.compile(r"[A-Za-z][A-Za-z]+")
COMPOUND = re.compile(r"(?<![A-Za-z])(?:(?<=-)[A-Za-z]{2,}|[A-Za-z]{2,}+(?=-))")
# A raw token may hold what the scan made of its letters.
RAW = re.compile(r"[A-Za-z0-9@!$|]+")
HAN = re.compile(r"[㐀-鿿]")
# What makes a page and a source look scanned, and where furniture stands (parameters of analysed).
WIDEST = 110  # columns that no line of a hard-wrapped page exceeds
SHARE = 0.4  # share of a source's records that must look scanned
EDGE = 3  # lines at each end of a page that may be furniture
BITS, LAST = 21, (1 << 21) - 1
# Bounds of the classifiers' training: clean texts for the line-pair classifiers, rows of either class for the rankers,
# and confusions that damage clean units. Samples are drawn in order of a hash, so they are the same in every run.
TEXTS, SAMPLE, CONFUSIONS = 300, 6000, 200
LEAST = 3  # times that clean text must show a candidate
VOTED = 3  # words that must show a confusion for it to damage words for the training


def widths(lines: list[str]) -> np.ndarray:
    """Columns that each line takes."""
    cp, off = codes(lines)
    upto = np.concatenate([[0], np.cumsum(wide_table()[cp], dtype=np.int64)])
    return upto[off[1:]] - upto[off[:-1]]


def letters(line: str) -> str:
    return "".join(c for c in line.lower() if c.isalpha())


def wrapped(lines: list[str], widest: int = WIDEST) -> bool:
    """Does a page look hard-wrapped: narrow, and full lines that stop inside a sentence?"""
    ends = [x.rstrip() for x in lines]
    wide = widths(ends)
    most = int(wide.max(initial=0))
    if most > widest:
        return False
    bar = max(34, 0.85 * most)
    full = pairs = 0
    for a, b, w in zip(ends, ends[1:], wide.tolist(), strict=False):
        if a and b and a.lstrip()[0] != "|":
            pairs += 1
            full += w >= bar and a[-1] not in STOPS
    return full >= 2 and full >= 0.3 * pairs


def surveyed(df: DataFrame, widest: int) -> DataFrame:
    """(s, scanned): whether each record of (s, text) looks scanned."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([wrapped(t.split("\n"), widest) for t in b.column(1).to_pylist()], pa.bool_())], names=["s", "scanned"])

    return df.select("s", "text").mapInArrow(run, "s long, scanned boolean")


# -- line pairs ---------------------------------------------------------------------------------------------------------


def divided(a: str, b: str) -> bool:
    """Does line a end in a dividing sign with what may be a word's rest at the start of line b?"""
    x, y = a.rstrip(), b.lstrip()
    if len(x) < 2 or not y or x[-1] not in DIVIDERS or not x[-2].isalpha() and x[-2] not in "@!01":
        return False
    # The hyphen of a code ("PO-1234") is part of it.
    return bool(re.match(r"[A-Za-z@!]|\d[A-Za-z]", y))


def pair_features(a: str, b: str, wide: float, wide_next: float, widest: int) -> list[float]:
    """What two lines in a row show: how full the first is, how it ends, how the second starts."""
    x, y = a.rstrip(), b.lstrip()
    first, last = y[:1], x[-1:]
    return [
        wide / max(1, widest), last in STOPS, last in "，,、", last in DIVIDERS, last.isalpha(), first.islower(), bool(HAN.match(first)) if first else 0, first.isupper(), first.isdigit(),
        first in "#*-|•（(", min(wide_next, 80) / max(1, widest), x.lstrip()[:1] in "#*-|•", len(b) - len(y), x[-2:-1].isalpha(), x[-2:-1].isspace(), y[1:2].isalpha(), divided(a, b),
    ]


def wrap(line: str, wide: int, rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """A line wrapped at a width, and how each piece goes on: 0 not, 1 between words, 2 inside a word, divided by a sign."""
    parts, kinds, now, w = [], [], "", 0
    for c in line:
        cw = int(wide_table()[ord(c)])
        if w + cw > wide:
            space, rest = now.rfind(" ") if c.isascii() else -1, ""
            if space > 0:
                now, rest = now[: space + 1], now[space + 1 :]
                # Some words are divided, as scans do.
                if len(rest) > 4 and rest.isalpha() and rng.random() < 0.5:
                    at = int(rng.integers(2, len(rest) - 1))
                    now, rest = now + rest[:at] + DIVIDERS[int(rng.integers(len(DIVIDERS)))], rest[at:]
                    kinds.append(2)
                else:
                    kinds.append(1)
            else:
                kinds.append(1)
            parts.append(now)
            now, w = rest, int(widths([rest])[0])
        now, w = now + c, w + cw
    return [*parts, now], [*kinds, 0]


class PagePairs:
    """The line-pair classifiers: joined(pairs), divided(pairs) and furniture(rows) give log odds. Trained on clean texts made into pages."""

    def __init__(self, texts: list[str], titles: list[str]):
        rng = np.random.default_rng(7)
        rows: list[list[float]] = []
        kinds: list[int] = []
        edges: list[list[float]] = []
        real: list[int] = []
        titles = titles or ["manual", "规程手册"]
        for t in texts:
            wide = 40 + stable_hash(t) % 28
            lines, goes = [], []
            for line in t.split("\n"):
                a, b = wrap(line, wide, rng)
                lines, goes = lines + a, goes + b
            w = widths([x.rstrip() for x in lines]).tolist()
            for k, g in enumerate(goes[:-1]):
                a, b = lines[k], lines[k + 1]
                if not a.strip() or not b.strip():
                    continue
                rows.append(pair_features(a, b, w[k], w[k + 1], wide))
                # A line broken behind a hyphen of its own is divided if letters go on.
                kinds.append(2 if g == 1 and divided(a, b) else g)
                # What looks like a divided word and is none: a stray dash at a line's end, a line broken inside a code.
                if g != 2 and rng.random() < 0.1:
                    rows.append(pair_features(f"{a.rstrip()} -", b, w[k] + 1, w[k + 1], wide))
                    kinds.append(g)
                for m in re.finditer(r"(?<=\w)-(?=\w)", a):
                    x, y = a[: m.end()], a[m.end() :]
                    rows.append(pair_features(x, y, *widths([x, y]).tolist(), wide))
                    kinds.append(2 if x[-2].isalpha() and y[0].isalpha() else 1)
            # Dress the text as a page: its own edges are no furniture, a damaged title and a number are.
            title = titles[stable_hash(t) % len(titles)]
            body = [x for x in lines if x.strip()]
            # Paragraphs' last lines may be as short as a title.
            short = [(b, a) for a, b, g in zip(lines, lines[1:], goes[1:], strict=False) if not g and a.strip() and b.strip()][:12]
            for x, y in [*zip(body[:EDGE] + body[-EDGE:], body[1 : EDGE + 1] + body[-EDGE - 1 : -1], strict=False), *short]:
                edges.append(edge_features(f"{x.rstrip()} -" if rng.random() < 0.3 else x, y, title, wide))
                real.append(0)
            for _ in range(2):
                number = "".join("Ool"[int(rng.integers(3))] if rng.random() < 0.05 else c for c in str(int(rng.integers(1, 400))))
                number = NUMBER_FORMS[int(rng.integers(len(NUMBER_FORMS)))].format(number, number)
                for x in (damaged(title, rng), number):
                    edges.append(edge_features(x, body[0] if body else "", title, wide))
                    real.append(1)
            if len(rows) > 4 * SAMPLE:
                break
        x, y = np.array(rows or [[0.0] * 17] * 2, float), np.array(kinds or [0, 1])
        signs = x[:, 3] > 0
        self._join = Booster(40).fit(x, y > 0)
        self._divide = Booster(20).fit(x[signs], y[signs] == 2) if len(set((y[signs] == 2).tolist())) == 2 else None
        self._edge = Booster(40).fit(np.array(edges or [[0.0] * 7] * 2, float), np.array(real or [0, 1]))

    def continues(self, features: list[list[float]]) -> np.ndarray:
        return self._join.score(np.array(features, float)) > 0 if features else np.zeros(0, bool)

    def divides(self, features: list[list[float]]) -> np.ndarray:
        """Is a word divided? Only where the first line ends in a dividing sign."""
        if not features:
            return np.zeros(0, bool)
        x = np.array(features, float)
        return (x[:, 3] > 0) & (self._divide.score(x) > 0 if self._divide else x[:, -1] > 0)

    def furniture(self, features: list[list[float]]) -> np.ndarray:
        return self._edge.score(np.array(features, float)) > 0 if features else np.zeros(0, bool)


def damaged(title: str, rng: np.random.Generator) -> str:
    """A title as a scan may show it: up to a third of its characters read wrongly."""
    out = list(title)
    for k in range(len(out)):
        if rng.random() < 0.12:
            out[k] = "iclo未口曰"[int(rng.integers(7))]
    return "".join(out)


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edge_features(line: str, other: str, title: str | None, widest: int) -> list[float]:
    """What an edge line and its neighbour show: how far it is from the source's title, whether it holds but a number, its
    size against the page's and the neighbour's."""
    x, y = line.strip(), other.strip()
    n = letters(x)
    far = 9.0
    # The difference in length bounds the distance from below, so long lines cost nothing.
    if title and n and abs(len(n) - len(title)) <= len(title):
        far = distance(n, title) / len(title)
    digits = sum(c.isdigit() for c in x)
    wide, wide_next = widths([x, y]).tolist()
    return [min(far, 1.0), bool(PAGE_NUMBER.match(x)), digits / max(1, len(x)), len(n) == 0, wide / max(1, widest), wide / max(1, wide_next), x[-1:] in STOPS]


def ending(norm: str) -> str:
    """What titles of one kind share: their last four Han characters, or their last eight letters."""
    return norm[-4:] if HAN.search(norm) else norm[-8:]


def edge_lines(pages: DataFrame, edge: int) -> DataFrame:
    """(key, s, line_no, line, next, norm, ending, number, widest): the lines at the ends of pages (key, s, text)."""
    kinds = {"key": pa.int64(), "s": pa.int64(), "line_no": pa.int32(), "line": pa.string(), "next": pa.string(), "norm": pa.string(), "ending": pa.string(), "number": pa.bool_(), "widest": pa.int32()}

    def run(batches):
        for b in batches:
            rows = []
            for key, s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines = t.split("\n")
                widest = int(widths([x.rstrip() for x in lines]).max(initial=1))
                full = [i for i, x in enumerate(lines) if x.strip()]
                spots = list(dict.fromkeys([*range(len(full))[:edge], *range(len(full))[-edge:]]))
                for p in spots:
                    # A head's neighbour is the line below, a foot's the line above.
                    near = full[p + 1] if p < edge and p + 1 < len(full) else full[p - 1] if p else None
                    line = lines[full[p]]
                    n = letters(line)
                    rows.append((key, s, full[p], line, lines[near] if near is not None else "", n, ending(n), bool(PAGE_NUMBER.match(line.strip())), widest))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds.values(), strict=True)], names=list(kinds))

    return pages.select("key", "s", "text").mapInArrow(run, "key long, s long, line_no int, line string, next string, norm string, ending string, number boolean, widest int")


def source_titles(lines: DataFrame) -> DataFrame:
    """(s, title): a source's title is the line most of its pages share at an edge, all but letters ignored; a source with one
    page takes an edge line that ends as the titles of other sources do."""
    shared = lines.filter("length(norm) >= 3 and not number").groupBy("s", "norm", "ending").agg(F.countDistinct("key").alias("n"), F.min("line_no").alias("at"))
    # Ties go to the line nearer to the page's top.
    titles = shared.filter("n >= 2").groupBy("s").agg(F.max(F.struct("n", (-F.col("at")).alias("at"), "norm", "ending")).alias("t")).select("s", "t.norm", "t.ending")
    kinds = titles.groupBy(F.xxhash64("ending").alias("e")).agg(F.count("*").alias("sources")).filter("sources >= 2").select("e")
    lone = shared.withColumn("e", F.xxhash64("ending")).join(titles.select("s"), "s", "left_anti").join(kinds, "e").groupBy("s").agg(F.min_by("norm", "at").alias("norm"))
    return titles.select("s", F.col("norm").alias("title")).unionByName(lone.withColumnRenamed("norm", "title"))


def furniture(lines: DataFrame, titles: DataFrame, model) -> DataFrame:
    """(key, line_no, kind) of the edge lines that the line-pair classifier takes for running headers and page numbers."""

    def judge(batches):
        for b in batches:
            d = b.to_pylist()
            hit = model.value.furniture([edge_features(r["line"], r["next"], r["title"], r["widest"]) for r in d])
            kept = [(r["key"], r["line_no"], "page_number" if r["number"] else "running_header") for r, h in zip(d, hit, strict=True) if h]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*kept, strict=True) if kept else [[]] * 3, (pa.int64(), pa.int32(), pa.string()), strict=True)], names=["key", "line_no", "kind"])

    return lines.join(bounded(titles), "s", "left").select("key", "line_no", "line", "next", "title", "widest", "number").mapInArrow(judge, "key long, line_no int, kind string")


def joined(lines: list[str], skip: set[int], breaks: set[int] | None = None) -> list[tuple[np.ndarray, str]]:
    """Lines as blocks of running text: (line number of each character, text); lines to skip don't interrupt a block.

    breaks: the lines whose last word goes on in the next one; by default all that look it."""
    blocks: list[tuple[np.ndarray, str]] = []
    parts: list[str] = []
    owners: list[int] = []
    last = -1

    def flush():
        if parts:
            blocks.append((np.repeat(np.array(owners), [len(p) for p in parts]), "".join(parts)))
        parts.clear()
        owners.clear()

    for i, line in enumerate(lines):
        if i in skip:
            continue
        s = line.strip()
        if not s:
            flush()
            continue
        if parts:
            end = parts[-1][-1]
            if end in DIVIDERS and (divided(parts[-1], s) if breaks is None else last in breaks):
                parts[-1] = parts[-1][:-1]
            elif not (HAN.match(end) or HAN.match(s[0]) or ord(end) > 0x2FFF):
                parts.append(" ")
                owners.append(i)
        parts.append(s)
        owners.append(i)
        last = i
    flush()
    return blocks


# -- units ---------------------------------------------------------------------------------------------------------------


def hyphened(text: str, start: int, end: int) -> bool:
    """Is text[start:end] part of a compound?"""
    return "-" in (text[max(0, start - 1) : start], text[end : end + 1])


def raw_tokens(text: str):
    """(start, token, in a compound) of the Latin tokens that may have been misread: at least three letters' room and no pure number or code."""
    for m in RAW.finditer(text):
        t = m.group().rstrip("!|$")
        if len(t) >= 3 and sum(c.isalpha() for c in t) * 2 >= len(t) and not (t.isupper() and len(t) <= 3):
            if m.start() and text[m.start() - 1] in "._/" or text[m.start() + len(t) : m.start() + len(t) + 1] in ("_", "/"):
                continue  # part of a name like t_batch.qty
            yield m.start(), t, hyphened(text, m.start(), m.start() + len(t))


def odd_inside(token: str) -> bool:
    """A sign or digit between letters: wrong whatever word was meant."""
    return bool(re.search(r"[A-Za-z][@!$|0-9]+[a-z]", token)) or bool(re.match(r"[@!$|][a-z]{2}", token))


def packed_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(position in the joined texts, packed trigram) around every Han character, digits as 0; texts are joined by newlines, so a
    text's edges have a newline as neighbour, as lines of clean text do. Positions count from the first text's start."""
    cp = codes(["\n" + "\n".join(texts) + "\n"])[0].astype(np.int64)
    cp[(cp >= 48) & (cp <= 57)] = 48
    at = np.flatnonzero((cp[1:-1] >= 0x3400) & (cp[1:-1] <= 0x9FFF))
    return at, (cp[at] << 2 * BITS) | (cp[at + 1] << BITS) | cp[at + 2]


def clean_counts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words (w, n, c), grams (g, n)) of the texts of clean records (a column t); c counts a word's uses in compounds."""

    def run(batches):
        for b in batches:
            words: Counter = Counter()
            inside: Counter = Counter()
            parts = [np.zeros(0, np.int64)]
            texts = b.column(0).to_pylist()
            for lo, hi in passes(texts):
                for t in texts[lo:hi]:
                    words.update(WORD.findall(t))
                    inside.update(COMPOUND.findall(t))
                parts.append(packed_grams(texts[lo:hi])[1])
            n: Counter = Counter()
            c: Counter = Counter()
            for counts, low in ((words, n), (inside, c)):
                for w, k in counts.items():
                    low[w.lower()] += k
            g, gn = np.unique(np.concatenate(parts), return_counts=True)
            columns = [[*n, *[None] * len(g)], [*[None] * len(n), *g.tolist()], [*n.values(), *gn.tolist()], [*(c.get(w, 0) for w in n), *[0] * len(g)]]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["w", "g", "n", "c"])

    both = cut(df.mapInArrow(run, "w string, g long, n long, c long").groupBy("w", "g").agg(F.sum("n").alias("n"), F.sum("c").alias("c")))
    return both.filter("w is not null").select("w", "n", "c"), both.filter("g is not null").select("g", "n")


def change(token: str, word: str) -> tuple[str, str]:
    """The differing middles of two strings."""
    p = 0
    while p < min(len(token), len(word)) and token[p] == word[p]:
        p += 1
    s = 0
    while s < min(len(token), len(word)) - p and token[-1 - s] == word[-1 - s]:
        s += 1
    return token[p : len(token) - s], word[p : len(word) - s]


def bigrams(word: str) -> list[str]:
    """The word's bigrams with its ends marked; a repeated one gets its number, so each counts once."""
    padded, seen = f"^{word}$", Counter()
    out = []
    for k in range(len(padded) - 1):
        q = padded[k : k + 2]
        seen[q] += 1
        out.append(q if seen[q] == 1 else f"{q}{seen[q]}")
    return out


# One change of up to two characters destroys at most three of a string's bigrams, so of any four one is left in both.
PREFIX = 4


def word_candidates(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, word, n, x, y): known words within a change x -> y of at most two characters a side, found by their shared q-grams.

    tokens: (token); words: (w, n). Each side enters the inverted join under its four rarest bigrams alone: strings that
    share all but three share one of these. So common bigrams, which would pair nearly everything, are never joined on.
    The join runs over distinct tokens and distinct words, so its size follows the vocabularies."""

    def grams(rare):
        def run(batches):
            for b in batches:
                rows, out = [], []
                for k, w in enumerate(b.column(0).to_pylist()):
                    g = sorted(bigrams(w), key=lambda q: (rare.value.get(q, 0), q))[:PREFIX]
                    rows += [k] * len(g)
                    out += [stable_hash(q) for q in g]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in b.columns), pa.array(np.array(out, np.uint64).view(np.int64))], names=[*b.schema.names, "q"])

        return run

    def counted(batches):
        for b in batches:
            n = Counter(q for w in b.column(0).to_pylist() for q in bigrams(w))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["q", "n"])

    # Pairs of some forty characters: a few thousand rows whatever the corpus.
    table = words.select("w").mapInArrow(counted, "q string, n long").groupBy("q").agg(F.sum("n").alias("n")).toArrow()
    rare = words.sparkSession.sparkContext.broadcast(dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True)))
    t = tokens.select("token").mapInArrow(grams(rare), "token string, q long")
    w = words.select(F.col("w").alias("word"), "n").mapInArrow(grams(rare), "word string, n long, q long")
    # The planner can't know how many q-grams a word gives nor how many pairs they make: the join is shuffled, never
    # broadcast, to as many tasks as the session asks for.
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = t.repartition(n, "q").join(w.repartition(n, "q").hint("merge"), "q").filter("abs(length(token) - length(word)) <= 1 and token != word")

    def check(batches):
        for b in batches:
            keep, xs, ys = [], [], []
            for k, (t, w) in enumerate(zip(b.column("token").to_pylist(), b.column("word").to_pylist(), strict=True)):
                x, y = change(t, w)
                if len(x) <= 2 and len(y) <= 2 and x and y:
                    keep.append(k)
                    xs.append(x)
                    ys.append(y)
            part = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(xs, pa.string()), pa.array(ys, pa.string())], names=["token", "word", "n", "x", "y"])

    return shared.select("token", "word", "n").mapInArrow(check, "token string, word string, n long, x string, y string").distinct()


def word_features(votes: int, n: int, token: str, x: str, y: str, cap: bool, compound: bool) -> list[float]:
    return [np.log1p(votes), np.log1p(n), len(token), any(not c.isalpha() for c in token), len(x) != len(y), cap, any(not c.isalpha() for c in x), compound]


def word_corrections(pages_tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, fix): misread Latin tokens, lower-cased, with the word they stand for. pages_tokens: (token, n, cap, compound);
    words: (w, n, c)."""
    known = words.filter(f"n >= {LEAST}")
    rare = words.filter("n <= 2 and length(w) >= 3").orderBy(F.xxhash64("w")).limit(SAMPLE).select(F.col("w").alias("token"), F.lit(False).alias("cap"), (F.col("c") == F.col("n")).alias("compound"), F.lit(True).alias("rare"))
    # Unknown tokens, and rare clean words, which are right as they stand: their candidates train the ranker.
    unknown = pages_tokens.join(words.select(F.col("w").alias("token")).hint("merge"), "token", "left_anti").select("token", "cap", "compound", F.lit(False).alias("rare"))
    asked = cut(unknown.unionByName(rare))
    found = cut(word_candidates(asked, known).join(asked.hint("merge"), "token"))
    # Clean text need not know the parts of compounds: letters alone there don't vote, and count as misread only by a
    # confusion that other tokens show in VOTED words.
    part = F.col("compound") & ~F.col("token").rlike("[^a-z]")
    pair = F.xxhash64("x", "y").alias("p")
    votes = cut(found.filter(~F.col("rare") & ~part).groupBy(pair, "x", "y").agg(F.countDistinct("word").alias("votes")))
    rated = cut(found.withColumn("p", pair).join(bounded(votes.select("p", "votes")), "p", "left").fillna(0, ["votes"]).filter(F.col("rare") | (F.col("votes") >= F.when(part, VOTED).otherwise(1))))
    # Confusions seen in many words damage clean words for the training. A damaged use is one in a compound as often as the word's uses are.
    frequent = [(r.x, r.y, r.votes) for r in votes.filter(f"votes >= {VOTED}").orderBy(F.desc("votes"), "x", "y").limit(CONFUSIONS).collect()]
    clean = known.orderBy(F.xxhash64("w")).limit(SAMPLE).toArrow().to_pylist()
    wrong = rated.filter("rare").orderBy(F.xxhash64("token", "word")).limit(SAMPLE).select("votes", "n", "token", "x", "y", "compound").toArrow().to_pylist()
    rows, labels = [], []
    for k, d in enumerate(clean):
        w, n = d["w"], d["n"]
        for x, y, v in frequent[k % 3 :: 3]:
            at = w.find(y)
            if at >= 0:
                rows.append(word_features(v, n, w[:at] + x + w[at + len(y) :], x, y, False, stable_hash(w) % n < d["c"]))
                labels.append(1)
                break
    for r in wrong:
        rows.append(word_features(r["votes"], r["n"], r["token"], r["x"], r["y"], False, r["compound"]))
        labels.append(0)
    model = Booster(40).fit(np.array(rows), np.array(labels)) if len(set(labels)) == 2 else None
    sent = rated.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for b in batches:
            if not len(b):
                continue
            x = np.array([word_features(r["votes"], r["n"], r["token"], r["x"], r["y"], bool(r["cap"]), bool(r["compound"])) for r in b.to_pylist()])
            s = sent.value.score(x) if sent.value else np.where(x[:, 6] > 0, 1.0, -1.0)
            # A sign or digit inside a word is never right, whatever the corpus has seen.
            s = np.where(x[:, 3] > 0, np.maximum(s, 1.0), s)
            yield pa.RecordBatch.from_arrays([b.column("token"), b.column("word"), pa.array(s)], names=["token", "fix", "score"])

    scored = rated.filter("not rare").select("token", "word", "n", "x", "y", "votes", "cap", "compound").mapInArrow(judge, "token string, fix string, score double").filter("score > 0")
    return scored.groupBy("token").agg(F.max_by("fix", F.struct("score", "fix")).alias("fix"))


def gram_corrections(page_grams: DataFrame, grams: DataFrame) -> DataFrame:
    """(g, fix): packed trigrams of scanned pages whose middle character was misread, with the right one.

    Candidates share both neighbours. page_grams: (g, n)."""
    mid = F.shiftright("g", BITS).bitwiseAND(F.lit(LAST))
    ctx = (F.shiftright("g", 2 * BITS) * F.lit(1 << BITS)) + F.col("g").bitwiseAND(F.lit(LAST))
    left, right = F.shiftright("g", BITS), F.col("g").bitwiseAND(F.lit((1 << 2 * BITS) - 1))
    pair = (F.col("c") * F.lit(1 << BITS) + F.col("fix")).alias("cf")
    zero = F.lit(0).cast("long")
    # Characters of clean text and of pages: at most the 27,648 of the blocks looked at. Bigrams: as first and as last two.
    chars = grams.select(mid.alias("c"), F.col("n").alias("n1"), zero.alias("s1")).unionByName(page_grams.select(mid.alias("c"), zero.alias("n1"), F.col("n").alias("s1")))
    chars = cut(chars.groupBy("c").agg(F.sum("n1").alias("n1"), F.sum("s1").alias("s1")))
    sides = grams.select(left.alias("k"), F.col("n").alias("nl"), zero.alias("nr")).unionByName(grams.select(right.alias("k"), zero.alias("nl"), F.col("n").alias("nr")))
    sides = cut(sides.groupBy("k").agg(F.sum("nl").alias("nl"), F.sum("nr").alias("nr")))
    strong = cut(grams.filter(f"n >= {LEAST}").select(ctx.alias("ctx"), mid.alias("fix"), F.col("n").alias("cand")))

    def rated(units: DataFrame) -> DataFrame:
        """Candidates and evidence of units (g, own, want): own is what the unit itself added to the clean counts, want the right character if known."""
        u = units.select("g", "own", "want", ctx.alias("ctx"), mid.alias("c"), left.alias("l"), right.alias("r")).join(strong.hint("merge"), "ctx").filter("fix <> c")
        u = u.join(F.broadcast(chars), "c", "left").join(sides.select(F.col("k").alias("l"), "nl").hint("merge"), "l", "left").join(sides.select(F.col("k").alias("r"), "nr").hint("merge"), "r", "left")
        less = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)) - F.col("own"), F.lit(0)).alias(c)
        return u.select("g", "ctx", "c", "fix", "cand", "want", pair, less("n1"), less("nl"), less("nr"), F.coalesce("s1", F.lit(0)).alias("s1"))

    found = cut(rated(page_grams.join(grams.select("g").hint("merge"), "g", "left_anti").select("g", F.lit(0).alias("own"), F.lit(None).cast("long").alias("want"))))
    # A confusion is voted for by contexts of characters that scanned pages show far oftener than clean text does.
    size = chars.agg(F.sum("n1"), F.sum("s1")).first()
    ratio = float(size[1] or 1) / float(size[0] or 1)
    votes = found.filter(F.col("n1") * ratio < 0.25 * F.col("s1")).groupBy("cf", "c", "fix").agg(F.countDistinct("ctx").alias("votes"))
    votes = cut(votes)
    by_pair = bounded(votes.select("cf", "votes"))
    with_votes = lambda d: d.join(by_pair, "cf", "left").fillna(0, ["votes"])
    # Training: rare clean trigrams are right although unseen but for themselves; frequent ones are damaged with what the
    # most voted confusions make of their middle.
    rare = grams.filter("n = 1").orderBy(F.xxhash64("g")).limit(SAMPLE).select("g", F.lit(1).alias("own"), F.lit(-1).cast("long").alias("want"))
    confusions = votes.filter("votes >= 3").orderBy(F.desc("votes"), "c", "fix").limit(CONFUSIONS)
    hurt = strong.join(F.broadcast(confusions.select("fix", "c")), "fix").orderBy(F.xxhash64("ctx", "fix", "c")).limit(SAMPLE)  # CONFUSIONS rows
    made = F.shiftright("ctx", BITS) * F.lit(1 << 2 * BITS) + F.col("c") * F.lit(1 << BITS) + F.col("ctx").bitwiseAND(F.lit(LAST))
    hurt = hurt.select(made.alias("g"), F.lit(0).alias("own"), F.col("fix").alias("want"))
    lesson = cut(with_votes(rated(cut(rare.unionByName(hurt)))).filter("want = -1 or want = fix").select("g", "fix", "want", "votes", "cand", "n1", "nl", "nr", "s1"))
    half = lambda c: lesson.filter(c).orderBy(F.xxhash64("g", "fix")).limit(SAMPLE)
    table = half("want = -1").unionByName(half("want = fix")).toArrow()

    def evidence(b) -> np.ndarray:
        num = lambda c: np.log1p(b.column(c).to_numpy().astype(float))
        return np.stack([num("votes"), num("cand"), num("n1"), num("nl"), num("nr"), num("n1") - num("s1")], axis=1)

    labels = table.column("want").to_numpy() >= 0
    model = Booster(40).fit(evidence(table), labels) if len(set(labels.tolist())) == 2 else None
    sent = grams.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for b in batches:
            if not len(b) or sent.value is None:
                continue
            score = pa.array(sent.value.score(evidence(b)))
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("fix"), b.column("votes"), score], names=["g", "fix", "votes", "score"])

    scored = with_votes(found).select("g", "fix", "votes", "cand", "n1", "nl", "nr", "s1").mapInArrow(judge, "g long, fix long, votes long, score double").filter("score > 0")
    # Of several accepted candidates the confusion with most votes is the likeliest.
    chosen = scored.groupBy("g").agg(F.max_by("fix", F.struct("votes", "score", "fix")).alias("fix"))
    # A character that clean text all but lacks is misread wherever it stands, also beside another misread one.
    best = votes.groupBy("c").agg(F.max(F.struct("votes", "fix")).alias("v")).filter("v.votes >= 5")
    foreign = best.join(F.broadcast(chars), "c").filter(F.coalesce("n1", F.lit(0)) * ratio < 0.03 * F.col("s1"))
    other = page_grams.select("g", mid.alias("c")).join(F.broadcast(foreign.select("c", "v.fix")), "c").select("g", "fix")  # characters: at most the alphabet
    return chosen.select("g", "fix", F.lit(0).alias("rank")).unionByName(other.select("g", "fix", F.lit(1).alias("rank"))).groupBy("g").agg(F.min_by("fix", "rank").alias("fix"))


def analysed(df: DataFrame, key: str, text: str, source: str, widest: int = WIDEST, share: float = SHARE, edge: int = EDGE):
    """(pages, found, fixes, model) of the scanned sources' records: pages (key, text, skip), found (key, line_no, kind), fixes
    (key, token, g, fix) the accepted corrections of each page, model the line-pair classifiers, broadcast."""
    spark = df.sparkSession
    # Sources are told by a 64-bit hash; a null source stands for its own record.
    whose = F.when(F.col(source).isNull(), F.xxhash64(F.lit("#"), F.col(key).cast("long"))).otherwise(F.xxhash64(source))
    own = df.select(F.col(key).cast("long").alias("key"), whose.alias("s"), F.col(text).alias("text")).filter("text is not null and text <> ''")
    sources = surveyed(own, widest).groupBy("s").agg(F.avg(F.col("scanned").cast("int")).alias("share")).filter(F.col("share") >= share)
    scanned = bounded(cut(sources.select("s")))
    pages = cut(own.join(scanned, "s", "left_semi"))
    clean = own.join(scanned, "s", "left_anti").select(F.col("text").alias("t"))

    lines = cut(edge_lines(pages, edge))
    titles = cut(source_titles(lines))
    lesson = clean.filter("length(t) > 200").orderBy(F.xxhash64("t")).limit(TEXTS).toArrow().column(0).to_pylist()
    shown = titles.orderBy(F.xxhash64("title")).limit(TEXTS).select("title").toArrow().column(0).to_pylist()
    model = spark.sparkContext.broadcast(PagePairs([t for t in lesson if not wrapped(t.split("\n"), widest)], shown))
    junk = cut(furniture(lines, titles, model))
    skips = cut(junk.groupBy("key").agg(F.collect_set("line_no").alias("skip")))  # a page's edges
    scans = pages.select("key", "text").join(bounded(skips), "key", "left")
    words, grams = clean_counts(clean)

    def units(batches):
        for b in batches:
            keys = b.column(0).to_pylist()
            texts = [t.split("\n") for t in b.column(1).to_pylist()]
            outs = [set(x or ()) for x in b.column(2).to_pylist()]
            # Furniture and blank lines between pages' ends don't part a word, a paragraph does.
            asked, features = [], []
            for k, (lines, out) in enumerate(zip(texts, outs, strict=True)):
                body = [i for i, x in enumerate(lines) if x.strip() and i not in out]
                for i, j in zip(body, body[1:], strict=False):
                    if lines[i].rstrip()[-1] in DIVIDERS and all(m in out for m in range(i + 1, j)):
                        asked.append((k, i))
                        w = widths([lines[i].rstrip(), lines[j].rstrip()]).tolist()
                        features.append(pair_features(lines[i], lines[j], *w, max(widths(lines))))
            breaks: list[set[int]] = [set() for _ in keys]
            for (k, i), hit in zip(asked, model.value.divides(features), strict=True):
                if hit:
                    breaks[k].add(i)
            rows = [(keys[k], i, None, None, None, "hyphen_break") for k, s in enumerate(breaks) for i in sorted(s)]
            han = [[np.zeros(0, np.int64)] * 3]
            for key, lines, out, ends in zip(keys, texts, outs, breaks, strict=True):
                blocks = joined(lines, out, ends)
                for where, block in blocks:
                    for at, token, compound in raw_tokens(block):
                        # The line of the odd character decides; for a plain token the line it starts on.
                        odd = next((m for m, c in enumerate(token) if not c.isalpha()), 0)
                        rows.append((key, int(where[at + odd]), token.lower(), token[0].isupper(), compound, "misread" if odd_inside(token) else None))
                if blocks:
                    at, g = packed_grams([x for _, x in blocks])
                    line = np.concatenate([x for w, _ in blocks for x in (w, [0])])
                    han.append([np.full(len(g), key), line[at], g])
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            k, i, g = (np.concatenate(x) for x in zip(*han, strict=True))
            tail = lambda kind: pa.nulls(len(g), kind)
            both = [
                pa.concat_arrays([pa.array(columns[0], pa.int64()), pa.array(k.astype(np.int64))]), pa.concat_arrays([pa.array(columns[1], pa.int32()), pa.array(i.astype(np.int32))]),
                *(pa.concat_arrays([pa.array(c, t), tail(t)]) for c, t in zip(columns[2:], (pa.string(), pa.bool_(), pa.bool_(), pa.string()), strict=True)), pa.concat_arrays([pa.nulls(len(rows), pa.int64()), pa.array(g)]),
            ]
            yield pa.RecordBatch.from_arrays(both, names=["key", "line_no", "token", "cap", "compound", "kind", "g"])

    seen = cut(scans.select("key", "text", "skip").mapInArrow(units, "key long, line_no int, token string, cap boolean, compound boolean, kind string, g long"))
    tokens = seen.filter("token is not null").groupBy("token").agg(F.count("*").alias("n"), F.min("cap").alias("cap"), F.min("compound").alias("compound"))
    fix_words = cut(word_corrections(tokens, words))
    fix_grams = cut(gram_corrections(seen.filter("g is not null").groupBy("g").agg(F.count("*").alias("n")), grams))
    # Tokens join by a 64-bit hash: a table by longs takes a tenth of the memory of one by strings.
    named = fix_words.select(F.xxhash64("token").alias("t"), "fix")
    latin = seen.filter("token is not null").withColumn("t", F.xxhash64("token")).join(bounded(named), "t").select("key", "line_no", "token", F.lit(None).cast("long").alias("g"), "fix")
    han = seen.filter("g is not null").select("key", "line_no", "g").join(bounded(fix_grams), "g").select("key", "line_no", F.lit(None).cast("string").alias("token"), "g", F.expr("decode(unhex(lpad(hex(fix), 8, '0')), 'UTF-32')").alias("fix"))
    fixes = cut(latin.unionByName(han))
    found = junk.unionByName(seen.filter("kind is not null").select("key", "line_no", "kind")).unionByName(fixes.select("key", "line_no", F.lit("misread").alias("kind"))).distinct()
    return scans, found, fixes, model


def scan_noise(df: DataFrame, key: str, text: str, source: str, **options) -> DataFrame:
    """(key, line_no, kind): lines with noise of scanning; kind is running_header, page_number, hyphen_break or misread.

    Only records of sources that look scanned are looked at (a null source stands for its own record). Null and empty texts
    and empty tables give no rows. Keys are unique longs. options: widest, share and edge of analysed."""
    return analysed(df, key, text, source, **options)[1].withColumnRenamed("key", key)


def repaired(df: DataFrame, key: str, text: str, source: str, **options) -> DataFrame:
    """(key, text): the scanned pages as continuous paragraphs: furniture out, divided words joined, misread characters
    replaced, wrapped lines joined where the line-pair classifier says so."""
    pages, _, fixes, model = analysed(df, key, text, source, **options)
    per_page = fixes.groupBy("key").agg(F.to_json(F.collect_set(F.struct("token", "g", "fix"))).alias("fixes"))  # bounded by the page

    def run(batches):
        for b in batches:
            out = []
            for t, skip, fx in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                fx = json.loads(fx) if fx else []
                words = {f["token"]: f["fix"] for f in fx if f.get("token")}
                grams = {f["g"]: f["fix"] for f in fx if f.get("g")}
                lines, gone = t.split("\n"), set(skip or ())
                wide = widths([x.rstrip() for x in lines]).tolist()
                # All pairs of the page are scored at once; a blank line ends a paragraph.
                body = [i for i in range(len(lines)) if i not in gone]
                pairs = [(i, j) for i, j in zip(body, body[1:], strict=False) if lines[i].strip() and lines[j].strip()]
                features = [pair_features(lines[i], lines[j], wide[i], wide[j], max(wide)) for i, j in pairs]
                goes, parts = model.value.continues(features), model.value.divides(features)
                joins = {j for (_, j), a, d in zip(pairs, goes, parts, strict=True) if a or d}
                breaks = {i for (i, _), d in zip(pairs, parts, strict=True) if d}
                paragraphs: list[list[int]] = []
                for i in body:
                    if lines[i].strip():
                        if i in joins:
                            paragraphs[-1].append(i)
                        else:
                            paragraphs.append([i])
                done = []
                for p in paragraphs:
                    s = " ".join(x for _, x in joined([lines[i] for i in p], set(), {m for m, i in enumerate(p) if i in breaks}))
                    at, g = packed_grams([s])
                    for k, x in zip(at[::-1].tolist(), g[::-1].tolist(), strict=True):
                        if x in grams:
                            s = s[:k] + grams[x] + s[k + 1 :]
                    for k, token, _ in reversed(list(raw_tokens(s))):
                        if token.lower() in words:
                            new = words[token.lower()]
                            s = s[:k] + (new.capitalize() if token[0].isupper() else new) + s[k + len(token) :]
                    done.append(s)
                out.append("\n\n".join(done))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["key", "text"])

    return pages.join(per_page, "key", "left").select("key", "text", "skip", "fixes").mapInArrow(run, "key long, text string").withColumnsRenamed({"key": key, "text": text})
