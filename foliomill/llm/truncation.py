"""Problem 5: values cut off by field limits or in transfer.

Method: a vocabulary trie of the corpus, kept as a table of its nodes (how many
words end at a node, how many go on), finds final tokens that are unknown proper
prefixes of known words; node counts of the same kind for sentence ends tell
whether a value stops where sentences of its kind do. A boosted classifier,
trained on whole and deliberately cut sentences of the same corpus, weighs
them; length evidence of each source and field is added.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .boost import Booster
from .kernel import BASE, U, mix, stable_hash

# Sentences of which the classifier's sample is drawn, at most: one whole and one cut form of each.
SAMPLE = 20_000
# Log odds above which a value counts as cut.
BAR = 0.0
# Marks put in place of what was cut, and brackets that must close.
CUT_MARKS = ("…", "...", "�")
PAIRS = (("“", "”"), ("（", "）"), ("(", ")"), ("「", "」"), ("《", "》"))
NUMBERING = re.compile(r"^\s*(?:[（(]\d{1,3}[）)]|\d{1,3}(?:[)）．、]|\.(?!\d)))\s*")
NUMBER_ONLY = re.compile(r"^\s*[（(]?\d{0,3}[)）．、.]?\s*$")
TOKEN = re.compile(r"[A-Za-z]+(?:-\d+)?|\d+|[^\sA-Za-z\d]")
SLOTS = 6


MARK = re.compile(r"[。！？!?；;\n]|\.(?=[\n ]|\Z)")


def sentences(value: str) -> list[tuple[str, bool]]:
    """The sentences of a value with their numbering taken off, each with whether a closing mark or a line end follows it."""
    text = value.rstrip().replace("\\n", "\n").replace("...”", "…”").replace('..."', '…"')
    out, start = [], 0
    for m in MARK.finditer(text):
        i = m.start()
        if text[i] == "." and NUMBER_ONLY.match(text[start : i + 1]):
            continue
        body = NUMBERING.sub("", text[start:i]).strip()
        if body:
            # A line that ends without a mark is whole as well: cuts stand at the end of a value.
            out.append((body, True))
        start = i + 1
    if text[start:].strip():
        out.append((NUMBERING.sub("", text[start:]).strip(), False))
    return out


CODE = re.compile(r"-\d+$")


def normal(token: str) -> str:
    """Numbers, and the number behind a code's letters, as 0."""
    return "0" if token[0].isdigit() else CODE.sub("-0", token)


@lru_cache(maxsize=1 << 18)
def token_hash(token: str) -> int:
    return stable_hash(normal(token).lower())


def open_pair(sentence: str) -> bool:
    return sentence.count('"') % 2 == 1 or any(sentence.count(a) > sentence.count(b) for a, b in PAIRS)


def position_keys(tok: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Keys of each token position (positions x SLOTS - 1): first with last token and pair, last two, three and five tokens, last with the fourth before."""
    n = np.diff(off)
    start = np.repeat(off[:-1], n)
    at = np.arange(len(tok))
    back = lambda k: np.where(at - k >= start, tok[np.maximum(at - k, 0)], U(7))
    first = tok[start]
    with np.errstate(over="ignore"):
        join = lambda tag, *xs: mix(sum((x * BASE ** U(i + 1) for i, x in enumerate(xs)), U(tag) * U(0x9E3779B1)))
        return np.stack(
            [
                join(1, first, back(0)),
                join(2, first, back(1), back(0)),
                join(3, back(2), back(1), back(0)),
                join(4, back(4), back(3), back(2), back(1), back(0)),
                join(5, back(3), back(0)),
            ],
            axis=1,
        )


def word_key(word: str) -> int:
    """Key of a trie node; the lowest bit is set, as in all keys."""
    return stable_hash("w " + word.lower()) | 1


def flat(sents: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Hashes of all sentences' tokens (words, single other characters), the sentences' offsets, and the raw tokens."""
    toks = [TOKEN.findall(s) or ["?"] for s in sents]
    off = np.zeros(len(sents) + 1, np.int64)
    np.cumsum([len(t) for t in toks], out=off[1:])
    return np.fromiter(map(token_hash, chain.from_iterable(toks)), U, int(off[-1])), off, toks


def is_word(token: str) -> bool:
    return token[0].isalpha() and token.isascii()


def node_counts(values: DataFrame) -> DataFrame:
    """(key, e, i) over all whole sentences: how often the context of a key ends a sentence, and how often it goes on;
    for words, the trie's nodes: how often a word ends there, and how often a longer one passes."""

    def run(batches):
        for b in batches:
            whole = [s for v in b.column(0).to_pylist() for s, done in sentences(v) if done]
            if not whole:
                continue
            tok, off, toks = flat(whole)
            keys = position_keys(tok, off)
            last = np.zeros(len(tok), U)
            last[off[1:] - 1] = 1
            # A key's lowest bit tells whether its sentence ends there, so one sort counts both cases.
            both, n = np.unique((keys | U(1)) ^ (U(1) - last)[:, None], return_counts=True)
            words: Counter = Counter()
            for w, c in Counter(chain.from_iterable(toks)).items():
                if is_word(w):
                    words[normal(w).lower()] += c
            nodes: dict[str, list[int]] = {}
            for w, c in words.items():
                for k in range(1, len(w) + 1):
                    node = nodes.setdefault(w[:k], [0, 0])
                    node[k < len(w)] += c
            end = (both & U(1)).astype(np.int64) * n
            key = np.concatenate([both | U(1), np.fromiter(map(word_key, nodes), U, len(nodes))])
            e = np.concatenate([end, np.fromiter((x[0] for x in nodes.values()), np.int64, len(nodes))])
            i = np.concatenate([n - end, np.fromiter((x[1] for x in nodes.values()), np.int64, len(nodes))])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(e), pa.array(i)], names=["key", "e", "i"])

    return values.mapInArrow(run, "key long, e long, i long").groupBy("key").agg(F.sum("e").alias("e"), F.sum("i").alias("i"))


def asked(rows: DataFrame, extra: list[str]) -> DataFrame:
    """One row per slot of each (id, sentence, *extra): (id, slot, key, shape), shape being what the sentence shows by itself."""

    def run(batches):
        for b in batches:
            sents = b.column(1).to_pylist()
            if not sents:
                continue
            tok, off, toks = flat(sents)
            keys = position_keys(tok, off)[off[1:] - 1] | U(1)
            words = np.array([is_word(t[-1]) for t in toks])
            word = np.array([word_key(normal(t[-1])) if w else 0 for t, w in zip(toks, words, strict=True)], U)
            keys = np.concatenate([keys, word[:, None]], axis=1)
            n = len(sents)
            shape = np.array([open_pair(s) + 2 * (t[-1][0].isdigit()) + 4 * bool(w) + 8 * min(len(t), 60) for s, t, w in zip(sents, toks, words, strict=True)], np.int32)
            # A sentence that doesn't end in a word has no node to ask for: its key is null and joins nothing.
            none = np.zeros((n, SLOTS), bool)
            none[:, -1] = ~words
            cols = [pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), SLOTS)), pa.array(np.tile(np.arange(SLOTS, dtype=np.int32), n)), pa.array(keys.ravel().view(np.int64), mask=none.ravel()), pa.array(np.repeat(shape, SLOTS))]
            take = pa.array(np.repeat(np.arange(n), SLOTS))
            yield pa.RecordBatch.from_arrays(cols + [b.column(2 + k).take(take) for k in range(len(extra))], names=["id", "slot", "key", "shape", *extra])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(["id long", "slot int", "key long", "shape int", *(f"{c} {kinds[c]}" for c in extra)])
    return rows.select("id", "sentence", *extra).mapInArrow(run, schema)


def featured(rows: DataFrame, nodes: DataFrame, extra: list[str]) -> DataFrame:
    """(id, shape, counts, *extra): counts holds for each slot how often its context ended and went on."""
    hit = asked(rows, extra).filter("key is not null").join(nodes, "key", "left")
    sums = [F.sum(F.when(F.col("slot") == k, F.col(c))).alias(f"{c}{k}") for k in range(SLOTS) for c in ("e", "i")]
    each = F.array(*[F.coalesce(F.col(f"{c}{k}"), F.lit(0)) for k in range(SLOTS) for c in ("e", "i")])
    return hit.groupBy("id", "shape", *extra).agg(*sums).select("id", "shape", each.alias("counts"), *extra)


def features(counts: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Columns for the classifier: per slot the log odds of ending and the log weight, then the shape's parts."""
    e, i = counts[:, 0::2].astype(float), counts[:, 1::2].astype(float)
    return np.concatenate([np.log((e + 0.2) / (i + 0.2)), np.log1p(e + i), np.stack([shape & 1, (shape >> 1) & 1, (shape >> 2) & 1, shape >> 3], axis=1)], axis=1)


def trained(values: DataFrame, nodes: DataFrame) -> Booster:
    """Classifier of whole against cut sentences, from a bounded sample of the corpus' own whole sentences.

    Each sampled sentence is shown whole, and cut at a place drawn from its hash; what it added to the counts itself is
    taken off again."""

    def run(batches):
        for b in batches:
            ids, sents, labels = [], [], []
            for v in b.column(0).to_pylist():
                for s, done in sentences(v):
                    if done and len(s) > 4:
                        h = stable_hash(s)
                        k = 1 + (h >> 8) % (len(s) - 1)
                        part = s[:k].rstrip()
                        if part:
                            ids += [h >> 1 << 1 & (1 << 62) - 1, (h >> 1 << 1 & (1 << 62) - 1) + 1]
                            sents += [s, part]
                            labels += [0, 1]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sents, pa.string()), pa.array(labels, pa.int32())], names=["id", "sentence", "label"])

    # About SAMPLE distinct values, drawn by their hash.
    some = values.filter(F.pmod(F.xxhash64("value"), F.lit(max(1, values.count() // SAMPLE))) == 0).distinct()
    rows = some.mapInArrow(run, "id long, sentence string, label int").dropDuplicates(["id"]).orderBy(F.xxhash64("id")).limit(2 * SAMPLE)
    got = featured(cut(rows), nodes, ["label"]).toArrow()
    if not got.num_rows:
        return Booster().fit(np.zeros((2, 2 * SLOTS + 4)), np.array([0, 1]))
    counts = np.array(got.column("counts").to_pylist(), np.int64)
    label, shape = got.column("label").to_numpy(), got.column("shape").to_numpy()
    own = np.zeros_like(counts)
    own[label == 0, 0 : 2 * SLOTS : 2] = 1
    own[label == 1, 1 : 2 * SLOTS : 2] = 1
    own[(label == 1) & ((shape >> 2) & 1 == 0), -1] = 0
    return Booster().fit(features(np.maximum(counts - own, 0), shape), label)


def length_evidence(candidates: DataFrame, by: list[str]) -> DataFrame:
    """(*by, n, spike): log ratio of unmarked values of exactly this length to those of the 8 lengths on either side."""
    w = Window.partitionBy(*by).orderBy("n").rangeBetween(-8, 8)
    c = candidates.groupBy(*by, "n").agg(F.count("*").alias("c")).withColumn("around", (F.sum("c").over(w) - F.col("c")) / 16)
    return c.select(*by, "n", F.when((F.col("c") >= 8) & (F.col("c") >= 4 * F.col("around")), F.log((F.col("c") + 0.5) / (F.col("around") + 0.5)) + 1).otherwise(0.0).alias("spike"))


def last_open(value: Column) -> Column:
    """Does the value lack a closing mark at its end? A cheap sieve; the rest is decided on its sentences."""
    return ~F.rtrim(value).rlike("[。！？!?；;]$")


def truncated(df: DataFrame, key: str, fields: list[str], source: str) -> DataFrame:
    """(key, field, evidence) of the values that were cut: evidence is 'mark', 'shape' (an open quote, a lone number or
    half a newline at the end) or 'score' (classifier and length).

    Null and blank values are never cut. A null source is a source of its own for the length evidence. Keys needn't be
    unique: equal rows give a row each, equal in all columns. An empty table gives no rows."""
    cells = df.select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), F.col(source).alias("source"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("c"))
    cells = cells.select((F.col("id") * len(fields) + F.array_position(F.array(*map(F.lit, fields)), F.col("c.field")) - 1).alias("id"), "key", "source", "c.field", "c.value").filter("value is not null and trim(value) <> ''")
    whole = cells.select("value")
    nodes = cut(node_counts(whole))
    model = trained(whole, nodes)

    def sift(batches):
        for b in batches:
            rows = {"keep": [], "sentence": [], "evidence": []}
            for k, v in enumerate(b.column("value").to_pylist()):
                v = v.rstrip()
                sents = sentences(v)
                if v.endswith(CUT_MARKS):
                    said = "mark"
                elif v.endswith("\\") or not sents or NUMBER_ONLY.match(v.replace("\\n", "\n").rsplit("\n", 1)[-1]) or (v[-1] in "、（(" or (sents[-1][1] and open_pair(sents[-1][0]))):
                    said = "shape"
                elif not sents[-1][1]:
                    said = None
                    if NUMBER_ONLY.match(sents[-1][0]):
                        said = "shape"
                else:
                    continue
                rows["keep"].append(k)
                rows["sentence"].append(sents[-1][0] if sents else "")
                rows["evidence"].append(said)
            take = pa.array(rows["keep"], pa.int64())
            values = b.column("value").take(take)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(take) for c in ("id", "key", "source", "field")), pa.array([len(v.as_py().rstrip()) for v in values], pa.int32()), pa.array([len(v.as_py().rstrip().encode("utf-8", "replace")) for v in values], pa.int32()), pa.array(rows["sentence"], pa.string()), pa.array(rows["evidence"], pa.string())],
                names=["id", "key", "source", "field", "chars", "bytes", "sentence", "evidence"],
            )

    kind = cells.schema["key"].dataType.simpleString()
    # The row numbers of monotonically_increasing_id hold for this one evaluation; all else reads the written table.
    sifted = cut(cells.filter(last_open(F.col("value"))).mapInArrow(sift, f"id long, key {kind}, source string, field string, chars int, bytes int, sentence string, evidence string"))
    open_ = sifted.filter("evidence is null")
    by = ["source", "field"]
    named = open_.withColumn("source", F.coalesce("source", F.lit("")))
    spikes = None
    for unit in ("chars", "bytes"):
        s = length_evidence(named.withColumn("n", F.col(unit)), by).filter("spike > 0").withColumn("unit", F.lit(unit))
        spikes = s if spikes is None else spikes.unionByName(s)
    spikes = cut(spikes)
    pick = lambda unit: spikes.filter(F.col("unit") == unit).select(*by, F.col("n").alias(unit), F.col("spike").alias(f"{unit}_spike"))
    scored = named.join(pick("chars"), [*by, "chars"], "left").join(pick("bytes"), [*by, "bytes"], "left").withColumn("spike", F.greatest(F.coalesce("chars_spike", F.lit(0.0)), F.coalesce("bytes_spike", F.lit(0.0))))
    table = featured(scored.select("id", "sentence", F.col("key").alias("rid"), "field", "spike"), nodes, ["rid", "field", "spike"])
    sent = df.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for b in batches:
            if not len(b):
                continue
            counts = np.array(b.column("counts").to_pylist(), np.int64)
            odds = np.clip(sent.value.score(features(counts, b.column("shape").to_numpy())), -5, 5) + b.column("spike").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("field"), pa.array(odds)], names=["key", "field", "odds"])

    judged = table.select("rid", "field", "shape", "counts", "spike").mapInArrow(judge, f"key {kind}, field string, odds double").filter(F.col("odds") > BAR)
    out = sifted.filter("evidence is not null").select("key", "field", "evidence").unionByName(judged.select("key", "field", F.lit("score").alias("evidence")))
    return out.withColumnRenamed("key", key)


def truncation_report(df: DataFrame, key: str, fields: list[str], source: str) -> DataFrame:
    """(source, field, filled, truncated, share) for each source and field; blank values don't count as filled."""
    cut_ones = truncated(df, key, fields, source).groupBy(key, "field").agg(F.count("*").alias("truncated"))
    cells = df.select(key, F.col(source).alias("source"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("c")).select(key, "source", "c.field", "c.value").filter("value is not null and trim(value) <> ''")
    per_key = cells.groupBy(key, "source", "field").agg(F.count("*").alias("filled"))
    joined = per_key.join(cut_ones, [key, "field"], "left")
    return joined.groupBy("source", "field").agg(F.sum("filled").alias("filled"), F.sum(F.coalesce("truncated", F.lit(0))).alias("truncated")).withColumn("share", F.col("truncated") / F.col("filled"))
