"""Chunking: sentence and clause splits as expressions; the stateful semantic chunker as one function per text."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, strip
from ..rules import CASE_STRUCTURES, CASE_WORDS, CHUNK_OVERLAP, CHUNK_SIZE, CLAUSE_MARKS, SENTENCE_MARKS, SHORT_CHUNK


def sentences(text: Column) -> Column:
    """Sentences with the mark that ends each; a rest without mark is a sentence."""
    m = re.escape(SENTENCE_MARKS).replace("\\\n", "\n")
    return F.regexp_extract_all(text, F.lit(f"[^{m}]*[{m}]|[^{m}]+$"), F.lit(0))


def clauses(sentence: Column) -> Column:
    return F.regexp_extract_all(sentence, F.lit(f"[^{CLAUSE_MARKS}]*[{CLAUSE_MARKS}]|[^{CLAUSE_MARKS}]+$"), F.lit(0))


def table_line(line: Column) -> Column:
    """A markdown table row: bars at both ends and at least one inside."""
    x = strip(line)
    return x.startswith("|") & x.endswith("|") & (F.size(F.split(x, r"\|", -1)) >= 4)


def chunk_type(text: Column) -> Column:
    x = strip(text)
    table = x.startswith("|") & x.endswith("|") & (F.contains(text, F.lit("---")) | F.contains(text, F.lit(" | ")))
    return (
        F.when(text.isNull(), None).when(table, "table")
        .when(text.rlike(r"^(?U)\d+[、.]"), "list")
        .when(text.rlike(f"^(#{{1,6}}{WS}+|(?U)\\d+([.:]|{WS}))"), "heading")
        .when(F.contains(text, F.lit("\n")), "paragraph")
        .otherwise("sentence")
    )


def packed(text: Column, size: int = CHUNK_SIZE) -> Column:
    """Paragraphs packed greedily into pieces of at most `size` characters, joined by empty lines; a longer paragraph stays whole."""
    parts = F.filter(F.transform(F.split(text, f"\n{WS}*\n|\n", -1), strip), lambda p: p != "")
    zero = F.struct(F.lit(0).alias("n"), F.lit("").alias("starts"))

    def step(s, p):
        # The fold notes which paragraphs start a piece; no text is copied in it.
        new = (s["n"] == 0) | (s["n"] + F.length(p) + 2 > size)
        return F.struct(F.when(new, F.length(p)).otherwise(s["n"] + 2 + F.length(p)).alias("n"), F.concat(s["starts"], F.when(new, "1").otherwise("0")).alias("starts"))

    starts = F.aggregate(parts, zero, step)["starts"]
    # Paragraphs hold no newline, so three in a row part the pieces.
    led = F.zip_with(parts, F.split(starts, ""), lambda p, k: F.concat(F.when(k == "1", "\n\n\n").otherwise("\n\n"), p))
    # The first piece's sign leaves an empty part in front.
    return F.filter(F.split(F.array_join(led, ""), "\n\n\n", -1), lambda c: c != "")


class SemanticChunker:
    """Greedy packer of segments with tables and test-case structures kept whole. State: pending text and overlap to carry."""

    def __init__(self, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, least: int = SHORT_CHUNK):
        self.size, self.overlap, self.least = size, overlap, least
        self._structure = re.compile("|".join(f"(?:{p})" for p in CASE_STRUCTURES))
        self._sentence = re.compile(f"[^{SENTENCE_MARKS}]*[{SENTENCE_MARKS}]|[^{SENTENCE_MARKS}]+")
        self._clause = re.compile(f"[^{CLAUSE_MARKS}]*[{CLAUSE_MARKS}]|[^{CLAUSE_MARKS}]+")
        self._step = re.compile(r"(?=步骤ID[：:])|(?=^\d+[、.])", re.M)

    @staticmethod
    def is_row(line: str) -> bool:
        x = line.strip()
        return x.startswith("|") and x.endswith("|") and len(x.split("|")) >= 4

    def segments(self, text: str, tables: bool) -> list[tuple[bool, str]]:
        """(is table, segment): paragraphs, or in a text with tables runs of table lines and of other lines."""
        if not tables:
            return [(False, p.strip()) for p in re.split(r"\n\s*\n|\n", text) if p.strip()]
        out: list[tuple[bool, list[str]]] = []
        for line in text.split("\n"):
            if line.strip():
                row = self.is_row(line)
                if out and out[-1][0] == row:
                    out[-1][1].append(line)
                else:
                    out.append((row, [line]))
        return [(row, "\n".join(x).strip()) for row, x in out]

    def tail(self, chunk: str) -> str:
        """Overlap: what follows the first boundary in the last `overlap` characters; else the last boundary before; else all."""
        if not chunk or self.overlap <= 0:
            return ""
        start = max(0, len(chunk) - self.overlap)
        marks = SENTENCE_MARKS + CLAUSE_MARKS
        for k in range(start, len(chunk) - 1):
            if chunk[k] in marks:
                return chunk[k + 1 :].strip()
        for k in range(start - 1, -1, -1):
            if chunk[k] in marks:
                return chunk[k + 1 :].strip()
        return chunk

    def table_pieces(self, table: str) -> list[str]:
        """An oversized table in pieces that each repeat its two head lines; at most three lines are never split."""
        rows = table.split("\n")
        if len(table) <= self.size or len(rows) <= 3:
            return [table]
        head, out, cur, n = rows[:2], [], [], 0
        for row in rows[2:]:
            if cur and n + len(row) + 1 > self.size:
                out.append("\n".join(head + cur))
                cur, n = [], 0
            cur.append(row)
            n += len(row) + 1
        return [*out, "\n".join(head + cur)] if cur else out

    def structure_pieces(self, text: str) -> list[str]:
        """An oversized structure split before its steps, packed up to the size; sentences where there are no steps."""
        parts = [p for p in self._step.split(text) if p.strip()]
        if len(parts) < 2:
            parts = self._sentence.findall(text)
        out, cur = [], ""
        for p in parts:
            if cur and len(cur) + len(p) > self.size:
                out.append(cur.strip())
                cur = ""
            cur += p
        return [x for x in [*out, cur.strip()] if x]

    def flush(self, text: str, carry: str) -> list[str]:
        if len(text) <= self.size:
            if len(text.strip()) < self.least:
                return []
            whole = carry + text if carry and not text.startswith(carry) else text
            return [whole if len(whole) <= self.size else text]
        out, cur = [], carry
        for s in self._sentence.findall(text):
            for part in self.fitting(s):
                if cur and len(cur) + len(part) > self.size:
                    out.append(cur)
                    ov = self.tail(cur)
                    cur = part if part.startswith(ov) or len(ov) + len(part) > self.size else ov + part
                else:
                    cur += part
        if len(cur.strip()) >= self.least:
            out.append(cur)
        return [x.strip() for x in out]

    def fitting(self, sentence: str) -> list[str]:
        """A sentence in parts of at most the size: whole, by clauses, or at fixed width."""
        if len(sentence) <= self.size:
            return [sentence]
        out = []
        for c in self._clause.findall(sentence):
            out += [c[k : k + self.size] for k in range(0, len(c), self.size)]
        return out

    def split(self, text: str | None, has_tables: bool = False) -> list[str]:
        if not text or not text.strip():
            return []
        tables = has_tables or any(self.is_row(x) for x in text.split("\n"))
        cases = any(w in text for w in CASE_WORDS)
        out: list[str] = []
        cur = carry = ""
        for row, seg in self.segments(text, tables):
            if cur and (row or len(cur) + len(seg) + 2 > self.size):
                out += self.flush(cur, carry)
                cur = carry = ""
            if row:
                pieces = self.table_pieces(seg)
            elif cases and self._structure.search(seg):
                if cur:
                    out += self.flush(cur, carry)
                    cur = carry = ""
                pieces = [seg] if len(seg) <= 1.5 * self.size else self.structure_pieces(seg)
            else:
                cur = f"{cur}\n\n{seg}" if cur else seg
                continue
            out += pieces
            carry = self.tail(pieces[-1]) if pieces else ""
        return out + (self.flush(cur, carry) if cur else [])


def semantic_chunks(df: DataFrame, key: str, text: str, has_tables: str | None = None, chunker: SemanticChunker | None = None) -> DataFrame:
    """(key, chunk_index, chunk, chunk_type, original_length), a row a chunk; texts are independent, so nothing is shuffled.
    Null and blank texts give no row."""
    own = chunker or SemanticChunker()

    def run(batches):
        for b in batches:
            rows, no, chunks = [], [], []
            for k, (t, h) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                got = own.split(t, bool(h))
                rows += [k] * len(got)
                no += range(len(got))
                chunks += got
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), pa.array(chunks, pa.string())], names=["key", "chunk_index", "chunk"])

    src = df.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.col(has_tables) if has_tables else F.lit(False)).alias("h"))
    out = src.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, chunk_index int, chunk string")
    return out.select(F.col("key").alias(key), "chunk_index", "chunk", chunk_type(F.col("chunk")).alias("chunk_type"), F.length("chunk").alias("original_length"))
