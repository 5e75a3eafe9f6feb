"""Extension points with deterministic defaults: tokenizer, embedder, pair scorer, chat client."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Default tokenizer: runs of ASCII letters and digits, single Han characters, lower-cased. An expression, so it stays in the JVM.
TOKENS = "[a-z0-9]+|[一-鿿]"

Tokenizer = Callable[[Column], Column]


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKENS), F.lit(0))


class Embedder(Protocol):
    dimensions: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashedEmbedder:
    """Unit vectors from hashed character trigrams: no model, the same on every machine."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dimensions), np.float32)
        for k, t in enumerate(texts):
            for i in range(len(t) - 2):
                h = zlib.crc32(t[i : i + 3].encode("utf-8", "surrogatepass"))
                out[k, h % self.dimensions] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class PairScorer(Protocol):
    def __call__(self, query: str, texts: list[str]) -> np.ndarray: ...


def overlap_scorer(query: str, texts: list[str]) -> np.ndarray:
    """Share of the query's tokens that a text holds."""
    import re

    q = set(re.findall(TOKENS, query.lower()))
    return np.array([len(q & set(re.findall(TOKENS, (t or "").lower()))) / max(1, len(q)) for t in texts])


class ChatClient(Protocol):
    def chat(self, messages: list[dict]) -> str: ...

    def stream(self, messages: list[dict]) -> Iterator[str]: ...


class EchoChat:
    """Stand-in for a chat model: returns the last message, and does nothing else."""

    def chat(self, messages: list[dict]) -> str:
        return messages[-1]["content"] if messages else ""

    def stream(self, messages: list[dict]) -> Iterator[str]:
        yield from self.chat(messages)

    def check(self) -> bool:
        return True


class VisionClient(Protocol):
    def describe(self, image: bytes) -> str: ...


class SizeVision:
    """Stand-in for a vision model: names an image by its format and bytes."""

    def describe(self, image: bytes) -> str:
        kind = "png" if image[:4] == b"\x89PNG" else "jpeg" if image[:2] == b"\xff\xd8" else "image"
        return f"{kind}, {len(image)} bytes"


def rewritten(chat: ChatClient, question: str, most: int = 2) -> list[str]:
    """The question and up to `most` rewritings of it, a line each of the reply; where the client fails, the question alone."""
    if isinstance(chat, EchoChat):
        return [question]
    try:
        reply = chat.chat([{"role": "user", "content": f"Rewrite this search question in {most} other ways, one a line, nothing else:\n{question}"}])
    except Exception:  # noqa: BLE001 - a search must not fail with its rewriting
        return [question]
    return [question, *[x.strip() for x in reply.split("\n") if x.strip()][:most]]


CHAT_CLIENTS: dict[str, Callable[..., ChatClient]] = {"echo": EchoChat}


def chat_client(name: str, **options) -> ChatClient:
    if name not in CHAT_CLIENTS:
        raise ValueError(f"unknown chat client {name!r}; registered: {sorted(CHAT_CLIENTS)}")
    return CHAT_CLIENTS[name](**options)
