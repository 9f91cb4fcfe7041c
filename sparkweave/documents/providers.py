"""Models that the pipeline calls, as Python callables, and deterministic stand-ins for tests.

A chat model is (system, user) -> text; an embedder is text -> vector. Embeddings run in Arrow batches over distinct
texts only.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Chat = Callable[[str, str], str]
Embedder = Callable[[str], list[float]]

#: Fixed value: bytes of a text that is embedded.
EMBED_BYTES = 6_000
M64 = 2**64 - 1


class MockChat:
    """Answers from a list, in turn."""

    def __init__(self, replies: list[str]):
        self.replies, self.calls = itertools.cycle(replies), 0

    def __call__(self, system: str, user: str) -> str:
        self.calls += 1
        return next(self.replies)


def mock_embedder(dim: int = 8) -> Embedder:
    """A unit vector that depends on the text alone: SplitMix64 numbers from the text's FNV-1a hash."""

    def embed(text: str) -> list[float]:
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = ((h ^ b) * 0x100000001B3) & M64
        out = []
        for _ in range(dim):
            h = (h + 0x9E3779B97F4A7C15) & M64
            z = h
            z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & M64
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & M64
            out.append(((z ^ (z >> 31)) >> 11) / 2**52 - 1)
        norm = math.sqrt(sum(x * x for x in out)) or 1.0
        return [x / norm for x in out]

    return embed


def vectorize(texts: DataFrame, known: DataFrame, embedder: Embedder) -> DataFrame:
    """key, hash, embedding of texts (key, text) whose hash differs from what is known (key, hash). Each distinct text
    is embedded once."""
    cut = F.when(F.octet_length("text") <= EMBED_BYTES, F.col("text")).otherwise(F.decode(F.substring(F.encode("text", "UTF-8"), 1, EMBED_BYTES), "UTF-8"))
    rows = texts.select("key", cut.alias("text")).withColumn("hash", F.substring(F.sha2("text", 256), 1, 16))
    stale = rows.join(known.select("key", "hash"), ["key", "hash"], "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"text": pdf["text"], "embedding": [embedder(t) for t in pdf["text"]]})

    vectors = stale.select("text").distinct().mapInPandas(run, "text string, embedding array<float>")
    return stale.join(vectors, "text").select("key", "hash", "embedding")


def json_in(text: str) -> dict:
    """The outermost JSON object in a reply; {} if there is none."""
    a, b = text.find("{"), text.rfind("}")
    try:
        return json.loads(text[a : b + 1]) if 0 <= a < b else {}
    except ValueError:
        return {}
