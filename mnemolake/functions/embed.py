"""Embedders: a pluggable callable, and a deterministic one of hashed words for use without a model."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 64


def _fnv1a(word: str) -> int:
    h = 0x811C9DC5
    for b in word.encode():
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    return h


@lru_cache(maxsize=50_000)
def word_vector(word: str, dim: int = DIM) -> tuple[float, ...]:
    """Numbers in [-1, 1) from a generator that the word's hash seeds."""
    state, out = _fnv1a(word), []
    for _ in range(dim):
        state = (state * 0x5851F42D4C957F2D + 0x14057B7EF767814F) & 0xFFFFFFFFFFFFFFFF
        out.append((state >> 33) / (1 << 30) - 1)
    return tuple(out)


def hashed_words(text: str | None, dim: int = DIM) -> list[float] | None:
    """The unit vector of a text's words; null where it has none."""
    words = re.findall(r"[^\W_]{2,}", (text or "").lower())
    if not words:
        return None
    total = [sum(c) for c in zip(*(word_vector(w, dim) for w in words))]
    size = math.sqrt(sum(x * x for x in total))
    return [x / size for x in total] if size else None


def embedding_text(name: str | None, tags: str | None, body: str | None) -> str:
    """What is embedded of a document: its trimmed, non-empty name, tags and body, a line each."""
    return "\n".join(t for t in ((x or "").strip() for x in (name, tags, body)) if t)


def embedding_text_column(name: str = "name", tags: str = "tags", body: str = "body") -> Column:
    """embedding_text as an expression over columns."""
    trimmed = [F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "") for c in (name, tags, body)]
    return F.array_join(F.filter(F.array(*trimmed), lambda x: x != ""), "\n")


def embed_udf(embed: Callable[[str], list[float] | None] = hashed_words):
    """An embedder as a vectorised function of a text column."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(embed)

    return run
