"""Token ids of a whole corpus by a public byte-level tokenizer, with each shared chunk of text encoded once.

Content-defined chunk reuse. A rolling hash over the last 16 bytes marks cut points, so texts that share a passage share
its cuts wherever it stands. A chunk's ids are looked up in its worker's table and encoded only if they aren't there.
Ids at a cut may differ from those of the whole text, so every joint is repaired: from the last place before the cut to
the first one behind it where the tokenizer's splitting is known to restart, the text is encoded again, as one piece. Such
a place is a space, tab or line break behind a visible ASCII character: no pattern of the tokenizer looks back, and none
that matches a visible character goes on into a space. Between such places the ids agree exactly with those of the whole.

The table belongs to the Python worker and lives as long as it does. Its size is bounded by a parameter; when it is full
it is emptied, which changes no result. No text moves between executors: a table of chunks for the whole corpus would have
to shuffle the corpus twice.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public vocabularies lie, and the one that is used unless another is named.
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
#: Chunks and joints that a worker keeps (some 500 bytes each).
TABLE_ENTRIES = 120_000
#: One byte in so many ends a chunk.
CHUNK_BYTES = 1024
#: How the byte-level vocabularies split a text (a fixed value of the public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_WORKER: dict[tuple[str, str], "ChunkEncoder"] = {}


class ChunkEncoder:
    def __init__(self, directory: str = TOKENIZER_DIR, name: str = TOKENIZER, entries: int = TABLE_ENTRIES, chunk: int = CHUNK_BYTES):
        import tiktoken

        with (Path(directory) / f"{name}.tiktoken").open("rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.entries, self.mask = entries, np.uint32((1 << max(1, chunk.bit_length() - 1)) - 1)
        self.table: dict[bytes, np.ndarray] = {}
        self.hits = self.misses = 0

    @staticmethod
    def worker(directory: str, name: str) -> "ChunkEncoder":
        return _WORKER.setdefault((directory, name), None) or _WORKER.__setitem__((directory, name), ChunkEncoder(directory, name)) or _WORKER[(directory, name)]

    def _piece(self, b: bytes) -> np.ndarray:
        ids = self.table.get(b)
        if ids is None:
            self.misses += 1
            if len(self.table) >= self.entries:
                self.table.clear()
            ids = np.array(self.encoding.encode_ordinary(b.decode("utf-8", "surrogatepass")), np.int32)
            self.table[b] = ids
        else:
            self.hits += 1
        return ids

    def marks(self, data: np.ndarray) -> np.ndarray:
        """Positions behind which a chunk ends, from a hash of the 16 bytes up to there."""
        h = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
        step, mul = 1, np.uint32(0x01000193)
        with np.errstate(over="ignore"):
            while step < 16:  # a window of twice the width from two of half
                g = h.copy()
                g[step:] += h[:-step] * mul
                h, step, mul = g, step * 2, np.uint32(int(mul) * int(mul) & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        return np.flatnonzero((h & self.mask) == 0) + 1

    @staticmethod
    def restarts(data: np.ndarray) -> np.ndarray:
        """Positions where splitting restarts: a space, tab or line break behind a visible ASCII character."""
        gap = (data == 32) | (data == 10) | (data == 9) | (data == 13)
        seen = (data > 32) & (data < 127)
        return np.flatnonzero(gap[1:] & seen[:-1]) + 1

    def batch(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(number of ids of each text, the ids of all in order); null counts as empty."""
        sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
        ends = np.cumsum(sizes)
        whole = b"".join(t for t in texts if t)
        counts = np.zeros(len(texts), np.int64)
        if not whole:
            return counts, []
        data = np.frombuffer(whole, np.uint8)
        cut, safe = self.marks(data), self.restarts(data)
        # each cut's joint: from the last restart not behind it to the first not before it
        i = np.searchsorted(safe, cut, "right")
        j = np.searchsorted(safe, cut, "left")
        lo = np.where(i > 0, safe[np.maximum(i - 1, 0)] if len(safe) else 0, 0)
        hi = np.where(j < len(safe), safe[np.minimum(j, max(len(safe) - 1, 0))] if len(safe) else len(data), len(data))
        inner = np.unique(np.concatenate([lo, hi]))
        first = np.searchsorted(inner, ends - sizes, "right").tolist()
        last = np.searchsorted(inner, ends, "left").tolist()
        inner = inner.tolist()
        out: list[np.ndarray] = []
        piece = self._piece
        for k, (size, end) in enumerate(zip(sizes.tolist(), ends.tolist())):
            if not size:
                continue
            p, n = end - size, 0
            for q in inner[first[k] : last[k]]:
                ids = piece(whole[p:q])
                n += len(ids)
                out.append(ids)
                p = q
            ids = piece(whole[p:end])
            out.append(ids)
            counts[k] = n + len(ids)
        return counts, out


def _texts(batch: pa.RecordBatch, text: str) -> list[bytes | None]:
    return batch.column(text).cast(pa.binary()).to_pylist()


def _encode(batches: Iterator[pa.RecordBatch], keys: list[str], text: str, directory: str, name: str) -> Iterator[pa.RecordBatch]:
    enc = ChunkEncoder.worker(directory, name)
    for whole in batches:
        for at in range(0, whole.num_rows, 500):  # so many texts' ids are held at once
            b = whole.slice(at, 500)
            counts, ids = enc.batch(_texts(b, text))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.ListArray.from_arrays(offsets, values)], [*keys, "ids"])


def _count(batches: Iterator[pa.RecordBatch], keys: list[str], text: str, directory: str, name: str) -> Iterator[pa.RecordBatch]:
    enc = ChunkEncoder.worker(directory, name)
    for b in batches:
        counts = np.concatenate([enc.batch(_texts(b.slice(at, 500), text))[0] for at in range(0, b.num_rows, 500)]) if b.num_rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(counts)], [*keys, "tokens"])


def _source(df: DataFrame, keys: list[str], text: str) -> tuple[DataFrame, str]:
    if {"ids", "tokens"} & set(keys):
        raise ValueError("a key column has the name of a result column")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    return df.select(*dict.fromkeys([*keys, text])), fields


def encode_corpus(df: DataFrame, keys: list[str], text: str, directory: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """(*keys, ids): one row a row of df, no special tokens. Null and empty texts get an empty list; other columns don't matter."""
    src, fields = _source(df, keys, text)
    return src.mapInArrow(lambda it: _encode(it, keys, text, directory, name), f"{fields}, ids array<int>")


def count_tokens(df: DataFrame, keys: list[str], text: str, directory: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """(*keys, tokens): the number of ids of each text, 0 for null and empty ones."""
    src, fields = _source(df, keys, text)
    return src.mapInArrow(lambda it: _count(it, keys, text, directory, name), f"{fields}, tokens bigint")
