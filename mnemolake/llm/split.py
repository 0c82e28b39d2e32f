"""Cut oversized texts into pieces under a limit, at natural boundaries, each sharing some text with the one before.

Pointer doubling: every position of a text is a boundary of some rank (paragraph end, line end, sentence end, word end,
or none). Each is joined to its farthest legal successor: the end of the piece that starts an overlap before it. The
successor table is then squared again and again; after r squarings the positions reached from the start are the first
2^r greedy cuts, so all cuts of all texts of a batch come out in as many array operations as the longest text has bits.

A piece ends at the last paragraph end in the second half of its room, else the last line end there, else the last
sentence end there, else the last word end anywhere in it, else (a run without spaces) where the room ends. It starts at the
word start nearest before `overlap` characters ahead of the previous end, at most half an overlap earlier or later.
Characters are code points. Pieces are exact substrings: dropping each piece's shared head gives the text back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters handled at once by the array operations (a longer text is handled alone).
BATCH_CHARS = 200_000
_SPACE = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_STOP = np.array([ord(c) for c in ".!?…。！？"], np.uint32)
_CLOSE = np.array([ord(c) for c in "\"')]»”’"], np.uint32)
_SCHEMA = "unit_no int, piece_no int, start int, end int, shared int, piece string"


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def paragraphs(text: str) -> list[tuple[int, int]]:
    """(start, end) of each longest run of lines that hold more than spaces, tabs and carriage returns, without its last line break."""
    out, start, pos, end = [], -1, 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\r"):
            if start < 0:
                start = pos
            last = pos + len(line) < len(text)  # a line break follows
            end = pos + len(line) - (1 if last and line.endswith("\r") else 0)
        elif start >= 0:
            out.append((start, end))
            start = -1
        pos += len(line) + 1
    if start >= 0:
        out.append((start, end))
    return out


def _ranks(c: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of a cut before each position, and whether a word starts there. c: code points with one pad behind each text."""
    space = np.isin(c, _SPACE)
    newline = c == 10
    before = np.empty_like(c)
    before[0], before[1:] = 10, c[:-1]
    first = at == 0
    sp_before = np.isin(before, _SPACE) | first
    rank = np.zeros(len(c), np.int8)
    rank[space & ~sp_before] = 1  # a word ends
    stop = np.isin(before, _STOP)
    closed = np.isin(before, _CLOSE)
    closed[1:] &= stop[:-1]
    rank[(stop | closed) & space] = 2
    rank[newline] = 3  # a line ends here; its break opens the next piece's shared text
    blank_next = np.zeros(len(c), bool)  # the line that begins after this break is blank or the text's end
    solid = ~(space & ~newline)
    nxt = np.where(solid, np.arange(len(c)), len(c) - 1)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    blank_next[:-1] = newline[nxt[1:]]
    rank[newline & blank_next & ~sp_before] = 4
    rank[first] = 0
    return rank, ~space & sp_before


def cuts(texts: list[str], limit: int, overlap: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(starts, ends) of the pieces of each text; all texts at once."""
    if not 0 <= overlap < limit // 3:
        raise ValueError("overlap must be under a third of the limit")
    if not texts:
        return []
    size = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    total = int((size + 1).sum())
    c = np.full(total, 32, np.uint32)
    for b, t in zip(base, texts):
        c[b : b + len(t)] = _points(t)
    doc = np.repeat(np.arange(len(texts)), size + 1)
    me = np.arange(total)
    at, end = me - base[doc], (base + size)[doc]
    rank, word = _ranks(c, at, size[doc])
    # the start that follows a cut at each position
    want = np.maximum(me - overlap, base[doc])
    last_word = np.maximum.accumulate(np.where(word, me, -1))
    next_word = np.minimum.accumulate(np.where(word, me, total)[::-1])[::-1]
    half = overlap // 2
    a, b = last_word[want], next_word[want]
    start = np.where((a >= want - half) & (a >= base[doc]), a, np.where(b <= want + half, b, want))
    start = np.where((at == 0) | (overlap == 0), me, start)
    # the farthest legal end of the piece that starts there
    room = np.minimum(start + limit, end)
    succ = room.copy()
    open_ = np.ones(total, bool)
    open_ &= room < end
    for k in (4, 3, 2, 1):
        last = np.maximum.accumulate(np.where(rank >= k, me, -1))[room]
        ok = open_ & (last > me) & ((last >= start + limit // 2) | (k == 1))
        succ = np.where(ok, last, succ)
        open_ &= ~ok
    succ = np.where(me == end, me, succ)
    # square the successor tables
    reached = np.zeros(total, bool)
    reached[base] = True
    table = succ
    while True:
        to = table[reached]
        if reached[to].all():
            break
        reached[to] = True
        table = table[table]
    out = []
    for b, n in zip(base, size):
        cut = np.flatnonzero(reached[b : b + n + 1])
        if n == 0 or len(cut) < 2:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        out.append((start[b + cut[:-1]] - b, cut[1:]))
    return out


def _split_batches(batches: Iterator[pa.RecordBatch], keys: list[str], text: str, limit: int, overlap: int, units: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(text).to_pylist()
        todo: list[tuple[int, int, int, str]] = []

        def flush() -> pa.RecordBatch:
            rows, cols = [], {k: [] for k in ("unit_no", "piece_no", "start", "end", "shared", "piece")}
            for (row, unit, offset, t), (s, e) in zip(todo, cuts([x[3] for x in todo], limit, overlap)):
                prev = 0
                for i, (p, q) in enumerate(zip(s.tolist(), e.tolist())):
                    rows.append(row)
                    for k, v in (("unit_no", unit), ("piece_no", i + 1), ("start", offset + p), ("end", offset + q), ("shared", max(0, prev - p)), ("piece", t[p:q])):
                        cols[k].append(v)
                    prev = q
            arrays = [batch.column(k).take(pa.array(rows, pa.int64())) for k in keys]
            arrays += [pa.array(cols[k], pa.string() if k == "piece" else pa.int32()) for k in cols]
            todo.clear()
            return pa.RecordBatch.from_arrays(arrays, [*keys, *cols])

        n = 0
        for row, t in enumerate(texts):
            if t is None or len(t) <= limit:
                continue
            todo.append((row, 0, 0, t))
            n += len(t)
            if units:
                for i, (a, b) in enumerate(paragraphs(t)):
                    if b - a > limit:
                        todo.append((row, i + 1, a, t[a:b]))
                        n += b - a
            if n > BATCH_CHARS:
                yield flush()
                n = 0
        if todo:
            yield flush()


def split_oversized(df: DataFrame, keys: list[str], text: str, limit: int, overlap: int, units: bool = False) -> DataFrame:
    """Pieces of the texts over the limit: (*keys, unit_no, piece_no, start, end, shared, piece).

    unit_no is 0 for the whole text; with units each paragraph that is itself over the limit is cut too, under its number
    from 1. start and end are offsets in the whole text, shared is what a piece has in common with the one before. Null,
    empty and short texts give no pieces; repeated rows are cut once each; other columns, of whatever name, don't matter.
    """
    clash = {"unit_no", "piece_no", "start", "end", "shared", "piece"} & set(keys)
    if clash:
        raise ValueError(f"key columns {sorted(clash)} have names of the result")
    src = df.select(*keys, text) if text not in keys else df.select(*keys)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    return src.mapInArrow(lambda it: _split_batches(it, keys, text, limit, overlap, units), f"{fields}, {_SCHEMA}")
