"""Approximate search by inverted lists: vectors in cells of a trained codebook, of which a query looks into a few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.operators.retrieval import top, valid_vector
from mnemolake.session import materialize

#: Vectors that the codebook is trained on, at most; every vector is indexed.
FIT_ROWS = 20_000


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)


def codebook(vectors: np.ndarray, cells: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centroids of a spherical k-means; empty cells keep their place."""
    u = _unit(np.asarray(vectors, np.float64))
    c = u[np.random.default_rng(seed).choice(len(u), min(cells, len(u)), replace=False)]
    for _ in range(rounds):
        near = (u @ c.T).argmax(axis=1)
        s = np.zeros_like(c)
        np.add.at(s, near, u)
        size = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(size > 0, s / np.maximum(size, 1e-300), c)
    return c


def build(docs: DataFrame, dim: int, cells: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(id, vector, cell) of every valid vector, written in order of cell, and the codebook."""
    v = docs.where(valid_vector("vector", dim)).select("id", "vector")
    n = v.count()
    if n == 0:
        return v.withColumn("cell", F.lit(0)), np.zeros((0, dim))
    sample = v if n <= FIT_ROWS else v.sample(FIT_ROWS / n, 11).limit(FIT_ROWS)
    book = codebook(np.array([r["vector"] for r in sample.select("vector").collect()], np.float64), cells or max(1, min(4096, int(np.sqrt(n)))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = b.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), pa.array((_unit(m) @ book.T).argmax(axis=1).astype(np.int32))], ["id", "vector", "cell"])

    # id takes part in the range, so a cell with most vectors spreads over several files
    out = v.mapInArrow(assign, "id string, vector array<float>, cell int").repartitionByRange("cell", "id").sortWithinPartitions("cell")
    return materialize(out, "ivf"), book


def search(index: DataFrame, book: np.ndarray, queries: DataFrame, dim: int, nprobe: int = 4, block: int = 20_000) -> DataFrame:
    """(query_id, id, score, rank): the k best of each query among its nprobe nearest cells. Queries run in blocks of bounded size."""
    q = queries.where(valid_vector("vector", dim) & (F.col("k") > 0)).select("query_id", "vector", "k")
    none = index.sparkSession.createDataFrame([], "query_id bigint, id string, score double")
    total = q.count() if len(book) else 0
    out = none
    blocks = -(-total // block)
    for i in range(blocks):
        rows = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).collect()
        if not rows:
            continue
        ids, ks = np.array([r["query_id"] for r in rows], np.int64), np.array([r["k"] for r in rows])
        u = _unit(np.array([r["vector"] for r in rows], np.float64))
        near = np.argsort(-(u @ book.T), axis=1, kind="stable")[:, :nprobe]
        probing = [np.flatnonzero((near == c).any(axis=1)) for c in range(len(book))]

        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                cell = b.column("cell").to_numpy()
                m = _unit(b.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
                names = b.column("id")
                for c in np.unique(cell):
                    at = np.flatnonzero(cell == c)
                    who = probing[c]
                    if not len(who):
                        continue
                    s = np.round(np.clip(u[who] @ m[at].T, -1, 1), 6)
                    r, col = [], []
                    for j in range(len(who)):
                        d = min(int(ks[who[j]]), s.shape[1])
                        keep = np.flatnonzero(s[j] >= np.partition(s[j], -d)[-d])
                        r.append(np.full(len(keep), j))
                        col.append(keep)
                    r, col = np.concatenate(r), np.concatenate(col)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[who[r]]), names.take(pa.array(at[col])), pa.array(s[r, col])], ["query_id", "id", "score"])

        found = index.mapInArrow(scores, "query_id bigint, id string, score double")
        out = found if out is none else out.unionByName(found)
    return top(out, queries, F.col("k")).select("query_id", "id", "score", "rank")


def trace(index: DataFrame, book: np.ndarray, vector: list[float], k: int, nprobe: int = 4) -> DataFrame:
    """How a search goes: (layer, node, distance); layer 1 are the cells it looks into, layer 0 the k best of their documents."""
    spark = index.sparkSession
    v = _unit(np.array([vector], np.float64))[0]
    near = np.argsort(-(book @ v), kind="stable")[:nprobe] if len(book) else []
    cells = spark.createDataFrame([(1, str(int(c)), round(float(1 - book[c] @ v), 6)) for c in near], "layer int, node string, distance double")
    dot = F.aggregate(F.zip_with("vector", F.array(*[F.lit(float(x)) for x in v]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    best = index.where(F.col("cell").isin([int(c) for c in near])).select(F.lit(0).alias("layer"), F.col("id").alias("node"), F.round(F.greatest(F.lit(0.0), 1 - dot / norm), 6).alias("distance"))
    return cells.unionByName(best.orderBy("distance", "node").limit(k))


def principal_axes(docs: DataFrame, dim: int, axes: int = 3) -> DataFrame:
    """(id, axis array<double>): vectors projected on their leading principal axes, from sums over all of them; each axis's largest part is positive."""
    v = docs.where(valid_vector("vector", dim)).select("id", "vector")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                m = b.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                n, s, ss = n + len(m), s + m.sum(axis=0), ss + m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([s.tolist()]), pa.array([ss.ravel().tolist()])], ["n", "s", "ss"])

    parts = v.select("vector").mapInArrow(moments, "n double, s array<double>, ss array<double>").collect()  # one row a task
    n = sum(p["n"] for p in parts)
    if not n:
        return v.select("id", F.array().cast("array<double>").alias("axis"))
    mean = np.sum([p["s"] for p in parts], axis=0) / n
    cov = np.sum([p["ss"] for p in parts], axis=0).reshape(dim, dim) / n - np.outer(mean, mean)
    e = np.linalg.eigh(cov)[1][:, ::-1][:, :axes]
    e = e * np.sign(e[np.abs(e).argmax(axis=0), np.arange(e.shape[1])])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = b.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(((m - mean) @ e).round(6).tolist(), pa.list_(pa.float64()))], ["id", "axis"])

    return v.mapInArrow(project, "id string, axis array<double>")
