"""The k most similar vectors of every vector, by shifted space-filling curves.

Each curve projects the unit vectors by a random rotation, shifts the grid by a random offset and orders the cells along a
Hilbert curve. Every curve's order is cut into ranges, one a task, by bounds from a sample of the keys; a range is sorted and read as a
stream, in which a vector is compared exactly with the `window` vectors on either side, in blocks, as matrix products. Rows near a bound
also go to the range beyond it, so windows go on over the bounds. The best of each window are merged over all curves
and ranked again. A pair that one curve tears apart is close on another, so recall grows with the number of curves. The grid is fine (16
bits a side), so that the order means something inside a dense group too, down to about the rounding of similarities; keys end
with the vector's number, so that any number of vectors of one cell are spread over ranges.

Copies of one vector are one point with the smallest ids that can matter: a group of copies of any size costs one row a curve,
and each copy still gets its own result. Points are numbered in order of their smallest id, and the best are picked by rounded
similarity and number, so ties go to the smaller id. Vectors that differ by less than the rounding shows, such as multiples of
one, share a cell of a fine grid; whoever meets one of them is also compared with the first of its cell, however many there are.
Vectors travel as bytes, and what most rows name (a vector with most copies, a hub) is looked up apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolake.operators.skew import lookup_join
from mnemolake.session import materialize, tasks

#: Vectors that the scales of the grid and the bounds of the ranges are fitted on, at most; every vector is indexed.
FIT_ROWS = 20_000
#: Rows of a task of a curve's ranges, about; rows that a task holds at once.
TASK_ROWS, HELD_ROWS = 60_000, 20_000
#: Queries of one matrix product.
STEP = 256
_NEAR = np.dtype([("far", "<i4"), ("near", "<i8")])
#: Sides of the cells that nearly equal unit vectors share; each grid is laid twice, with other offsets.
CELLS = (1e-5, 3e-4)


def is_valid(v: Column, dim: int) -> Column:
    """Exactly dim finite numbers that aren't all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _hilbert_bits(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each cell on the Hilbert curve through a grid of 2^bits cells a side, as (rows, bits * dimensions) binary digits; cells: (rows, dimensions).

    Gray-code form: from the top bit down, each axis either inverts the lower bits of the first axis or swaps them with
    its own; what results, read bit by bit across the axes, is the place.
    """
    x = cells.T.astype(np.uint64).copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for axis in range(dims):
            on = (x[axis] & bit) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(on, below, swap)
            x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & np.uint64(1 << level)) != 0, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turn
    levels = np.arange(bits - 1, -1, -1, dtype=np.uint64)
    digits = (x[None, :, :] >> levels[:, None, None]) & np.uint64(1)
    return digits.reshape(bits * dims, -1).T.astype(np.uint8)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The places as numbers, where bits * dimensions is at most 63."""
    digits = _hilbert_bits(cells, bits).astype(np.int64)
    return digits @ (1 << np.arange(digits.shape[1] - 1, -1, -1, dtype=np.int64))


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as byte strings."""
    n, size = rows.shape
    offsets = np.arange(0, (n + 1) * size, size, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _bytes(col: pa.Array, size: int) -> np.ndarray:
    """Byte strings of one size as rows of bytes."""
    offsets = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4)
    return np.frombuffer(col.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])).reshape(-1, size) if len(col) else np.zeros((0, size), np.uint8)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return _bytes(col, 4 * dim).view("<f4")


def _packed(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            m = b.column("vector").flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column("id"), _binary((m + np.float32(0)).view(np.uint8))], ["id", "v"])  # no minus zeros


def _unit(m: np.ndarray) -> np.ndarray:
    wide = m.astype(np.float64)
    # scaled first, so that very large or small numbers don't overflow
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _curves(count: int, dim: int, dims: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    g = np.random.default_rng(seed)
    return [(np.linalg.qr(g.normal(size=(dim, dim)))[0][:, :dims], g.random(dims)) for _ in range(count)]


class Curve:
    """One order of all vectors, and its ranges."""

    def __init__(self, fit: np.ndarray, uid: np.ndarray, line: tuple[np.ndarray, np.ndarray], bits: int, ranges: int, window: int, n: int):
        self.rotation, self.shift = line
        self.bits = bits
        lo, hi = np.quantile(fit @ self.rotation, [0.001, 0.999], axis=0)
        self.lo, self.width = lo, np.maximum(hi - lo, 1e-9)
        keys = np.sort(self.keys(fit, uid))
        at = (np.arange(1, ranges) * len(keys)) // ranges
        around = int(1.5 * window * len(keys) / n) + 2  # so many sampled keys lie in a window, and some more
        self.bounds, self.before, self.behind = keys[at], keys[np.maximum(at - around, 0)], keys[np.minimum(at + around, len(keys) - 1)]

    def keys(self, u: np.ndarray, uid: np.ndarray) -> np.ndarray:
        """Place on the curve and number, as byte strings."""
        side = 1 << self.bits
        # the grid reaches a width and more beyond the fitted range, so that few rows lie outside
        cells = np.clip(((u @ self.rotation - self.lo) / self.width + self.shift + 1) / 4 * side, 0, side - 1)
        key = np.concatenate([np.packbits(_hilbert_bits(cells, self.bits), axis=1), uid.astype(">u8").view(np.uint8).reshape(-1, 8)], axis=1)
        return key.view(f"S{key.shape[1]}").ravel()

    def ranges(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, range, whether it is the row's own): also the range beyond a bound that is near."""
        own = np.searchsorted(self.bounds, key, "right")
        rows = np.arange(len(key))
        if not len(self.bounds):
            return rows, own, np.ones(len(key), bool)
        up = np.flatnonzero((own < len(self.bounds)) & (key >= self.before[np.minimum(own, len(self.bounds) - 1)]))
        down = np.flatnonzero((own > 0) & (key <= self.behind[np.maximum(own - 1, 0)]))
        is_own = np.repeat([True, False], [len(key), len(up) + len(down)])
        return np.concatenate([rows, up, down]), np.concatenate([own, own[up] + 1, own[down] - 1]), is_own


def _keys(batches: Iterator[pa.RecordBatch], dim: int, curves: list[Curve], ranges: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, HELD_ROWS):
            b = whole.slice(at, HELD_ROWS)
            u, uid = _unit(_matrix(b.column("v"), dim)), b.column("uid").to_numpy()
            for i, curve in enumerate(curves):
                key = curve.keys(u, uid)
                row, part, own = curve.ranges(key)
                rows = key[row].view(np.uint8).reshape(len(row), -1) if len(row) else np.zeros((0, key.dtype.itemsize), np.uint8)
                part = pa.array((i * ranges + part).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part, _binary(rows), b.column("v").take(pa.array(row)), pa.array(own)], ["part", "key", "v", "own"])


def _around(part: np.ndarray, uid: np.ndarray, unit: np.ndarray, own: np.ndarray, p: int, z: int, window: int, keep: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(number, best neighbours) of the rows from p to z that are their range's own, against the window around them."""
    lo, hi = max(0, p - window), min(len(uid), z + window)
    q = p + np.flatnonzero(own[p:z])
    n = min(keep, hi - lo - 1)
    if n <= 0 or not len(q):
        return None
    # one number that sorts by similarity at 6 decimals, then by uid
    place = np.empty(hi - lo)
    place[np.argsort(uid[lo:hi])] = np.arange(hi - lo)
    s = unit[q] @ unit[lo:hi].T
    s *= -1e6
    np.rint(s, out=s)
    s *= hi - lo
    s += place
    s[np.arange(len(q)), q - lo] = np.inf
    if part[lo] != part[hi - 1]:  # neighbours of another range, where a task has several
        s[part[q][:, None] != part[lo:hi][None, :]] = np.inf
    best = np.argpartition(s, n - 1, axis=1)[:, :n]
    out = np.empty((len(q), n), _NEAR)
    out["far"] = -np.round(np.einsum("ijk,ik->ij", unit[lo:hi][best], unit[q]) * 1e6)
    out["near"] = np.where(np.isinf(np.take_along_axis(s, best, 1)), -1, uid[lo:hi][best])
    return uid[q], out


def _windows(batches: Iterator[pa.RecordBatch], dim: int, window: int, keep: int) -> Iterator[pa.RecordBatch]:
    """Compare each vector with those around it; rows come sorted by (part, key) and are held a stretch at a time."""
    held: list[np.ndarray] | None = None
    done = 0  # rows of held whose neighbours are found

    def emit(upto: int) -> Iterator[pa.RecordBatch]:
        for p in range(done, upto, STEP):
            found = _around(*held, p, min(p + STEP, upto), window, keep)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), _binary(found[1].view(np.uint8).reshape(len(found[0]), -1))], ["uid", "best"])

    for whole in batches:
        for at in range(0, whole.num_rows, HELD_ROWS):
            b = whole.slice(at, HELD_ROWS)
            size = b.column("key")[0].as_py()
            key = _bytes(b.column("key"), len(size))
            uid = np.ascontiguousarray(key[:, -8:]).view(">u8").ravel().astype(np.int64)
            new = [b.column("part").to_numpy(), uid, _unit(_matrix(b.column("v"), dim)), b.column("own").to_numpy(zero_copy_only=False)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            upto = len(held[0]) - window
            if upto > done:
                yield from emit(upto)
                cut = max(0, upto - window)
                held, done = [x[cut:] for x in held], upto - cut
    if held is not None:
        yield from emit(len(held[0]))


def _merge(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """Of each point the best over all curves; rows come sorted by uid, and a point brings a row a curve."""
    held: tuple[np.ndarray, np.ndarray] | None = None

    def best(uid: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((c["near"], c["far"], uid))
        uid, c = uid[order], c[order]
        fresh = np.ones(len(uid), bool)
        fresh[1:] = (uid[1:] != uid[:-1]) | (c["near"][1:] != c["near"][:-1])
        uid, c = uid[fresh], c[fresh]
        at = np.arange(len(uid))
        first = np.maximum.accumulate(np.where(np.concatenate([[True], uid[1:] != uid[:-1]]), at, 0)) if len(uid) else at
        top = at - first < keep
        return pa.RecordBatch.from_arrays([pa.array(uid[top]), pa.array(-c["far"][top] / 1e6), pa.array(c["near"][top])], ["uid", "sim", "near"])

    for b in batches:
        if not b.num_rows:
            continue
        best_ = b.column("best")
        sizes = np.diff(np.frombuffer(best_.buffers()[1], np.int32, len(best_) + 1, best_.offset * 4)) // _NEAR.itemsize
        first = int(np.frombuffer(best_.buffers()[1], np.int32, 1, best_.offset * 4)[0])
        c = np.frombuffer(best_.buffers()[2], _NEAR, int(sizes.sum()), first)
        uid = np.repeat(b.column("uid").to_numpy(), sizes)
        uid, c = uid[c["near"] >= 0], c[c["near"] >= 0]
        if held is not None:
            uid, c = np.concatenate([held[0], uid]), np.concatenate([held[1], c])
        if not len(uid):
            continue
        full = uid < uid[-1]
        held = uid[~full], c[~full]
        if full.any():
            yield best(uid[full], c[full])
    if held is not None and len(held[0]):
        yield best(*held)


def _cells(batches: Iterator[pa.RecordBatch], dim: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The cell of each vector in each fine grid, as a hash; a clash only adds candidates."""
    g = np.random.default_rng(seed)
    grids = [(side, g.random(dim), g.integers(-(2**62), 2**62, dim) | 1) for side in CELLS for _ in range(2)]
    for b in batches:
        if b.num_rows:
            u = _unit(_matrix(b.column("v"), dim))
            for side, shift, odd in grids:
                cell = (np.floor(u / side + shift).astype(np.int64) * odd).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell), b.column("uid")], ["cell", "uid"])


def _compare(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            sims = np.einsum("ij,ij->i", _unit(_matrix(b.column("a"), dim)), _unit(_matrix(b.column("b"), dim)))
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(np.round(sims, 6)), b.column("near")], ["uid", "sim", "near"])


def _with_cells(pairs: DataFrame, points: DataFrame, dim: int, keep: int, seed: int) -> DataFrame:
    """Pairs (uid, sim, near), and each uid's pairs with the first `keep` points of every shared cell that it or one of its partners is in."""
    cells = points.select("uid", "v").mapInArrow(lambda it: _cells(it, dim, seed), "cell bigint, uid bigint")
    first = cells.withColumn("_r", F.row_number().over(Window.partitionBy("cell").orderBy("uid"))).where(F.col("_r") <= keep)
    heads = materialize(first.groupBy("cell").agg(F.collect_list("uid").alias("heads")).where(F.size("heads") > 1), "cells")
    if heads.isEmpty():
        return pairs
    pairs = materialize(pairs, "pairs")
    shared = materialize(cells.join(heads.select("cell"), "cell", "left_semi"), "shared")
    met = pairs.select("uid", "near").unionByName(shared.select("uid", F.col("uid").alias("near")))
    met = met.join(shared.withColumnRenamed("uid", "near"), "near").select("uid", "cell").distinct()
    more = met.join(heads, "cell").select("uid", F.explode("heads").alias("near")).where("uid <> near").distinct()
    more = more.join(points.select("uid", F.col("v").alias("a")), "uid").join(points.select(F.col("uid").alias("near"), F.col("v").alias("b")), "near")
    more = more.select("uid", "near", "a", "b").mapInArrow(lambda it: _compare(it, dim), "uid bigint, sim double, near bigint")
    return pairs.unionByName(more).groupBy("uid", "near").agg(F.max("sim").alias("sim"))


def nearest(df: DataFrame, dim: int, k: int = 5, curves: int = 16, window: int = 1024, dims: int = 8, bits: int = 16, seed: int = 7) -> DataFrame:
    """(id, near_id, sim, rank): the k most similar others of each id with a valid vector, by cosine rounded to 6 decimals, ties to the smaller id.

    df: (id string, vector array<float>), one row an id; extra columns don't matter. Rows with a null id or a vector that
    isn't dim finite numbers, not all zero, take no part. With fewer than k others all of them come out.
    """
    spark = df.sparkSession
    valid = df.where(F.col("id").isNotNull() & is_valid(F.col("vector"), dim)).select("id", F.col("vector").cast("array<float>").alias("vector"))
    valid = materialize(valid.mapInArrow(lambda it: _packed(it, dim), "id string, v binary"), "vectors")
    # points: copies share one, with the k + 1 smallest ids
    ranked = valid.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_r") <= k + 1)
    points = ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("id").alias("first"))
    # numbered in order of the smallest id
    points = points.repartitionByRange(tasks(spark), "first").sortWithinPartitions("first").withColumn("uid", F.monotonically_increasing_id()).drop("first")
    points = materialize(points, "points")
    n = points.count()
    if n == 0:
        return spark.createDataFrame([], "id string, near_id string, sim double, rank int")
    sample = points.select("uid", "v") if n <= FIT_ROWS else points.select("uid", "v").sample(FIT_ROWS / n, seed).limit(FIT_ROWS)
    rows = sample.collect()
    fit, uid = _unit(np.frombuffer(b"".join(bytes(r["v"]) for r in rows), "<f4").reshape(-1, dim)), np.array([r["uid"] for r in rows], np.int64)
    # a range of more rows than it should have is still read as a stream
    ranges = max(1, min(-(-n // TASK_ROWS), len(rows) // 8))
    orders = [Curve(fit, uid, line, bits, ranges, window, n) for line in _curves(curves, dim, min(dims, dim), seed)]
    keyed = points.select("uid", "v").mapInArrow(lambda it: _keys(it, dim, orders, ranges), "part int, key binary, v binary, own boolean")
    keyed = keyed.repartitionById(ranges * curves, "part").sortWithinPartitions("part", "key")
    keep = k + 1
    found = keyed.mapInArrow(lambda it: _windows(it, dim, window, keep), "uid bigint, best binary")
    parts = max(tasks(spark), -(-n // TASK_ROWS))
    pairs = found.repartition(parts, "uid").sortWithinPartitions("uid").mapInArrow(lambda it: _merge(it, keep), "uid bigint, sim double, near bigint")
    pairs = materialize(pairs, "pairs")
    pairs = _with_cells(pairs, points, dim, k + 2, seed)
    ids = points.select(F.col("uid").alias("_near"), "ids")
    others = lookup_join(pairs, ids, "near", "_near", keep * n).select("uid", "sim", F.explode("ids").alias("near_id"))
    own = points.where(F.size("ids") > 1).select("uid", F.lit(1.0).alias("sim"), F.explode("ids").alias("near_id"))
    order = Window.partitionBy("uid").orderBy(F.desc("sim"), "near_id")
    best = others.unionByName(own).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    best = best.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rank", "near_id", "sim"))).alias("c"))
    best = materialize(points.join(best, "uid").select(F.col("v").alias("_v"), "c"), "best")
    # each copy gets its point's list without itself
    each = lookup_join(valid, best, "v", "_v", n).select("id", F.slice(F.filter("c", lambda x: x["near_id"] != F.col("id")), 1, k).alias("c"))
    return each.select("id", F.posexplode("c").alias("p", "c")).select("id", F.col("c.near_id").alias("near_id"), F.col("c.sim").alias("sim"), (F.col("p") + 1).alias("rank"))


def pairs_of(neighbours: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a before id_b: pairs where one is among the other's nearest, once each."""
    return neighbours.select(F.least("id", "near_id").alias("id_a"), F.greatest("id", "near_id").alias("id_b")).distinct()


def brute_force(ids: list[str], vectors: np.ndarray, k: int, rows: np.ndarray | None = None) -> dict[str, list[str]]:
    """The exact answer for some rows, in blocks; to measure recall."""
    u = _unit(np.asarray(vectors))
    order = np.argsort(np.array(ids, object))
    rows = np.arange(len(ids)) if rows is None else rows
    out = {}
    for i in rows:
        s = np.round(u[order] @ u[i], 6)
        best = [j for j in order[np.argsort(-s, kind="stable")[: k + 1]] if j != i][:k]
        out[ids[i]] = [ids[j] for j in best]
    return out
