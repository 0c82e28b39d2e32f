"""Fill containers of fixed capacity with items of varying length.

An item over the capacity is cut: full containers of its own, and a rest that is packed like any item. Items are dealt at
random (by a hash of their id and size) to blocks of a few hundred containers, one task each. In a block Karmarkar-Karp multiway
differencing makes k windows: each item is a partial partition of one window; the two partial partitions with the
greatest imbalance are merged so that the fullest window of one meets the emptiest of the other, until one is left. k
starts at the block's load over the capacity, the least that could do.

Near-equal windows lie close to the capacity, some above it. A window that is over gives up its overflow, the smallest item
that is enough; windows that are then full but for a little slack are kept. The count rises for what was given up and for the
windows that weren't kept: their items are differenced again, among themselves, with a little more slack, level after
level. Where windows hold two or three items differencing alone leaves 3 % unused, as one item is too coarse an overflow; so
after LEVELS the items still loose go, largest first, to the fullest open window with room, and a window is added whenever
none has room.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.session import tasks

#: Containers of a block, as long as its items stay below the second bound.
BLOCK_WINDOWS = 256
BLOCK_ITEMS = 20_000
#: Rows of one id and size that go to a block together.
COPIES = 16
#: Items that a task holds, about.
TASK_ITEMS = 500_000


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: (window of each item, load of each window)."""
    n = len(sizes)
    if n == 0 or k == 1:
        return np.zeros(n, np.int64), np.array([sizes.sum()] * (1 if k == 1 else 0) or [0] * k, np.int64)
    parent: list[int] = list(range(n))  # windows of partial partitions form a forest; its leaves are the items
    heap = [(-int(s), i) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    count = n

    def part(i: int) -> tuple[np.ndarray, np.ndarray]:
        if i in parts:
            return parts.pop(i)
        load, node = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        load[0], node[0] = sizes[i], i
        return load, node

    for _ in range(n - 1):
        (_, i), (_, j) = heapq.heappop(heap), heapq.heappop(heap)
        (la, na), (lb, nb) = part(i), part(j)
        lb, nb = lb[::-1], nb[::-1]
        load, node = la + lb, np.where(na >= 0, na, nb)
        both = np.flatnonzero((na >= 0) & (nb >= 0))
        if len(both):
            new = np.arange(len(parent), len(parent) + len(both))
            for x, y, z in zip(na[both].tolist(), nb[both].tolist(), new.tolist()):
                parent[x] = parent[y] = z
            parent.extend(new.tolist())
            node = node.copy()
            node[both] = new
        order = np.argsort(-load, kind="stable")
        load, node = load[order], node[order]
        parts[count] = (load, node)
        heapq.heappush(heap, (-int(load[0] - load[-1]), count))
        count += 1
    load, node = part(heap[0][1])
    where = np.full(len(parent), -1, np.int64)
    for w, x in enumerate(node.tolist()):
        if x >= 0:
            where[x] = w
    for x in range(len(parent) - 1, -1, -1):  # a parent's number is above its children's
        if where[x] < 0:
            where[x] = where[parent[x]]
    return where[:n], load


#: Share of a window that may be unused for it to be kept, by level.
LEVELS = (0.002, 0.003, 0.005, 0.008, 0.012, 0.02, 0.03)


def _level(sizes: np.ndarray, capacity: int, slack: float) -> tuple[np.ndarray, int]:
    """(window of each item that is kept, -1 for the others; number of windows kept) of one differencing."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    where, load = differencing(sizes, k)
    if load.max() <= capacity:  # k is the least count that could do
        return where, k
    stays = np.ones(len(sizes), bool)
    order = np.lexsort((sizes, where))
    for w in np.flatnonzero(load > capacity).tolist():
        mine = order[np.searchsorted(where[order], w) : np.searchsorted(where[order], w, "right")]
        at = np.searchsorted(sizes[mine], load[w] - capacity)  # the smallest item that is enough
        if at < len(mine):
            stays[mine[at]] = False
            load[w] -= sizes[mine[at]]
    keep = (load <= capacity) & (load >= capacity * (1 - slack)) & (load > 0)
    number = np.cumsum(keep) - 1
    return np.where(stays & keep[where], number[where], -1), int(keep.sum())


def pack_block(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(window of each item, number of windows that differencing made); no window is above the capacity. No item may be above it."""
    out = np.full(len(sizes), -1, np.int64)
    loose, k = np.arange(len(sizes)), 0
    for slack in LEVELS:
        if not len(loose):
            break
        where, more = _level(sizes[loose], capacity, slack)
        kept = where >= 0
        out[loose[kept]] = where[kept] + k
        loose, k = loose[~kept], k + more
    made = k
    rooms: list[tuple[int, int]] = []
    for i in loose[np.argsort(-sizes[loose], kind="stable")].tolist():
        s = int(sizes[i])
        at = bisect_left(rooms, (s, -1))
        if at == len(rooms):
            room, w, k = capacity, k, k + 1
        else:
            room, w = rooms.pop(at)
        out[i] = w
        insort(rooms, (room - s, w))
    return out, made


def _pack(capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        for block, pdf in pd.concat(parts, ignore_index=True).groupby("block", sort=True):
            pdf = pdf.loc[pdf.index.repeat(pdf["copies"])].sort_values(["tokens", "item_id", "piece_no"], ascending=[False, True, True], ignore_index=True)
            pdf["window_no"] = pack_block(pdf["tokens"].to_numpy(np.int64), capacity)[0]
            yield pdf[["item_id", "piece_no", "start", "tokens", "block", "window_no"]]

    return run


def pack(items: DataFrame, capacity: int, n_tasks: int | None = None) -> DataFrame:
    """Containers of items: (item_id, piece_no, start, tokens, container_id).

    items: (item_id bigint, tokens bigint), one row an item. Only an item over the capacity has several pieces, numbered
    from 1, that start at `start` tokens. An item without tokens takes no space but still gets a container. Null ids and
    repeated ids are items as any; a null size counts as 0. Containers are text ids `f:<item>:<piece>` for pieces that fill one
    alone, else `b:<block>:<window>`. No items, no containers.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    size = F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("bigint")
    n = F.greatest(F.ceil(size / F.lit(capacity)), F.lit(1)).cast("int")
    pieces = items.select("item_id", size.alias("size"), F.explode(F.sequence(F.lit(1), n)).alias("piece_no"))
    start = ((F.col("piece_no") - 1) * F.lit(capacity)).cast("bigint")
    pieces = pieces.select("item_id", "piece_no", start.alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("size") - start).alias("tokens"))
    full = pieces.where(F.col("tokens") == capacity)
    rest = pieces.where(F.col("tokens") < capacity)
    load, count = rest.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, -(-load // (BLOCK_WINDOWS * capacity)), -(-count // BLOCK_ITEMS))
    # blocks follow ids and sizes, not the layout of the files; rows that agree in both travel as one, a few copies to a block
    rest = rest.groupBy("item_id", "piece_no", "start", "tokens").agg(F.count(F.lit(1)).alias("n"))
    rest = rest.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {COPIES}"))))
    rest = rest.withColumn("copies", F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES).cast("int"))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("item_id", "piece_no", "tokens", "part"), F.lit(blocks)).cast("int")).drop("n", "part")
    # several blocks a task: as many tasks as the session has, more only where a task would hold too many rows
    parts = min(blocks, max(n_tasks or tasks(items.sparkSession), -(-count // TASK_ITEMS)))
    rest = rest.repartitionById(parts, F.pmod("block", F.lit(parts)).cast("int")) if parts > 1 else rest.repartition(1)
    packed = rest.mapInPandas(_pack(capacity), "item_id bigint, piece_no int, start bigint, tokens bigint, block int, window_no bigint")
    packed = packed.select("item_id", "piece_no", "start", "tokens", F.format_string("b:%d:%d", "block", "window_no").alias("container_id"))
    return packed.unionByName(full.select("item_id", "piece_no", "start", "tokens", F.format_string("f:%d:%d", "item_id", "piece_no").alias("container_id")))
