"""Parent-child links to full hierarchies: root, depth, rings, paths and descendants of every node.

Every node has at most one parent, so the links form trees and rings. The work is done by weighted disjoint-set forests:

1. Nodes are range-partitioned and cut into blocks of neighbouring ids, as they are read: a block never holds more than
   BLOCK_ROWS, however many nodes there are. Each block links its own nodes in one forest, where a node holds the
   offset to its set's root; finds are flattened by path halving, for all nodes at once. What can't be flattened ends in a ring.
2. A set whose root has its parent in another block becomes one node of a smaller graph, linked to the set that holds
   that parent, with the sum of offsets as weight. That graph is cut into blocks again, and so on until it fits in one.
3. Results flow back down: a node's root is its set's root, its depth the set's depth plus its own offset.

Where links reach far, so that the smaller graph isn't smaller, its chains are resolved by rounds of pointer doubling, as
joins. A node with most of the links, or a tree with most of the nodes, is a hot key of those joins and is looked up apart.

Nulls: a row with a null id is no node; a null parent, or one that is no node, makes a root. Of several rows of an id one
counts, the one with the greatest parent. A node that is its own parent is a ring of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.operators.skew import fragment_join, key_loads, lookup_join, plan_shards
from mnemolake.session import materialize, tasks

#: Rows of a block, the most that one task links at once (some 100 bytes a row).
BLOCK_ROWS = 250_000
#: Rows that are worth a task of their own.
TASK_ROWS = 8_000
#: Entries of the paths that a task holds at once.
CHAIN_ENTRIES = 4_000_000
_LINKED = "node bigint, set_root bigint, offset bigint, low bigint, ext bigint, ext_weight bigint, ext_low bigint, ring bigint"
_RESOLVED = "node bigint, root bigint, depth bigint, ring bigint"


def forest(node: np.ndarray, parent: np.ndarray, weight: np.ndarray, low: np.ndarray, has_parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Link the nodes whose parent is among them.

    node ascends without repeats; low is the smallest id that a node's link passes, its end included. Gives, by node: the
    index of its set's root, the offset to it, the smallest id on the way there, whether its chain ends in a ring, and the
    smallest id on that ring. Root, offset and way mean nothing where it does.
    """
    n = len(node)
    me = np.arange(n)
    at = np.minimum(np.searchsorted(node, parent), max(n - 1, 0))
    inside = has_parent & (node[at] == parent) if n else has_parent
    step = np.where(inside, at, me)
    up, off, way = step, np.where(inside, weight, 0), np.where(inside, low, np.iinfo(np.int64).max)
    for _ in range(n.bit_length() + 1):
        if not inside[up].any():
            break
        off, way, up = off + off[up], np.minimum(way, way[up]), up[up]
    ringed = inside[up]
    least = node
    if ringed.any():
        ring, jump = np.where(inside, low, node), step
        for _ in range(n.bit_length() + 1):
            ring, jump = np.minimum(ring, ring[jump]), jump[jump]
        least = ring[up]  # up is on the ring, and from there all that is met is on it
    return up, off, way, ringed, least


def _blocks(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """A task's rows, sorted by node, cut into blocks of at most `rows`."""
    held: list[pd.DataFrame] = []
    n = 0
    for b in batches:
        while len(b):
            part, b = b.iloc[: rows - n], b.iloc[rows - n :]
            held.append(part)
            n += len(part)
            if n == rows:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _numbers(s: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    there = s.notna().to_numpy()
    return there, s.astype("Int64").fillna(0).to_numpy(np.int64)


def _nullable(values: np.ndarray, there: np.ndarray) -> pd.Series:
    return pd.Series(pd.arrays.IntegerArray(values.astype(np.int64), ~there))


def _link(pdf: pd.DataFrame) -> pd.DataFrame:
    node = pdf["node"].to_numpy(np.int64)
    has, parent = _numbers(pdf["parent"])
    low, weight = _numbers(pdf["low"])[1], pdf["weight"].to_numpy(np.int64)
    up, off, way, ringed, least = forest(node, parent, weight, low, has)
    return pd.DataFrame(
        {
            "node": node,
            "set_root": node[up],
            "offset": off,
            "low": np.minimum(node, way),
            "ext": _nullable(parent[up], has[up] & ~ringed),
            "ext_weight": weight[up],
            "ext_low": low[up],
            "ring": _nullable(least, ringed),
        }
    )


def _in_blocks(links: DataFrame, parts: int, block_rows: int, work, schema: str) -> DataFrame:
    """work on each block of the links, which are range-partitioned by node into so many tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _blocks(batches, block_rows):
            out = work(pdf)
            if isinstance(out, pd.DataFrame):
                yield out
            else:
                yield from out

    spread = links.repartitionByRange(parts, "node") if parts > 1 else links.repartition(1)
    return spread.sortWithinPartitions("node").mapInPandas(run, schema)


def _parts(links: DataFrame, rows: int, block_rows: int) -> int:
    """As many tasks as the session has, where there are rows for them; more where a task would hold more than four blocks."""
    return max(min(tasks(links.sparkSession), -(-rows // min(TASK_ROWS, block_rows))), -(-rows // (4 * block_rows)), 1)


def _doubled(links: DataFrame, rows: int) -> DataFrame:
    """Resolve links (node, parent, weight, low, into) by pointer doubling; rounds stop once no chain moves or all that do must be in rings."""
    state = links.select("node", "parent", "weight", F.coalesce("low", "node").alias("low"))
    k = 0
    while True:
        b = state.select(F.col("node").alias("_n"), F.col("parent").alias("_p"), F.col("weight").alias("_w"), F.col("low").alias("_l"))
        on = F.col("_p").isNotNull()
        state = materialize(
            lookup_join(state, b, "parent", "_n", rows).select(
                "node",
                F.when(on, F.col("_p")).otherwise(F.col("parent")).alias("parent"),
                (F.coalesce("weight", F.lit(0)) + F.when(on, F.col("_w")).otherwise(0)).alias("weight"),
                F.when(on, F.least("low", "_l")).otherwise(F.col("low")).alias("low"),
                on.alias("open"),
            ),
            "double",
        )
        k += 1
        if state.where("open").isEmpty():
            return state.select("node", F.coalesce("parent", "node").alias("root"), F.when(F.col("parent").isNotNull(), F.col("weight")).otherwise(0).alias("depth"), F.lit(None).cast("bigint").alias("ring"))
        if 2**k > rows:
            break
    # what still moves after more steps than there are nodes is on a ring or runs into one, and stands on it now
    b = state.where("open").select(F.col("node").alias("_n"), F.col("low").alias("_l"))
    ring = F.when(F.col("open"), F.col("_l"))
    return lookup_join(state, b, "parent", "_n", rows).select(
        "node", F.coalesce(ring, "parent", "node").alias("root"), F.when(F.col("open"), -1).when(F.col("parent").isNotNull(), F.col("weight")).otherwise(0).alias("depth"), ring.alias("ring")
    )


def _resolve(links: DataFrame, rows: int, block_rows: int, parts: int | None = None) -> DataFrame:
    """Links (node, parent, weight, low), one row a node, to (node, root, depth, ring)."""
    if rows == 0:
        return links.sparkSession.createDataFrame([], _RESOLVED)
    parts = parts or _parts(links, rows, block_rows)
    linked = _in_blocks(links, parts, block_rows, _link, _LINKED)
    own = F.when(F.col("ring").isNotNull(), -1).otherwise(F.col("offset"))
    if parts == 1 and rows <= block_rows:  # there is no other block: a parent outside is no node
        return linked.select("node", F.coalesce("ring", "set_root").alias("root"), own.alias("depth"), "ring")
    linked = materialize(linked, "forest")
    roots = linked.where(F.col("ext").isNotNull() & (F.col("node") == F.col("set_root"))).select("node", "ext", "ext_weight", "ext_low")
    there = linked.select(F.col("node").alias("_n"), "set_root", "offset", "low", F.col("ring").alias("into"))
    # the set that holds each outside parent; a parent that is no node, or that ends in a ring of its block, ends the chain
    cross = lookup_join(roots, there, "ext", "_n", rows)
    free = F.col("into").isNull()
    cross = materialize(cross.select("node", F.when(free, F.col("set_root")).alias("parent"), (F.coalesce("offset", F.lit(0)) + F.col("ext_weight")).alias("weight"), F.least("low", "ext_low").alias("low"), "into"), "cross")
    whole = materialize(_closed(cross), "sets")
    n = whole.count()
    if n > rows // 2 and n > block_rows:
        up = _doubled(whole, n)
    else:
        up = _resolve(whole.select("node", "parent", "weight", "low"), n, block_rows, -(-n // block_rows))
    ends = cross.where("into is not null").select(F.col("node").alias("_e"), "into")
    up = lookup_join(materialize(up, "upper"), ends, "root", "_e", n)
    ring = F.coalesce(F.col("ring"), F.col("into"))
    up = up.select(F.col("node").alias("_u"), F.coalesce(ring, F.col("root")).alias("_root"), F.when(ring.isNotNull(), -1).otherwise(F.col("depth")).alias("_depth"), ring.alias("_ring"))
    # a set lies in one block, so no key here has more than block_rows rows
    out = linked.join(up, linked["set_root"] == up["_u"], "left")
    ring = F.coalesce("ring", "_ring")
    return out.select("node", F.coalesce("ring", "_root", "set_root").alias("root"), F.when(ring.isNotNull(), -1).otherwise(F.col("offset") + F.coalesce("_depth", F.lit(0))).alias("depth"), ring.alias("ring"))


def _closed(cross: DataFrame) -> DataFrame:
    """Also the sets that are only ever reached, as nodes without a parent, so that every chain ends in a node."""
    heads = cross.select(F.col("parent").alias("node")).where("node is not null").distinct().join(cross.select("node"), "node", "left_anti")
    none = F.lit(None).cast("bigint")
    return cross.unionByName(heads.select("node", none.alias("parent"), F.lit(0).cast("bigint").alias("weight"), none.alias("low"), none.alias("into")))


def _links(df: DataFrame, node: str, parent: str) -> DataFrame:
    one = df.select(F.col(node).cast("bigint").alias("node"), F.col(parent).cast("bigint").alias("parent")).where("node is not null").groupBy("node").agg(F.max("parent").alias("parent"))
    return one.select("node", "parent", F.lit(1).cast("bigint").alias("weight"), F.col("parent").alias("low"))


def hierarchy(df: DataFrame, node: str, parent: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, root, depth, ring) of every node. On a ring, or on a chain that runs into one, depth is -1 and root and ring are its smallest id."""
    links = materialize(_links(df, node, parent), "links")
    return _resolve(links, links.count(), block_rows)


_CHAIN = "node bigint, set_root bigint, ext bigint, chain array<bigint>"


def _chains(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Each node's way down from its set's root, by walking the block's parent index; at most CHAIN_ENTRIES of them, or one node's, at once."""
    node = pdf["node"].to_numpy(np.int64)
    has, parent = _numbers(pdf["parent"])
    up, off, _, ringed, _ = forest(node, parent, np.ones(len(node), np.int64), parent, has)
    at = np.minimum(np.searchsorted(node, parent), len(node) - 1)
    inside = has & (node[at] == parent)
    left = np.flatnonzero(~ringed)
    total = np.cumsum(off[left] + 1)
    a = 0
    while a < len(left):
        z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CHAIN_ENTRIES, "right")))
        part, a = left[a:z], z
        ends = np.cumsum(off[part] + 1)
        flat = np.empty(int(ends[-1]), np.int64)
        x, k, live = part.copy(), ends - 1, np.ones(len(part), bool)
        while live.any():  # one step up for all nodes of the part at once
            flat[k[live]] = node[x[live]]
            live &= inside[x]
            x = np.where(live, at[x], x)
            k = k - 1
        yield pd.DataFrame({"node": node[part], "set_root": node[up[part]], "ext": _nullable(parent[up[part]], has[up[part]]), "chain": np.split(flat, ends[:-1])})


def _paths_over(left: DataFrame, key: str, right: DataFrame, right_key: str, how: str) -> DataFrame:
    """left joined to the right rows whose key its own names; a key that most of left names is cut into shards, as paths may be long."""
    name = "_key"
    left, right = left.withColumnRenamed(key, name), right.withColumnRenamed(right_key, name)
    return fragment_join(left, right, plan_shards(key_loads(left, [name]), [name]), how).withColumnRenamed(name, key)


def paths(df: DataFrame, node: str, parent: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, path) for every node of a tree: the ids from its root down to itself. Nodes on or above rings have none.

    A path is as long as its node is deep; that is the size of the result. Chains inside a block come from its parent
    index; what stands above a set's root is put together by doubling: after r rounds a prefix spans 2^r sets.
    """
    links = materialize(_links(df, node, parent), "links")
    rows = links.count()
    resolved = materialize(_resolve(links, rows, block_rows), "resolved")
    tree = links.join(resolved.where("ring is null").select("node"), "node")
    parts = _parts(links, rows, block_rows)
    chains = materialize(_in_blocks(tree, parts, block_rows, _chains, _CHAIN), "chains")
    if parts == 1 and rows <= block_rows:
        return chains.select("node", F.col("chain").alias("path"))
    r = chains.where(F.col("ext").isNotNull() & (F.col("node") == F.col("set_root"))).select(F.col("node").alias("r"), "ext")
    c = chains.select(F.col("node").alias("_n"), F.col("set_root").alias("nxt"), F.col("chain").alias("seg"))
    above = materialize(_paths_over(r, "ext", c, "_n", "inner").select("r", "nxt", "seg"), "above")
    while True:
        b = above.select(F.col("r").alias("_r"), F.col("nxt").alias("_nxt"), F.col("seg").alias("_seg"))
        j = _paths_over(above, "nxt", b, "_r", "left")
        more = F.col("_seg").isNotNull()
        above = materialize(j.select("r", F.col("_nxt").alias("nxt"), F.when(more, F.concat("_seg", "seg")).otherwise(F.col("seg")).alias("seg")), "above")
        if above.where("nxt is not null").isEmpty():
            break
    out = chains.join(above, chains["set_root"] == above["r"], "left")
    return out.select("node", F.when(F.col("seg").isNotNull(), F.concat("seg", "chain")).otherwise(F.col("chain")).alias("path"))


def descendants(paths_: DataFrame) -> DataFrame:
    """(ancestor, node, distance): every node below every node, from the table of paths."""
    p = paths_.select("node", F.posexplode("path").alias("pos", "ancestor"), F.size("path").alias("n"))
    return p.where("ancestor <> node").select("ancestor", "node", (F.col("n") - 1 - F.col("pos")).cast("bigint").alias("distance"))


def all_descendants(df: DataFrame, node: str, parent: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(ancestor, node, distance): every node below every node, rings included.

    The links of ring members are cut, which makes each the root of what hangs below it. A ring's members are above one
    another and above all that hangs below any of them, once each, by the shortest way; a node isn't its own descendant.
    """
    links = materialize(_links(df, node, parent), "links")
    ringed = _resolve(links, links.count(), block_rows).where("ring is not null").select("node", "ring")
    ringed = materialize(links.join(ringed, "node").select("node", "parent", "ring"), "ringed")
    n = ringed.count()
    place = _ring_places(ringed, n)
    cut = links.join(place.select("node", F.lit(True).alias("on")), "node", "left").select("node", F.when(F.col("on").isNull(), F.col("parent")).alias("parent"))
    tree = materialize(paths(cut, "node", "parent", block_rows), "paths")
    below = descendants(tree)
    # a member and what hangs below it, against the other members: up the ring from the member is that many steps more
    hung = tree.select("node", F.col("path")[0].alias("top"), (F.size("path") - 1).cast("bigint").alias("depth"))
    own = place.select(F.col("node").alias("_top"), "ring", F.col("steps").alias("from_steps"), "size")
    other = place.select(F.col("node").alias("ancestor"), F.col("ring").alias("_ring"), F.col("steps").alias("to_steps"))
    hung = materialize(hung, "hung")
    hung = lookup_join(hung, own, "top", "_top", hung.count()).where("ring is not null")
    over = hung.join(other, (hung["ring"] == other["_ring"]) & (hung["top"] != other["ancestor"]))
    up = F.pmod(F.col("from_steps") - F.col("to_steps"), F.col("size"))
    return below.unionByName(over.select("ancestor", "node", (F.col("depth") + up).cast("bigint").alias("distance")))


def _ring_places(ringed: DataFrame, n: int) -> DataFrame:
    """(node, ring, steps, size) of the nodes on rings: steps up to the ring's smallest id, and the ring's size.

    ringed: (node, parent, ring) of all nodes on rings or below them, n in number. By pointer doubling: with the links of
    the smallest ids cut, every node's chain ends in its ring's smallest id; a node is on the ring if the chain of that
    id's parent passes it.
    """
    start = F.col("node") == F.col("ring")
    state = ringed.select("node", "ring", F.when(~start, F.col("parent")).alias("parent"), F.when(start, 0).otherwise(1).cast("bigint").alias("steps"))
    # on: the last members of the rings, and what is met from them, twice as far each round
    on = materialize(ringed.where(start).select(F.col("parent").alias("node")).distinct(), "ring")
    for _ in range(n.bit_length() + 1):
        b = state.select(F.col("node").alias("_n"), F.col("parent").alias("_p"), F.col("steps").alias("_s"))
        met = on.join(state, "node").where("parent is not null").select(F.col("parent").alias("node"))
        on = materialize(on.unionByName(met).distinct(), "ring")
        j = state.join(b, state["parent"] == b["_n"], "left")
        state = materialize(j.select("node", "ring", F.col("_p").alias("parent"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps")), "ring-steps")
        if state.where("parent is not null").isEmpty():
            break
    place = state.join(on, "node").select("node", "ring", "steps")
    size = place.groupBy("ring").agg(F.count(F.lit(1)).alias("size"))
    return materialize(place.join(size, "ring").select("node", "ring", "steps", "size"), "places")
