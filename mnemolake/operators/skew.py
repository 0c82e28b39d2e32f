"""Per-key results when a few keys hold most of the rows.

Fragment and replicate by estimated load. The load of every key is counted with a partial aggregation, so a hot key
costs one row a task. Keys above a share of a task's fair load are *large*: each is cut into shards in proportion to
its load. Shards and buckets of small keys are bin-packed, largest first, onto tasks. Rows of a large key are dealt
over the tasks of its shards, and the matching side of a join is copied to those tasks only.

What reaches the driver is bounded by the number of tasks, never by the number of keys: a key is large only from
`1 / (split * tasks)` of all rows on, so there are at most `split * tasks` of them, and the small keys are seen as
`buckets * tasks` hash buckets.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.session import materialize, tasks

_TASK = "_task"
#: Slices in which a key is counted before its rows are dealt to shards.
SLICES = 64


@dataclass(frozen=True)
class ShardPlan:
    """Where rows go: the task of each shard of each large key, in which a task may hold several, and the task of each bucket of small keys."""

    keys: tuple[str, ...]
    n_tasks: int
    n_buckets: int
    total: int
    large: tuple[tuple[tuple, int, tuple[int, ...]], ...]
    bucket_task: tuple[int, ...]

    def loads(self) -> list[float]:
        """Rows that the large keys bring to each task."""
        out = [0.0] * self.n_tasks
        for _, load, where in self.large:
            for t in where:
                out[t] += load / len(where)
        return out


def key_loads(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each key, null keys as keys of their own: (*keys, load). Combined before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("load"))


def _bucket(keys: tuple[str, ...], n: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(n)).cast("int")


def plan_shards(loads: DataFrame, keys: list[str], n_tasks: int | None = None, split: int = 4, buckets: int = 8) -> ShardPlan:
    """Bin-pack keys to tasks by load.

    Ties in load go to the smaller key and the smaller task number; an empty table gives a plan without large keys.
    """
    spark = loads.sparkSession
    n_tasks = n_tasks or tasks(spark)
    n_buckets = buckets * n_tasks
    ks = tuple(keys)
    total = loads.agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0]
    piece = max(1, -(-total // (split * n_tasks)))
    # one pass over the loads: a row a large key, at most split * n_tasks, and a row a bucket of small keys, at most n_buckets
    is_large = F.col("load") >= piece
    bucket, own = F.when(~is_large, _bucket(ks, n_buckets)).alias("_bucket"), F.when(is_large, F.struct(*ks)).alias("_own")
    rows = loads.groupBy(bucket, own).agg(F.sum("load").alias("load")).collect() if total else []
    small = [r for r in rows if r["_bucket"] is not None]
    large = sorted(((tuple(r["_own"]), r["load"]) for r in rows if r["_bucket"] is None), key=lambda x: (-x[1], tuple((v is None, str(v)) for v in x[0])))
    assert len(large) <= split * n_tasks

    items: list[tuple[float, int, int]] = []  # (load, large key or -1, bucket)
    for i, (_, load) in enumerate(large):
        n = min(n_tasks, -(-load // piece))
        items += [(load / n, i, -1)] * n
    items += [(r["load"], -1, r["_bucket"]) for r in small]
    items.sort(key=lambda x: (-x[0], x[1], x[2]))
    heap = [(0.0, t) for t in range(n_tasks)]
    shards: dict[int, list[int]] = {i: [] for i in range(len(large))}
    where = [b % n_tasks for b in range(n_buckets)]
    for load, i, b in items:
        least, t = heapq.heappop(heap)
        heapq.heappush(heap, (least + load, t))
        if i >= 0:
            shards[i].append(t)
        else:
            where[b] = t
    return ShardPlan(ks, n_tasks, n_buckets, total, tuple((k, load, tuple(sorted(shards[i]))) for i, (k, load) in enumerate(large)), tuple(where))


def _large_frame(plan: ShardPlan, df: DataFrame) -> DataFrame:
    """The plan's large keys as a table of at most split * n_tasks rows: its size is bounded, so it is broadcast."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in plan.keys) + ", _where array<int>"
    return df.sparkSession.createDataFrame([(*k, list(where)) for k, _, where in plan.large], schema)


def _with_where(df: DataFrame, plan: ShardPlan) -> DataFrame:
    if not plan.large:
        return df.withColumn("_where", F.lit(None).cast("array<int>"))
    large = _large_frame(plan, df)
    for k in plan.keys:
        large = large.withColumnRenamed(k, f"_k_{k}")
    on = F.lit(True)
    for k in plan.keys:
        on = on & df[k].eqNullSafe(large[f"_k_{k}"])
    return df.join(F.broadcast(large), on, "left").drop(*[f"_k_{k}" for k in plan.keys])


def fragment(df: DataFrame, plan: ShardPlan) -> DataFrame:
    """Add _task: a large key's rows are dealt in turn over the tasks of its shards; a small key's go to its bucket's."""
    spread = F.element_at("_where", (F.pmod(F.monotonically_increasing_id(), F.size("_where")) + 1).cast("int"))
    small = F.element_at(F.lit(list(plan.bucket_task)), _bucket(plan.keys, plan.n_buckets) + 1)
    return _with_where(df, plan).withColumn(_TASK, F.when(F.col("_where").isNotNull(), spread).otherwise(small).cast("int")).drop("_where")


def replicate(df: DataFrame, plan: ShardPlan) -> DataFrame:
    """Add _task: one copy of a row for each task that holds a shard of its key, one for small keys."""
    small = F.array(F.element_at(F.lit(list(plan.bucket_task)), _bucket(plan.keys, plan.n_buckets) + 1).cast("int"))
    return _with_where(df, plan).withColumn(_TASK, F.explode(F.array_distinct(F.coalesce("_where", small)))).drop("_where")


def sharded_aggregate(df: DataFrame, plan: ShardPlan, partial: dict[str, Column], merge: dict[str, Column]) -> DataFrame:
    """Decomposable aggregates a key: partial ones by (key, shard), combined in each task before they move, then merged by key.

    Null keys form a group. Nothing is dropped; the merge sees one row a shard.
    """
    by_shard = fragment(df, plan).groupBy(*plan.keys, _TASK).agg(*[c.alias(n) for n, c in partial.items()])
    return by_shard.groupBy(*plan.keys).agg(*[c.alias(n) for n, c in merge.items()])


def fragment_join(df: DataFrame, match: DataFrame, plan: ShardPlan, how: str = "inner") -> DataFrame:
    """Join the large df with match on the plan's keys; each task holds an even share of df.

    df's rows move once, to the task the plan gives them, and match is copied only to the tasks of its key's shards.
    how: inner or left; null keys match each other. Columns of match that df also has are taken from df.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins keep one copy of a row")
    left = fragment(df, plan).repartitionById(plan.n_tasks, _TASK)
    right = replicate(match.select(*plan.keys, *[c for c in match.columns if c not in df.columns]), plan)
    right = right.select(F.col(_TASK).alias("_t"), *[F.col(k).alias(f"_m_{k}") for k in plan.keys], *[c for c in right.columns if c not in (*plan.keys, _TASK)])
    right = right.repartitionById(plan.n_tasks, "_t")
    on = left[_TASK] == right["_t"]
    for k in plan.keys:
        on = on & left[k].eqNullSafe(right[f"_m_{k}"])
    return left.join(right, on, how).drop(_TASK, "_t", *[f"_m_{k}" for k in plan.keys])


def lookup_join(left: DataFrame, right: DataFrame, key: str, right_key: str, total: int, split: int = 4) -> DataFrame:
    """left with the right row whose key its own names, or nulls; right is unique in its key and narrow, left has about `total` rows.

    Keys that more than 1 / (split * tasks) of left name are looked up apart: there are at most split * tasks of them, so their
    right rows are broadcast; all others meet by a shuffle. A null key names nothing.
    """
    most = split * tasks(left.sparkSession)
    least = max(2, -(-total // most))
    hot = [r[0] for r in left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).orderBy(F.desc("_n")).select(key).limit(most).collect()]
    plain = left.join(right, left[key] == right[right_key], "left")
    if not hot:
        return plain
    few, many = right.where(F.col(right_key).isin(hot)), F.coalesce(F.col(key).isin(hot), F.lit(False))
    rest, top = left.where(~many), left.where(many)
    return rest.join(right, rest[key] == right[right_key], "left").unionByName(top.join(F.broadcast(few), top[key] == few[right_key], "left"))


def heavy_keys(df: DataFrame, fields: list[str], share: float, n_tasks: int | None = None) -> DataFrame:
    """Keys that hold at least `share` of all rows of df, for each field: (field_name, key_text, rows, total).

    Null keys are no keys. df is read once: each field and key is counted in SLICES slices, combined in each task before the
    shuffle. These counts give the loads, and they are what the plan deals to the shards of the large keys; the field's total
    is copied to those shards only, and every key that could hold the share is a large one.
    """
    spark = df.sparkSession
    keys = ["field_name", "key_text"]
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("key_text")) for f in fields])).alias("p"), F.monotonically_increasing_id().alias("_id")).select("p.*", "_id")
    counts = materialize(pairs.groupBy(*keys, F.pmod("_id", F.lit(SLICES)).alias("_slice")).agg(F.count(F.lit(1)).alias("n")), "counts").drop("_slice")
    n_tasks = n_tasks or tasks(spark)
    plan = plan_shards(counts.groupBy(*keys).agg(F.sum("n").alias("load")), keys, n_tasks, split=max(4, -(-int(2 * len(fields) / share) // n_tasks)))
    total = plan.total // len(fields)
    found = [(*k, total) for k, _, _ in plan.large if k[1] is not None]
    match = spark.createDataFrame(found, "field_name string, key_text string, total bigint")
    shards = fragment_join(counts, match, plan).groupBy(*keys, "total").agg(F.sum("n").alias("rows"))
    return shards.where(F.col("rows") >= F.lit(share) * F.col("total")).select(*keys, "rows", "total")


def key_profile(events: DataFrame, field: str, n_tasks: int | None = None) -> DataFrame:
    """Complete per-key results over current records: counts, latest state and tool statistics.

    (key_text, events, last_seq, latest_state, tool_calls, tool_errors, latency_ms, slow_calls). latest_state is the
    payload of the StateTransition with the greatest seq, null if there is none. latency_ms sums the calls whose latency
    is a non-negative integer; slow_calls counts those above twice the key's mean, which needs the key's mean beside
    each of its rows: that join is the fragment-replicate one. A null key is a group of its own.
    """
    from mnemolake.functions.jsonx import outcome_is_error, strict_uint

    call = F.col("kind_tag") == "ToolCall"
    rows = events.select(
        F.col(field).alias("key_text"),
        "seq",
        call.alias("is_call"),
        F.when(F.col("kind_tag") == "StateTransition", F.col("seq")).alias("state_seq"),
        F.when(F.col("kind_tag") == "StateTransition", F.col("payload")).alias("state"),
        F.when(call, outcome_is_error("payload")).otherwise(False).alias("is_error"),
        F.when(call, strict_uint("payload", "latency_ms")).alias("latency"),
    )
    rows = materialize(rows, "key-profile")  # read by three branches: payloads are parsed once
    plan = plan_shards(key_loads(rows, ["key_text"]), ["key_text"], n_tasks)
    base = sharded_aggregate(
        rows,
        plan,
        {
            "n": F.count(F.lit(1)),
            "s": F.max("seq"),
            "st": F.max_by(F.struct("state_seq", "state"), "state_seq"),
            "c": F.count_if("is_call"),
            "e": F.count_if("is_error"),
            "l": F.sum("latency"),
            "k": F.count("latency"),
        },
        {
            "events": F.sum("n"),
            "last_seq": F.max("s"),
            "latest": F.max_by("st", "st.state_seq"),
            "tool_calls": F.sum("c"),
            "tool_errors": F.sum("e"),
            "latency_ms": F.coalesce(F.sum("l"), F.lit(0)),
            "timed": F.sum("k"),
        },
    )
    timed = rows.where(F.col("latency").isNotNull()).select("key_text", "latency")
    slow = fragment_join(timed, base.select("key_text", "latency_ms", "timed"), plan)
    slow = sharded_aggregate(slow, plan, {"n": F.count_if(F.col("latency") * F.col("timed") > 2 * F.col("latency_ms"))}, {"slow_calls": F.sum("n")})
    slow = slow.withColumnRenamed("key_text", "_key")
    out = base.join(slow, base["key_text"].eqNullSafe(slow["_key"]), "left")
    return out.select("key_text", "events", "last_seq", F.col("latest.state").alias("latest_state"), "tool_calls", "tool_errors", "latency_ms", F.coalesce("slow_calls", F.lit(0)).alias("slow_calls"))
