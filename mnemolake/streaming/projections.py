"""The log as a stream: subscriptions, projections kept up to date, windows and state with a time limit."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemolake.operators.predicates import EventPattern
from mnemolake.operators.projections import Projection
from mnemolake.sources.log import SCHEMA
from mnemolake.sources.versioned import VersionedTable


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Records of a log folder as they come; agents are read from the folders' names."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).option("basePath", path).parquet(path)


def subscribe(events: DataFrame, pattern: EventPattern, after_seq: int, deliver: Callable[[list[dict]], None], checkpoint: str, batch_rows: int = 10_000, once: bool = False) -> StreamingQuery:
    """Deliver matching records after a seq, in order of seq within a trigger, at least once.

    Rows come to the driver through an iterator, batch_rows at a time, never as a whole.
    """

    def each(batch: DataFrame, _: int) -> None:
        held: list[dict] = []
        for r in batch.orderBy("seq").toLocalIterator(prefetchPartitions=False):
            held.append(r.asDict() | {"payload": json.loads(r["payload"]) if r["payload"] is not None else None})
            if len(held) >= batch_rows:
                deliver(held)
                held = []
        if held:
            deliver(held)

    w = events.where((F.col("seq") > after_seq) & pattern.column()).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def maintain(events: DataFrame, ledger: VersionedTable, checkpoint: str, name: str = "tool_counts", once: bool = True) -> StreamingQuery:
    """Keep partial tool statistics of each batch in a table; their sums are the projection.

    A batch's rows and its number enter the table in one manifest, so a batch that is run again after a failure adds nothing.
    """
    from mnemolake.operators.projections import tool_ledger

    def each(batch: DataFrame, number: int) -> None:
        if ledger.manifest()["processed"].get(name, -1) >= number:
            return
        part = tool_ledger(batch).withColumn("batch", F.lit(number).cast("bigint"))
        ledger.commit(part, processed={name: number})

    w = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def keep(events: DataFrame, projection: Projection, target: VersionedTable, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the partial state of each batch of any projection; projection.merge(target.read()) is its state table.

    A batch's rows and its number enter the table in one manifest, so a batch that is run again after a failure adds nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        if target.manifest()["processed"].get(projection.name, -1) < number:
            target.commit(projection.partial(batch), processed={projection.name: number})

    w = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


LEDGER_SCHEMA = "tool string, invocations bigint, errors bigint, total_latency_ms bigint, total_cost double, last_outcome string, last_seq bigint, batch bigint"


def ledger_total(ledger: VersionedTable) -> DataFrame:
    """The tool statistics that the kept batches add up to."""
    return (
        ledger.read()
        .groupBy("tool")
        .agg(
            F.sum("invocations").alias("invocations"),
            F.sum("errors").alias("errors"),
            F.sum("total_latency_ms").alias("total_latency_ms"),
            F.round(F.sum("total_cost"), 6).alias("total_cost"),
            F.max_by("last_outcome", F.when(F.col("last_outcome").isNotNull(), F.col("last_seq"))).alias("last_outcome"),
            F.max("last_seq").alias("last_seq"),
        )
    )


def rebuild(events: DataFrame, projection: Projection, target: VersionedTable) -> int:
    """Drop what a projection's table holds and fill it from the whole log, as one version."""
    m = target.manifest()
    return target.commit(projection.frame(events), drop=m["data"], base=m["version"])


def rate_windows(events: DataFrame, size: str = "1 minute", slide: str = "10 seconds", late: str = "5 minutes") -> DataFrame:
    """Records of each agent in sliding windows of their clock; windows close once the clock is `late` past them."""
    e = events.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    return e.groupBy("agent_id", F.window("ts", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("events")).select("agent_id", F.unix_millis("w.start").alias("start_ms"), "events")


def idle_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "5 minutes") -> DataFrame:
    """Sessions of each stream: records less than a gap apart."""
    e = events.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    return e.groupBy("stream_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select("stream_id", F.unix_millis("w.start").alias("start_ms"), "events")


def working_state(updates: DataFrame, late: str = "1 minute") -> DataFrame:
    """Working memory as a stream: (agent_id, key, value, ttl_ms, ts) to the value after each update and null once it expires.

    The state of a key is one value; it ends when the watermark passes its expiry.
    """

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"agent_id": [key[0]], "key": [key[1]], "value": pd.Series([None], dtype="object")})
            return
        last, at = (state.get if state.exists else (None, -1)), -1
        value, at = last if last is not None else (None, -1)
        expires = None
        for pdf in frames:
            for r in pdf.sort_values("ts").itertuples():
                ms = int(r.ts.timestamp() * 1000)
                if ms >= at:
                    value, at = r.value, ms
                    expires = None if pd.isna(r.ttl_ms) else ms + max(0, int(r.ttl_ms))
        state.update((value, at))
        if expires is not None:
            state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"agent_id": [key[0]], "key": [key[1]], "value": pd.Series([value], dtype="object")})

    u = updates.withWatermark("ts", late)
    return u.groupBy("agent_id", "key").applyInPandasWithState(step, "agent_id string, key string, value string", "value string, at bigint", "append", GroupStateTimeout.EventTimeTimeout)
