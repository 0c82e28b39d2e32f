"""The event log: an append-only table of immutable files, partitioned by agent, with seq and time assigned by the engine."""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.sources.tables import EVENT_KINDS

_LONG, _TEXT = T.LongType(), T.StringType()
SCHEMA = T.StructType([T.StructField(n, k) for n, k in (("seq", _LONG), ("agent_id", _TEXT), ("stream_id", _TEXT), ("kind_tag", _TEXT), ("ts_ms", _LONG), ("causation", _LONG), ("correlation", _TEXT), ("payload", _TEXT))])

#: Payload fields that a kind needs, and their types.
NEEDS = {
    "MemoryInvalidate": {"target_seq": int},
    "ToolCall": {"tool": str},
    "ConsentGranted": {"from": str, "to": str, "action": str, "resource": str},
    "ConsentRevoked": {"grant_seq": int},
    "IntentLogged": {"actor": str, "intent": str},
}


def check_event(kind: str, payload: object, correlation: str | None) -> str | None:
    """Raise ValueError unless the event is well formed; gives the correlation in its canonical form."""
    if kind not in EVENT_KINDS:
        raise ValueError(f"unknown event kind: {kind}")
    for name, type_ in NEEDS.get(kind, {}).items():
        value = payload.get(name) if isinstance(payload, dict) else None
        if not isinstance(value, type_) or isinstance(value, bool):
            raise ValueError(f"{kind} requires payload.{name}")
    if correlation is None:
        return None
    try:
        return str(uuid.UUID(correlation))
    except ValueError:
        raise ValueError("invalid correlation UUID") from None


class EventLog:
    """Appends enter a journal before they return, are written in files of many records, and are seen by every read at once.

    The journal is a file of lines beside the records, forced to disk at each append; what it holds and the records don't is
    taken up when the log is opened again, so a lost driver loses nothing that was acknowledged.
    """

    def __init__(self, spark: SparkSession, path: str, now_ms: Callable[[], int], buffer_rows: int = 5_000):
        self.spark, self.path, self.now_ms, self.buffer_rows = spark, path.rstrip("/"), now_ms, buffer_rows
        self._lock = threading.RLock()
        self._buffer: list[tuple] = []
        self._listeners: list[tuple[Callable[[dict], bool], Callable[[dict], None]]] = []
        self._journal = None
        last = self._stored().agg(F.max("seq")).first()[0] or 0
        kept = self._journals()
        self._buffer = sorted({row[0]: row for _, rows in kept for row in rows if row[0] > last}.values())
        self._next = max([last, *(row[0] for row in self._buffer)]) + 1
        if kept:
            self.flush()
            for path, _ in kept:
                self._fs(path)[0].delete(self._fs(path)[1], False)

    def _fs(self, path: str) -> tuple:
        h = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return h.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), h

    def _exists(self) -> bool:
        fs, h = self._fs(f"{self.path}/events")
        return fs.exists(h)

    def _journals(self) -> list[tuple[str, list[tuple]]]:
        """Journals left by stores that weren't closed, with their events; a last line that was cut short was never acknowledged."""
        fs, h = self._fs(f"{self.path}/journal")
        out = []
        for s in fs.listStatus(h) if fs.exists(h) else []:
            stream = fs.open(s.getPath())
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            out.append((s.getPath().toString(), [tuple(json.loads(line)) for line in text.split("\n")[:-1]]))
        return out

    def _note(self, row: tuple) -> None:
        """Force an event to the journal."""
        line = (json.dumps(row, ensure_ascii=False) + "\n").encode()
        local = self.path.startswith("file://")
        if self._journal is None:
            name = f"{self.path}/journal/{uuid.uuid4().hex}"
            if local:
                os.makedirs(os.path.dirname(name[7:]), exist_ok=True)
            self._journal = name, open(name[7:], "ab") if local else self._fs(name)[0].create(self._fs(name)[1], False)
        out = self._journal[1]
        out.write(line if local else bytearray(line))
        if local:
            out.flush()
            os.fsync(out.fileno())
        else:
            out.hsync()

    def _stored(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/events").select(*SCHEMA.fieldNames())

    def append(self, agent_id: str, stream_id: str, kind: str, payload: object = None, causation: int | None = None, correlation: str | None = None) -> int:
        """Check, number and keep one event; listeners whose pattern fits hear of it before this returns."""
        correlation = check_event(kind, payload, correlation)
        with self._lock:
            seq = self._next
            self._next += 1
            row = (seq, agent_id, stream_id, kind, self.now_ms(), causation, correlation, json.dumps(payload, separators=(",", ":"), ensure_ascii=False))
            self._note(row)
            self._buffer.append(row)
            if len(self._buffer) >= self.buffer_rows:
                self.flush()
        event = dict(zip(SCHEMA.fieldNames(), row)) | {"payload": payload}
        for fits, tell in list(self._listeners):
            if fits(event):
                tell(event)
        return seq

    def append_bulk(self, rows: DataFrame, order: list[str]) -> tuple[int, int]:
        """Number many events (agent_id, stream_id, kind_tag, payload, causation?, correlation?) in an order, in parallel; (first, last) seq.

        Range-partitioned by the order; each task numbers its own rows from an offset, the sum of the counts before it, so
        that no task sees them all. One count a task reaches the driver. Unknown kinds fail the job.
        """
        from mnemolake.session import materialize

        have = set(rows.columns)
        kind = F.when(F.col("kind_tag").isin(*EVENT_KINDS), F.col("kind_tag")).otherwise(F.raise_error(F.concat(F.lit("unknown event kind: "), F.coalesce("kind_tag", F.lit("null")))))
        cols = [F.col("agent_id"), F.col("stream_id"), kind.alias("kind_tag")] + [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in (("causation", "bigint"), ("correlation", "string"), ("payload", "string"))]
        keyed = rows.select(*cols, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
        by = [f"_o{i}" for i in range(len(order))]
        parts = keyed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
        parts = materialize(parts, "bulk")
        part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
        counts = sorted((r["p"], r["n"]) for r in parts.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
        with self._lock:
            self.flush()
            first = self._next
            offsets, total = {}, first
            for p, n in counts:
                offsets[p] = total
                total += n
            if not counts:
                return first, first - 1
            table = self.spark.createDataFrame(list(offsets.items()), "p bigint, base bigint")
            out = parts.withColumn("p", part).join(F.broadcast(table), "p").withColumn("seq", F.col("base") + at).withColumn("ts_ms", F.lit(self.now_ms()))
            out.select(*SCHEMA.fieldNames()).write.mode("append").partitionBy("agent_id").parquet(f"{self.path}/events")
            self._next = total
        return first, total - 1

    def flush(self) -> None:
        with self._lock:
            if self._buffer:
                df = self.spark.createDataFrame(self._buffer, SCHEMA)
                df.repartition("agent_id").sortWithinPartitions("seq").write.mode("append").partitionBy("agent_id").parquet(f"{self.path}/events")
                self._buffer = []
            if self._journal is not None:
                name, out = self._journal
                out.close()
                self._fs(name)[0].delete(self._fs(name)[1], False)
                self._journal = None

    def frame(self) -> DataFrame:
        """All records; the buffer's are unioned in, so what was appended is read."""
        with self._lock:
            stored = self._stored()
            return stored.unionByName(self.spark.createDataFrame(self._buffer, SCHEMA)) if self._buffer else stored

    def read(self, seq: int) -> dict:
        r = self.frame().where(F.col("seq") == seq).first() if 0 < seq < self._next else None
        if r is None:
            raise KeyError(f"no event {seq}")
        return r.asDict() | {"payload": json.loads(r["payload"])}

    def last_seq(self) -> int:
        return self._next - 1

    def __len__(self) -> int:
        """The last seq, not a count."""
        return self._next - 1

    def read_stream(self, stream_id: str, agents: Iterable[str] | None = None) -> DataFrame:
        """A stream's records in order of seq; agents prune the partitions that are read."""
        df = self.frame().where(F.col("stream_id") == stream_id)
        return (df if agents is None else df.where(F.col("agent_id").isin(sorted(set(agents))))).orderBy("seq")

    def listen(self, fits: Callable[[dict], bool], tell: Callable[[dict], None]) -> Callable[[], None]:
        """Hear of events appended from now on; call the result to stop."""
        entry = (fits, tell)
        self._listeners.append(entry)
        return lambda: self._listeners.remove(entry) if entry in self._listeners else None
