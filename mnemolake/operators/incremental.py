"""What a projection's next run over the log must process: seqs that are new or whose record changed since its last kept run.

The delivered log is landed in a versioned table: what arrived between two marks is one version, its rows are new files, and
the rows that it replaces enter a deletion vector. A projection's kept runs are a version that it has processed; its next
run's input is the difference between the manifests of that version and of the last one: rows of added files, and rows that
added deletion vectors name. A seq whose removed and added record are equal is unchanged. The rows and the version they were
found up to are kept in one commit, so a run that fails is repeated without skipping or repeating a record.

A record's content is hashed once, as it lands; differences read seqs, hashes and positions, never payloads.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.functions.jsonx import canonical_json
from mnemolake.functions.ranges import bucket_of
from mnemolake.session import scratch_path
from mnemolake.sources.versioned import VersionedTable, process_changes


def _moment(m: datetime) -> Column:
    """A literal without time zone, whatever the session's is."""
    return F.lit(m.isoformat(sep=" ")).cast("timestamp_ntz")


def marks(runs: DataFrame) -> DataFrame:
    """(projection, mark): the greatest read_until of the runs with status ok; null for a projection that never had one.

    Repeated rows and runs out of order don't matter. Rows with a null projection are no runs.
    """
    ok = F.when(F.col("status") == "ok", F.col("read_until"))
    return runs.where("projection is not null").groupBy("projection").agg(F.max(ok).alias("mark"))


def content_hash(log: DataFrame) -> Column:
    """A hash of a record without seq and arrived_at; payloads that are equal as JSON values hash alike."""
    same = sorted(c for c in log.columns if c not in ("seq", "arrived_at", "payload"))
    return F.xxhash64(F.lit(7), *[x for c in same for x in (F.col(c), F.col(c).isNull())], canonical_json(F.col("payload")), F.col("payload").isNull())


def land_log(log: DataFrame, at: list[datetime], path: str) -> tuple[VersionedTable, str]:
    """The log as a versioned table, and the name of its column of hashes: version i + 1 is the log as of the i-th moment, the last one the log as of now.

    Rows with a null seq are no records; null arrivals count as oldest, before every moment.
    """
    name = "_content"
    while name in log.columns:
        name += "_"
    arrived = F.coalesce("arrived_at", _moment(datetime(1, 1, 1)))
    at = sorted(set(at))
    table = VersionedTable(log.sparkSession, path, T.StructType([*log.schema.fields, T.StructField(name, T.LongType())]))
    rows = log.where("seq is not null").withColumn(name, content_hash(log))
    table.land(rows, bucket_of(arrived, [_moment(m) for m in at]) + 1, ["seq"], arrived, len(at) + 1)
    return table, name


def record_deltas(log: DataFrame, runs: DataFrame) -> DataFrame:
    """(projection, seq, change) of every seq to process; change is `new` or `changed`.

    Records are compared without arrived_at, payloads as JSON values. A projection without a kept run gets every seq, one
    that read everything none. All projections are served by one pass over the manifests' differences.
    """
    spark = log.sparkSession
    found = {r["projection"]: r["mark"] for r in marks(runs).collect()}  # the registry of projections
    if not found:
        return spark.createDataFrame([], "projection string, seq bigint, change string")
    at = sorted({m for m in found.values() if m is not None})
    table, content = land_log(log, at, scratch_path(spark, "log"))
    out = VersionedTable(spark, scratch_path(spark, "deltas"), "name string, seq bigint, change string")
    # what the journal says was kept
    out.commit(processed={p: 0 if m is None else at.index(m) + 1 for p, m in found.items()})
    process_changes(table, out, list(found), ["seq"], content)
    return out.read().withColumnRenamed("name", "projection")
