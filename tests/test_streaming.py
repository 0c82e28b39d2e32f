from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mnemolake.session import clear_scratch, materialize
from mnemolake.streaming.projections import idle_sessions, rate_windows, working_state

EVENTS = "agent_id string, stream_id string, seq bigint, ts_ms bigint"


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_windows_and_sessions(spark, tmp_path):
    rows = [("a", "s", i, t * 1000) for i, t in enumerate((0, 5, 30, 4000, 4010, 9000))]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    e = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
    got = {(r["start_ms"], r["events"]) for r in run(rate_windows(e, "60 seconds", "60 seconds"), tmp_path, "rate", "complete")}
    assert got == {(0, 3), (3_960_000, 2), (9_000_000, 1)}
    # a closed session comes out once the clock is past it; the last is still open
    got = {(r["start_ms"], r["events"]) for r in run(idle_sessions(e, "30 minutes"), tmp_path, "idle", "append")}
    assert got <= {(0, 3), (4_000_000, 2), (9_000_000, 1)} and (0, 3) in got


def test_working_state_expires(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    schema = "agent_id string, key string, value string, ttl_ms bigint, ts timestamp"
    for i, rows in enumerate(([("a", "k", "1", 1000, t0), ("a", "j", "x", None, t0)], [("a", "k", "2", 1000, t0 + timedelta(milliseconds=500))], [("b", "z", "y", None, t0 + timedelta(hours=1))], [("b", "z", "w", None, t0 + timedelta(hours=2))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    u = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    got = [(r["agent_id"], r["key"], r["value"]) for r in run(working_state(u), tmp_path, "working")]
    assert ("a", "k", "2") in got and ("a", "k", None) in got and ("a", "j", None) not in got
    assert got.index(("a", "k", "2")) < got.index(("a", "k", None))


def test_scratch_tables(spark):
    df = materialize(spark.range(5).select(F.col("id"), F.lit(None).cast("string").alias("s")), "t")
    assert df.count() == 5 and df.schema.fieldNames() == ["id", "s"]
    clear_scratch(spark)
    assert spark.sparkContext._mnemolake_tables == []
