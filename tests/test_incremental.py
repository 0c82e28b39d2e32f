from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mnemolake.operators.incremental import land_log, record_deltas
from mnemolake.sources.versioned import VersionConflict, VersionedTable, process_changes, run_incremental

LOG = "seq bigint, agent_id string, correlation string, payload string, arrived_at timestamp_ntz"
RUNS = "projection string, read_until timestamp_ntz, status string"


def at(day, s=0):
    return datetime(2025, 1, day, 0, 0, s)


def test_record_deltas(spark):
    log = spark.createDataFrame(
        [
            (1, "a", None, '{"x":1,"y":2}', at(1)),
            (1, "a", None, '{ "y": 2.0, "x" : 1 }', at(9)),  # the same value
            (2, "a", None, '{"x":1}', at(1)),
            (2, "a", None, '{"x":2}', at(9)),
            (3, "a", None, None, at(9)),
            (4, "a", None, None, at(1)),
            (4, "a", "c", None, at(9)),
            (5, "a", None, "no json", at(2)),
            (5, "a", None, "no json", at(9)),
            (6, "a", None, '{"x":1}', None),
            (None, "a", None, None, at(9)),
            (7, "a", None, '{"x":1}', at(1)),
            (7, "a", None, '{"x":2}', at(3)),
            (7, "a", None, '{"x":1}', at(9)),
        ],
        LOG,
    )
    runs = spark.createDataFrame([("p", at(5), "ok"), ("p", at(4), "ok"), ("p", at(30), "failed"), ("q", at(10), "aborted"), ("r", at(20), "ok"), (None, at(20), "ok")], RUNS)
    got = {(r["projection"], r["seq"], r["change"]) for r in record_deltas(log, runs).collect()}
    assert got == {("p", 2, "changed"), ("p", 3, "new"), ("p", 4, "changed"), ("p", 7, "changed")} | {("q", s, "new") for s in range(1, 8)}
    assert record_deltas(log.limit(0), runs).count() == 0 and record_deltas(log, runs.limit(0)).count() == 0
    many = spark.range(1500).select(F.concat(F.lit("m"), "id").alias("projection"), F.lit(at(1)).cast("timestamp_ntz").alias("read_until"), F.lit("ok").alias("status"))
    assert record_deltas(log, many).count() == 1500 * 4


def test_landed_versions(spark, tmp_path):
    """Every version of a landed log is the log as of its moment, whatever arrives late, again or in one stretch with what replaces it."""
    rows = [(s, "a", None, f'{{"x":{d % 3}}}', at(1 + (s * 7 + d * 5) % 20, d)) for s in range(30) for d in range(s % 5)] + [(99, "a", None, f'{{"x":{i}}}', at(3, i % 60)) for i in range(200)]
    log = spark.createDataFrame(rows, LOG).repartition(3)
    moments = [at(4), at(9), at(15)]
    t, content = land_log(log, moments, f"file://{tmp_path}/log")
    now = {}
    for v, m in enumerate([*moments, at(31)], 1):
        then = {}
        for r in sorted(rows, key=lambda r: r[4]):
            if r[4] <= m:
                then[r[0]] = r[4]
        assert {r["seq"]: r["arrived_at"] for r in t.read(v).collect()} == then
        now[v] = {r["seq"]: r[content] for r in t.read(v).select("seq", content).collect()}
    now[0] = {}
    got = sorted(tuple(r) for r in t.key_changes([0, 1, 2, 3, 4], ["seq"], content).collect())
    want = [(s, v, "new" if s not in now[v] else "changed") for v in range(5) for s in now[4] if now[v].get(s) != now[4][s]]
    assert got == sorted(want)
    # a compaction changes no record
    t.compact()
    assert sorted(tuple(r) for r in t.key_changes([0, 1, 2, 3, 4], ["seq"], content).collect()) == sorted(want) and t.manifest()["deleted"] == []


def test_consumers_in_one_commit(spark, tmp_path):
    t, out = table(spark, tmp_path / "s"), VersionedTable(spark, f"file://{tmp_path}/o", "name string, k bigint, change string")
    t.commit(frame(spark, [(1, "a"), (2, "b"), (3, "c")]))
    assert process_changes(t, out, ["p"], ["k"], "v") == 1 and out.manifest()["processed"] == {"p": 1}
    t.upsert(frame(spark, [(2, "B"), (3, "c"), (4, "d")]), ["k"])
    t._publish(t.manifest() | {"version": 3, "deleted": [*t.manifest()["deleted"]]})
    process_changes(t, out, ["p", "q"], ["k"], "v")
    assert sorted(tuple(r) for r in out.read().collect()) == sorted([("p", k, "new") for k in (1, 2, 3)] + [("p", 2, "changed"), ("p", 4, "new")] + [("q", k, "new") for k in (1, 2, 3, 4)])
    assert out.manifest()["processed"] == {"p": 3, "q": 3} and process_changes(t, out, ["p", "q"], ["k"], "v") is None


def table(spark, path, schema="k bigint, v string"):
    return VersionedTable(spark, f"file://{path}", schema)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k bigint, v string")


def test_versions_and_diff(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert t.version() == 0 and t.read().count() == 0
    t.commit(frame(spark, [(1, "a"), (2, "b"), (3, "c")]))
    t.upsert(frame(spark, [(2, "B"), (4, "d")]), ["k"])
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    assert sorted(tuple(r) for r in t.read(1).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(tuple(r) for r in t.diff(1, 2).collect()) == [(2, "B", "+"), (2, "b", "-"), (4, "d", "+")]
    assert t.diff(2, 2).count() == 0 and t.diff(0, 2).count() == 4
    m = t.manifest()
    t.commit(frame(spark, [(9, "z")]), drop=m["data"], base=m["version"])
    assert sorted(r["change"] for r in t.diff(2, 3).collect()) == ["+", "-", "-", "-", "-"]
    with pytest.raises(VersionConflict):
        t.commit(frame(spark, [(5, "e")]), base=1)


def test_moved_rows_are_no_change(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.commit(frame(spark, [(i, "a") for i in range(5)]))
    t.upsert(frame(spark, [(1, "b")]), ["k"])
    t.compact()
    assert t.diff(2, 3).count() == 0 and t.manifest()["deleted"] == []
    t.upsert(frame(spark, [(1, "c"), (9, "z")]), ["k"])
    assert sorted(tuple(r) for r in t.diff(1).collect()) == [(1, "a", "-"), (1, "c", "+"), (9, "z", "+")]


def test_runs_survive_failures(spark, tmp_path):
    src, out = table(spark, tmp_path / "s"), VersionedTable(spark, f"file://{tmp_path}/o", "k bigint, n bigint")
    seen = []

    def step(d):
        seen.append(sorted((r["k"], r["change"]) for r in d.collect()))
        return d.where("change = '+'").groupBy("k").agg(F.count(F.lit(1)).alias("n"))

    def broken(d):
        step(d)
        raise RuntimeError("lost")

    src.commit(frame(spark, [(1, "a"), (2, "b")]))
    with pytest.raises(RuntimeError):
        run_incremental(src, out, "p", broken, ["k"])
    assert out.read().count() == 0
    run_incremental(src, out, "p", step, ["k"])
    src.upsert(frame(spark, [(2, "c"), (3, "d")]), ["k"])
    run_incremental(src, out, "p", step, ["k"])
    assert run_incremental(src, out, "p", step, ["k"]) is None
    assert seen[0] == seen[1] == [(1, "+"), (2, "+")] and seen[2] == [(2, "+"), (2, "-"), (3, "+")] and len(seen) == 3
    assert sorted(r["k"] for r in out.read().collect()) == [1, 2, 3] and out.manifest()["processed"] == {"p": 2}
