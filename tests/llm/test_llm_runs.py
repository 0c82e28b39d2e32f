import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemolake.llm import runs as runs_module
from mnemolake.llm.runs import _NAMES, _stretch, _tie, agglomerate, collapse_runs, message_key, tool_key

SCHEMA = "agent_id string, stream_id string, seq bigint, ts_ms bigint, tool string, outcome string"


def plain(rows):
    """Rows of events as runs of one."""
    out = []
    for a, s, q, t, tool, o in rows:
        w = " ".join(sorted(set(o.split())))
        out.append((a, s, q, q, 1, t, t, t, t, tool, o, True, w, w, False))
    return pd.DataFrame(out, columns=_NAMES)


def one_by_one(rows, least, gap):
    """The best pair of neighbouring runs, again and again, looking at all of them each time."""
    runs = [[r] for r in sorted(rows, key=lambda r: (r[0], r[1], r[2]))]

    def value(x, y):
        if x[0][:2] != y[0][:2] or x[0][4] != y[0][4] or (gap is not None and y[0][3] - x[-1][3] > gap):
            return 0
        outs = [r[5] for r in x + y]
        if len(set(outs)) == 1:
            return 1
        if not all(o.startswith("Err: ") for o in outs):
            return 0
        sets = [set(o.split()) for o in outs]
        return min(1 - 1e-9, len(set.intersection(*sets)) / len(set.union(*sets)))

    while True:
        best = max(((value(x, y), -int(_tie(np.array([y[0][2]]))[0]), i) for i, (x, y) in enumerate(zip(runs, runs[1:]))), default=(0, 0, 0))
        if best[0] < least or best[0] == 0:
            return [(r[0][2], r[-1][2], len(r)) for r in runs]
        i = best[2]
        runs[i : i + 2] = [runs[i] + runs[i + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_near_runs_by_brute_force_and_any_cut(seed, monkeypatch):
    r = random.Random(seed)
    words = "abcdefgh"
    base = " ".join(words)
    rows = []
    for q in range(160):
        o = "Ok" if r.random() < 0.1 else "Err: " + " ".join(w if r.random() < 0.93 else r.choice("xyz") for w in words) if r.random() < 0.7 else f"Err: {base}"
        # clocks that run back
        rows.append(("a", r.choice("st") if seed % 2 else "s", q, q * 1000 + r.choice([0, 0, 9_000_000, -5_000_000]), "t" if r.random() < 0.95 else "u", o))
    least, gap = r.choice([0.5, 0.6, 0.8]), r.choice([None, 3_600_000, 2_000])
    want = one_by_one(rows, least, gap)
    df = plain(sorted(rows, key=lambda r: (r[0], r[1], r[2])))
    merged, final = agglomerate(df, least, gap)
    assert list(zip(merged["first_seq"], merged["last_seq"], merged["n"])) == want and final.all()
    # cut into tasks and batches of any size
    for tasks, chunk in ((1, 3), (4, 7), (9, 1), (40, 50)):
        monkeypatch.setattr(runs_module, "CHUNK", chunk)
        monkeypatch.setattr(runs_module, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": staticmethod(lambda: 0)}))}))
        size = -(-len(df) // tasks)
        parts = [p for i in range(0, len(df), size) for p in _stretch(least, gap, False)(iter([df.iloc[i : i + size]]))]
        parts = pd.concat([p for p in parts if len(p)])
        edges = parts[parts["part"].notna()][_NAMES].sort_values(["agent_id", "stream_id", "first_seq"], ignore_index=True)
        again = [p for p in _stretch(least, gap, True)(iter([edges])) if len(p)]
        got = pd.concat([parts[parts["part"].isna()][_NAMES], *again]).sort_values(["agent_id", "stream_id", "first_seq"])
        assert list(zip(got["first_seq"], got["last_seq"], got["n"])) == want


@pytest.mark.parametrize("seed", range(3))
def test_identical_runs_come_through_the_queue(seed, monkeypatch):
    """The limit of p4_found spares no work: boundaries are valued as under any limit, merges come from the queue, at any cut."""
    r = random.Random(seed)
    rows = [("a", r.choice("st"), q, q * 10, "t" if r.random() < 0.9 else "u", r.choice(["Ok", "Ok", "Err: a b c d", "Err: a b c e"])) for q in range(200)]
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    valued, popped = [], []
    value, pop = runs_module.similarity, runs_module.heapq.heappop
    monkeypatch.setattr(runs_module, "similarity", lambda a, b: valued.append((a, b)) or value(a, b))
    monkeypatch.setattr(runs_module.heapq, "heappop", lambda q: popped.append(q[0]) or pop(q))
    touching = sum(a[:2] + a[4:5] == b[:2] + b[4:5] for a, b in zip(rows, rows[1:]))
    merged, final = agglomerate(plain(rows), 1.0, None)
    want = one_by_one(rows, 1.0, None)
    assert list(zip(merged["first_seq"], merged["last_seq"], merged["n"])) == want and final.all()
    assert len(popped) == len(rows) - len(want) and popped == sorted(popped)
    assert len(valued) > touching  # anew beside merged runs
    first = valued[:touching]
    valued.clear()
    agglomerate(plain(rows), 0.6, None)
    assert valued[:touching] == first
    monkeypatch.setattr(runs_module, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": staticmethod(lambda: 0)}))}))
    for size, chunk in ((200, 3), (50, 7), (5, 50), (1, 1)):
        monkeypatch.setattr(runs_module, "CHUNK", chunk)
        df = plain(rows)
        parts = pd.concat([p for i in range(0, len(df), size) for p in _stretch(1.0, None, False)(iter([df.iloc[i : i + size]])) if len(p)])
        edges = parts[parts["part"].notna()][_NAMES].sort_values(["agent_id", "stream_id", "first_seq"], ignore_index=True)
        got = pd.concat([parts[parts["part"].isna()][_NAMES], *_stretch(1.0, None, True)(iter([edges]))]).sort_values(["agent_id", "stream_id", "first_seq"])
        assert list(zip(got["first_seq"], got["last_seq"], got["n"])) == want


def brute(rows, gap=None):
    out, by = [], {}
    for r in rows:
        by.setdefault((r[0], r[1]), []).append(r)
    for key, rs in by.items():
        rs.sort(key=lambda r: r[2])
        run = [rs[0]]
        for r in rs[1:]:
            if r[4] is not None and (r[4], r[5]) == (run[-1][4], run[-1][5]) and (gap is None or (r[3] or 0) - (run[-1][3] or 0) <= gap):
                run.append(r)
            else:
                out.append((*key, run[0][2], run[-1][2], len(run)))
                run = [r]
        out.append((*key, run[0][2], run[-1][2], len(run)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = []
    for s in range(900):
        agent = "hot" if r.random() < 0.8 else r.choice(["b", None])
        rows.append((agent, r.choice(["s", None]), s, s * 10, None if r.random() < 0.02 else r.choice("xy") if r.random() < 0.2 else "x", "Ok" if r.random() < 0.7 else "Err: e"))
    got = collapse_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((x["agent_id"], x["stream_id"], x["first_seq"], x["last_seq"], x["n"]) for x in got), key=str) == brute(rows)
    assert all(x["duration_ms"] == (x["last_seq"] - x["first_seq"]) * 10 for x in got)


def test_near_runs_and_gaps(spark):
    e = ["Err: a b c d", "Err: a b c e", "Err: a b c e", "Err: q", "Ok", "Ok"]
    rows = [("a", "s", i, i * 10 + (1000 if i == 5 else 0), "t", o) for i, o in enumerate(e)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r["first_seq"], r["n"]) for r in collapse_runs(df, 0.6).orderBy("first_seq").collect()] == [(0, 3), (3, 1), (4, 2)]
    assert [(r["first_seq"], r["n"]) for r in collapse_runs(df, 1.0, 100).orderBy("first_seq").collect()] == [(0, 1), (1, 2), (3, 1), (4, 1), (5, 1)]
    assert collapse_runs(df.limit(0)).count() == 0


def test_no_drift():
    """Neighbours that are alike one by one don't make a run whose ends have nothing in common."""
    rows = [("a", "s", q, q, "t", "Err: " + " ".join(f"w{q + k}" for k in range(10))) for q in range(30)]
    merged, _ = agglomerate(plain(rows), 0.6, None)
    assert merged["n"].max() <= 4 and merged["n"].sum() == 30
    assert len(agglomerate(plain(rows)[:0], 1.0, None)[0]) == 0


def test_keys(spark):
    t = spark.createDataFrame([(x,) for x in ("disk.write", " DISK_WRITE ", "Disk-Write", "disk write")], "t string").select(tool_key(F.col("t")).alias("k")).distinct().collect()
    assert [r["k"] for r in t] == ["disk.write"]
    same = [
        ["lock on ticket AB-12 is held by another worker", "  LOCK  on ticket ZQ-99 is held by another worker.", "Lock on ticket x1 is held by another worker!"],
        ["no such entry: '/srv/tmp/a.dat'", "No such entry: '/srv/cache/9f.dat'."],
        ["upstream unavailable (trace=abc)", "UPSTREAM UNAVAILABLE (TRACE=12F)"],
        ["request dead-beef rejected by policy", "request 12ab-34cd rejected by policy"],
        ["worker lost at 2025-03-03T01:02:03Z", "worker lost at 2024-01-01T11:12:13Z"],
        ["quota used up", "Quota used up."],
    ]
    flat = [(i, m) for i, g in enumerate(same) for m in g]
    got = spark.createDataFrame(flat, "i int, m string").select("i", message_key(F.col("m")).alias("k")).distinct().collect()
    assert len(got) == len(same) and len({r["k"] for r in got}) == len(same)
