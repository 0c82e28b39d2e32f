import numpy as np
import pyarrow as pa
import pytest

from mnemolake.llm import knn
from mnemolake.llm.knn import brute_force, hilbert_keys, nearest, pairs_of


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (5, 2)])
def test_curve_is_a_path(dims, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = hilbert_keys(cells, bits)
    assert sorted(key) == list(range(side**dims))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_recall_ties_and_copies(spark):
    g = np.random.default_rng(0)
    v = (g.normal(size=(60, 32))[g.integers(0, 60, 1500)] + g.normal(size=(1500, 32)) * 0.5).astype(np.float32)
    ids = [f"d{i:05d}" for i in range(1500)]
    v[100:140] = v[100]  # forty copies
    rows = [(i, x.tolist()) for i, x in zip(ids, v)]
    bad = [("n1", None), ("n2", [0.0] * 32), ("n3", [float("nan")] * 32), ("n4", [1.0] * 31), ("n5", [float("inf")] + [1.0] * 31), (None, [1.0] * 32), ("n6", [None] + [1.0] * 31)]
    df = spark.createDataFrame(rows + bad, "id string, vector array<float>")
    got = {}
    for r in nearest(df, 32, curves=12, window=128).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["near_id"]))
    got = {k: [n for _, n in sorted(x)] for k, x in got.items()}
    want = brute_force(ids, v, 5)
    assert set(got) == set(ids) and all(len(x) == 5 for x in got.values())
    assert sum(len(set(got[i]) & set(w)) for i, w in want.items()) / (5 * len(ids)) > 0.97
    assert all(got[i] == want[i] for i in ids[100:140])


def test_few_and_none(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 2.0])], "id string, vector array<float>")
    n = nearest(df, 2)
    assert sorted((r["id"], r["near_id"]) for r in n.collect()) == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b")]
    assert pairs_of(n).count() == 3
    assert nearest(df.limit(1), 2).count() == 0 and nearest(df.limit(0), 2).count() == 0


def test_dense_third(spark):
    g = np.random.default_rng(2)
    centre = g.normal(size=(1, 32))
    v = np.concatenate([centre + g.normal(size=(1500, 32)) * 0.05, g.normal(size=(3000, 32))]).astype(np.float32)
    ids = [f"d{i:05d}" for i in g.permutation(4500)]
    got = {}
    for r in nearest(spark.createDataFrame(list(zip(ids, v.tolist())), "id string, vector array<float>"), 32, curves=12, window=64).collect():
        got.setdefault(r["id"], set()).add(r["near_id"])
    want = brute_force(ids, v, 5, np.arange(0, 1500, 5))
    assert sum(len(got[i] & set(w)) for i, w in want.items()) / (5 * len(want)) > 0.8


def test_ties_of_multiples(spark):
    g = np.random.default_rng(4)
    one = g.normal(size=(1, 32))
    v = np.concatenate([one * g.uniform(0.1, 9, (600, 1)), g.normal(size=(200, 32)), one + g.normal(size=(20, 32)) * 0.1]).astype(np.float32)
    ids = [f"d{i:05d}" for i in g.permutation(820)]
    got = {}
    for r in nearest(spark.createDataFrame(list(zip(ids, v.tolist())), "id string, vector array<float>"), 32, curves=12, window=32).orderBy("rank").collect():
        got.setdefault(r["id"], []).append(r["near_id"])
    want = brute_force(ids, v, 5, np.arange(600))
    assert all(got[i] == w for i, w in want.items())
    want = brute_force(ids, v, 5, np.arange(800, 820))
    assert sum(len(set(got[i]) & set(w)) for i, w in want.items()) > 90


def test_ranges_and_streams_change_nothing(spark, monkeypatch):
    """Windows go on over the bounds of ranges and of what is held at once."""
    g = np.random.default_rng(6)
    v = (g.normal(size=(80, 32))[g.integers(0, 80, 2500)] + g.normal(size=(2500, 32)) * 0.3).astype(np.float32)
    ids = [f"d{i:05d}" for i in range(2500)]
    df = spark.createDataFrame(list(zip(ids, v.tolist())), "id string, vector array<float>")
    want = {(i, n) for i, x in brute_force(ids, v, 5).items() for n in x}
    for rows in (60_000, 400):
        monkeypatch.setattr(knn, "TASK_ROWS", rows)
        got = {(r["id"], r["near_id"]) for r in nearest(df, 32, curves=10, window=200).collect()}
        assert len(got) == len(want) and len(got & want) >= 0.99 * len(want)
    rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(900, np.int32)), knn._binary(g.permutation(900).astype(">u8").view(np.uint8).reshape(-1, 8)), knn._binary(v[:900].view(np.uint8)), pa.array(np.ones(900, bool))], ["part", "key", "v", "own"])
    found = []
    monkeypatch.setattr(knn, "STEP", 1)
    for size in (900, 40):
        out = knn._windows(iter([rows.slice(i, size) for i in range(0, 900, size)]), 32, 100, 4)
        found.append({(u, bytes(x)) for b in out for u, x in zip(b.column("uid").to_pylist(), b.column("best").to_pylist())})
    keep = lambda f: {u: frozenset((int(c["far"]), int(c["near"])) for c in np.frombuffer(x, knn._NEAR)) for u, x in f}
    assert keep(found[0]) == keep(found[1]) and len(found[0]) == 900
