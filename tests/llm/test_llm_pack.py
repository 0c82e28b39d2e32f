import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemolake.llm.pack import differencing, pack, pack_block


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=80), st.integers(1, 9))
def test_differencing_is_whole(sizes, k):
    s = np.array(sizes, np.int64)
    where, load = differencing(s, k)
    assert len(where) == len(s) and ((where >= 0) & (where < k)).all()
    assert (np.bincount(where, s, k) == load).all()


def test_differencing_is_even():
    s = np.random.default_rng(0).integers(1, 100, 600)
    _, load = differencing(s, 12)
    assert load.max() - load.min() <= 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=120))
def test_no_window_over_capacity(sizes):
    s = np.array(sizes, np.int64)
    where, made = pack_block(s, 64)
    assert len(where) == len(s) and (not len(s) or np.bincount(where, s).max() <= 64)


def test_most_windows_come_from_differencing():
    rng = np.random.default_rng(5)
    small, large = rng.integers(1, 300, 3000), rng.integers(100, 1500, 1500)
    for s, capacity, share in ((small, 2048, 0.95), (large, 2048, 0.05)):
        where, made = pack_block(s, capacity)
        k = where.max() + 1
        assert made >= share * k and k <= 1.03 * -(-s.sum() // capacity) + 1


def test_layout_does_not_matter(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i) if i % 7 else None, int(x)) for i, x in enumerate(rng.integers(1, 700, 2000))] + [(5, 300)] * 400
    df = spark.createDataFrame(rows, "item_id bigint, tokens bigint")
    a, b = (sorted(map(tuple, pack(d, 512).collect()), key=str) for d in (df, df.repartition(3).sortWithinPartitions("tokens")))
    assert a == b and len(a) == len([1 for _, x in rows for _ in range(-(-x // 512))])


def test_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(x)) for i, x in enumerate(rng.lognormal(5, 1, 3000))] + [(9000, 0), (9001, None), (9002, 512), (9003, 1500), (1, 30), (None, 40)]
    out = pack(spark.createDataFrame(rows, "item_id bigint, tokens bigint"), 512).collect()
    load = {}
    for r in out:
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["tokens"]
    assert max(load.values()) <= 512 and sum(load.values()) == sum(x or 0 for _, x in rows)
    assert sum(load.values()) / (512 * len(load)) > 0.98
    cut = [r for r in out if r["item_id"] == 9003]
    assert sorted((r["piece_no"], r["start"], r["tokens"]) for r in cut) == [(1, 0, 512), (2, 512, 512), (3, 1024, 476)]
    assert {r["item_id"] for r in out} == {i for i, _ in rows}
    assert all(sum(1 for r in out if r["item_id"] == i) == 1 for i, x in rows[:3000] if x <= 512 and i != 1)
    assert pack(spark.createDataFrame([], "item_id bigint, tokens bigint"), 512).count() == 0


def test_one_size_for_all(spark):
    out = pack(spark.createDataFrame([(7, 300)] * 500, "item_id bigint, tokens bigint"), 512).collect()
    assert len(out) == 500 and len({r["container_id"] for r in out}) == 500
