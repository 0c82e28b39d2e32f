from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemolake.operators.skew import fragment, fragment_join, heavy_keys, key_loads, plan_shards, sharded_aggregate


def rows(spark):
    r = [("hot", i) for i in range(3000)] + [(None, i) for i in range(800)] + [(f"k{i % 40}", i) for i in range(1200)]
    return r, spark.createDataFrame(r, "k string, v int").repartition(3)


def test_plan_splits_hot_keys_evenly(spark):
    r, df = rows(spark)
    plan = plan_shards(key_loads(df, ["k"]), ["k"], 6)
    assert plan.total == len(r) and [k for k, _, _ in plan.large] == [("hot",), (None,)]
    sizes = Counter(x["_task"] for x in fragment(df, plan).select("_task").collect())
    assert max(sizes.values()) <= 1.5 * len(r) / 6


def test_aggregate_and_join_keep_everything(spark):
    r, df = rows(spark)
    plan = plan_shards(key_loads(df, ["k"]), ["k"], 6)
    got = {x["k"]: (x["n"], x["s"]) for x in sharded_aggregate(df, plan, {"c": F.count(F.lit(1)), "t": F.sum("v")}, {"n": F.sum("c"), "s": F.sum("t")}).collect()}
    want = {k: (n, sum(v for a, v in r if a == k)) for k, n in Counter(k for k, _ in r).items()}
    assert got == want
    # a clashing column name is taken from the large side; null keys match; keys without a match stay in a left join
    match = spark.createDataFrame([("hot", 1, -1), (None, 2, -1), ("k1", 3, -1)], "k string, w int, v int")
    j = fragment_join(df, match, plan, "left").collect()
    assert len(j) == len(r) and Counter(x["w"] for x in j) == {1: 3000, 2: 800, 3: 30, None: 1170}
    assert sorted((x["k"] or "", x["v"]) for x in j) == sorted((k or "", v) for k, v in r)


def test_heavy_keys(spark):
    df = spark.createDataFrame([("a", None)] * 50 + [("b", "x")] * 49 + [("c", "y")], "f string, g string")
    got = {(x["field_name"], x["key_text"], x["rows"]) for x in heavy_keys(df, ["f", "g"], 0.02).collect()}
    assert got == {("f", "a", 50), ("f", "b", 49), ("g", "x", 49)}
    assert heavy_keys(df.limit(0), ["f", "g"], 0.02).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 500), max_size=30), st.integers(1, 9))
def test_plan_is_whole(spark, loads, n):
    df = spark.createDataFrame([(f"k{i}", x) for i, x in enumerate(loads)], "k string, load bigint")
    p = plan_shards(df, ["k"], n)
    assert p.total == sum(loads) and all(0 <= t < n for _, _, w in p.large for t in w) and len(p.large) <= 4 * n
