import random

import pytest

from mnemolake.operators.hierarchy import all_descendants, descendants, hierarchy, paths


def brute(par):
    out = {}
    for n in par:
        x, seen = n, []
        while True:
            if x in seen:
                out[n] = (min(seen[seen.index(x) :]), -1)
                break
            seen.append(x)
            p = par[x]
            if p is None or p not in par:
                out[n] = (x, len(seen) - 1)
                break
            x = p
    return out


def made(seed, n=300, far=0.1):
    r = random.Random(seed)
    par = {}
    for i in range(1, n + 1):
        u = r.random()
        par[i * 3] = None if u < 0.03 else r.randrange(1, n + 20) * 3 if u < far else max(1, i - r.randrange(1, 4)) * 3
    par[30], par[33], par[9] = 33, 30, 9
    return par


@pytest.mark.parametrize("seed, far, block", [(0, 0.1, 40), (1, 0.9, 40), (2, 0.1, 9), (5, 0.2, 7), (3, 0.5, 1000)])
def test_roots_depths_rings(spark, seed, far, block):
    par = made(seed, 120 if block < 10 else 300, far)
    df = spark.createDataFrame([*par.items(), (None, 3), *list(par.items())[:5]], "a bigint, b bigint")
    assert {x["node"]: (x["root"], x["depth"]) for x in hierarchy(df, "a", "b", block).collect()} == brute(par)


def test_long_chain_over_blocks_and_empty(spark):
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(500)], "a bigint, b bigint")
    got = {x["node"]: x["depth"] for x in hierarchy(df, "a", "b", 50).collect()}
    assert got == {i: i for i in range(500)}
    assert hierarchy(df.limit(0), "a", "b").count() == 0


def test_paths_and_descendants(spark):
    par = made(4, 150)
    want = brute(par)
    p = paths(spark.createDataFrame(list(par.items()), "a bigint, b bigint"), "a", "b", 30)
    got = {x["node"]: x["path"] for x in p.collect()}
    assert set(got) == {n for n, (_, d) in want.items() if d >= 0}
    for n, path in got.items():
        assert path[0] == want[n][0] and path[-1] == n and len(path) == want[n][1] + 1
        assert all(par[b] == a for a, b in zip(path, path[1:]))
    assert descendants(p).count() == sum(d for _, d in want.values() if d > 0)


@pytest.mark.parametrize("seed", [4, 6])
def test_descendants_of_rings(spark, seed):
    par = made(seed, 150)
    par.update({1000 + i: 1000 + (i + 1) % 7 for i in range(7)})  # a ring of seven, a tail below it, and a ring of one
    par.update({2000: 1003, 2001: 2000, 2002: 2001, 3000: 3000, 3001: 3000})
    want = {}
    for n in par:
        x, d = par[n], 1
        while x in par and (x, n) not in want:
            if x != n:
                want[x, n] = d
            else:
                break
            x, d = par[x], d + 1
    got = [((r["ancestor"], r["node"]), r["distance"]) for r in all_descendants(spark.createDataFrame(list(par.items()), "a bigint, b bigint"), "a", "b", 40).collect()]
    assert len(got) == len(dict(got)) and dict(got) == want
