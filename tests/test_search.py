import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake.adapters import NamespaceStore, TextStore
from mnemolake.functions.analyzer import analyze, fold, stem_es, stop_words
from mnemolake.operators import ann, retrieval
from mnemolake.store import Clock, MemoryStore


def test_stemmer():
    assert stem_es("zanahorias") == stem_es("zanahoria") and stem_es("canciones") == stem_es("cancion")
    assert stem_es("cantando") == stem_es("cantar") == stem_es("cantaba") == "cant"
    assert stem_es("felizmente") == stem_es("feliz") and stem_es("actividades") == stem_es("actividad") and stem_es("rapido") == "rap"
    assert stem_es("si") == "si" and stem_es("") == ""
    assert fold("ñandú") == "nandu"


def test_analysis(spark):
    stops = stop_words()
    assert analyze("¿Cómo es la Canción?", stops) == analyze("cancion", stops) and analyze(None, stops) == []


def test_query_reading():
    p = retrieval.parse_query
    assert p('+red "big blue" -old name:fox') == {"must": [(None, ["red"])], "should": [(None, ["big", "blue"]), ("name", ["fox"])], "must_not": [(None, ["old"])]}
    assert p("a AND b NOT c OR d")["must"] == [(None, ["a"]), (None, ["b"])] and p("a AND b NOT c OR d")["must_not"] == [(None, ["c"])]
    assert p('"open ((: +') ["should"] == [(None, ["open"])] and p(None) == {"must": [], "should": [], "must_not": []}


def test_operators(spark):
    docs = spark.createDataFrame([("a", "big blue fox", None, None), ("b", "blue big fox", None, None), ("c", "red fox", "big blue", None), ("d", "old big blue fox", None, None)], "id string, body string, name string, tags string").withColumn("filters", F.lit(None).cast("array<struct<field:string,value:string>>"))

    def ids(text):
        q = spark.createDataFrame([(1, text, 10)], "query_id bigint, query_text string, k int").withColumn("filters", F.lit(None).cast("array<struct<field:string,value:string>>"))
        return {r["id"] for r in retrieval.bm25_parsed(docs, q).collect()}

    assert ids('"big blue"') == {"a", "c", "d"} and ids('"big blue" -old') == {"a", "c"} and ids('body:"big blue"') == {"a", "d"}
    assert ids("+red fox") == {"c"} and ids("red AND fox") == {"c"} and ids("fox NOT old") == {"a", "b", "c"} and ids("-fox") == set()
    assert ids('name:blue') == {"c"} and ids('"') == set() and ids("zebra fox") == {"a", "b", "c", "d"}


@pytest.fixture(scope="module")
def vectors(spark):
    g = np.random.default_rng(1)
    m = (g.normal(size=(20, 16))[g.integers(0, 20, 800)] + 0.4 * g.normal(size=(800, 16))).astype(np.float32)
    df = spark.createDataFrame([(f"d{i:04d}", x.tolist(), [{"field": "g", "value": str(i % 4)}]) for i, x in enumerate(m)] + [("bad", [0.0] * 16, None)], "id string, vector array<float>, filters array<struct<field:string,value:string>>")
    q = spark.createDataFrame([(i, None, m[i].tolist(), 10, [{"field": "g", "value": "1"}] if i % 2 else []) for i in range(40)] + [(99, None, None, 10, [])], "query_id bigint, query_text string, vector array<float>, k int, filters array<struct<field:string,value:string>>")
    return m, df, q


def test_exact_and_filtered(vectors):
    m, df, q = vectors
    got = {}
    for r in retrieval.top(retrieval.cosine(df, q, 16), q, F.col("k")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    u = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    for i in range(40):
        s = np.round(u @ u[i], 6)
        want = sorted((j for j in range(800) if not i % 2 or j % 4 == 1), key=lambda j: (-s[j], j))[:10]
        assert [n for _, n in sorted(got[i])] == [f"d{j:04d}" for j in want]
    assert 99 not in got


def test_inverted_lists(vectors):
    _, df, q = vectors
    plain = q.withColumn("filters", F.lit(None).cast("array<struct<field:string,value:string>>"))
    index, book = ann.build(df, 16)
    assert index.count() == 800
    found = ann.search(index, book, plain, 16, nprobe=6)
    truth = retrieval.top(retrieval.cosine(df, plain, 16), plain, F.col("k"))
    assert retrieval.recall_at_k(found, truth).first()["recall"] >= 0.9
    t = ann.trace(index, book, q.first()["vector"], 3).collect()
    assert [r["layer"] for r in t] == [1] * 4 + [0] * 3 and t[4]["node"] == "d0000" and t[4]["distance"] == 0.0
    empty, none = ann.build(df.limit(0), 16)
    assert ann.search(empty, none, plain, 16).count() == 0
    axes = ann.principal_axes(df, 16).collect()
    a = np.array([r["axis"] for r in axes])
    assert a.shape == (800, 3) and (np.diff(a.var(axis=0)) <= 1e-9).all()


def test_adapters(spark, tmp_path):
    with MemoryStore(spark, str(tmp_path), clock=Clock(5)) as s:
        n = NamespaceStore(s)
        n.batch([("put", ("u", "a"), "k1", {"t": "green carrot", "n": 3}), ("put", ("u", "b"), "k2", {"t": "red motor", "n": 5}), ("put", ("u", "a", "x"), "k3", {"t": "carrot soup"}, False)])
        assert n.get(("u", "a"), "k1").value["n"] == 3 and n.get(("u",), "k1") is None
        assert [i.key for i in n.search(("u",), "carrot")] == ["k1"] and [i.key for i in n.search(("u", "a"))] == ["k1", "k3"]
        assert [i.key for i in n.search(("u",), filter={"n": {"$gt": 3}})] == ["k2"]
        assert n.list_namespaces(max_depth=2) == [("u", "a"), ("u", "b")] and n.list_namespaces(suffix=("x",)) == [("u", "a", "x")]
        n.delete(("u", "a"), "k1")
        assert n.search(("u",), "carrot") == []
        t = TextStore(s)
        ids = t.add_texts(["blue whale", "small fish"], [{"kind": "big"}, {"kind": "small"}])
        assert t.similarity_search("fish")[0][0]["id"] == ids[1] and t.similarity_search("fish", filter={"kind": "big"}) == []
        assert [d["id"] for d in t.get_by_ids([ids[1], "none", ids[0]])] == [ids[1], ids[0]]
        t.delete(ids)
        assert t.get_by_ids(ids) == []
