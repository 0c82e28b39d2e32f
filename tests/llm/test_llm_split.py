from hypothesis import given, settings
from hypothesis import strategies as st

from mnemolake.llm.split import cuts, paragraphs, split_oversized


def greedy(text, starts, ends, limit):
    assert ends[-1] == len(text) and starts[0] == 0
    assert all(0 < e - s <= limit for s, e in zip(starts, ends))
    assert all(a < b for a, b in zip(ends, ends[1:]))
    shown = [text[max(s, p) : e] for s, e, p in zip(starts, ends, [0, *ends[:-1]])]
    assert "".join(shown) == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab .\n\r\té🐝", max_size=400), max_size=5), st.integers(10, 60))
def test_round_trip(texts, limit):
    for t, (s, e) in zip(texts, cuts(texts, limit, limit // 4)):
        if t:
            greedy(t, s.tolist(), e.tolist(), limit)
        else:
            assert len(e) == 0


def test_boundaries_and_overlap():
    words = "This is a sentence of some words. " * 60
    (s, e), = cuts([words], 200, 40)
    greedy(words, s.tolist(), e.tolist(), 200)
    assert all(words[x - 1] in ".!?" for x in e[:-1])
    assert all(20 <= p - q <= 60 and words[q - 1] == " " for p, q in zip(e[:-1], s[1:]))
    text = ("x" * 30 + "\n\n") * 40
    (s, e), = cuts([text], 200, 10)
    assert all(text[x : x + 2] == "\n\n" for x in e[:-1])
    solid = "y" * 5000
    (s, e), = cuts([solid], 1000, 100)
    assert [b - a for a, b in zip(s, e)][:-1] == [1000] * (len(e) - 1) and all(p - q == 100 for p, q in zip(e[:-1], s[1:]))


def test_paragraphs():
    t = "a\r\nb\r\n \t\r\n\n c\n"
    assert [t[a:b] for a, b in paragraphs(t)] == ["a\r\nb", " c"]
    assert paragraphs("") == [] and paragraphs(" \n\t") == [] and paragraphs("x\r") == [(0, 2)]


def test_rows(spark):
    long = "word " * 300
    rows = [("a", long, 1), ("a", long, 1), ("b", None, 2), ("c", "", 3), ("d", "short", 4), (None, "z" * 2500, 5), ("e", "s\n\n" + "q" * 1200, 6)]
    df = spark.createDataFrame(rows, "id string, body string, piece int")  # piece clashes with a result column
    out = split_oversized(df, ["id"], "body", 1000, 100, units=True).collect()
    assert sorted({(r["id"] or "", r["unit_no"]) for r in out}) == [("", 0), ("", 1), ("a", 0), ("a", 1), ("e", 0), ("e", 2)]
    assert all(len(r["piece"]) <= 1000 and r["end"] - r["start"] == len(r["piece"]) for r in out)
    assert sum(1 for r in out if r["id"] == "a" and r["unit_no"] == 0 and r["piece_no"] == 1) == 2
    assert split_oversized(df.limit(0), ["id"], "body", 1000, 100).count() == 0
