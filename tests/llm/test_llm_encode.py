import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemolake.llm.encode import TOKENIZER_DIR, ChunkEncoder, count_tokens, encode_corpus

if not os.path.exists(f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"):
    pytest.skip("no vocabulary files", allow_module_level=True)
ENC = ChunkEncoder(chunk=16, entries=50)


def by_chunks(texts):
    counts, ids = ENC.batch([None if t is None else t.encode() for t in texts])
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=300), st.text(alphabet="ab' sé\n\t  .1🐝", max_size=300)), min_size=1, max_size=6))
def test_exact(texts):
    assert by_chunks(texts) == [ENC.encoding.encode_ordinary(t) if t else [] for t in texts]


def test_shared_chunks_are_encoded_once():
    e = ChunkEncoder()
    base = " ".join(f"word{i} and more" for i in range(2000))
    e.batch([base.encode()])
    first = e.misses
    e.batch([("Another start. " + base).encode()])
    assert e.misses - first < 0.05 * first


def test_rows(spark):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (3, "", "z"), (4, "a" * 70_000, "t"), (5, "Hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(df, ["doc_id"], "text").collect()}
    assert got == {i: ENC.encoding.encode_ordinary(t) if t else [] for i, t, _ in rows}
    assert {r["doc_id"]: r["tokens"] for r in count_tokens(df, ["doc_id"], "text").collect()} == {k: len(v) for k, v in got.items()}
    assert encode_corpus(df.limit(0), ["doc_id"], "text").count() == 0
    assert ENC.encoding.decode(got[4]) == rows[3][1]
