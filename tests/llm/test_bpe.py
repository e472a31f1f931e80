import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from reckoner.llm import bpe as B


@pytest.fixture(scope="module")
def plain():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ours():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return B.Encoder(B.Vocabulary(f.read()), P.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("abcetion ü\n'", max_size=80), max_size=8))
def test_ids_equal_tiktoken(plain, ours, texts):
    import numpy as np

    got = list(ours.encode(texts))
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text)
        assert ours.decode(ids) == text.encode()


def test_whole_table_and_cases(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "doc_id")
    more = [(None, -1), ("", -2), ("<|endoftext|>", -3), ("a" * 200_000, -4), ("x y " * 700_000, -5), ("same", -6), ("same", -6)]
    docs = docs.union(spark.createDataFrame(more, "text string, doc_id long")).cache()
    want = []
    for text, doc_id in docs.collect():
        ids = plain.encode_ordinary(text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, B.digests(docs).collect())) == sorted(want)


def test_encode_then_decode(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(1, "Ünï one two", 7), (2, None, 8)], "doc_id long, text string, ids_sha256 int")
    got = {r.doc_id: bytes(r.decoded) for r in B.decode(B.encode(docs, path, P.PATTERN), path).collect()}
    assert got == {1: "Ünï one two".encode(), 2: b""}
    assert B.digests(docs.limit(0)).collect() == []
