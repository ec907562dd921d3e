"""Byte-level BPE against the public library, and round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from faultledger.llm import byte_bpe, queries

NAME = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path(NAME))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_strings(ranks, library):
    encode = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)
    draw = random.Random(7)
    letters = "ab '\t\n\x1c\x85\xa0sté1漢字́😀ll've$%"
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))
        assert memoryview(encode(text)).cast("i").tolist() == library.encode_ordinary(text)


def test_long_pre_token(ranks, library):
    text = "abcaab" * 5000
    assert byte_bpe.merge(text.encode(), ranks, byte_bpe.words_of(ranks)) == library.encode_ordinary(text)


def test_lower_rank_appears_later():
    # "abc" ranks below "ab": the rank that a merge opens comes before the rest of the bucket.
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"ab": 4, b"abcab": 5}
    assert byte_bpe.merge(b"abcabc", ranks, 1) == [3, 3]


def test_ranks_with_gaps():
    ranks = {b"a": 0, b"b": 70_000, b"ab": 900_000}
    assert byte_bpe.merge(b"abab", ranks, byte_bpe.words_of(ranks)) == [900_000, 900_000]


def test_memories_are_bounded(ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 2)
    encode = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)
    text = "the other words, and more of the other words" * 3
    assert memoryview(encode(text)).cast("i").tolist() == library.encode_ordinary(text)
    assert len(encode.young) <= 2 and len(encode.old) <= 2


def test_edge_rows(spark, ranks):
    rows = [(1, None, "x", "k"), (2, "", "x", "k"), (3, "Hi there", "y", "k"), (3, "Hi there", "y", "k"), (None, "é" * 5000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, TOKEN_IDS string, decoded string")
    out = byte_bpe.bpe_decode(byte_bpe.bpe_encode(docs, ranks, public_tokenizers.PATTERN), ranks).collect()
    assert len(out) == 5
    for row in out:
        assert bytes(row.decoded).decode() == (row.text or "")
    assert byte_bpe.bpe_encode(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_query(spark, sf_dir, library):
    got = {row.doc_id: row for row in queries.op9_byte_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = library.encode_ordinary(text)
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
