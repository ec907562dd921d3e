"""Substring deduplication against SQL and brute force."""

import random

import numpy as np
import pytest
from oracle import assert_same

from faultledger.llm import queries
from faultledger.llm import substring_dedup as sd


def plain(rows, length):
    """n_words, n_removed, kept of each (key, text)."""
    split = [(key, (text or "").encode().split()) for key, text in rows]
    owner = {}
    for key, words in split:
        for i in range(len(words) - length + 1):
            said = tuple(words[i : i + length])
            rank = sd.LAST if key is None else key
            owner[said] = min(rank, owner.get(said, rank))
    out = []
    for key, words in split:
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            if owner[tuple(words[i : i + length])] < (sd.LAST if key is None else key):
                gone[i : i + length] = [True] * length
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((key, len(words), sum(gone), b" ".join(kept).decode()))
    return sorted(out, key=repr)


def result(spark, rows, length):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, doc string, kept int")
    out = sd.drop_repeats(docs, length=length)
    assert out.columns == ["doc_id", "text", "doc", "n_words", "n_removed", "kept"]
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()), key=repr)


def test_query_against_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = assert_same(queries.op7_substring_dedup(spark, sf_dir), queries.ORACLES["op7_substring_dedup"], sf_dir)
    assert sum(r[2] > 0 for r in rows) > 10


@pytest.mark.parametrize("slab", [60, 1_000_000])
def test_against_brute_force(spark, monkeypatch, slab):
    monkeypatch.setattr(sd, "SLAB", slab)
    draw = random.Random(11)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for key in range(120):
        words = [draw.choice(base[:6]) if draw.random() < 0.2 else draw.choice(base) for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 3)):
            at = draw.randrange(300)
            words = words + base[at : at + draw.randint(5, 50)]
        rows.append((draw.randrange(200), draw.choice([" ", "\n", "  "]).join(words)))
    rows += [(7, "a " * 80), (8, "a " * 80), (9, "a " * 40), (rows[0][0], rows[0][1]), (None, rows[3][1]), (None, rows[3][1]), (5, None), (6, "")]
    assert result(spark, rows, 12) == plain(rows, 12)


def test_one_changed_word_keeps_what_is_around_it(spark):
    words = [f"u{i}" for i in range(300)]
    other = words[:150] + ["new"] + words[151:]
    assert result(spark, [(1, " ".join(words)), (2, " ".join(other))], 50)[1] == (2, 300, 299, "new")


def test_equal_windows_have_equal_anchors():
    words = [f"v{i % 37}" for i in range(200)]
    slab = sd.Slab([" ".join(words).encode(), ("x y z " + " ".join(words)).encode()], sd.Powers())
    text, anchor, *_ = slab.spans(50)
    assert set(anchor[text == 0]) <= set(anchor[text == 1])
    least = sd._sliding_least(np.array([5, 3, 4, 9, 1, 7]), 3)
    assert least.tolist() == [3, 3, 1, 1]


def test_a_text_that_repeats_itself_is_one_span():
    slab = sd.Slab([b"lorem ipsum " * 5000], sd.Powers())
    text, anchor, span, first, windows = slab.spans(50)
    assert len(text) == 1 and windows.tolist() == [10_000 - 49]


def test_empty_table_and_very_long_text(spark):
    docs = spark.createDataFrame([(1, "lorem ipsum " * 60_000), (2, "lorem ipsum " * 30)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in sd.drop_repeats(docs).collect()}
    assert got[1][:2] == (120_000, 0) and got[2] == (60, 60, "")
    assert sd.drop_repeats(docs.limit(0)).count() == 0


def _alternating(n, a, b):
    """The sequence in which each half is the other one with a and b exchanged: polynomial hashes modulo 2**64 can't tell it from its reverse."""
    return [a if bin(i).count("1") % 2 == 0 else b for i in range(n)]


def test_words_and_texts_that_cancel_in_polynomial_hashes(spark):
    one, other = "".join(_alternating(2048, "a", "b")), "".join(_alternating(2048, "b", "a"))
    same = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join([*same, one])), (2, " ".join([*same, other]))]
    assert [r[2] for r in result(spark, rows, 50)] == [0, 0]
    rows += [(3, " ".join(_alternating(2048, "x", "y"))), (4, " ".join(_alternating(2048, "y", "x")))]
    assert result(spark, rows, 50) == plain(rows, 50)
    texts = [" ".join([f"s{i}" for i in range(30)] + _alternating(2048, p, q) + [f"e{i}" for i in range(30)]) for p, q in ("uv", "vu")]
    rows = [(i, t) for i, t in enumerate(texts)]
    assert result(spark, rows, 1500) == plain(rows, 1500)
