"""Personal data: patterns against plain regular expressions, the field against brute force."""

import hashlib
import random
import re
from itertools import product

import numpy as np
import pytest

from faultledger.llm import pii, queries

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_luhn(digits):
    total = 0
    for place, d in enumerate(reversed(digits)):
        v = int(d) * (2 if place % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
    out += [("ip", *m.span()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(CARD, text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and plain_luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(PHONE, text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_patterns_on_random_strings():
    draw = random.Random(5)
    pieces = ["a", "b@", "c.d", ".", "@", "_x", "-", "+1", "é", " ", "12", "4539578763621486", "255", "256", "0001", "(", ")", "\n", "x@y.z", "10.2.3.4"]
    for _ in range(20000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" * 100_000, "a@" * 100_000):
        pii.base_spans(text)


def test_labelled_table_is_learned():
    field = pii.train()
    assert field.plain_is_outside
    for line in filter(str.strip, pii.LABELLED.splitlines()):
        text, labels = pii.parse(line)
        assert len(labels) == len(text.split())
        data = np.frombuffer(text.encode(), np.uint8)
        found = [(k, text.encode()[a:b].decode()) for k, a, b in pii.label_islands(field, data, np.array([len(data)]))]
        assert found == re.findall(r"\[(\w+) ([^\]]+)\]", line)


def test_viterbi_against_all_paths():
    draw = np.random.default_rng(1)
    field = pii.Field(np.zeros((pii.PLAIN + 1, 3)), draw.normal(size=(3, 3)))
    scores = draw.normal(size=(6, 5, 3))
    for chain, got in zip(scores, field.viterbi(scores), strict=True):
        value = lambda path: sum(chain[t, y] for t, y in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:], strict=False))
        assert tuple(got) == max(product(range(3), repeat=5), key=value)


def test_islands_equal_the_whole_chain(monkeypatch):
    field = pii.train()
    draw = random.Random(9)
    pieces = ["word", "4111", "1111", "(415)", "555-2671", "10.2.3.4", "+1", "x@y.example", "ab(at)c.d", "1998", "4539578763621486", "card"]
    texts = [" ".join(draw.choice(pieces) for _ in range(draw.randint(0, 12))).encode() for _ in range(800)]
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    breaks = np.cumsum([len(t) + 1 for t in texts])
    apart = pii.label_islands(field, data, breaks)
    monkeypatch.setattr(pii.Field, "plain_is_outside", False)
    assert pii.label_islands(field, data, breaks) == apart and len(apart) > 500


def test_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op8_pii(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for row in got:
        base = plain_spans(docs[row.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        assert set(listed.split(",")) - {""} <= set(row.spans.split(","))


@pytest.mark.parametrize("slab", [10, 1_000_000])
def test_edge_rows(spark, monkeypatch, slab):
    monkeypatch.setattr(pii, "SLAB", slab)
    rows = [(1, None, 1), (2, "", 1), (3, "é mail jo@a.example.org, call (415) 555-2671!", 2), (3, "é mail jo@a.example.org, call (415) 555-2671!", 2), (None, "word " * 40000 + "10.0.0.7", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, PII long")
    found = pii.find_pii(docs)
    out = found.collect()
    assert [len(r.pii) for r in out] == [0, 0, 2, 2, 1]
    assert [(s.kind, s.base) for s in out[2].pii] == [("email", True), ("phone", False)]
    assert out[4].pii[0].start == 200_000
    clean = [r.text for r in pii.redact(found).collect()]
    assert clean[:3] == [None, "", "é mail <email>, call <phone>!"] and clean[4].endswith("word <ip>")
    assert pii.find_pii(docs.limit(0)).count() == 0
