"""SimHash near-duplicates against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from faultledger.llm import queries, simhash


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, max_bits=3):
    """Root of each distinct fingerprint, by comparing all."""
    nodes = np.array(sorted(set(prints)), "<u8")
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(nodes)):
        for j in np.flatnonzero(np.bitwise_count(nodes ^ nodes[i]) <= max_bits).tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {int(n): root(i) for i, n in enumerate(nodes)}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("max_bits", range(8))
def test_every_close_pair_meets_in_a_key(max_bits):
    keys = simhash.index_positions(max_bits)
    for wrong in combinations(range(8), max_bits):
        assert any(not set(wrong) & set(key) for key in keys)


def test_native_hash_is_the_same(spark):
    row = spark.sql("select xxhash64('a b c') as h").first()
    assert row.h == signed(xxhash.xxh64_intdigest(b"a b c", 42))


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {d: plain_fingerprint(t) for d, t in docs}
    roots = plain_components(prints.values())
    least = {}
    for d, p in prints.items():
        least[roots[p]] = min(d, least.get(roots[p], d))
    got = queries.op10_simhash(spark, sf_dir).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{p:016x}", least[roots[p]]) for d, p in prints.items()}
    assert len(got) == len(docs)


@pytest.mark.parametrize("block", [4, 1024])
def test_links_connect_what_brute_force_connects(spark, block):
    draw = random.Random(3)
    hubs = [draw.getrandbits(64) for _ in range(4)]
    prints = set(hubs)
    for _ in range(400):
        x = draw.choice(sorted(prints)) if draw.random() < 0.7 else draw.choice(hubs)
        for _ in range(draw.randint(1, 5)):
            x ^= 1 << draw.randrange(64)
        prints.add(x)
    roots = plain_components(prints)
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    edges = simhash.links(frame, 3, block)
    labels = {r.node % (1 << 64): r.label for r in simhash.components(edges).collect()}
    by_label = {}
    for p in prints:
        by_label.setdefault(labels.get(p, signed(p)), set()).add(roots[p])
    assert all(len(found) == 1 for found in by_label.values())
    assert len(by_label) == len(set(roots.values()))
    # a forest of each posting, not all pairs of it
    assert edges.where((F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) > 3)).isEmpty()


@pytest.mark.parametrize("few", [200_000, 0])
def test_long_chain(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "EDGES_OF_A_TASK", few)
    chain = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.label for r in simhash.components(chain).collect()} == {0}


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_edge_rows(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW_LOSERS", few)
    long = "Lorem ipsum dolor " * 20000
    rows = [
        (5, None, "a"), (7, "", "a"), (3, " \t", "b"), (4, "one two", "c"), (4, "one two", "c"), (8, "ONE two", "d"),
        (None, "one  two", "e"), (None, "alone here now", "f"), (9, long, "g"), (10, long.upper(), "g"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, simhash string")
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(rows)
    of = {(r.doc_id, r.simhash): r.component_id for r in got}
    assert of[5, 0] == of[7, 0] == of[3, 0] == 3
    assert {of[k] for k in of if k[0] in (4, 8)} == {4} and {of[k] for k in of if k[0] in (9, 10)} == {9}
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 4, 9]
    assert simhash.simhash_components(docs.limit(0)).count() == simhash.simhash_dedup(docs.limit(0)).count() == 0
