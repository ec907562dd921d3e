"""Mixing: targets against plain water filling, SQL, edge rows, many sources."""

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from faultledger.llm import mixing, queries

DOC = "doc_id long, text string, source string, size string"


def plain_targets(sizes, weights=mixing.WEIGHTS, most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in out]
        left = total - sum(out.values())
        over = [s for s in free if left * weight[s] / sum(weight[f] for f in free) > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        out |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, None: 10}, {"a": 1, "b": 100, "c": 100, "d": 1000}, {"z": 0, "y": 5}, {"é": 7, "z": 1, "Z": 900, None: 2}, {"a": 3}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(plain_targets(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("few", [10_000, 0])
def test_query_against_sql(spark, sf_dir, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    rows = assert_same(queries.op4_mixing(spark, sf_dir), queries.ORACLES["op4_mixing"], sf_dir)
    totals = {}
    for _, size, source_size, taken, target in rows:
        assert taken in [size * k for k in range(4)]
        old = totals.get(source_size, (target, 0, 0))
        totals[source_size] = (target, old[1] + taken, max(old[2], size))
    for target, taken, largest in totals.values():
        assert abs(taken - target) <= largest / 2 + 1


def test_edge_rows(spark):
    rows = [(1, None, "a", "x"), (2, "", "a", "x"), (3, "one two", "a", None), (4, "three " * 50_000, None, "x"), (4, "three " * 50_000, None, "x"), (None, "w", "b", "y"), (7, " \t\n ", "empty", "")]
    docs = spark.createDataFrame(rows, DOC)
    got = mixing.mix(docs).collect()
    assert len(got) == 7
    by_source = {r.source_size: r for r in got}
    assert by_source[100_000].taken in (50_000, 100_000, 0) or by_source[100_000].taken % 50_000 == 0
    assert [r.size for r in got if r.doc_id == 7] == [0] and [r.target for r in got if r.doc_id == 7] == [0.0]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = {(r.doc_id, r.size): r.taken for r in got}
    words = {}
    for r in out.collect():
        n = len(r.text.split())
        words[r.doc_id, n] = words.get((r.doc_id, n), 0) + n
    assert {k: v for k, v in taken.items() if v} == {k: v // (2 if k[0] == 4 else 1) for k, v in words.items()}
    assert mixing.mix(docs.limit(0)).count() == mixing.mixed(docs.limit(0)).count() == 0


def test_equal_ids_and_equal_rows_are_parted(spark, tmp_path):
    """A source of one row repeated, and one of rows without an id; each comes near its target."""
    rows = [(None, "w x y", "a", None)] * 100 + [(None, f"w x {i}", "b", None) for i in range(100)] + [(7, "w x y", None, str(i)) for i in range(50)]
    docs = spark.createDataFrame(rows, DOC).repartition(7)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = assert_same(mixing.mix(docs), queries.ORACLES["op4_mixing"], str(tmp_path))
    assert len(got) == 250 and sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    want = plain_targets({"a": 300, "b": 300, None: 150})
    out = mixing.mixed(docs).groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("words")).collect()
    assert {r.source for r in out} == set(want)
    for r in out:
        assert abs(r.words - want[r.source]) <= 1.5
    of_a = {row[3] for row in got if row[4] == want["a"]}
    assert of_a == {3, 6}
