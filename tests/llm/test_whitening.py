"""Whitening against the whole decomposition of the covariance by numpy."""

import math

import numpy as np
import pytest

from faultledger.llm import queries, whitening


def plain(x, k):
    n, totals = len(x), [sum(column) for column in zip(*x.tolist(), strict=True)]
    y = np.array([[(n * a - s) / n for a, s in zip(row, totals, strict=True)] for row in x.tolist()])
    matrix = y.T @ y / n
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    squares = [sum((n * a - s) ** 2 for a, s in zip(row, totals, strict=True)) for row in x.tolist()]
    return y @ vectors / np.sqrt(values), values / matrix.trace(), squares


def test_query_against_numpy(spark, sf_dir):
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())
    x = np.floor(64 * np.array([v for _, v in rows], np.float64)).astype(np.int64) + 1_000_000
    want, explained, squares = plain(x, 32)
    got = sorted(queries.op11_whitening(spark, sf_dir).collect(), key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in got] == [(i, c + 1) for i, _ in rows for c in range(32)]
    assert {r.n for r in got} == {len(rows)}
    assert [r.deviation for r in got] == [s for s in squares for _ in range(32)]
    whitened = np.array([r.whitened for r in got]).reshape(-1, 32)
    signs = np.sign((whitened * want).sum(axis=0))
    assert np.abs(whitened - want * signs).max() < 1e-7
    assert [r.explained for r in got[:32]] == pytest.approx(explained.tolist(), rel=1e-9)
    assert np.abs(whitened.T @ whitened / len(rows) - np.eye(32)).max() < 1e-9
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


@pytest.mark.parametrize("kind", ["plain", "clusters", "equal", "blocks", "graded", "one", "two"])
def test_eigenpairs(kind):
    draw = np.random.default_rng(4)
    size = {"one": 1, "two": 2}.get(kind, 40)
    turned = np.linalg.qr(draw.normal(size=(size, size)))[0]
    values = {
        "clusters": np.repeat([5, 5 - 1e-9, 1, 0.5], 10) + draw.random(40) * 1e-12,
        "equal": np.repeat([7.0, 3.0, 1.0, 0.0], 10),
        "graded": 10.0 ** -np.arange(40),
    }.get(kind, draw.random(size) + 0.1)
    matrix = np.diag(values) if kind == "blocks" else turned @ np.diag(values) @ turned.T
    matrix = (matrix + matrix.T) / 2 * 1e30
    got, vectors = whitening.leading_eigenpairs(matrix, 32)
    want = np.linalg.eigvalsh(matrix)[::-1]
    want = want[: min(32, size)]
    want = want[want > want[0] * whitening.TOLERANCE]
    assert len(got) == len(want) and np.allclose(got, want, rtol=1e-9, atol=want[0] * 1e-14)
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * got).max() < 1e-12 * want[0]


def test_sturm_counts():
    draw = np.random.default_rng(2)
    diagonal, off = draw.normal(size=30), draw.normal(size=29)
    off[10] = 0
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    x = np.linspace(-5, 5, 101)
    assert whitening.sturm_count(diagonal, off, x).tolist() == [(values < at).sum() for at in x]


def run(spark, tmp_path, rows):
    schema = "embedding array<double>, vec_id long, component string, X int"
    spark.createDataFrame([(v, i, "clash", 1) for i, v in rows], schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted((tuple(r) for r in queries.op11_whitening(spark, str(tmp_path)).collect()), key=repr)


def test_edge_rows(spark, tmp_path):
    draw = np.random.default_rng(6)
    good = [(i, draw.normal(size=3).tolist()) for i in range(20)]
    good += [good[0], (None, good[1][1]), (50, [1e3, -1e3, 0.0])]
    bad = [(30, None), (31, []), (32, [1.0, None, 2.0]), (33, [math.nan, 1.0, 1.0]), (34, [1.0, math.inf, 1.0]), (35, [1.0, 2.0]), (36, [1e300, 0.0, 0.0])]
    got = run(spark, tmp_path, good + bad)
    want, explained, squares = plain(np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good]), 32)
    assert len(got) == 3 * len(good)
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got) == sorted((str(i), c + 1, len(good), s) for (i, _), s in zip(good, squares, strict=True) for c in range(3))
    assert {round(r[5], 12) for r in got} == {round(e, 12) for e in explained.tolist()}
    assert sorted(round(abs(r[4]), 6) for r in got) == sorted(round(abs(v), 6) for v in want.ravel().tolist())


def test_empty_equal_and_huge(spark, tmp_path):
    assert run(spark, tmp_path / "none", [(1, None)]) == []
    assert run(spark, tmp_path / "equal", [(i, [0.5, 0.5]) for i in range(5)]) == []
    far = [(i, [2.0**50 * i, 1.0]) for i in range(4)]
    got = run(spark, tmp_path / "far", far)
    assert len(got) == 4 and {r[3] for r in got} == {None}
    assert sorted(abs(r[4]) for r in got) == pytest.approx([0.2**0.5, 0.2**0.5, 1.8**0.5, 1.8**0.5])
