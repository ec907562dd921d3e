"""Whitening of embeddings by their leading principal components.

Two passes over the vectors give the exact sums of all dimensions and the centred
covariance: every partition adds up its own, and the partial matrices are added row
by row, each row of the matrix in a task of its own. The matrix, whose size depends on the length
of a vector only, is taken apart on the driver: Householder reflections make it
tridiagonal, bisection on Sturm counts finds the leading eigenvalues, inverse
iteration their vectors, which are reorthogonalised within clusters of close
eigenvalues. The components are broadcast, and every row is projected where it lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultledger.llm.shared import quoted, schema_with, without

#: The driver holds a few matrices of this many rows and columns (128 MB each).
LONGEST_VECTOR = 4096
#: Largest entry of a vector: differences of two fit into a long.
LARGEST_ENTRY = 2**61
#: Eigenvalues of at most this share of the first are rounding, not variance.
TOLERANCE = 1e-11
#: Eigenvalues closer than this share of the matrix's norm are one cluster.
CLUSTER = 1e-3


@dataclass(frozen=True)
class Model:
    """``n`` vectors with the exact ``sums``; unit ``components`` in columns, by falling variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.trace

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whole, rest) with n * x - S = n * whole - rest, so that nothing is rounded."""
        floors, rests = self._split()
        return x - floors, rests

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rests = self.deviations(x)
        return whole - rests / self.n

    def _split(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = [divmod(total, self.n) for total in self.sums]
        return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)

    def squares(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2, exact; None where a long can't hold it."""
        whole, rests = self.deviations(x)
        largest = int(np.abs(whole).max(initial=0)) + 1
        if (self.n * largest) ** 2 * x.shape[1] < 2**63:
            return ((self.n * whole - rests) ** 2).sum(axis=1).tolist()
        rest = rests.tolist()
        exact = [sum((self.n * a - b) ** 2 for a, b in zip(row, rest, strict=True)) for row in whole.tolist()]
        return [total if total < 2**63 else None for total in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows that take part: whole-number vectors without nulls, all of the commonest length.

    Left out are null and empty vectors, those with a null entry or one beyond
    2**61, and vectors of another length than most (of equally frequent lengths the
    larger counts). Null ids and repeated rows stay.
    """
    within = F.forall(quoted(vector), lambda x: F.coalesce((x <= LARGEST_ENTRY) & (x >= -LARGEST_ENTRY), F.lit(False)))
    rows = vectors.where((F.size(quoted(vector)) > 0) & within)
    lengths = rows.groupBy(F.size(quoted(vector)).alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    first = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    if first and first["n"] > LONGEST_VECTOR:
        raise ValueError(f"vectors of more than {LONGEST_VECTOR} entries")
    return rows.where(F.size(quoted(vector)) == (first["n"] if first else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sums(rows: DataFrame, vector: str) -> tuple[int, tuple[int, ...]]:
    """How many vectors there are, and the exact sum of every dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                # a thousand entries below 2**53 can't overflow; others are added as Python's numbers
                whole = x if np.abs(x).max() < 2**53 else x.astype(object)
                parts = [whole[at : at + 1000].sum(axis=0).tolist() for at in range(0, len(x), 1000)]
                total = [sum(column) for column in zip(*parts, *([total] if total else []), strict=True)]
                n += len(x)
        if total:
            yield pa.record_batch(
                [pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([str(t) for t in total])], names=["i", "n", "total"]
            )

    parts = rows.select(quoted(vector)).mapInArrow(add, "i int, n bigint, total string")
    whole = F.sum(F.col("total").cast("decimal(38,0)")).cast("string")
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), whole.alias("total")).orderBy("i").collect()
    return (found[0]["n"] if found else 0), tuple(int(row["total"]) for row in found)


def covariance(rows: DataFrame, vector: str, n: int, width: int, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Covariance (divisor n) of what ``centred`` makes of the vectors; centred before multiplying."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = centred(_matrix(batch.column(0)))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield _rows_of(range(width), total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), _matrix(batch.column(1)) if batch.num_rows else [], strict=True):
                totals[i] = totals[i] + row if i in totals else row
        if totals:
            yield _rows_of(list(totals), np.array(list(totals.values())))

    schema = "i int, row array<double>"
    parts = rows.select(quoted(vector)).mapInArrow(part, schema)
    out = np.zeros((width, width))
    for row in parts.repartition("i").mapInArrow(add, schema).collect():
        out[row["i"]] = row["row"]
    return (out + out.T) / (2 * n)


def _rows_of(numbers, matrix: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(numbers, pa.int32()), _lists(matrix)], names=["i", "row"])


def _lists(matrix: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(matrix, np.float64).ravel()))


# -- leading eigenpairs of a symmetric matrix -----------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit vectors of the Householder reflections."""
    a, size, reflections = matrix.astype(np.float64).copy(), len(matrix), []
    for k in range(size - 2):
        v = a[k + 1 :, k].copy()
        length = float(np.linalg.norm(v))
        v[0] += np.copysign(length, v[0])
        norm = float(np.linalg.norm(v))
        if norm:
            below = -np.copysign(length, a[k + 1, k])
            v /= norm
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            w = p - (v @ p) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1, k] = below
        reflections.append(v)
    return a.diagonal().copy(), a.diagonal(-1).copy(), reflections


def sturm_count(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues are below each ``x``: the negative pivots of T - x."""
    squares = off**2
    least = np.finfo(float).tiny * max(1.0, squares.max(initial=0.0))
    q = diagonal[0] - x
    count = (q < 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        q = np.where(np.abs(q) < least, -least, q)
        q = diagonal[i] - x - squares[i - 1] / q
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest, falling, each bisected to neighbouring doubles."""
    size = len(diagonal)
    around = np.abs(np.concatenate([off, [0]])) + np.abs(np.concatenate([[0], off]))
    low = np.full(k, (diagonal - around).min())
    high = np.full(k, (diagonal + around).max())
    below = size - 1 - np.arange(k)
    for _ in range(200):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        up = sturm_count(diagonal, off, middle) <= below
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return low


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) x = right by elimination with row exchanges; zero pivots become ``least``."""
    size = len(diagonal)
    main, upper, second = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * size
    lower, x = off.tolist(), right.tolist()
    for i in range(size - 1):
        if abs(main[i]) >= abs(lower[i]):
            factor = lower[i] / (main[i] or least)
            main[i] = main[i] or least
            main[i + 1] -= factor * upper[i]
            x[i + 1] -= factor * x[i]
        else:
            factor = main[i] / lower[i]
            main[i], upper[i], second[i], main[i + 1], upper[i + 1] = (
                lower[i],
                main[i + 1],
                upper[i + 1],
                upper[i] - factor * main[i + 1],
                -factor * upper[i + 1],
            )
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
    for i in reversed(range(size)):
        ahead = (upper[i] * x[i + 1] if i + 1 < size else 0.0) + (second[i] * x[i + 2] if i + 2 < size else 0.0)
        pivot = main[i] if abs(main[i]) > least else least
        x[i] = (x[i] - ahead) / pivot
    return np.array(x)


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors in columns, by inverse iteration; those of a cluster are made orthogonal in every step."""
    size, norm = len(diagonal), max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    eps = np.finfo(float).eps
    draw = np.random.default_rng(11)
    found: list[np.ndarray] = []
    first, shift = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        # equal eigenvalues are taken apart a little, so that their systems differ
        shift = min(value, shift - 10 * eps * norm) if j > first else value
        z = draw.normal(size=size)
        for _ in range(5):
            for other in (*found[first:], *found[first:]):
                z -= (other @ z) * other
            z /= np.linalg.norm(z)
            z = _solve(diagonal, off, shift, z, eps * norm)
            z /= np.linalg.norm(z)
        for other in (*found[first:], *found[first:]):
            z -= (other @ z) * other
        found.append(z / np.linalg.norm(z))
    return np.array(found).T


def leading_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors in columns) of the at most ``k`` largest eigenvalues above ``TOLERANCE`` of the first."""
    largest = np.abs(matrix).max(initial=0.0)
    if not largest:
        return np.zeros(0), np.zeros((len(matrix), 0))
    scaled = matrix / largest
    diagonal, off, reflections = tridiagonal(scaled)
    values = leading_eigenvalues(diagonal, off, min(k, len(matrix)))
    values = values[values > max(values[0], 0) * TOLERANCE]
    vectors = eigenvectors(diagonal, off, values)
    for k_, v in reversed(list(enumerate(reflections))):
        vectors[k_ + 1 :] -= 2 * np.outer(v, v @ vectors[k_ + 1 :])
    values = np.einsum("ij,ij->j", vectors, scaled @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order] * largest, vectors[:, order]


# -- the operator ---------------------------------------------------------------------------


def fit(rows: DataFrame, vector: str, components: int) -> Model | None:
    """The model of all ``rows``, as ``usable`` gives them; None if there is none."""
    n, totals = sums(rows, vector)
    if not n:
        return None
    plain = Model(n, totals, np.zeros((len(totals), 0)), np.zeros(0), 0.0)
    matrix = covariance(rows, vector, n, len(totals), plain.centred)
    values, vectors = leading_eigenpairs(matrix, components)
    return Model(n, totals, vectors, values, float(matrix.trace()))


def identity_error(rows: DataFrame, vector: str, model: Model) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, by a pass over them."""
    width = len(model.variances)
    if not width:
        return 0.0
    return float(np.abs(covariance(rows, vector, model.n, width, model.whitened) - np.eye(width)).max())


def whiten(rows: DataFrame, vector: str, model: Model, whitened: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """``rows`` with ``whitened`` (array, one entry per component) and ``deviation``.

    ``deviation`` is the exact sum over dimensions of (n * x - S) ** 2, null beyond a
    long. The model decides how many components there are: at most as many as asked
    for and as there are dimensions, and none whose variance is 1e-11 of the first
    or less; vectors that are all equal have none. Repeated rows and null ids stay,
    each row by itself; a column of one of the two names is replaced.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = without(rows, whitened, deviation)
    at = kept.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(at))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, _lists(own.whitened(x)), pa.array(own.squares(x), pa.int64())],
                    names=[*batch.schema.names, whitened, deviation],
                )

    return kept.mapInArrow(run, schema_with(kept, (whitened, T.ArrayType(T.DoubleType())), (deviation, T.LongType())))
