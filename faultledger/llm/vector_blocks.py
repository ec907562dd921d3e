"""Top-k searches of a query set against all rows, block by block.

A row has a cell of some index and a side: a few numbers from which bounds are made.
It is stored in one of its cell's blocks, by a hash of its id, so a cell of any size
(a third of all rows may be one vector) splits into blocks of about one size. A query
first searches the block that it stands in itself; the k-th score found there is what
others must reach. Then it visits the cells that the index doesn't rule out. Blocks of
queries meet blocks of rows in a join on the cell and the block's number, and every
such meeting is a piece of work of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultledger.llm.shared import checkpoint, quoted

#: Rows of a block, and queries of a block.
ROWS = 2048
QUERIES = 256
#: Cells that an index may have: their counts and boxes go to the driver and to all tasks.
CELLS = 1024


#: A score that a double may not hold: its digits, and a text that sorts like it.
WIDE = pa.struct([("order", pa.string()), ("digits", pa.string())])


def _wide(scores: list[int]) -> list[dict[str, str]]:
    """Scores as texts: after the sign the number of digits and the digits, which count down below zero."""
    out = []
    for score in scores:
        digits = str(abs(score))
        order = f"{len(digits):04d}{digits}"
        if score < 0:
            order = "".join(chr(ord("0") + 9 - int(d)) for d in order)
        out.append({"order": ("0" if score < 0 else "1") + order, "digits": str(score)})
    return out


class Index(Protocol):
    """What a search must know; scores are inner products, bounds are scores to reach."""

    k: int
    #: Whether scores are Python's whole numbers, beyond what doubles hold; absent is no.
    wide: bool

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and sides of rows."""

    def query_sides(self, queries: np.ndarray) -> np.ndarray: ...

    def sees(self, queries: np.ndarray, sides: np.ndarray, bounds: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which cells each query must visit, from the boxes of the cells' sides."""

    def search(self, vectors: np.ndarray, sides: np.ndarray, ids: np.ndarray, query: np.ndarray, side: np.ndarray, query_id: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the best rows of a block.

        An index may have ``search_block`` besides, which answers a block of queries
        at once, and ``rows``, the rows of its blocks.
        """


def usable(vectors: DataFrame, vec_id: str, vector: str, nonzero: bool) -> DataFrame:
    """id, vec (array of double) of the rows that take part.

    Left out are null ids, null and empty vectors, those with null or non-finite
    components, with ``nonzero`` zero vectors, and vectors of another length than
    most have (of lengths equally frequent the larger counts).
    """
    rows = vectors.select(quoted(vec_id).cast("bigint").alias("id"), F.transform(quoted(vector), lambda x: x.cast("double")).alias("vec"))
    finite = F.forall("vec", lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False)))
    rows = rows.where(F.col("id").isNotNull() & (F.size("vec") > 0) & finite)
    if nonzero:
        rows = rows.where(F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    first = sizes.orderBy(F.desc("rows"), F.desc("n")).first()
    return rows.where(F.size("vec") == F.lit(first["n"] if first else 0))


def square(vector: str = "vec") -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x)


def sample(rows: DataFrame, n: int) -> np.ndarray:
    """The vectors of at most ``n`` rows, the first by a hash: a bounded choice that every run makes alike."""
    taken = rows.select("vec", F.xxhash64("id", "vec").alias("turn"), "id").orderBy("turn", "id").limit(n).collect()
    return np.array([row["vec"] for row in taken], np.float64)


def _blocked(rows: DataFrame, size: int, columns: tuple[str, ...]) -> DataFrame:
    """cell, blocks, block, ids and the flattened ``columns`` of blocks of about ``size`` distinct rows."""
    counts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    numbered = rows.join(F.broadcast(counts), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    grouped = numbered.groupBy("cell", "blocks", "block").agg(F.collect_set(F.struct("id", *columns)).alias("rows"))
    return grouped.select("cell", "blocks", "block", F.col("rows.id").alias("ids"), *(F.flatten(F.col(f"rows.{c}")).alias(c) for c in columns))


def _matrix(column: pa.Array, row: int, width: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False).reshape(-1, width)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(matrix).ravel()))


def top_k(rows: DataFrame, index: Index, every: int, dim: int, side: int) -> DataFrame:
    """query_id, rank, vec_id, score for the rows (id, vec) whose id is divisible by ``every``.

    ``score`` is a double, or ``WIDE`` if the index has wide scores.
    """
    wide = getattr(index, "wide", False)
    score_type = "struct<order:string,digits:string>" if wide else "double"
    listed = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", WIDE if wide else pa.float64())]))

    def told(scores) -> list:
        return _wide(scores) if wide else list(scores)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, sides = index.cells(_vectors(batch.column(1), dim))
            yield pa.record_batch([*batch.columns, _lists(sides), pa.array(cells.astype(np.int32))], names=["id", "vec", "side", "cell"])

    placed = rows.mapInArrow(place, "id bigint, vec array<double>, side array<double>, cell int")
    stored = checkpoint(_blocked(placed, getattr(index, "rows", ROWS), ("vec", "side")))

    def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [_matrix(batch.column(1), row, side) for row in range(batch.num_rows)]
            if sides:
                ends = [_lists(np.array([f(s, axis=0) for s in sides])) for f in (np.min, np.max)]
                yield pa.record_batch([batch.column(0), *ends], names=["cell", "low", "high"])

    boxes = stored.select("cell", "side").mapInArrow(box, "cell int, low array<double>, high array<double>")
    lows, highs = ([f(F.col(name)[i]).alias(f"{name}{i}") for i in range(side)] for f, name in ((F.min, "low"), (F.max, "high")))
    known = boxes.groupBy("cell").agg(F.array(*lows).alias("low"), F.array(*highs).alias("high")).collect()
    numbers = np.array([row["cell"] for row in known], np.int32)
    low, high = (np.array([row[name] for row in known], np.float64).reshape(-1, side) for name in ("low", "high"))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column(0)[row].values.to_numpy()
                vec, sides = _matrix(batch.column(1), row, dim), _matrix(batch.column(2), row, side)
                asked = np.flatnonzero(ids % every == 0)
                own = index.query_sides(vec[asked])
                found = _search(index, vec, sides, ids, vec[asked], own, ids[asked], np.full(len(asked), -np.inf))
                bounds = np.array([kth(doubles(one[1]), index.k) for one in found], np.float64)
                sees = index.sees(vec[asked], own, bounds, low, high)
                yield pa.record_batch(
                    [
                        *(pa.array(ids[asked]), _lists(vec[asked]), _lists(own), _lists(bounds[:, None])),
                        pa.array([numbers[one].tolist() for one in sees], pa.list_(pa.int32())),
                        pa.array([[{"vec_id": i, "score": x} for i, x in zip(one[0], told(one[1]), strict=True)] for one in found], listed),
                    ],
                    names=["id", "vec", "side", "bound", "cells", "found"],
                )

    schema = f"id bigint, vec array<double>, side array<double>, bound array<double>, cells array<int>, found array<struct<vec_id:bigint,score:{score_type}>>"
    started = checkpoint(stored.select("ids", "vec", "side").mapInArrow(start, schema))
    asked = started.select(F.explode("cells").alias("cell"), "id", "vec", "side", "bound")
    packed = _blocked(asked, QUERIES, ("vec", "side", "bound"))
    queries = packed.select("cell", *(F.col(c).alias(f"q_{c}") for c in ("ids", "vec", "side", "bound")))
    spread = queries.join(F.broadcast(stored.select("cell", "blocks").distinct()), "cell")
    spread = spread.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    met = spread.join(stored.drop("blocks"), ["cell", "block"]).select("q_ids", "q_vec", "q_side", "q_bound", "ids", "vec", "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, ids = (batch.column(c)[row].values.to_numpy() for c in (0, 4))
                vec, sides = _matrix(batch.column(5), row, dim), _matrix(batch.column(6), row, side)
                q_vec, q_side, bounds = _matrix(batch.column(1), row, dim), _matrix(batch.column(2), row, side), _matrix(batch.column(3), row, 1)[:, 0]
                new = np.array([not _holds(ids, vec, q, i) for q, i in zip(q_vec, q_ids, strict=True)], bool)
                q_ids = q_ids[new]
                found = _search(index, vec, sides, ids, q_vec[new], q_side[new], q_ids, bounds[new])
                if not found:
                    continue
                who = np.repeat(q_ids, [len(one[0]) for one in found])
                scores = [score for one in found for score in told(one[1])]
                columns = [pa.array(who), pa.array(np.concatenate([one[0] for one in found])), pa.array(scores, WIDE if wide else pa.float64())]
                yield pa.record_batch(columns, names=["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    own = started.select(F.col("id").alias("query_id"), F.inline("found"))
    found = met.mapInArrow(search, f"query_id bigint, vec_id bigint, score {score_type}").unionByName(own)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= index.k).select("query_id", "rank", "vec_id", "score")


def _search(index: Index, vectors, sides, ids, queries, query_sides, query_ids, bounds) -> list[tuple[np.ndarray, np.ndarray]]:
    """ids and scores for every query of a block."""
    if hasattr(index, "search_block"):
        return index.search_block(vectors, sides, ids, queries, query_sides, query_ids, bounds)
    asked = zip(queries, query_sides, query_ids.tolist(), bounds, strict=True)
    return [index.search(vectors, sides, ids, *one) for one in asked]


def doubles(scores) -> np.ndarray:
    """Scores as the doubles next to them; beyond all doubles an infinity."""
    if isinstance(scores, np.ndarray):
        return scores
    largest = int(np.finfo(np.float64).max)
    return np.array([float(s) if abs(s) <= largest else float("inf") * (1 if s > 0 else -1) for s in scores], np.float64)


def _holds(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, query_id: int) -> bool:
    """Whether this is the block that the query stands in, which it has searched already."""
    return bool((vectors[ids == query_id] == query).all(axis=1).any())


def kth(scores: np.ndarray, k: int) -> float:
    """The k-th largest score, or none to reach if there are fewer."""
    return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf


def largest(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to smaller ids."""
    place = np.flatnonzero(scores >= kth(scores, k))
    return place[np.lexsort((ids[place], -scores[place]))][:k]
