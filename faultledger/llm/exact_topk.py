"""Exact top-k by inner product over integer vectors, with a pivot table.

Rows become points of a metric space in which the nearest has the largest inner
product: with M the largest squared length, a row x gets the extra coordinate
sqrt(M - x.x) and a query q gets 0, so |q - x|^2 = q.q + M - 2 q.x. A table holds every
row's distances to some pivots. By the triangle inequality the largest difference of
two points' pivot distances is a lower bound of their distance, hence gives an upper
bound of the score. Rows are evaluated in the order of that bound, until the next
bound is below the k-th score found; cells (the rows nearest to one pivot) are ruled
out in the same way by the ranges of their pivot distances.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultledger.llm import vector_blocks as blocks
from faultledger.llm.shared import checkpoint

#: Rows of which the pivots are chosen, how many, and how many of the first make cells.
SAMPLE = 2000
PIVOTS = 128
CELL_PIVOTS = 16
#: Doubles hold every whole number below this.
WHOLE = 2.0**53
#: Slack of the bounds for rounding, relative to the lengths.
SLACK = 1e-9


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as doubles that hold whole numbers, of any size."""
    return F.transform(vector, lambda x: F.when(F.abs(x * scale) < WHOLE, F.floor(x * scale).cast("double")).otherwise(x * scale))


def choose_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """The longest point, then in turn that which is farthest from those chosen."""
    chosen = [int(np.argmax((points**2).sum(axis=1)))]
    far = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(points)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def dots(vectors: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products of whole numbers that doubles may not hold."""
    own = [int(b) for b in query.tolist()]
    return [sum(int(a) * b for a, b in zip(row, own, strict=True)) for row in vectors.tolist()]


class PivotTable:
    def __init__(self, sampled: np.ndarray, longest: float, k: int) -> None:
        self.k, self.longest = k, longest
        # no score, and no sum on the way to one, is larger than the largest squared length
        self.wide = not longest < WHOLE
        self.pivots = choose_pivots(self.lifted(sampled), PIVOTS)

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        return np.hstack([vectors, np.sqrt(np.maximum(self.longest - (vectors**2).sum(axis=1), 0))[:, None]])

    def distances(self, points: np.ndarray) -> np.ndarray:
        squares = (points**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1)[None] - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(squares, 0))

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table = self.distances(self.lifted(vectors))
        return table[:, :CELL_PIVOTS].argmin(axis=1), table

    def query_sides(self, queries: np.ndarray) -> np.ndarray:
        return self.distances(np.hstack([queries, np.zeros((len(queries), 1))]))

    def upper(self, lower: np.ndarray, length: np.ndarray | float) -> np.ndarray:
        """Upper bounds of scores, from lower bounds of distances and the query's q.q; infinite where doubles overflow."""
        slack = SLACK * (length + self.longest)
        limits = (length + self.longest - np.maximum(lower - np.sqrt(slack), 0) ** 2) / 2 + slack
        return np.where(np.isfinite(limits), limits, np.inf)

    def sees(self, queries, sides, bounds, low, high):
        gaps = np.maximum(np.maximum(sides[:, None] - high[None], low[None] - sides[:, None]), 0).max(axis=2)
        return self.upper(gaps, (queries**2).sum(axis=1)[:, None]) >= bounds[:, None]

    def search(self, vectors, sides, ids, query, side, query_id, bound):
        limits = self.upper(np.abs(sides - side).max(axis=1), float(query @ query))
        order = np.flatnonzero((limits >= bound) & (ids != query_id))
        order = order[np.argsort(-limits[order], kind="stable")]
        scores, exact, at, step = np.zeros(0), [], 0, 8 * self.k
        while at < len(order) and limits[order[at]] >= bound:
            near = vectors[order[at : at + step]]
            if self.wide:
                exact += dots(near, query)
                scores = blocks.doubles(exact)
            else:
                scores = np.concatenate([scores, near @ query])
            bound = max(bound, blocks.kth(scores, self.k))
            at, step = at + step, 2 * step
        seen = order[: len(scores)]
        if self.wide:
            found = sorted(zip((-score for score in exact), ids[seen].tolist(), strict=True))[: self.k]
            best = [-score for score, _ in found]
            # equal doubles may be of different scores, so the bound's own are kept
            kept = blocks.doubles(best) >= bound
            return np.array([one[1] for one in found], np.int64)[kept], [score for score, keep in zip(best, kept, strict=True) if keep]
        top = blocks.largest(scores, ids[seen], self.k)
        top = top[scores[top] >= bound]
        return ids[seen[top]], scores[top]


def exact_top_k(vectors: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of each query, ties to smaller ids.

    Queries are the rows whose id is divisible by ``every``; components become
    floor(scale * x). All rows but those with the query's id are candidates, and all
    are returned if there are fewer than ``k``. Null ids and vectors, vectors with
    null or non-finite components and vectors of another length than most take no
    part; a zero vector does, and one with a component whose product with ``scale`` is no
    finite double doesn't. Repeated rows count once. Other columns are ignored. An empty
    table gives an empty result. Scores are exact and compared exactly, whatever their
    size; ``exact`` has their digits, and ``score`` is null where no long holds them.
    """
    usable = blocks.usable(vectors, vec_id, vector, nonzero=False)
    whole = usable.select("id", integers(F.col("vec"), scale).alias("vec"))
    rows = checkpoint(whole.where(F.forall("vec", lambda x: F.abs(x) < float("inf"))))
    longest = rows.agg(F.max(blocks.square()).alias("m")).first()["m"]
    if longest is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long, exact string")
    sampled = blocks.sample(rows, SAMPLE)
    table = PivotTable(sampled, longest, k)
    found = blocks.top_k(rows, table, every, sampled.shape[1], len(table.pivots))
    exact = F.col("score.digits") if table.wide else F.col("score").cast("bigint").cast("string")
    return found.select("query_id", "rank", "vec_id", exact.try_cast("bigint").alias("score"), exact.alias("exact"))
