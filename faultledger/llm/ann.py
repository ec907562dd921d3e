"""Approximate nearest neighbours: stable projections in a kd-tree, with a chi-square stopping test.

Points are projected on a few Gaussian directions. Such a projection is stable: the
squared projected distance of two points, divided by their squared distance, has a
chi-square distribution with as many degrees as there are directions. A kd-tree over
the projections gives the projected neighbours of a query, leaf by leaf in growing
distance; they are verified on the original vectors. The search stops when, by that
distribution, a point as near as the k-th found would have shown up in the projection
with probability ``sure``. Subtrees of some thousand rows are the blocks that queries
meet; the k-th score of a query's own block goes with it to the others, and within a
block every leaf is verified for the queries at once whose test does not hold yet.

Nearness is the inner product. With M the largest squared length, a row x gets the
coordinate sqrt(M - x.x) and a query q gets 0; the nearest point then has the largest
inner product, and its distance follows from the score.
"""

from __future__ import annotations

from math import exp

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultledger.llm import vector_blocks as blocks
from faultledger.llm.shared import checkpoint

#: Directions (even, for the closed form of the distribution).
DIRECTIONS = 16
#: Rows that the tree's cuts are made of; all rows are indexed.
SAMPLE = 20_000
#: Leaves of a block, and blocks' rows as a multiple of those of other indexes.
LEAVES, LARGER = 16, 4
SLACK = 1e-9


def chi_square(x: float, degrees: int) -> float:
    """The distribution function, for an even number of degrees."""
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - exp(-x / 2) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return high


class Tree:
    """Cuts of a kd-tree in heap order: node n has the children 2n and 2n + 1."""

    def __init__(self, points: np.ndarray, leaves: int) -> None:
        self.depth = max(leaves - 1, 0).bit_length()
        self.axis = np.zeros(1 << self.depth, np.int64)
        self.cut = np.zeros(1 << self.depth)
        inside = {1: points}
        for node in range(1, 1 << self.depth):
            mine = inside.pop(node)
            if len(mine):
                self.axis[node] = axis = int(np.argmax(mine.max(axis=0) - mine.min(axis=0)))
                self.cut[node] = np.median(mine[:, axis])
            right = mine[:, self.axis[node]] > self.cut[node]
            inside[2 * node], inside[2 * node + 1] = mine[~right], mine[right]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - (1 << self.depth)


class Projections:
    def __init__(self, sampled: np.ndarray, longest: float, rows: int, k: int, sure: float, seed: int) -> None:
        self.k, self.longest = k, longest
        self.directions = np.random.default_rng(seed).normal(size=(sampled.shape[1] + 1, DIRECTIONS))
        self.reach = chi_square_quantile(sure, DIRECTIONS)
        self.rows = LARGER * blocks.ROWS
        cells = min(rows // self.rows + 1, blocks.CELLS)
        self.tree = Tree(self.project(sampled), min(cells * LEAVES, len(sampled) // 16 + 1))
        self.shift = max(self.tree.depth - (cells - 1).bit_length(), 0)

    def project(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest - (vectors**2).sum(axis=1), 0))
        return np.hstack([vectors, rest[:, None]]) @ self.directions

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sides = self.project(vectors)
        return self.tree.leaf(sides) >> self.shift, sides

    def query_sides(self, queries: np.ndarray) -> np.ndarray:
        return queries @ self.directions[:-1]

    def radius(self, length: np.ndarray | float, bound: np.ndarray | float) -> np.ndarray | float:
        """Squared projected distance at which the test stops, given the k-th score so far."""
        whole = length + self.longest
        return np.maximum(whole - 2 * bound, 0) * self.reach + SLACK * whole

    def gaps(self, sides: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Squared projected distances of queries from boxes."""
        return sum(np.maximum(np.maximum(sides[:, None, i] - high[None, :, i], low[None, :, i] - sides[:, None, i]), 0) ** 2 for i in range(sides.shape[1]))

    def sees(self, queries, sides, bounds, low, high):
        return self.gaps(sides, low, high) <= self.radius((queries**2).sum(axis=1), bounds)[:, None]

    def search_block(self, vectors, sides, ids, queries, query_sides, query_ids, bounds):
        """ids and scores of each query's best rows of a block, at least as good as its bound."""
        leaf = self.tree.leaf(sides)
        order = np.argsort(leaf, kind="stable")
        heads = np.flatnonzero(np.diff(leaf[order], prepend=-1))
        parts = np.split(order, heads[1:])
        low, high = (np.array([f(sides[part], axis=0) for part in parts]) for f in (np.min, np.max))
        gaps = self.gaps(query_sides, low, high)
        lengths = (queries**2).sum(axis=1)
        bounds, best = bounds.astype(np.float64).copy(), np.full((len(queries), self.k), -np.inf)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in np.argsort(gaps.mean(axis=0), kind="stable") if len(queries) else ():
            limit = self.radius(lengths, bounds)
            asked = np.flatnonzero(gaps[:, at] <= limit)
            if not len(asked):
                continue
            part = parts[at]
            apart = (query_sides[asked] ** 2).sum(axis=1)[:, None] + (sides[part] ** 2).sum(axis=1)[None] - 2 * query_sides[asked] @ sides[part].T
            scores = queries[asked] @ vectors[part].T
            # rounding of the distances is within the slack of the radius
            scores[(apart > limit[asked, None] + SLACK * np.abs(apart)) | (query_ids[asked, None] == ids[part][None])] = -np.inf
            slack = SLACK * (lengths[asked] + self.longest)
            which, row = np.nonzero(scores >= np.maximum(bounds[asked] - slack, np.finfo(float).min)[:, None])
            kept.append((asked[which], part[row], scores[which, row]))
            both = np.hstack([best[asked], scores])
            best[asked] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
            bounds[asked] = np.maximum(bounds[asked], best[asked].min(axis=1))
        who, row, score = (np.concatenate(parts) if parts else np.zeros(0, np.int64) for parts in (zip(*kept, strict=True) if kept else ((), (), ())))
        near = score >= bounds[who] - SLACK * (lengths[who] + self.longest) if len(who) else np.zeros(0, bool)
        who, row = who[near], row[near]
        # summed in one order whatever the block, so equal vectors have equal scores
        final = (vectors[row] * queries[who]).sum(axis=1) if len(who) else np.zeros(0)
        out = []
        for query in range(len(queries)):
            mine = np.flatnonzero(who == query)
            top = mine[blocks.largest(final[mine], ids[row[mine]], self.k)]
            out.append((ids[row[top]], final[top]))
        return out


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", sure: float = 0.85, seed: int = 7
) -> DataFrame:
    """query_id, rank, vec_id, score: ``k`` rows of about the largest inner product with each query.

    Queries are the rows whose id is divisible by ``every``; all rows but those with
    the query's id are candidates. Scores are exact; ties go to smaller ids. Null
    ids and vectors, zero vectors, vectors with null or non-finite components and
    vectors of another length than most take no part. Repeated rows count once.
    Other columns are ignored; an empty table gives an empty result. ``sure`` is the
    probability of the stopping test; no number of candidates is fixed.
    """
    rows = checkpoint(blocks.usable(vectors, vec_id, vector, nonzero=True))
    known = rows.agg(F.max(blocks.square()).alias("m"), F.count(F.lit(1)).alias("n")).first()
    if not known["n"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sampled = blocks.sample(rows, SAMPLE)
    index = Projections(sampled, known["m"], known["n"], k, sure, seed)
    return blocks.top_k(rows, index, every, sampled.shape[1], DIRECTIONS)
