"""Nearest vectors by inner product: vantage-point trees per shard, pruned by the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.llm.blocks import search_blocks
from tableloom.llm.words import map_batches

LEAF = 128
ROW_BLOCK, QUERY_BLOCK = 1 << 14, 1 << 11
SLACK = 1e-6  # of the largest length, for rounding of distances


def usable_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, width, vector`` (doubles) without missing ids and vectors that are NULL, zero or not all finite numbers."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0))
    return rows.select("id", F.size("vector").alias("width"), "vector")


@dataclass
class _Node:
    rows: np.ndarray | None = None  # of a leaf
    vantage: np.ndarray | None = None
    inside: "_Node | None" = None
    outside: "_Node | None" = None
    ranges: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # distances from the vantage: both sides, low and high


class VantageTree:
    """Vectors x are lifted to (x, sqrt(M^2 - |x|^2)) with M the largest length.

    There the squared distance to a query (q, 0) is |q|^2 + M^2 - 2 q.x, so the nearest points have the largest inner
    products and the triangle inequality holds.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, factor: float):
        self.vectors, self.ids, self.factor = vectors, ids, factor
        squares = np.einsum("ij,ij->i", vectors, vectors)
        self.square = float(squares.max())
        self.points = np.hstack((vectors, np.sqrt(np.maximum(0, self.square - squares))[:, None]))
        self.drawn = np.random.Generator(np.random.PCG64(7))
        self.root = self._grow(np.arange(len(ids)))

    def _grow(self, rows: np.ndarray) -> _Node:
        if len(rows) <= LEAF:
            return _Node(rows=rows)
        vantage = self.points[rows[self.drawn.integers(len(rows))]]
        away = np.linalg.norm(self.points[rows] - vantage, axis=1)
        middle = len(rows) // 2
        order = np.argpartition(away, middle)
        near, far = order[:middle], order[middle:]
        ranges = (away[near].min(), away[near].max(), away[far].min(), away[far].max())
        return _Node(None, vantage, self._grow(rows[near]), self._grow(rows[far]), ranges)

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the k best rows of each query, best first; missing ones have the score -inf."""
        self.queries, self.query_ids, self.k = queries, query_ids, k
        self.lengths = np.einsum("ij,ij->i", queries, queries) + self.square
        self.lifted = np.hstack((queries, np.zeros((len(queries), 1))))
        self.slack = SLACK * np.sqrt(self.lengths)
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self._visit(self.root, np.arange(len(queries)))
        return self.found, self.scores

    def _reach(self, active: np.ndarray) -> np.ndarray:
        """The distance of each query's kth best so far."""
        kth = self.scores[active, -1]
        return np.sqrt(np.maximum(0, self.lengths[active] - 2 * kth)) + self.slack[active]

    def _visit(self, node: _Node, active: np.ndarray) -> None:
        if not len(active):
            return
        if node.rows is not None:
            self._compare(node.rows, active)
            return
        away = np.linalg.norm(self.lifted[active] - node.vantage, axis=1)
        low_in, high_in, low_out, high_out = node.ranges
        gap_in = np.maximum(0, np.maximum(low_in - away, away - high_in))
        gap_out = np.maximum(0, np.maximum(low_out - away, away - high_out))
        first_in = gap_in <= gap_out
        for child, chosen, gap in (
            (node.inside, first_in, gap_in),
            (node.outside, ~first_in, gap_out),
            (node.outside, first_in, gap_out),
            (node.inside, ~first_in, gap_in),
        ):
            # No row of the child is nearer than the gap; a factor above one takes it for more than that.
            open_ = gap[chosen] * self.factor <= self._reach(active[chosen])
            self._visit(child, active[chosen][open_])

    def _compare(self, rows: np.ndarray, active: np.ndarray) -> None:
        # einsum adds the products of every pair in one order, so equal vectors have equal scores
        scores = np.einsum("qd,nd->qn", self.queries[active], self.vectors[rows], optimize=False)
        ids = self.ids[rows]
        scores[self.query_ids[active][:, None] == ids] = -np.inf
        better = (scores >= self.scores[active, -1:]).any(axis=1)
        active, scores = active[better], scores[better]
        if not len(active):
            return
        all_scores = np.hstack((self.scores[active], scores))
        all_ids = np.hstack((self.found[active], np.broadcast_to(ids, scores.shape)))
        all_ids[all_scores == -np.inf] = np.iinfo(np.int64).max
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.scores[active] = np.take_along_axis(all_scores, order, 1)
        self.found[active] = np.take_along_axis(all_ids, order, 1)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.1) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows with the largest inner product found for each query.

    Both tables have the columns ``id, width, vector``. ``factor`` relaxes the pruning: a subtree is left out once
    ``factor`` times its least distance exceeds the kth best so far, so 1 finds the exact answer and more finds it
    sooner with some loss. A row is no candidate for a query of its own id; ties go to the smaller id; vectors meet
    vectors of their own width; a query with fewer than k candidates gets them all. Every row is indexed.
    """

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "worse": np.zeros(0)}
        if len(rows) and len(asked):
            width = rows["width"][0].as_py()
            tree = VantageTree(_matrix(rows["vector"], width), rows["id"].to_numpy(), factor)
            query_ids = asked["id"].to_numpy()
            found, scores = tree.search(_matrix(asked["vector"], width), query_ids, k)
            known = scores > -np.inf
            out = {"query_id": np.repeat(query_ids, known.sum(axis=1)), "vec_id": found[known], "worse": -scores[known]}
        return pa.table(out)

    found = search_blocks(vectors, queries, search, k, "worse", "double", ROW_BLOCK, QUERY_BLOCK)
    return found.select("query_id", "rank", "vec_id", (-F.col("worse")).alias("score"))
