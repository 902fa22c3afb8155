"""Exact nearest binary codes by multi-index hashing with growing radii."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.llm.blocks import search_blocks
from tableloom.llm.words import map_batches

SEGMENT = 16  # bits of a segment; each has a table of all its values
ROW_BLOCK, QUERY_BLOCK = 1 << 17, 1 << 13


def sign_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, width, vector``: one bit per component, set if it is positive; ``width`` is the number of bits.

    Rows without an id and vectors that are NULL, empty or hold NULL, NaN or an infinity have no code and are left out.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & (F.size("vector") > 0))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            ids, widths, codes = [], [], []
            for i, x in zip(batch["id"].to_pylist(), batch["vector"], strict=True):
                values = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(values).all():
                    ids.append(i)
                    widths.append(len(values))
                    codes.append(np.packbits(values > 0, bitorder="little").tobytes())
            yield {"id": pa.array(ids, pa.int64()), "width": pa.array(widths, pa.int32()), "vector": pa.array(codes, pa.binary())}

    return map_batches(rows, run, "id long, width int, vector binary")


@cache
def _masks(radius: int) -> np.ndarray:
    """All segment values with ``radius`` bits set."""
    picks = combinations(range(SEGMENT), radius)
    return np.array([sum(1 << b for b in pick) for pick in picks], np.int64)


class SegmentTables:
    """For every segment the rows by their value in it."""

    def __init__(self, codes: np.ndarray):
        """``codes``: one row of 16-bit segments per code."""
        self.codes = codes
        self.order, self.starts = [], []
        for column in codes.T:
            self.order.append(np.argsort(column, kind="stable"))
            self.starts.append(np.concatenate(([0], np.cumsum(np.bincount(column, minlength=1 << SEGMENT)))))

    def rows(self, segment: int, values: np.ndarray) -> np.ndarray:
        first, last = self.starts[segment][values], self.starts[segment][values + 1]
        sizes = last - first
        if not (total := int(sizes.sum())):
            return np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        places = np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(first, sizes)
        return self.order[segment][places]

    def nearest(self, code: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the k nearest allowed codes, ties to the smaller id.

        With the segments before ``s`` searched to radius r and the others to r - 1, an unseen code differs from the
        query in at least r + 1 bits of each of the former and r of each of the latter. The search ends once the kth
        verified distance is smaller than the sum of these.
        """
        segments = len(code)
        seen = ~allowed
        found, distances = np.zeros(0, np.int64), np.zeros(0, np.int64)
        unseen = int(allowed.sum())
        for radius in range(SEGMENT + 1):
            for segment in range(segments):
                fresh = self.rows(segment, code[segment] ^ _masks(radius))
                fresh = fresh[~seen[fresh]]
                seen[fresh] = True
                unseen -= len(fresh)
                away = np.bitwise_count((self.codes[fresh] ^ code).astype(np.uint32)).sum(axis=1).astype(np.int64)
                found, distances = np.concatenate((found, fresh)), np.concatenate((distances, away))
                if len(found) > k:
                    best = np.lexsort((ids[found], distances))[:k]
                    found, distances = found[best], distances[best]
                covered = segments * radius + segment + 1
                if not unseen or (len(found) == k and distances.max() < covered):
                    best = np.lexsort((ids[found], distances))
                    return found[best], distances[best]
        raise AssertionError("all radii leave no code unseen")


def _codes(column: pa.Array) -> np.ndarray:
    raw = [x + b"\0" * (-len(x) % 2) for x in column.to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint16).reshape(len(raw), -1).astype(np.int64)


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, distance``: the k codes nearest to each query in Hamming distance, exactly.

    Both tables have the columns ``id, width, vector`` (binary). A row is no candidate for a query of its own id; ties
    go to the smaller id; codes meet codes of their own width; a query with fewer than k candidates gets them all. Rows
    that repeat an id are candidates each.
    """

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "distance": []}
        if len(rows) and len(asked):
            ids, tables = rows["id"].to_numpy(), SegmentTables(_codes(rows["vector"]))
            for query, code in zip(asked["id"].to_numpy(), _codes(asked["vector"]), strict=True):
                allowed = ids != query
                if allowed.any():
                    found, distances = tables.nearest(code, allowed, ids, k)
                    out["query_id"] += [query] * len(found)
                    out["vec_id"] += ids[found].tolist()
                    out["distance"] += distances.tolist()
        return pa.table({name: pa.array(x, pa.int64()) for name, x in out.items()})

    return search_blocks(codes, queries, search, k, "distance", "long", ROW_BLOCK, QUERY_BLOCK)
