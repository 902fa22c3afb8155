"""Searches of a query set against all rows, in bounded blocks that meet pairwise."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Search = Callable[[pa.Table, pa.Table], pa.Table]


def search_blocks(
    rows: DataFrame, queries: DataFrame, search: Search, k: int, best: str, best_type: str, row_block: int, query_block: int
) -> DataFrame:
    """``query_id, rank, vec_id`` and ``best``: the k best rows of each query, ties to the smaller id.

    ``rows`` and ``queries`` have the columns ``id, width, vector``; only equal widths meet. Both are dealt by a hash of
    the id to blocks of about ``row_block`` and ``query_block``, and every two blocks meet in one task, which calls
    ``search`` and hands on its k best per query (``query_id, vec_id, best``, smaller is better). Those are merged
    per query, combined before the shuffle. Queries that repeat an id are one, with the smallest vector.
    """
    one = F.min(F.struct("width", "vector")).alias("one")
    queries = queries.groupBy("id").agg(one).select("id", "one.width", "one.vector")
    row_blocks = 1 + rows.count() // row_block
    query_blocks = 1 + queries.count() // query_block
    tasks = row_blocks * query_blocks
    own = F.pmod(F.xxhash64("id"), F.lit(row_blocks))
    dealt = rows.select("id", "width", "vector", own.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("block"))
    own = F.pmod(F.xxhash64("id"), F.lit(query_blocks))
    asked = queries.select("id", "width", "vector", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("shard"), own.alias("block"))
    keys = ("width", "shard", "block")
    left = dealt.withColumn("block", F.col("block").cast("long")).repartition(tasks, *keys).groupBy(*keys)
    right = asked.withColumn("shard", F.col("shard").cast("long")).repartition(tasks, *keys).groupBy(*keys)
    found = left.cogroup(right).applyInArrow(search, f"query_id long, vec_id long, {best} {best_type}")
    order = Window.partitionBy("query_id").orderBy(best, "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", best)
