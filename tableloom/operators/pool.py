"""Random picks, with replacement, from the rows of another table's column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096  # at least; more for pools of more rows than BUCKET_ROWS each
BUCKET_ROWS = 1 << 20
CHUNK = 1 << 16
TASK_ROWS = 1 << 22  # rows that one task unfolds


def bucket_of(value: Column, buckets: int = BUCKETS) -> Column:
    """Stable bucket of a value of any type, by its text."""
    text = F.coalesce(value.cast("string"), F.lit("\\N"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def index_pool(pool: DataFrame, column: str, buckets: int = BUCKETS) -> tuple[DataFrame, Column]:
    """Number the pool rows 0 .. n - 1 by (bucket, value); returns ``(_index, _value)`` and n.

    Equal values are counted before anything is shuffled, buckets are numbered side by side, and
    only the bucket totals (``buckets`` rows, or one per ``BUCKET_ROWS`` pool rows) meet in one place, so no global sort is needed.
    A value held by many rows is unfolded in chunks spread over the tasks.
    """
    rows = pool.count()
    buckets = max(buckets, 1 << (rows // BUCKET_ROWS).bit_length())
    counted = pool.groupBy(F.col(column).alias("__value")).agg(F.count(F.lit(1)).alias("_count"))
    counted = counted.withColumn("_bucket", bucket_of(F.col("__value"), buckets))
    totals = counted.groupBy("_bucket").agg(F.sum("_count").alias("_total"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    size = totals.agg(F.coalesce(F.sum("_total"), F.lit(0))).scalar()

    inside = Window.partitionBy("_bucket").orderBy(F.col("__value").asc_nulls_last())
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    ranged = counted.select(
        "_bucket", "__value", "_count", F.coalesce(F.sum("_count").over(inside), F.lit(0)).alias("_start")
    ).join(F.broadcast(offsets), "_bucket", "left")  # every bucket has its offset; left keeps the counts reusable
    # the rows are few and small here, but unfold to the whole pool
    tasks = max(int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / TASK_ROWS))
    first = F.col("_offset") + F.col("_start")
    chunks = ranged.select(
        "__value",
        (first + F.col("_count")).alias("_end"),
        F.explode_outer(F.sequence(first, first + F.col("_count") - 1, F.lit(CHUNK).cast("bigint"))).alias("_from"),
    ).repartition(tasks, "_from")
    last = F.least(F.col("_from") + F.lit(CHUNK), F.col("_end")) - 1
    return chunks.select(F.explode_outer(F.sequence("_from", last)).alias("__index"), "__value"), size


def pick_from_pool(df: DataFrame, pool: DataFrame, column: str, draw: Column, name: str) -> DataFrame:
    """Add ``name``: for each row the pool value at ``draw mod n``; NULL when the pool is empty.

    The join key is a uniform number, so neither side can be skewed; the optimizer broadcasts
    the pool only when its measured size allows.
    """
    indexed, size = index_pool(pool, column)
    with_pick = df.withColumn("__pick", draw % F.nullif(size, F.lit(0).cast("bigint")))
    joined = with_pick.join(indexed, F.col("__pick") == F.col("__index"), "left")
    return joined.select(*df.columns, F.col("__value").alias(name))
