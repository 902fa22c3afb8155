"""Left-outer lookup that stays correct and balanced when one key holds much of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.session import fits_broadcast

HOT_SHARE = 256  # a key is hot when it holds more than 1/256 of the rows, so at most 255 keys are
SPREAD = 2  # tasks of rows in a hot key's salts, per task of its share


def lookup(
    df: DataFrame,
    key: str,
    table: DataFrame,
    table_key: str,
    wanted: dict[str, Column],
    broadcast_rows: int = 200_000,
    measured: DataFrame | None = None,
) -> DataFrame:
    """``df`` with ``wanted`` columns of ``table``; every row of ``df`` is kept exactly once.

    ``table`` must have one row per key. Measured small (at most ``broadcast_rows``, counted on
    ``measured`` when that is cheaper and no smaller than the table), it is broadcast and nothing is shuffled.
    Otherwise both sides shuffle by key, and rows of hot keys and of NULL, which match nothing, are first spread
    over as many salts as the hottest share asks for. The salt counts rows, so rows that are alike part too.
    """
    right = table.select(F.col(table_key).alias("_lookup_key"), *[c.alias(f"_found_{n}") for n, c in wanted.items()])
    right = right.where(F.col("_lookup_key").isNotNull())
    found = [F.col(f"_found_{name}").alias(name) for name in wanted]
    if broadcast_rows and fits_broadcast(right if measured is None else measured, broadcast_rows):
        joined = df.join(F.broadcast(right), F.col(key) == F.col("_lookup_key"), "left")
        return joined.select(*df.columns, *found)

    hot_keys, share = _hot_keys(df, key)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = 1 + int(SPREAD * share * tasks)
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(salts))
    salt = F.when(F.col(key).isNull() | F.col(key).isin(hot_keys), spread).otherwise(F.lit(0)).cast("bigint")
    every_salt = F.sequence(F.lit(0), F.lit(salts - 1))
    copies = F.when(F.col("_lookup_key").isin(hot_keys), every_salt).otherwise(F.array(F.lit(0)))
    left = df.withColumn("_salt", salt)
    salted = right.select("*", F.explode_outer(copies.cast("array<bigint>")).alias("_right_salt")).hint("merge")
    match = (F.col(key) == F.col("_lookup_key")) & (F.col("_salt") == F.col("_right_salt"))
    return left.join(salted, match, "left").select(*df.columns, *found)


def _hot_keys(df: DataFrame, key: str) -> tuple[list, float]:
    """Keys with more than 1/``HOT_SHARE`` of the rows, fewer than ``HOT_SHARE``; the largest share, NULL's included."""
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_rows"))
    total = df.count()
    top = counts.where(F.col("_rows") * F.lit(HOT_SHARE) > F.lit(total)).collect()
    return [row[0] for row in top if row[0] is not None], max((row[1] for row in top), default=0) / max(1, total)
