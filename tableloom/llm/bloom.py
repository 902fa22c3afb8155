"""Blocked Bloom filters: built by Spark, probed next to the data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANES = 8  # 64-bit words of a block; a key sets one bit in each
BLOCK_BYTES = LANES * 8
BITS_PER_KEY = 16
MAX_FILTER_BYTES = 128 << 20


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


class BlockedBloom:
    """Bit blocks of 64 bytes; all bits of a key lie in one block."""

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks

    @staticmethod
    def build(listed: DataFrame, key: str, max_bytes: int = MAX_FILTER_BYTES) -> BlockedBloom | None:
        """The filter of all keys, set by a distributed OR; None if it would be larger than ``max_bytes``."""
        n = 1 + listed.count() * BITS_PER_KEY // (8 * BLOCK_BYTES)
        if n * BLOCK_BYTES > max_bytes:
            return None
        place, bits = _hashes(F.col(key))
        lanes = [F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(LANES)]
        rows = listed.select(F.pmod(place, F.lit(n)).alias("block"), *[x.alias(f"b{i}") for i, x in enumerate(lanes)])
        ored = [F.expr(f"bit_or(shiftleft(1L, b{i}))").alias(f"w{i}") for i in range(LANES)]
        blocks = np.zeros((n, LANES), np.int64)
        for row in rows.groupBy("block").agg(*ored).toLocalIterator():  # at most max_bytes in all
            blocks[row[0]] = row[1:]
        return BlockedBloom(blocks.view(np.uint64))

    def possible(self, spark: SparkSession, key: Column) -> Column:
        """Whether a key may be in the filter, which goes to every worker; only two hashes go through Python."""
        shared = spark.sparkContext.broadcast(self)

        @F.pandas_udf("boolean")
        def probe(place: pd.Series, bits: pd.Series) -> pd.Series:
            return pd.Series(shared.value.may_hold(place.to_numpy(), bits.to_numpy()))

        return probe(*_hashes(key))

    def may_hold(self, place: np.ndarray, bits: np.ndarray) -> np.ndarray:
        block = self.blocks[np.mod(place.astype(np.int64), len(self.blocks))]
        shift = (bits.astype(np.int64).view(np.uint64)[:, None] >> np.arange(0, 6 * LANES, 6, dtype=np.uint64)) & np.uint64(63)
        return ((block >> shift) & np.uint64(1)).all(axis=1)
