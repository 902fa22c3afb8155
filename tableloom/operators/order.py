"""One sort key for several columns, for picking the first or last row of a group."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits a value of the type can take; timestamps reach the year 9999.
_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64, "date": 32, "timestamp": 60, "timestamp_ntz": 60}
_MOST_BITS = 126  # what 38 decimal digits can hold


def order_key(df: DataFrame, columns: Sequence[str]) -> Column:
    """A key that orders like the columns together, NULLs first.

    Whole numbers, dates and times are packed into one decimal where they fit: an aggregate keeps
    that in its hash table, while a struct would make it sort all rows first.
    """
    kinds = dict(df.dtypes)
    bits = [_BITS.get(kinds[c], _MOST_BITS) + 1 for c in columns]
    if sum(bits) > _MOST_BITS:
        return F.struct(*columns)
    key = None
    for column, size in zip(columns, bits):
        part = _number(F.col(column), kinds[column])
        if size - 1 < 64:
            part = F.coalesce(part, F.lit(-(1 << (size - 2)) - 1).cast("bigint")).cast("decimal(19,0)")
        else:
            part = F.coalesce(part.cast("decimal(20,0)"), F.lit(Decimal(-(1 << 63) - 1)))
        key = part if key is None else key * F.lit(Decimal(1 << size)) + part
    return key.cast("decimal(38,0)")


def _number(column: Column, kind: str) -> Column:
    if kind == "date":
        return F.unix_date(column)
    if kind == "timestamp":
        return F.unix_micros(column)
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz"), column)
    return column
