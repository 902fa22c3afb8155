"""Grouped aggregation and deduplication."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.functions.formula import compile_condition
from tableloom.operators.order import order_key
from tableloom.plans.spec import check_column_name

# Accepted function, strategy and direction names.
FUNCTIONS = ("sum", "avg", "min", "max", "count", "count_distinct", "first", "last")
STRATEGIES = ("keep_first", "keep_last", "keep_none")
DIRECTIONS = ("asc", "desc")
# Distinct counts by sketch: the count itself, or the sketch to merge with others later.
SKETCHES = ("count_distinct_approx", "distinct_sketch")
SKETCH_BITS = 14  # log2 of a sketch's registers
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)  # relative standard error of a count, 0.8 %


@dataclass(frozen=True)
class Aggregation:
    column: str
    function: str
    alias: str = ""

    def __post_init__(self):
        if self.function not in (*FUNCTIONS, *SKETCHES):
            raise ValueError(f"unknown aggregate function: {self.function!r}")
        check_column_name(self.column)
        check_column_name(self.name)

    @property
    def name(self) -> str:
        return self.alias or f"{self.function}_{self.column}"

    @classmethod
    def parse(cls, text: str) -> "Aggregation":
        """``column:function`` or ``column:function:alias``."""
        parts = text.split(":")
        if len(parts) not in (2, 3):
            raise ValueError(f"not column:function[:alias]: {text!r}")
        return cls(*parts)


@dataclass(frozen=True)
class OrderBy:
    column: str
    direction: str = "desc"

    def __post_init__(self):
        check_column_name(self.column)
        if self.direction not in DIRECTIONS:
            raise ValueError("order direction must be asc or desc")

    @classmethod
    def parse(cls, text: str) -> "OrderBy":
        """``column`` or ``column:asc`` / ``column:desc``."""
        return cls(*text.split(":", 1))


def aggregate(
    df: DataFrame,
    group_by: Sequence[str],
    aggregations: Sequence[Aggregation],
    order_by: Sequence[str] = (),
    numeric_text: bool = True,
) -> DataFrame:
    """Group by one or more columns (NULL is a group of its own).

    ``order_by`` fixes what first and last mean; without it they are unspecified. With
    ``numeric_text`` sum, avg, min and max read text as numbers and fail on other text. ``count_distinct_approx`` counts
    with a standard error of ``SKETCH_ERROR``, in one pass and with a bounded state per group; ``distinct_sketch`` gives
    that state as binary, for ``merge_sketches``.
    """
    if not group_by or not aggregations:
        raise ValueError("at least one group column and one aggregation are needed")
    for name in (*group_by, *order_by):
        check_column_name(name)
    exprs = [_aggregate(df, a, order_by, numeric_text).alias(a.name) for a in aggregations]
    return df.groupBy(*group_by).agg(*exprs)


def _aggregate(df: DataFrame, a: Aggregation, order_by: Sequence[str], numeric_text: bool) -> Column:
    column, dtype = F.col(a.column), df.schema[a.column].dataType
    if a.function in ("sum", "avg", "min", "max") and numeric_text and isinstance(dtype, T.StringType):
        column, dtype = column.cast("double"), T.DoubleType()
    if a.function == "sum" and isinstance(dtype, T.IntegralType):
        return wide_sum(column.cast("bigint"))
    if a.function in ("first", "last"):
        if not order_by:
            return F.first(column) if a.function == "first" else F.last(column)
        order = order_key(df, order_by)
        pick = F.min_by if a.function == "first" else F.max_by
        return pick(column, order)
    if a.function in SKETCHES:
        sketch = F.hll_sketch_agg(_sketched(column, dtype), F.lit(SKETCH_BITS))
        return sketch if a.function == "distinct_sketch" else F.hll_sketch_estimate(sketch)
    plain = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.count_distinct}
    return plain[a.function](column)


def _sketched(column: Column, dtype: T.DataType) -> Column:
    """Values as a type that sketches take; equal values stay equal, others differ."""
    if isinstance(dtype, (T.StringType, T.BinaryType, T.LongType)):
        return column
    if isinstance(dtype, T.IntegralType):
        return column.cast("bigint")
    if isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType):
        column = F.when(column == 0, F.lit(0.0)).otherwise(column)  # one zero, as in an exact count
    return column.cast("string")


def merge_sketches(df: DataFrame, group_by: Sequence[str], sketches: Sequence[str]) -> DataFrame:
    """One row per group of the ``sketches`` columns of any number of aggregates, without their rows.

    The merged columns are sketches again; ``sketch_count`` reads one. A group without a sketch has that of no value.
    """
    for name in (*group_by, *sketches):
        check_column_name(name)
    return df.groupBy(*group_by).agg(*[F.hll_union_agg(F.col(c)).alias(c) for c in sketches])


def sketch_count(sketch: str | Column) -> Column:
    """The distinct count that a sketch stands for; 0 for NULL."""
    return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0)).cast("bigint")


def wide_sum(column: Column) -> Column:
    """Exact sum of 64-bit integers as a decimal.

    A 64-bit sum may overflow and a decimal one is several times slower, so three parts of 22 bits
    are summed apart; each is safe for 2**41 rows per group.
    """
    part = F.lit((1 << 22) - 1)
    low, middle = column.bitwiseAND(part), F.shiftright(column, 22).bitwiseAND(part)
    total = F.lit(0).cast("decimal(38,0)")
    for piece, weight in ((F.shiftright(column, 44), 1 << 44), (middle, 1 << 22), (low, 1)):
        total = total + F.sum(piece).cast("decimal(20,0)") * F.lit(weight).cast("decimal(15,0)")
    return total.cast("decimal(38,0)")


def dedup(
    df: DataFrame, keys: Sequence[str], strategy: str = "keep_first", order_by: OrderBy | None = None
) -> DataFrame:
    """One row per key (``keep_first`` / ``keep_last``) or only keys that occur once (``keep_none``).

    Without an order the first column decides, largest first. Remaining columns break ties, so the
    result does not depend on task order. NULLs sort last in both directions.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown dedup strategy {strategy!r}")
    if not keys:
        raise ValueError("at least one key column is needed")
    for name in keys:
        check_column_name(name)
    if strategy == "keep_none":
        return _singles(df, keys)

    order = order_by or OrderBy(df.columns[0])
    descending = (order.direction == "desc") == (strategy == "keep_first")
    direct = F.col(order.column).desc_nulls_last() if descending else F.col(order.column).asc_nulls_last()
    ties = [
        F.col(f.name).asc_nulls_last()
        for f in df.schema
        if f.name not in (*keys, order.column) and not isinstance(f.dataType, T.MapType)
    ]
    rank = _free_name(df)
    window = Window.partitionBy(*keys).orderBy(direct, *ties)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) == 1).select(*df.columns)


def _singles(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs once.

    Each map task folds its rows to one candidate and a count per key before the shuffle, so a key
    held by many rows never gathers them. A single NULL key is no match; NULLs inside a
    composite key are.
    """
    if len(keys) == 1:
        df = df.where(F.col(keys[0]).isNotNull())
    rest = [c for c in df.columns if c not in keys]
    count = _free_name(df)
    row = F.first(F.struct(*rest)) if rest else F.lit(None)
    folded = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), row.alias(f"{count}_row"))
    picked = {c: F.col(c) if c in keys else F.col(f"{count}_row")[c] for c in df.columns}
    return folded.where(F.col(count) == 1).select(*[v.alias(c) for c, v in picked.items()])


def _free_name(df: DataFrame) -> str:
    name = "_rank"
    while name in df.columns:
        name += "_"
    return name


def filter_by(df: DataFrame, *conditions: str) -> DataFrame:
    """Rows for which every ``field op literal`` condition holds."""
    types = dict(df.dtypes)
    wide = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double", "timestamp": "timestamp_ntz"}
    types = {n: wide.get(t, t) for n, t in types.items()}
    tests = [c for c in (compile_condition(text, types, null_safe=False) for text in conditions) if c is not None]
    return df.where(reduce(operator.and_, tests)) if tests else df
