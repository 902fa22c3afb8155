"""Listings: pages, newest rows, search, category filter, column and chart views."""

from __future__ import annotations

import os.path
from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PER_PAGE = 1000
NEAR_ROWS = 1000  # rows that may be sorted just to be skipped
SPLITS = 200

# SQL names the reference types print under.
SQL_NAMES = {
    "tinyint": "TINYINT",
    "smallint": "SMALLINT",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "float": "FLOAT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp": "TIMESTAMP WITH TIME ZONE",
    "timestamp_ntz": "TIMESTAMP",
    "binary": "BLOB",
}
NUMERIC_NAMES = ("BIGINT", "DOUBLE", "INTEGER", "FLOAT", "DECIMAL")
TEXT_NAMES = ("VARCHAR", "STRING")


def page(df: DataFrame, order: Sequence[str], page: int = 1, per_page: int = 100) -> DataFrame:
    """Rows ``(page - 1) * per_page`` onwards in a fixed order, at most ``per_page`` of them.

    The rows before the page are counted by ranges of the order's first column and skipped; inside a range that is one
    value, the next column is counted. So no task keeps more than ``NEAR_ROWS`` rows and a page, however
    deep, unless more rows are alike in all columns of the order.
    """
    if page < 1 or not 1 <= per_page <= MAX_PER_PAGE:
        raise ValueError(f"page must be at least 1 and per_page 1..{MAX_PER_PAGE}")
    pieces = _pieces(df, list(order), 0, (page - 1) * per_page, per_page)
    return reduce(DataFrame.unionByName, pieces).orderBy(*order) if pieces else df.limit(0)


def _pieces(df: DataFrame, order: list[str], depth: int, skip: int, take: int) -> list[DataFrame]:
    """The page's rows by ranges of the order; ``df`` has one value in each of the first ``depth`` columns."""
    if skip <= NEAR_ROWS or depth == len(order):
        return [df.orderBy(*order).offset(skip).limit(take)]
    part = _ranges(df, order[depth])
    sizes = sorted(df.groupBy(part.alias("part")).count().collect())  # at most SPLITS + 1 rows
    if len(sizes) < 2:
        low, high = df.agg(F.min(order[depth]), F.max(order[depth])).first()
        return _pieces(df, order, depth + 1 if low == high else len(order), skip, take)
    out, before = [], 0
    for index, size in sizes:
        first, last = max(skip, before), min(skip + take, before + size)
        if first < last:
            out += _pieces(df.where(part == F.lit(index)), order, depth, first - before, last - first)
        before += size
    return out


def _ranges(df: DataFrame, column: str) -> Column:
    """The number of the range of ``column`` that a row lies in, about ``SPLITS`` of them; -1 for NULL, which comes first."""
    key = _rising_number(df, column)
    shares = [i / SPLITS for i in range(1, SPLITS)]
    cuts = sorted(set(df.select(F.percentile_approx(key, shares, 10_000)).first()[0] or []))
    part = reduce(lambda total, cut: total + F.when(key > F.lit(cut), 1).otherwise(0), cuts, F.lit(0))
    return F.when(F.col(column).isNull(), F.lit(-1)).otherwise(part)


def _rising_number(df: DataFrame, column: str) -> Column:
    """A number that never falls as the column rises, to cut the column's range by."""
    kind, col = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.NumericType):
        return col
    if isinstance(kind, T.DateType):
        return F.unix_date(col)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz"), col)
    if isinstance(kind, T.BooleanType):
        return col.cast("int")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        low, high = df.agg(F.min(col).cast("binary"), F.max(col).cast("binary")).first()
        shared = len(os.path.commonprefix([bytes(low or b""), bytes(high or b"")]))
        # seven bytes after the part that all values share, as a 56-bit number
        digits = F.rpad(F.hex(F.substring(col.cast("binary"), shared + 1, 7)), 14, "0")
        return F.conv(digits, 16, 10).cast("bigint")
    raise ValueError(f"rows cannot be paged by {column!r} of type {kind.simpleString()}")


def newest(df: DataFrame, created: str, n: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """All rows newest first, or only the ``n`` newest."""
    ordered = df.orderBy(F.col(created).desc_nulls_last(), *ties)
    return ordered if n is None else ordered.limit(n)


def search(df: DataFrame, text: str, id_column: str, name_column: str, area_column: str) -> DataFrame:
    """Rows whose id or name contains ``text`` in any case; one per id, by area and id."""
    needle = F.lit(text.lower())
    hits = df.where(F.lower(F.col(id_column)).contains(needle) | F.lower(F.col(name_column)).contains(needle))
    return first_per(hits, [id_column], [area_column, name_column]).orderBy(area_column, id_column)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of every key in ``order``; each task keeps one row per key before the shuffle."""
    if set(df.columns) <= set(keys):
        return df.distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def in_category(df: DataFrame, area_column: str, domains: DataFrame, domain_id: str | int) -> DataFrame:
    """Rows whose area is the name of the given domain; an unknown id gives none."""
    names = domains.where(F.col("id") == F.lit(domain_id)).select(F.col("name").alias("_area")).distinct()
    return df.join(names, F.col(area_column) == F.col("_area"), "left_semi")


def describe(df: DataFrame) -> list[tuple[str, str]]:
    """Column names with their SQL type names."""
    named = []
    for name, kind in df.dtypes:
        sql = SQL_NAMES.get(kind) or ("DECIMAL" + kind[7:] if kind.startswith("decimal") else kind.upper())
        named.append((name, sql))
    return named


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, t in describe(df) if t.split("(")[0] in NUMERIC_NAMES]


def text_columns(df: DataFrame) -> list[str]:
    return [n for n, t in describe(df) if t in TEXT_NAMES]


def chart_series(df: DataFrame, order: Sequence[str], n: int, x: str | None = None, y: str | None = None) -> DataFrame:
    """``(x, y)`` of the first ``n`` rows; by default the first text and the first numeric column."""
    texts, numbers = text_columns(df), numeric_columns(df)
    x = x or (texts[0] if texts else None)
    y = y or (numbers[0] if numbers else None)
    if not x or not y:
        raise ValueError("select X and Y columns")
    return df.orderBy(*order).limit(n).select(F.col(x).alias("x"), F.col(y).alias("y"))
