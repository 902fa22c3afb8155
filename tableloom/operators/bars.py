"""Open-high-low-close-volume bars from a table of ticks or finer bars."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.operators.order import order_key
from tableloom.operators.transform import wide_sum

# Accepted intervals and look-back periods.
INTERVALS = {
    "1m": "1 minute",
    "2m": "2 minutes",
    "5m": "5 minutes",
    "15m": "15 minutes",
    "30m": "30 minutes",
    "60m": "60 minutes",
    "1h": "60 minutes",
    "1d": "1 day",
    "5d": "5 days",
    "1wk": "week",
    "1mo": "month",
}
PERIODS = {
    "1d": "INTERVAL 1 DAY",
    "5d": "INTERVAL 5 DAYS",
    "1mo": "INTERVAL 1 MONTH",
    "3mo": "INTERVAL 3 MONTHS",
    "6mo": "INTERVAL 6 MONTHS",
    "1y": "INTERVAL 1 YEAR",
    "2y": "INTERVAL 2 YEARS",
    "5y": "INTERVAL 5 YEARS",
    "10y": "INTERVAL 10 YEARS",
}


def ohlcv_bars(
    ticks: DataFrame,
    interval: str = "1d",
    period: str = "max",
    symbols: Sequence[str] | None = None,
    as_of: datetime | None = None,
    symbol: str = "symbol",
    ts: str = "ts",
    price: str = "price",
    volume: str = "volume",
    tie_break: str | None = None,
) -> DataFrame:
    """One row per symbol and interval: symbol, date, open, high, low, close, volume.

    ``period`` looks back from ``as_of`` (default: the latest tick). ``tie_break`` orders ticks of one
    instant; without it the price does. Ticks are folded before the shuffle, so a symbol
    that holds most of them does not burden one task.
    """
    if interval not in INTERVALS:
        raise ValueError(f"unknown interval: {interval!r}")
    wanted = [s.strip().upper() for s in symbols] if symbols is not None else None
    rows = ticks.select(
        F.upper(F.trim(F.col(symbol).cast("string"))).alias("symbol"),
        F.col(ts).cast("timestamp_ntz").alias("_ts"),
        F.col(price).cast("double").alias("_price"),
        F.col(volume).cast("bigint").alias("_volume"),
        F.col(tie_break or price).alias("_tie"),
    ).where(F.col("_ts").isNotNull())
    if wanted is not None:
        rows = rows.where(F.col("symbol").isin(wanted))
    rows = _within(rows, period, as_of)
    keyed = rows.withColumn("_order", order_key(rows, ["_ts", "_tie"]))
    return keyed.groupBy("symbol", _bar_start(interval).alias("date")).agg(
        F.min_by("_price", "_order").alias("open"),
        F.max("_price").alias("high"),
        F.min("_price").alias("low"),
        F.max_by("_price", "_order").alias("close"),
        # a sum beyond 64 bits is NULL
        F.when(F.count("_volume") == 0, F.lit(0)).otherwise(wide_sum(F.col("_volume")).try_cast("bigint")).alias("volume"),
    )


def _within(rows: DataFrame, period: str, as_of: datetime | None) -> DataFrame:
    if period == "max":
        return rows
    last = F.lit(as_of).cast("timestamp_ntz") if as_of else rows.agg(F.max("_ts")).scalar()
    if period == "ytd":
        first = F.trunc(last.cast("date"), "year").cast("timestamp_ntz")
    elif period in PERIODS:
        first = last - F.expr(PERIODS[period])
    else:
        raise ValueError(f"unknown period: {period!r}")
    return rows.where((F.col("_ts") >= first) & (F.col("_ts") <= last))


def _bar_start(interval: str) -> Column:
    """Start of the bar: a date for bars of a day or longer, else a timestamp."""
    unit = INTERVALS[interval]
    if unit in ("week", "month"):
        return F.trunc(F.col("_ts").cast("date"), unit)
    if interval == "1d":
        return F.col("_ts").cast("date")
    start = F.window("_ts", unit)["start"]
    return start.cast("date") if interval == "5d" else start
