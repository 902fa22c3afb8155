from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tableloom.operators import joins
from tableloom.operators.bars import ohlcv_bars
from tableloom.operators.enrich import QUOTE_TYPES, build_quotes, distinct_keys, enrich, quote_snapshot, require_rows
from tableloom.session import fits_broadcast
from tests.conftest import plan

RAW = "symbol string, shortName string, regularMarketPrice double, last_price double, regularMarketPreviousClose double, previousClose double, volume long, currency string"


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        ("test", "Test Co", 100.0, None, None, 99.0, 1000, "EUR"),
        ("fast", None, 0.0, 50.0, 7.0, 48.0, None, ""),
        ("closed", "", None, None, 20.0, 5.0, 0, None),
        ("gone", "x", 0.0, None, 0.0, 5.0, 0, None),
        ("flat", "f", 10.0, None, None, 0.0, 0, None),
        ("zero", "z", None, 0.0, None, None, 0, None),
    ]
    return spark.createDataFrame(rows, RAW)


def test_quotes(raw):
    quotes = build_quotes(raw)
    assert [(f.name, f.dataType.simpleString()) for f in quotes.schema] == list(QUOTE_TYPES.items())
    rows = {r.symbol: r for r in quotes.collect()}
    assert set(rows) == {"TEST", "FAST", "CLOSED", "FLAT", "ZERO"}
    t = rows["TEST"]
    assert (t.change, t.changePercent, t.currency, t.longName, t.dayHigh, t.marketCap) == (1.0, 1.01, "EUR", "", 0.0, None)
    f = rows["FAST"]
    assert (f.regularMarketPrice, f.change, f.shortName, f.volume, f.currency) == (50.0, 2.0, "FAST", 0, "USD")
    assert (rows["CLOSED"].previousClose, rows["CLOSED"].change) == (20.0, 0.0)
    assert (rows["FLAT"].previousClose, rows["ZERO"].changePercent) == (10.0, 0.0)


def test_snapshot_of_symbols(raw):
    assert {r.symbol for r in quote_snapshot(raw, " test,nope\nFAST,, ").collect()} == {"TEST", "FAST"}
    with pytest.raises(ValueError, match="No valid quote data"):
        require_rows(quote_snapshot(raw, ["nope"]))
    with pytest.raises(ValueError):
        quote_snapshot(raw, " , ")


def test_enrich_keeps_rows_and_types(spark, raw):
    source = spark.createDataFrame([("TEST", 1), ("test", 2), ("nope", 3), (None, 4), ("", 5), ("TEST", 1)], "symbol string, n int")
    made = enrich(source, "symbol", build_quotes(raw), ["shortName", "volume", "sector"])
    assert made.dtypes[-3:] == [("shortName", "string"), ("volume", "bigint"), ("sector", "string")]
    assert sorted((r.n, r.shortName) for r in made.collect()) == [
        (1, "Test Co"), (1, "Test Co"), (2, "Test Co"), (3, None), (4, None), (5, None),
    ]
    assert enrich(source, "symbol", build_quotes(raw), ["sector"]).count() == 6


def test_hot_keys_are_salted(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(joins, "HOT_SHARE", 8)
    monkeypatch.setattr(joins, "SPREAD", 1)
    source = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id"
    )
    table = spark.createDataFrame([("hot", 1.5), ("k2", 2.5), ("k5", 3.5), ("other", 9.0)], "key string, price double")
    made = joins.lookup(source, "k", table, "key", {"price": F.col("price")}, broadcast_rows=0)
    assert "SortMergeJoin" in plan(made) and joins._hot_keys(source, "k") == (["hot"], 1 / 3)
    prices = {"hot": 1.5, "k2": 2.5, "k5": 3.5}
    rows = made.collect()
    assert len(rows) == 3000 and all(r.price == prices.get(r.k) for r in rows)
    assert sorted(r.id for r in rows) == list(range(3000))


def test_hot_rows_that_are_alike_part(spark, no_broadcast):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        source = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"))
        table = spark.createDataFrame([("hot", 1.5)], "key string, price double")
        made = joins.lookup(source, "k", table, "key", {"price": F.col("price")}, broadcast_rows=0)
        sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 40_000 and max(sizes) < 2 * 40_000 / 8
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_broadcast_only_what_was_measured(spark):
    df = spark.range(100).select(F.repeat(F.lit("x"), 100).alias("s"))
    assert fits_broadcast(df, 100) and not fits_broadcast(df, 99) and not fits_broadcast(df, 100, 5000)
    assert fits_broadcast(df.where("s IS NULL"))


def test_distinct_keys(spark):
    df = spark.createDataFrame([("a", 0, True), ("", 1, False), (None, None, None), ("a", 1, True)], "s string, n int, b boolean")
    assert [r.s for r in distinct_keys(df, "s").collect()] == ["a"]
    assert [r.n for r in distinct_keys(df, "n").collect()] == [1]
    assert [r.b for r in distinct_keys(df, "b").collect()] == [True]
    with pytest.raises(ValueError):
        distinct_keys(df, "bad name")


# --- bars ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ticks(spark):
    t = datetime
    rows = [
        (1, "a ", t(2024, 1, 1, 9, 0, 0), 10.0, 5), (2, "A", t(2024, 1, 1, 9, 0, 0), 11.0, 5), (3, "a", t(2024, 1, 1, 9, 4, 59), 8.0, None),
        (4, "a", t(2024, 1, 1, 9, 4, 59), 9.0, 1), (5, "a", t(2024, 1, 8, 0, 0), 20.0, 2), (6, "b", t(2023, 12, 31, 23, 59), 1.0, 1),
        (7, "a", None, 1.0, 1),
    ]
    return spark.createDataFrame(rows, "id long, symbol string, ts timestamp_ntz, price double, volume long")


def test_ties_follow_the_tie_column(ticks):
    rows = {(r.symbol, r.date): r for r in ohlcv_bars(ticks, "5m", tie_break="id").collect()}
    bar = rows["A", datetime(2024, 1, 1, 9, 0)]
    assert (bar.open, bar.high, bar.low, bar.close, bar.volume) == (10.0, 11.0, 8.0, 9.0, 11)
    assert len(rows) == 3
    by_price = {(r.symbol, r.date): r for r in ohlcv_bars(ticks, "5m").collect()}
    assert by_price == rows


@pytest.mark.parametrize(
    "interval, dates",
    [
        ("1d", {date(2024, 1, 1), date(2024, 1, 8), date(2023, 12, 31)}),
        ("1wk", {date(2024, 1, 1), date(2024, 1, 8), date(2023, 12, 25)}),
        ("1mo", {date(2024, 1, 1), date(2023, 12, 1)}),
        ("2m", {datetime(2024, 1, 1, 9, 0), datetime(2024, 1, 1, 9, 4), datetime(2024, 1, 8), datetime(2023, 12, 31, 23, 58)}),
    ],
)
def test_intervals(ticks, interval, dates):
    made = ohlcv_bars(ticks, interval, tie_break="id")
    assert made.columns == ["symbol", "date", "open", "high", "low", "close", "volume"]
    assert {r.date for r in made.collect()} == dates


def test_periods_and_symbols(ticks):
    assert {r.symbol for r in ohlcv_bars(ticks, symbols=["b "]).collect()} == {"B"}
    assert ohlcv_bars(ticks, period="5d").count() == 1
    assert ohlcv_bars(ticks, period="ytd").count() == 2
    assert ohlcv_bars(ticks, period="5d", as_of=datetime(2024, 1, 2)).count() == 2
    for bad in ({"interval": "3m"}, {"period": "7y"}):
        with pytest.raises(ValueError):
            ohlcv_bars(ticks, **bad)


def test_bars_are_folded_in_hash_tables(ticks):
    assert "SortAggregate" not in plan(ohlcv_bars(ticks, "1d", tie_break="id"))
