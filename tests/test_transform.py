from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableloom.operators import listing, transform
from tableloom.operators.order import order_key
from tableloom.operators.transform import Aggregation, OrderBy, aggregate, dedup, filter_by
from tests.conftest import plan


@pytest.fixture(scope="module")
def sales(spark):
    rows = [("A", 1, "5"), ("A", 4, "7"), ("B", None, "1.5"), (None, 2, None), ("B", 3, "2")]
    return spark.createDataFrame(rows, "category string, value long, text string")


def test_all_functions(sales):
    specs = [Aggregation("value", f) for f in ("sum", "avg", "min", "max", "count", "count_distinct", "first", "last")]
    made = aggregate(sales, ["category"], specs, ["value"])
    rows = {r.category: r for r in made.collect()}
    assert made.columns == ["category"] + [f"{s.function}_value" for s in specs]
    a = rows["A"]
    assert (a.sum_value, a.avg_value, a.min_value, a.max_value, a.count_value, a.count_distinct_value) == (5, 2.5, 1, 4, 2, 2)
    assert (a.first_value, a.last_value) == (1, 4) and rows["B"].count_value == 1 and rows[None].sum_value == 2
    assert rows["B"].first_value is None  # NULL is the smallest here and stays


def test_sum_of_large_integers_does_not_overflow(spark):
    big = spark.range(4).select(F.lit(1).alias("k"), F.lit(2**63 - 1).alias("v"))
    assert int(aggregate(big, ["k"], [Aggregation("v", "sum")]).first().sum_v) == 4 * (2**63 - 1)


def test_text_as_numbers(sales, spark):
    made = aggregate(sales, ["category"], [Aggregation("text", "max"), Aggregation("text", "count")])
    assert {r.category: r.max_text for r in made.collect()} == {"A": 7.0, "B": 2.0, None: None}
    words = spark.createDataFrame([("x", "word")], "k string, v string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        aggregate(words, ["k"], [Aggregation("v", "sum")]).collect()
    assert aggregate(words, ["k"], [Aggregation("v", "min")], numeric_text=False).first().min_v == "word"


def test_aggregate_specs():
    assert Aggregation.parse("value:sum:total") == Aggregation("value", "sum", "total")
    assert Aggregation.parse("value:sum").name == "sum_value"
    for bad in ("value", "a:b:c:d", "value:median", "bad name:sum", "value:sum:bad name"):
        with pytest.raises(ValueError):
            Aggregation.parse(bad)
    assert OrderBy.parse("a") == OrderBy("a", "desc") and OrderBy.parse("a:asc").direction == "asc"
    with pytest.raises(ValueError):
        OrderBy.parse("a:up")


def test_aggregate_needs_groups_and_functions(sales):
    for groups, specs in (([], [Aggregation("value", "sum")]), (["category"], [])):
        with pytest.raises(ValueError):
            aggregate(sales, groups, specs)


def test_dedup_strategies(sales):
    def kept(strategy, order=None):
        return {(r.category, r.value) for r in dedup(sales, ["category"], strategy, order).collect()}

    by_value = OrderBy("value")
    assert kept("keep_first", by_value) == {("A", 4), ("B", 3), (None, 2)}
    assert kept("keep_last", by_value) == {("A", 1), ("B", 3), (None, 2)}
    assert kept("keep_first", OrderBy("value", "asc")) == {("A", 1), ("B", 3), (None, 2)}
    assert kept("keep_none") == set()  # a single NULL key is no key


def test_keep_none_nulls_in_composite_keys(spark):
    rows = [(None, 1, 1), (2, 2, 2), (2, 2, 3), (3, None, 4), (None, None, 5)]
    df = spark.createDataFrame(rows, "a int, b int, v int")
    assert {r.v for r in dedup(df, ["a", "b"], "keep_none").collect()} == {1, 4, 5}
    assert {r.v for r in dedup(df, ["a"], "keep_none").collect()} == {4}
    assert dedup(df, ["a", "b", "v"], "keep_none").count() == 5


def test_dedup_default_order_and_helper_names(spark):
    df = spark.createDataFrame([(1, "k", 9), (2, "k", 8)], "id int, key string, _rank int")
    made = dedup(df, ["key"])
    assert made.columns == df.columns and [tuple(r) for r in made.collect()] == [(2, "k", 8)]


def test_dedup_folds_hot_keys_before_the_shuffle(spark):
    hot = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    text = plan(dedup(hot, ["k"]))
    assert text.index("Exchange") < text.rindex("WindowGroupLimit")
    assert "Window " not in plan(dedup(hot, ["k"], "keep_none"))


def test_dedup_errors(sales):
    for keys, strategy in (([], "keep_first"), (["category"], "keep_all"), (["bad name"], "keep_first")):
        with pytest.raises(ValueError):
            dedup(sales, keys, strategy)


def test_filters_reach_the_scan(spark, sf):
    made = filter_by(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_quantity >= 10", "l_returnflag == 'R'")
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan(made) and "EqualTo(l_returnflag,R)" in plan(made)
    assert filter_by(made, "missing > 1") is made


# --- listings ------------------------------------------------------------------------------


def test_pages(spark):
    df = spark.range(250).repartition(5)
    assert [r.id for r in listing.page(df, ["id"], 3, 100).collect()] == list(range(200, 250))
    assert listing.page(df, ["id"], 9, 100).count() == 0
    for page, size in ((0, 10), (1, 0), (1, 1001)):
        with pytest.raises(ValueError):
            listing.page(df, ["id"], page, size)


@pytest.mark.parametrize("page", [1, 7, 50, 99, 100, 101])
def test_deep_pages_skip_by_key_range(spark, monkeypatch, page):
    monkeypatch.setattr(listing, "NEAR_ROWS", 100)
    monkeypatch.setattr(listing, "SPLITS", 7)
    df = spark.range(1000).select((F.col("id") / 3).cast("int").alias("k"), "id").repartition(5)
    expected = [(i // 3, i) for i in range((page - 1) * 10, min(1000, page * 10))]
    assert [tuple(r) for r in listing.page(df, ["k", "id"], page, 10).collect()] == expected


@pytest.mark.parametrize(
    "key",
    [
        "concat('Customer#', lpad(id, 9, '0'))",
        "CASE WHEN id > 300 THEN repeat('é', int(id / 100)) END",
        "CASE WHEN id > 100 THEN id - 500 END",
        "id * -0.5D",
        "date_add(DATE '2024-01-01', int(id / 9))",
        "timestamp_seconds(id * 1000)",
        "CAST(timestamp_seconds(id * 1000) AS TIMESTAMP_NTZ)",
        "CAST(NULL AS STRING)",
    ],
)
def test_deep_pages_by_any_kind_of_key(spark, monkeypatch, tmp_path, key):
    monkeypatch.setattr(listing, "NEAR_ROWS", 50)
    monkeypatch.setattr(listing, "SPLITS", 9)
    df = spark.range(1000).select(F.expr(key).alias("k"), "id").repartition(4)
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    expected = [tuple(r) for r in stored.orderBy("k", "id").collect()]
    for page in (1, 6, 23, 50, 51):
        found = [tuple(r) for r in listing.page(stored, ["k", "id"], page, 20).collect()]
        assert found == expected[(page - 1) * 20 : page * 20]


def test_deep_page_of_one_repeated_key(spark, monkeypatch):
    monkeypatch.setattr(listing, "NEAR_ROWS", 10)
    df = spark.range(100).select(F.lit(1).alias("k"), "id")
    assert [r.id for r in listing.page(df, ["k", "id"], 5, 10).collect()] == list(range(40, 50))


def test_describe_and_chart(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert ("ts", "TIMESTAMP") in listing.describe(events) and ("value", "DOUBLE") in listing.describe(events)
    assert listing.numeric_columns(events) == ["event_id", "user_id", "value"]
    made = listing.chart_series(events, ["event_id"], 100)
    assert made.columns == ["x", "y"] and made.count() == 100
    with pytest.raises(ValueError):
        listing.chart_series(events.select("ts"), ["ts"], 100)


def test_search_keeps_one_row_per_id(spark):
    df = spark.createDataFrame([("b.1", "Pay", "X"), ("b.1", "Payment", "X"), ("a.1", "Other", "Y"), ("p.PAY", "z", "A")], "id string, name string, area string")
    assert [(r.area, r.id) for r in listing.search(df, "pay", "id", "name", "area").collect()] == [("A", "p.PAY"), ("X", "b.1")]


def test_newest(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", None)], "n string, t int")
    assert [r.n for r in listing.newest(df, "t").collect()] == ["b", "a", "c"]
    assert [r.n for r in listing.newest(df, "t", 1).collect()] == ["b"]


def test_unknown_category_gives_nothing(spark):
    domains = spark.createDataFrame([("1", "X")], "id string, name string")
    rows = spark.createDataFrame([("X",), ("Y",)], "area string")
    assert listing.in_category(rows, "area", domains, "1").count() == 1
    assert listing.in_category(rows, "area", domains, "9").count() == 0


# --- order keys ----------------------------------------------------------------------------

_TIMES = st.one_of(st.none(), st.datetimes(datetime(1, 1, 2), datetime(9999, 12, 30)))
_LONGS = st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1), st.sampled_from([0, 1, -1]))


@given(st.lists(st.tuples(_TIMES, _LONGS), min_size=2, max_size=40))
@settings(max_examples=10, deadline=None)
def test_packed_order_is_the_order_of_the_columns(spark, rows):
    df = spark.createDataFrame(rows, "t timestamp_ntz, n long")
    packed = df.withColumn("key", order_key(df, ["t", "n"]))
    assert dict(packed.dtypes)["key"] == "decimal(38,0)"
    found = [(r.t, r.n) for r in packed.orderBy("key").collect()]
    assert found == sorted(rows, key=lambda r: tuple((v is not None, v) if v is not None else (False,) for v in r))


def test_orders_that_do_not_fit_stay_structs(spark):
    df = spark.createDataFrame([(1, 2, "x", 1.5)], "a long, b long, s string, d double")
    for columns in (["a", "b"], ["s"], ["d", "a"]):
        assert df.select(order_key(df, columns).alias("k")).dtypes[0][1].startswith("struct")


def test_first_and_last_are_folded_in_hash_tables(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    made = aggregate(orders, ["o_custkey"], [Aggregation("o_totalprice", "first")], ["o_orderdate", "o_orderkey"])
    assert "SortAggregate" not in plan(made)


def test_sketches_count_and_merge(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 20_000).alias("n"), (F.col("id") % 7 / 2).alias("d"), F.lit(None).cast("int").alias("z"))
    counts = transform.aggregate(rows, ["k"], [Aggregation(c, "count_distinct_approx", c) for c in ("n", "d", "z")]).collect()
    exact = {r.k: r.n for r in rows.groupBy("k").agg(F.count_distinct("n").alias("n")).collect()}
    assert all(abs(r.n - exact[r.k]) <= 4 * transform.SKETCH_ERROR * exact[r.k] and (r.d, r.z) == (7, 0) for r in counts)
    parts = [transform.aggregate(rows.where(test), ["k"], [Aggregation("n", "distinct_sketch", "s")]) for test in ("n < 9000", "n >= 5000")]
    merged = transform.merge_sketches(parts[0].unionByName(parts[1]), ["k"], ["s"]).select("k", transform.sketch_count("s").alias("n")).collect()
    whole = transform.aggregate(rows, ["k"], [Aggregation("n", "distinct_sketch", "s")]).select("k", transform.sketch_count("s").alias("n")).collect()
    assert sorted(map(tuple, merged)) == sorted(map(tuple, whole))


def test_sketches_see_one_zero_and_all_types(spark):
    rows = spark.sql("SELECT 1 AS k, * FROM VALUES (0.0D, DATE '2024-01-01', 1.50BD, true), (-0.0D, DATE '2024-01-01', 1.5BD, false), (NULL, NULL, NULL, NULL) t(a, b, c, d)")
    found = transform.aggregate(rows, ["k"], [Aggregation(c, "count_distinct_approx", c) for c in "abcd"]).first()
    assert tuple(found) == (1, 1, 1, 1, 2)
