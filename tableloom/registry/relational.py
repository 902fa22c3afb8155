"""Scans, listings, aggregation, deduplication, enrichment and bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.functions.labels import magnitude_label, symbol_array
from tableloom.operators import bars, enrich, listing, transform
from tableloom.operators.order import order_key
from tableloom.operators.transform import Aggregation, OrderBy
from tableloom.registry.sql import load
from tableloom.session import new_work_path
from tableloom.sinks.catalog import Catalog

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# --- scans and listings --------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey FROM orders")
def scan_orders(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey", "o_custkey")


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page_orders(spark, sf):
    return listing.page(load(spark, sf, "orders"), ["o_orderkey"], page=3, per_page=50)


@query("SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100 OFFSET 1200")
def page_deep(spark, sf):
    """A page far down, found by counting key ranges instead of sorting all rows before it."""
    return listing.page(load(spark, sf, "orders"), ["o_totalprice", "o_orderkey"], page=13, per_page=100)


@query("SELECT * FROM orders ORDER BY o_orderstatus, o_orderkey LIMIT 40 OFFSET 1400")
def page_deep_ties(spark, sf):
    """The first column of the order has three values: the page is found inside one by the next column."""
    return listing.page(load(spark, sf, "orders"), ["o_orderstatus", "o_orderkey"], page=36, per_page=40)


@query(
    """SELECT * FROM (
    SELECT 'o_orderkey' AS name, 'BIGINT' AS type, 'numeric' AS kind, count(o_orderkey) AS filled, count(*) AS total FROM orders
    UNION ALL SELECT 'o_custkey', 'BIGINT', 'numeric', count(o_custkey), count(*) FROM orders
    UNION ALL SELECT 'o_orderstatus', 'VARCHAR', 'text', count(o_orderstatus), count(*) FROM orders
    UNION ALL SELECT 'o_totalprice', 'DOUBLE', 'numeric', count(o_totalprice), count(*) FROM orders
    UNION ALL SELECT 'o_orderdate', 'TIMESTAMP', 'other', count(o_orderdate), count(*) FROM orders
    UNION ALL SELECT 'o_orderpriority', 'VARCHAR', 'text', count(o_orderpriority), count(*) FROM orders)"""
)
def describe_orders(spark, sf):
    orders = load(spark, sf, "orders")
    numbers, texts = listing.numeric_columns(orders), listing.text_columns(orders)
    rows = [
        F.struct(
            F.lit(n).alias("name"),
            F.lit(t).alias("type"),
            F.lit("numeric" if n in numbers else "text" if n in texts else "other").alias("kind"),
            F.count(n).alias("filled"),
            F.count(F.lit(1)).alias("total"),
        )
        for n, t in listing.describe(orders)
    ]
    return orders.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


@query("SELECT o_orderstatus AS x, o_orderkey AS y FROM orders ORDER BY o_orderkey LIMIT 100")
def chart_series(spark, sf):
    return listing.chart_series(load(spark, sf, "orders"), ["o_orderkey"], 100)


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
    WHERE l_quantity >= 10 AND l_discount < 0.05 AND l_returnflag = 'R' AND l_linestatus <> 'O'
      AND l_linenumber <= 6 AND l_partkey > 3"""
)
def filter_condition(spark, sf):
    tests = ["l_quantity >= 10", "l_discount < 0.05", "l_returnflag == 'R'", 'l_linestatus != "O"']
    tests += ["l_linenumber <= 6", "l_partkey > 3", "no_such_field > 1"]
    rows = transform.filter_by(load(spark, sf, "lineitem"), *tests)
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query(
    """SELECT p_partkey::VARCHAR AS id, p_name AS name, p_brand AS area FROM part
    WHERE contains(lower(p_partkey::VARCHAR), 'ring') OR contains(lower(p_name), 'ring')"""
)
def search_keyword(spark, sf):
    part = load(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("area")
    )
    return listing.search(part, "RING", "id", "name", "area")


@query(
    """SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
    WHERE n_name = (SELECT n_name FROM nation WHERE n_nationkey = 7)"""
)
def category_filter(spark, sf):
    nation = load(spark, sf, "nation")
    areas = load(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    domains = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return listing.in_category(areas.select("s_suppkey", "s_name", "n_name"), "n_name", domains, 7)


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey <> 0")
def distinct_keys(spark, sf):
    return enrich.distinct_keys(load(spark, sf, "orders"), "o_custkey")


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice) * (CASE l_linenumber % 4 WHEN 0 THEN 1
        WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 1000000000 END) AS amount FROM lineitem),
      b AS (SELECT *, CASE WHEN amount >= 1e12 THEN 'T' WHEN amount >= 1e9 THEN 'B' WHEN amount >= 1e6 THEN 'M' END AS suffix,
        amount / CASE WHEN amount >= 1e12 THEN 1e12 WHEN amount >= 1e9 THEN 1e9 ELSE 1e6 END AS x FROM a)
    SELECT l_orderkey, l_linenumber, CASE WHEN suffix IS NULL THEN '$' || format('{:,.2f}', amount)
      -- an exact tie goes up; only whole eighths can be one
      WHEN x * 8 = floor(x * 8) THEN printf('$%.2f', x + 0.001) || suffix ELSE printf('$%.2f', x) || suffix END AS label
    FROM b"""
)
def magnitude_labels(spark, sf):
    scale = F.element_at(F.lit([1.0, 1e3, 1e6, 1e9]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    amount = F.floor("l_extendedprice").cast("double") * scale
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", magnitude_label(amount).alias("label"))


@query(
    """SELECT p_partkey, array_to_string([upper(trim(p_name)), upper(p_brand), upper(p_type)], '|') AS symbols FROM part"""
)
def symbol_lists(spark, sf):
    typed = F.concat(F.lit("  "), "p_name", F.lit(" , "), "p_brand", F.lit(",,\n"), "p_type", F.lit("\n "))
    return load(spark, sf, "part").select("p_partkey", F.array_join(symbol_array(typed), "|").alias("symbols"))


# --- aggregation ---------------------------------------------------------------------------


@query(
    """SELECT l_returnflag, l_linestatus, sum(l_orderkey)::BIGINT AS sum_l_orderkey, round(sum(l_quantity), 2) AS sum_qty,
      round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS min_l_discount, max(l_extendedprice) AS max_price,
      count(l_tax) AS count_l_tax, count(DISTINCT l_partkey) AS parts
    FROM lineitem GROUP BY l_returnflag, l_linestatus"""
)
def agg_group(spark, sf):
    specs = ["l_orderkey:sum", "l_quantity:sum:sum_qty", "l_extendedprice:avg:avg_price", "l_discount:min"]
    specs += ["l_extendedprice:max:max_price", "l_tax:count", "l_partkey:count_distinct:parts"]
    made = transform.aggregate(
        load(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], [Aggregation.parse(s) for s in specs]
    )
    return made.withColumns(
        {
            "sum_l_orderkey": F.col("sum_l_orderkey").cast("bigint"),
            "sum_qty": F.round("sum_qty", 2),
            "avg_price": F.round("avg_price", 4),
        }
    )


@query(
    """SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_shipdate) AS days, true AS orders_close, true AS days_close
    FROM lineitem GROUP BY l_returnflag"""
)
def agg_distinct_sketch(spark, sf):
    """Distinct counts of two snapshots merged from their sketches, next to the exact counts; close is four standard errors."""
    lines = load(spark, sf, "lineitem")
    catalog = Catalog(spark, new_work_path(spark, "catalog"))
    specs = [Aggregation("l_orderkey", "distinct_sketch", "orders_sketch"), Aggregation("l_shipdate", "distinct_sketch", "days_sketch")]
    halves = [lines.where(F.col("l_linenumber") % 2 == i) for i in (0, 1)]
    saved = [catalog.save(transform.aggregate(half, ["l_returnflag"], specs), f"half {i}") for i, half in enumerate(halves)]
    merged = transform.merge_sketches(catalog.read(saved[0]).unionByName(catalog.read(saved[1])), ["l_returnflag"], ["orders_sketch", "days_sketch"])
    exact = transform.aggregate(lines, ["l_returnflag"], [Aggregation("l_orderkey", "count_distinct", "orders"), Aggregation("l_shipdate", "count_distinct", "days")])
    close = [
        (F.abs(transform.sketch_count(f"{c}_sketch") - F.col(c)) <= 4 * transform.SKETCH_ERROR * F.col(c)).alias(f"{c}_close") for c in ("orders", "days")
    ]
    return exact.join(merged, "l_returnflag").select("l_returnflag", "orders", "days", *close)


@query(
    """SELECT o_orderstatus, sum(d) AS sum_rank, round(avg(d), 6) AS avg_rank, min(d) AS min_rank, max(d) AS max_rank,
      count(d) AS count_rank
    FROM (SELECT o_orderstatus, CAST(left(o_orderpriority, 1) AS DOUBLE) AS d FROM orders) GROUP BY o_orderstatus"""
)
def agg_text_numeric(spark, sf):
    ranked = load(spark, sf, "orders").select("o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("rank"))
    specs = [Aggregation("rank", fn, f"{fn}_rank") for fn in ("sum", "avg", "min", "max", "count")]
    return transform.aggregate(ranked, ["o_orderstatus"], specs).withColumn("avg_rank", F.round("avg_rank", 6))


@query(
    """SELECT a, count(*) AS count_o_orderkey, count(DISTINCT o_orderpriority) AS count_distinct_o_orderpriority
    FROM (SELECT *, nullif(o_custkey % 100, 0) AS a FROM orders) GROUP BY a"""
)
def agg_null_group(spark, sf):
    orders = load(spark, sf, "orders").withColumn("a", F.nullif(F.col("o_custkey") % 100, F.lit(0).cast("bigint")))
    specs = [Aggregation("o_orderkey", "count"), Aggregation("o_orderpriority", "count_distinct")]
    return transform.aggregate(orders, ["a"], specs)


@query(
    """SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first_o_totalprice,
      arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS newest_status FROM orders GROUP BY o_custkey"""
)
def agg_first_last(spark, sf):
    specs = [Aggregation("o_totalprice", "first"), Aggregation("o_orderstatus", "last", "newest_status")]
    return transform.aggregate(load(spark, sf, "orders"), ["o_custkey"], specs, ["o_orderdate", "o_orderkey"])


# --- deduplication -------------------------------------------------------------------------

_DEDUP = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
    ORDER BY {order}) AS rn FROM orders) WHERE rn = 1"""


@query(_DEDUP.format(order="o_totalprice ASC NULLS LAST, o_orderkey"))
def dedup_keep_first(spark, sf):
    return transform.dedup(load(spark, sf, "orders"), ["o_custkey"], "keep_first", OrderBy.parse("o_totalprice:asc"))


@query(_DEDUP.format(order="o_totalprice DESC NULLS LAST, o_orderkey"))
def dedup_keep_last(spark, sf):
    return transform.dedup(load(spark, sf, "orders"), ["o_custkey"], "keep_last", OrderBy.parse("o_totalprice:asc"))


@query(_DEDUP.format(order="o_orderkey DESC NULLS LAST"))
def dedup_default_order(spark, sf):
    return transform.dedup(load(spark, sf, "orders"), ["o_custkey"])


@query("SELECT * FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) = 1)")
def dedup_keep_none(spark, sf):
    return transform.dedup(load(spark, sf, "orders"), ["o_custkey"], "keep_none")


_NULLABLE = """SELECT o_orderkey, nullif(o_custkey % 500, 0) AS a,
    CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS b, o_totalprice FROM orders"""


def _nullable_orders(spark, sf):
    return load(spark, sf, "orders").select(
        "o_orderkey",
        F.nullif(F.col("o_custkey") % 500, F.lit(0).cast("bigint")).alias("a"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")).alias("b"),
        "o_totalprice",
    )


@query(
    f"""WITH o AS ({_NULLABLE})
    SELECT o.* FROM o JOIN (SELECT a, b FROM o GROUP BY a, b HAVING count(*) = 1) s
    ON o.a IS NOT DISTINCT FROM s.a AND o.b IS NOT DISTINCT FROM s.b"""
)
def dedup_keep_none_two_keys(spark, sf):
    return transform.dedup(_nullable_orders(spark, sf), ["a", "b"], "keep_none")


@query(
    f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY o_totalprice DESC NULLS LAST,
    o_orderkey) AS rn FROM ({_NULLABLE})) WHERE rn = 1"""
)
def dedup_nullable_keys(spark, sf):
    return transform.dedup(_nullable_orders(spark, sf), ["a", "b"], "keep_first", OrderBy("o_totalprice"))


# --- quotes, enrichment and bars -----------------------------------------------------------

# larger parts have no price, so they have no quote
_PART_QUOTES = """SELECT p_partkey::VARCHAR AS symbol, p_name AS "shortName", p_retailprice AS "regularMarketPrice",
    round(p_retailprice - p_size, 2) AS prev FROM part WHERE p_size <= 25"""


def _part_quotes(spark, sf):
    return enrich.build_quotes(
        load(spark, sf, "part").select(
            F.col("p_partkey").cast("string").alias("symbol"),
            F.col("p_name").alias("shortName"),
            F.when(F.col("p_size") <= 25, F.col("p_retailprice")).alias("regularMarketPrice"),
            F.round(F.col("p_retailprice") - F.col("p_size"), 2).alias("previousClose"),
        )
    )


_ENRICHED = """SELECT l.l_orderkey, l.l_linenumber, {key} AS ticker, q."shortName", q."regularMarketPrice",
    round(q."regularMarketPrice" - q.prev, 2) AS change, NULL::VARCHAR AS sector
    FROM lineitem l LEFT JOIN ({quotes}) q ON q.symbol = ({key})::VARCHAR AND ({key}) <> 0"""


def _enriched(spark, sf, key, **options):
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", key.alias("ticker"))
    columns = ["shortName", "regularMarketPrice", "change", "sector"]
    return enrich.enrich(lines, "ticker", _part_quotes(spark, sf), columns, **options)


@query(_ENRICHED.format(key="l.l_partkey", quotes=_PART_QUOTES))
def enrich_left(spark, sf):
    return _enriched(spark, sf, F.col("l_partkey"))


@query(
    f"""SELECT t.ticker, q.regularMarketPrice AS "regularMarketPrice", count(*) AS n
    FROM (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'P2' ELSE 'P' || l_partkey END AS ticker FROM lineitem) t
    LEFT JOIN (SELECT 'P' || p_partkey AS symbol, p_retailprice AS regularMarketPrice FROM part WHERE p_partkey % 3 <> 0) q
      ON t.ticker = q.symbol GROUP BY ALL"""
)
def enrich_only_ticker(spark, sf):
    """Rows that are nothing but their ticker, half of them alike, looked up without a broadcast."""
    hot = F.when(F.col("l_orderkey") % 2 == 0, F.lit(2).cast("bigint")).otherwise(F.col("l_partkey"))
    rows = load(spark, sf, "lineitem").select(F.concat(F.lit("P"), hot.cast("string")).alias("ticker"))
    part = load(spark, sf, "part").where(F.col("p_partkey") % 3 != 0)
    quotes = part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_retailprice").alias("regularMarketPrice"))
    made = enrich.enrich(rows, "ticker", quotes, ["regularMarketPrice"], broadcast_rows=0)
    return made.groupBy("ticker", "regularMarketPrice").agg(F.count(F.lit(1)).alias("n"))


@query(_ENRICHED.format(key="CASE WHEN l.l_orderkey % 3 = 0 THEN 2 ELSE l.l_partkey END", quotes=_PART_QUOTES))
def enrich_hot_ticker(spark, sf):
    """A third of all rows share one ticker, and the quotes count as too large to broadcast."""
    hot = F.when(F.col("l_orderkey") % 3 == 0, F.lit(2).cast("bigint")).otherwise(F.col("l_partkey"))
    return _enriched(spark, sf, hot, broadcast_rows=0)


@query(
    """SELECT upper(event_type) AS symbol, upper(event_type) AS "shortName", '' AS "longName", price AS "regularMarketPrice",
      prev AS "previousClose", round(price - prev, 2) AS change,
      CASE WHEN prev = 0 THEN 0 ELSE round(round(price - prev, 2) / prev * 100, 2) END AS "changePercent",
      high AS "dayHigh", low AS "dayLow", n AS volume, NULL::DOUBLE AS "marketCap", 'USD' AS currency
    FROM (SELECT event_type, arg_max(value, (ts, event_id)) AS price, arg_min(value, (ts, event_id)) AS prev,
      max(value) AS high, min(value) AS low, count(*) AS n FROM events GROUP BY event_type)"""
)
def quote_snapshot(spark, sf):
    events = load(spark, sf, "events")
    when = order_key(events, ["ts", "event_id"])
    raw = events.groupBy(F.col("event_type").alias("symbol")).agg(
        F.max_by("value", when).alias("regularMarketPrice"),
        F.min_by("value", when).alias("previousClose"),
        F.max("value").alias("dayHigh"),
        F.min("value").alias("dayLow"),
        F.count(F.lit(1)).alias("volume"),
    )
    return enrich.quote_snapshot(raw, "view, signup ,Click\nerror,,PURCHASE,unknown")


@query(
    """WITH raw AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN 0 ELSE NULL END AS market,
        CASE event_id % 4 WHEN 1 THEN value ELSE NULL END AS last,
        CASE event_id % 4 WHEN 2 THEN value ELSE NULL END AS market_close, nullif(user_id % 5, 1)::DOUBLE AS prev FROM events),
      p AS (SELECT event_id, coalesce(nullif(market, 0), last) AS live, nullif(market_close, 0) AS closed, nullif(prev, 0) AS prev FROM raw),
      q AS (SELECT event_id, coalesce(live, closed) AS price, CASE WHEN live IS NULL THEN closed ELSE coalesce(prev, live) END AS prev FROM p)
    SELECT 'E' || event_id AS symbol, price AS "regularMarketPrice", prev AS "previousClose", round(price - prev, 2) AS change,
      CASE WHEN prev = 0 THEN 0 ELSE round(round(price - prev, 2) / prev * 100, 2) END AS "changePercent", 'USD' AS currency
    FROM q WHERE price IS NOT NULL"""
)
def quote_fallbacks(spark, sf):
    kind, value = F.col("event_id") % 4, F.col("value")
    raw = load(spark, sf, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("symbol"),
        F.when(kind == 0, value).when(kind == 1, F.lit(0.0)).alias("regularMarketPrice"),
        F.when(kind == 1, value).alias("last_price"),
        F.when(kind == 2, value).alias("regularMarketPreviousClose"),
        F.nullif(F.col("user_id") % 5, F.lit(1).cast("bigint")).cast("double").alias("previousClose"),
    )
    columns = ["symbol", "regularMarketPrice", "previousClose", "change", "changePercent", "currency"]
    return enrich.build_quotes(raw).select(*columns)


_BARS = """SELECT upper(event_type) AS symbol, {start} AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
    min(value) AS low, arg_max(value, (ts, event_id)) AS close, sum(user_id)::BIGINT AS volume
    FROM events {where} GROUP BY 1, 2"""
_MINUTES = "make_timestamp((epoch_us(ts) // {us}) * {us})"


def _bars(spark, sf, interval, period="max", **options):
    return bars.ohlcv_bars(
        load(spark, sf, "events"), interval, period,
        symbol="event_type", price="value", volume="user_id", tie_break="event_id", **options,
    )


@query(_BARS.format(start="ts::DATE", where=""))
def ohlcv_bars_1d(spark, sf):
    return _bars(spark, sf, "1d", symbols=["view", "click", "error", "signup", "purchase"])


@query(_BARS.format(start=_MINUTES.format(us=3_600_000_000), where=""))
def ohlcv_bars_60m(spark, sf):
    return _bars(spark, sf, "60m")


@query(_BARS.format(start=_MINUTES.format(us=300_000_000), where=""))
def ohlcv_bars_5m(spark, sf):
    return _bars(spark, sf, "5m")


def _minute_bars(minutes: int):
    """The remaining intervals below an hour, registered alike."""

    def bars_of(spark, sf):
        return _bars(spark, sf, f"{minutes}m")

    bars_of.__name__ = f"ohlcv_bars_{minutes}m"
    return query(_BARS.format(start=_MINUTES.format(us=minutes * 60_000_000), where=""))(bars_of)


def _last_bars(period: str, span: str):
    def bars_of(spark, sf):
        return _bars(spark, sf, "1d", period)

    bars_of.__name__ = f"ohlcv_last_{period}"
    return query(_BARS.format(start="ts::DATE", where=f"WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {span}"))(bars_of)


for _minutes in (1, 2, 15, 30):
    _minute_bars(_minutes)
for _period, _span in (("1d", "1 DAY"), ("1mo", "1 MONTH"), ("3mo", "3 MONTH"), ("6mo", "6 MONTH"), ("1y", "1 YEAR"), ("2y", "2 YEAR"), ("5y", "5 YEAR"), ("10y", "10 YEAR")):
    _last_bars(_period, _span)


@query(_BARS.format(start="DATE '1970-01-01' + (epoch_us(ts) // 86400000000 // 5 * 5)::INT", where=""))
def ohlcv_bars_5d(spark, sf):
    return _bars(spark, sf, "5d")


@query(_BARS.format(start="date_trunc('week', ts)::DATE", where=""))
def ohlcv_bars_1wk(spark, sf):
    return _bars(spark, sf, "1wk")


@query(_BARS.format(start="date_trunc('month', ts)::DATE", where=""))
def ohlcv_bars_1mo(spark, sf):
    return _bars(spark, sf, "1mo")


@query(_BARS.format(start="ts::DATE", where="WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY"))
def ohlcv_last_5d(spark, sf):
    return _bars(spark, sf, "1d", "5d")


@query(_BARS.format(start="ts::DATE", where="WHERE ts >= (SELECT date_trunc('year', max(ts)) FROM events)"))
def ohlcv_ytd(spark, sf):
    return _bars(spark, sf, "1d", "ytd")
