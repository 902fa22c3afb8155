"""Imports, exports and the catalog, written to a fresh folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.operators.transform import Aggregation
from tableloom.plans.generate import generate
from tableloom.plans.spec import DatasetSpec, Field, Request
from tableloom.registry.generation import AS_OF, SEED
from tableloom.registry.sql import draws, load
from tableloom.session import new_work_path
from tableloom.sinks.catalog import Catalog
from tableloom.sinks.export import export
from tableloom.sources.csv import import_csv, list_csv

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return register


# --- files ---------------------------------------------------------------------------------


@query("SELECT * REPLACE (c_nationkey::BIGINT AS c_nationkey) FROM customer")
def csv_roundtrip(spark, sf) -> DataFrame:
    path = export(load(spark, sf, "customer"), new_work_path(spark, "csv"), "all customers", "1", "csv")
    return import_csv(spark, path)


_NOTES = """SELECT o_orderkey AS id, 'line "one" of ' || o_orderkey || chr(10) || 'second; line, ' || o_orderpriority AS note,
    o_totalprice AS price FROM orders"""


@query(_NOTES)
def csv_line_breaks(spark, sf):
    """Values with quotes, separators and line breaks survive an export to one file and an import by many tasks."""
    note = F.concat(F.lit('line "one" of '), F.col("o_orderkey").cast("string"), F.lit("\nsecond; line, "), "o_orderpriority")
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), note.alias("note"), F.col("o_totalprice").alias("price"))
    return import_csv(spark, export(rows.coalesce(1), new_work_path(spark, "notes"), "notes", "1", "csv"))


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier")
def csv_swapped_columns(spark, sf):
    """Files with the same columns in another order are matched by name."""
    rows = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    path = new_work_path(spark, "swapped")
    rows.where("id % 2 = 0").write.option("header", True).csv(f"{path}/even")
    rows.where("id % 2 = 1").select("balance", "id", "name").write.option("header", True).csv(f"{path}/odd")
    return import_csv(spark, f"{path}/*")


@query(
    """SELECT o_orderkey AS id, 'a "quoted"' || chr(13) || chr(10) || 'note; of ' || o_orderkey AS note FROM orders
    ORDER BY o_orderkey // (SELECT 1 + max(o_orderkey) // 7 FROM orders), o_orderkey LIMIT 1000"""
)
def csv_first_rows(spark, sf):
    """A cap over several files keeps the first files' rows, by name and then by line, line breaks in values or not."""
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    part = F.expr("id div (1 + bigint(top) div 7)")
    note = F.concat(F.lit('a "quoted"\r\nnote; of '), F.col("id").cast("string"))
    top = orders.agg(F.max("id").alias("top"))
    rows = orders.withColumn("top", top.scalar()).select("id", note.alias("note"), part.alias("part"))
    path = new_work_path(spark, "files")
    ordered = rows.repartition("part").sortWithinPartitions("part", "id")
    ordered.write.partitionBy("part").option("header", True).option("escape", '"').csv(path)
    return import_csv(spark, f"{path}/*", max_rows=1000)


@query("SELECT 700::BIGINT AS rows, 700::BIGINT AS known")
def csv_max_rows(spark, sf):
    """A cap keeps that many rows of the files, whichever tasks hold them."""
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    kept = import_csv(spark, export(rows.repartition(9, "id"), new_work_path(spark, "capped"), "capped", "1", "csv"), max_rows=700)
    known = kept.join(rows, ["id", "price"], "left_semi").agg(F.count(F.lit(1)).alias("known"))
    return kept.agg(F.count(F.lit(1)).alias("rows")).withColumn("known", known.scalar())


@query("SELECT * FROM customer")
def parquet_roundtrip(spark, sf):
    path = export(load(spark, sf, "customer"), new_work_path(spark, "parquet"), "customers", "1", "parquet")
    return spark.read.parquet(path)


@query("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status, o_totalprice FROM orders")
def json_roundtrip(spark, sf):
    rows = load(spark, sf, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"), "o_totalprice"
    )
    path = export(rows, new_work_path(spark, "json"), "orders", "1", "jsonl")
    return spark.read.schema(rows.schema).json(path)


@query(
    """SELECT o_orderkey AS first_name, o_totalprice AS _2col, o_orderdate::DATE AS _select, o_custkey % 2 = 0 AS ab,
      nullif(o_orderpriority, '5-LOW') AS uni, o_orderdate + INTERVAL 1 HOUR AS moment,
      CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE (o_orderkey % 3)::VARCHAR END AS mixed
    FROM orders WHERE o_orderkey % 10 <> 9"""
)
def csv_import_dirty(spark, sf):
    """Lines with odd headers and blanks; every tenth line is short and must not widen a type."""
    key = F.col("o_orderkey")
    good = F.concat_ws(
        ",",
        key.cast("string"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
        F.date_format("o_orderdate", "yyyy-MM-dd"),
        (F.col("o_custkey") % 2 == 0).cast("string"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("")).otherwise(F.col("o_orderpriority")),
        F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd HH:mm:ss"),
        F.when(key % 3 == 0, F.lit("x")).otherwise((key % 3).cast("string")),
    )
    line = F.when(key % 10 == 9, F.lit("broken,line")).otherwise(good)
    path = new_work_path(spark, "dirty")
    header = "First Name,2col,select,a-b,Ünï,Moment,mixed"
    plain = load(spark, sf, "orders").select(line.alias(header)).write.option("header", True)
    plain.option("quote", "").option("sep", "\u0001").csv(path)
    return import_csv(spark, path)


@query("SELECT sum(length(c_custkey || ',' || c_name || ',' || c_mktsegment) + 1)::BIGINT AS bytes, true AS named FROM customer")
def csv_listing(spark, sf):
    """The size of the CSV files of an export, less their header lines."""
    customers = load(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    path = export(customers, new_work_path(spark, "listing"), "customers", "1", "csv")
    header = len(",".join(customers.columns)) + 1
    return list_csv(spark, path).agg(
        F.sum(F.col("size") - header).alias("bytes"), F.every(F.col("name").endswith(".csv")).alias("named")
    )


# --- pages ---------------------------------------------------------------------------------


@query(
    """SELECT o_orderkey, o_orderpriority, o_orderdate, true AS few_files FROM orders
    ORDER BY o_orderpriority, o_orderkey LIMIT 100 OFFSET ((SELECT count(*) FROM orders) * 3 // 4 // 100 * 100)"""
)
def page_indexed(spark, sf):
    """A deep page of a snapshot saved in page order: its index names the files to open."""
    catalog = Catalog(spark, new_work_path(spark, "catalog"))
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    order = ("o_orderpriority", "o_orderkey")
    saved = catalog.save(orders, "orders", page_order=order)
    total = catalog.get(saved)["row_count"]
    page, _ = catalog.rows(saved, order, total * 3 // 4 // 100 + 1, 100)
    return page.withColumn("few_files", F.lit(len(page.inputFiles()) <= 3))


# --- catalog -------------------------------------------------------------------------------


@query(
    """SELECT 'people' AS name, (SELECT count(*) FROM customer) AS row_count,
      'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns, true AS stored
    UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), 'n_nationkey,n_name,n_regionkey', true"""
)
def catalog_lifecycle(spark, sf):
    """Save three snapshots, rename one, delete one, list the rest."""
    catalog = Catalog(spark, new_work_path(spark, "catalog"))
    ids = {t: catalog.save(load(spark, sf, t), t) for t in ("customer", "nation", "supplier")}
    catalog.rename(ids["customer"], "people")
    catalog.delete(ids["supplier"])
    stored = {i: catalog.read(i).count() for t, i in ids.items() if t != "supplier"}
    return catalog.list_datasets().select(
        "name",
        "row_count",
        F.array_join("columns", ",").alias("columns"),
        F.col("row_count").isin(list(stored.values())).alias("stored"),
    )


@query(
    """SELECT 4::BIGINT AS datasets, 2::BIGINT AS templates, 2::BIGINT AS runs,
      (SELECT count(*) FROM orders) * 2 + (SELECT count(DISTINCT o_orderstatus) FROM orders) AS total_rows"""
)
def catalog_totals(spark, sf):
    """A run of two generated datasets, an aggregate, and a dataset without rows."""
    catalog = Catalog(spark, new_work_path(spark, "catalog"))
    orders = load(spark, sf, "orders")
    fields = (Field("age", "random_int", "integer"),)
    rows = orders.count()
    request = Request((DatasetSpec("a", rows, fields), DatasetSpec("b", rows, fields)), seed=SEED)
    made = generate(spark, request, AS_OF)
    catalog.save_run(made.datasets, request.homogeneity, made.seed)
    statuses = orders.select("o_orderstatus").distinct()
    catalog.save(statuses, "statuses")
    catalog.save(orders.where(F.lit(False)), "none")
    return catalog.totals(templates=2)


_RUN_AGE = draws("SELECT unnest(range((SELECT count(*) FROM orders))) AS i", ["i"], {"age": (SEED, "age", 0)})


@query(f"SELECT 1::BIGINT AS run_id, count(*) AS row_count, sum(age % 1000000)::BIGINT AS ages FROM ({_RUN_AGE})")
def catalog_run(spark, sf):
    """A saved run read back: its id, its rows and the sum of a generated column."""
    catalog = Catalog(spark, new_work_path(spark, "catalog"))
    spec = DatasetSpec("a", load(spark, sf, "orders").count(), (Field("age", "random_int", "integer"),))
    request = Request((spec,), homogeneity=100, seed=SEED)
    run_id, ids = catalog.save_run(generate(spark, request, AS_OF).datasets, 100, SEED)
    read = catalog.read(ids["a"]).agg(F.sum("age").alias("ages"))
    runs = catalog.runs().where(F.col("run_id") == run_id).select("run_id", "row_count")
    return runs.withColumn("ages", read.scalar())


@query(
    """SELECT 'by status' AS name, (SELECT count(DISTINCT o_orderstatus) FROM orders) AS row_count, 'o_orderstatus' AS grouped, NULL AS strategy
    UNION ALL SELECT 'latest', (SELECT count(DISTINCT o_custkey) FROM orders), NULL, 'keep_last'"""
)
def lineage_log(spark, sf):
    """An aggregate and a deduplication of one snapshot, joined to their logged settings."""
    catalog = Catalog(spark, new_work_path(spark, "catalog"))
    source = catalog.save(load(spark, sf, "orders"), "orders")
    catalog.aggregate(source, "by status", ["o_orderstatus"], [Aggregation("o_totalprice", "sum")])
    catalog.dedup(source, "latest", ["o_custkey"], "keep_last")
    logged = catalog.transforms().select(
        "name",
        F.get_json_object("config_json", "$.group_by[0]").alias("grouped"),
        F.get_json_object("config_json", "$.strategy").alias("strategy"),
    )
    return logged.join(catalog.datasets().select("name", "row_count"), "name")


@query("SELECT name, row_count FROM (VALUES (1, 'nation', (SELECT count(*) FROM nation)), (2, 'customer', (SELECT count(*) FROM customer))) t(i, name, row_count)")
def catalog_recent(spark, sf):
    """The two newest of three saved snapshots."""
    catalog = Catalog(spark, new_work_path(spark, "catalog"))
    for table in ("supplier", "customer", "nation"):
        catalog.save(load(spark, sf, table), table)
    return catalog.recent(2).select("name", "row_count")
