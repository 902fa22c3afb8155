"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom import registry
from tableloom.plans.generate import Run, flat_dataset
from tableloom.plans.spec import DatasetSpec, Field
from tableloom.session import configure

HEADLINE = (
    "gen_person gen_numbers gen_formula gen_uuid gen_text gen_grouped gen_shared_key gen_shared_key_repeats gen_overlap "
    "agg_group agg_first_last dedup_keep_first dedup_keep_none dedup_nullable_keys enrich_left enrich_hot_ticker "
    "ohlcv_bars_60m filter_condition html_anchors xsd_fields xml_template_fields field_map_words csv_roundtrip "
    "csv_import_dirty json_roundtrip"
).split()


def names_by_15(spark: SparkSession, sf: str) -> DataFrame:
    """Fifteen ``name`` columns for every line item: six times 100,000 rows at sf0.1."""
    spec = DatasetSpec("names", 1, tuple(Field(f"name_{i}", "name") for i in range(15)))
    ids = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return flat_dataset(spark, spec, Run(42, homogeneity=100), row_ids=ids)


def names_100k_by_15(spark: SparkSession, sf: str) -> DataFrame:
    """The reference's own benchmark shape: 100,000 rows of fifteen ``name`` columns."""
    spec = DatasetSpec("names", 100_000, tuple(Field(f"name_{i}", "name") for i in range(15)))
    return flat_dataset(spark, spec, Run(42, homogeneity=100))


def timed(fn, spark: SparkSession, sf: str) -> float:
    """The better of two runs, planning included; every row and column is produced."""
    runs = []
    for _ in range(2):
        start = time.perf_counter()
        fn(spark, sf).write.format("noop").mode("overwrite").save()
        runs.append(time.perf_counter() - start)
    return round(min(runs), 3)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = registry.queries()
    todo = {"names_100k_by_15": names_100k_by_15, "names_by_15": names_by_15, **{n: known[n] for n in HEADLINE}}
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start the executor threads
    found = {name: timed(fn, spark, sf) for name, fn in todo.items()}
    total = round(sum(found.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": found, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
