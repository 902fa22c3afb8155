"""Check every registered query against its SQL: python tests/check_all.py [sf dir] [name part ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from tableloom.registry import oracles, queries  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf), oracles(), []
    for name, fn in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            problem = compare(fn(spark, sf), con, sql[name]) if name in sql else f"rows only: {fn(spark, sf).count()}"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        took = time.time() - start
        ok = problem is None or problem.startswith("rows only")
        bad += [] if ok else [name]
        print(f"{'ok  ' if ok else 'BAD '} {name} {took:.2f}s {problem or ''}", flush=True)
    print("failed:", bad)
