"""Snapshots in page order with a side table of their files, so that a page opens the files it lies in and no other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableloom.operators.listing import MAX_PER_PAGE

FILE_ROWS = 100_000  # rows of a file at most
_FILE = r"part-(\d+)-.*?(?:-c(\d+))?\.[^-]*$"  # the writer's task, and its file in it


def write_ordered(df: DataFrame, path: str, order: Sequence[str], file_rows: int = FILE_ROWS) -> None:
    """Write a new snapshot whose files follow each other in ``order`` (ascending, NULL first).

    Rows alike in ``order`` are kept apart by a hash of the others, so a value that most rows share fills many files,
    also in different tasks; a file holds ``file_rows`` rows at most.
    """
    rest = [c for c in df.columns if c not in order and "map<" not in df.schema[c].dataType.simpleString()]
    keys = [F.col(c) for c in order] + ([F.xxhash64(*rest)] if rest else [])
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged.write.mode("errorifexists").option("maxRecordsPerFile", file_rows).parquet(path)


def write_index(spark: SparkSession, snapshot: str, path: str, order: Sequence[str]) -> int:
    """Write one row per file of an ordered snapshot: name, rows, rows before it, first and last key; the rows of all.

    Only the columns of ``order`` are read. The running sum goes over one small row per file.
    """
    rows = spark.read.parquet(snapshot)
    name = F.col("_metadata.file_name")
    key = F.struct(*order)
    files = rows.select(name.alias("file"), key.alias("key")).groupBy("file")
    files = files.agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("first"), F.max("key").alias("last"))
    place = [F.regexp_extract("file", _FILE, i).try_cast("bigint") for i in (1, 2)]
    before = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    indexed = files.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))).orderBy("start")
    indexed.coalesce(1).write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def indexed_page(spark: SparkSession, snapshot: str, index: str, page: int = 1, per_page: int = 100) -> DataFrame:
    """The rows of one page, in the snapshot's order; as many files are opened as hold them."""
    if page < 1 or not 1 <= per_page <= MAX_PER_PAGE:
        raise ValueError(f"page must be at least 1 and per_page 1..{MAX_PER_PAGE}")
    low, high = (page - 1) * per_page, page * per_page
    files = spark.read.parquet(index)
    held = files.where((F.col("start") < high) & (F.col("start") + F.col("rows") > low)).select("file", "start").collect()  # at most a page
    if not held:
        return spark.read.parquet(snapshot).limit(0)
    return _numbered(spark, snapshot, held).where((F.col("#at") >= low) & (F.col("#at") < high)).orderBy("#at").drop("#at")


def page_of(spark: SparkSession, index: str, key: Sequence, per_page: int = 100) -> tuple[int, int]:
    """The pages on which the first row at or after ``key`` (values of the order's columns) can stand, by the index alone."""
    files = spark.read.parquet(index)
    names = files.schema["first"].dataType.names
    asked = F.struct(*[F.lit(v).cast(files.schema["first"].dataType[n].dataType).alias(n) for n, v in zip(names, key, strict=True)])
    found = files.where(F.col("last") >= asked).agg(F.min(F.struct("start", "rows")).alias("f")).first().f
    total = files.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    low, high = (found.start, found.start + found.rows - 1) if found else (total, total)
    return 1 + low // per_page, 1 + high // per_page


def _numbered(spark: SparkSession, snapshot: str, files: Sequence) -> DataFrame:
    """The rows of some files with their place in the whole snapshot, ``#at``."""
    starts = F.create_map(*[F.lit(x) for file, start in files for x in (file, start)])
    rows = spark.read.parquet(*[f"{snapshot}/{file}" for file, _ in files])
    at = F.element_at(starts, F.col("_metadata.file_name")) + F.col("_metadata.row_index")
    return rows.select("*", at.alias("#at"))
