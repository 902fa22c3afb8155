"""Session settings the library relies on, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
FREE_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_FOLDERS: dict[str, str] = {}  # by application; local sessions without the setting


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings that change results: timestamps are handled in UTC, and bad casts fail.

    Python workers started from here on find this package where the driver did, whatever folder they run in.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    environment, home = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([home, *paths])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session, where driver and executors are one process, may fall back to a
    temporary folder of its own; on a cluster a missing setting is an error, since a
    machine-local path would be lost with its machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getConf().get(CHECKPOINT_SETTING)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="tableloom-")
    return _LOCAL_FOLDERS[context.applicationId]


def new_work_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; never reused, so no run overwrites another."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    held = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if held is None else spark.conf.set(name, held)


def materialise(df: DataFrame, label: str, free: bool = False, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    With ``free``, what the write has shuffled goes when it ends, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = new_work_path(spark, label)
    with _setting(spark, FREE_SETTING, "true") if free else nullcontext():
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 64 << 20) -> bool:
    """Measure ``df`` in one aggregate and say whether it is small enough to copy to every executor."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 for c in df.columns), F.lit(0))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes
