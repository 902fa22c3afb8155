"""Snapshots and exports as files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

# Export format -> file extension.
EXTENSIONS = {"csv": "csv", "parquet": "parquet", "jsonl": "jsonl"}


def friendly_name(name: str, dataset_id: str, kind: str) -> str:
    """Output name: anything but letters, digits, ``_``, ``.`` and ``-`` becomes ``_``."""
    return f"{re.sub(r'[^\w.-]', '_', name)}_{dataset_id}.{EXTENSIONS[kind]}"


def write_snapshot(df: DataFrame, path: str) -> str:
    """Write a new immutable Parquet snapshot; an existing one is an error."""
    df.write.mode("errorifexists").parquet(path)
    return path


def export(df: DataFrame, folder: str, name: str, dataset_id: str, kind: str) -> str:
    """Export as ``csv`` (with header), ``parquet`` or ``jsonl`` (NULL keys kept) to a new folder."""
    if kind not in EXTENSIONS:
        raise ValueError(f"unknown export format: {kind!r}")
    path = f"{folder}/{friendly_name(name, dataset_id, kind)}"
    writer = df.write.mode("errorifexists")
    if kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        writer.option("ignoreNullFields", False).json(path)
    return path
