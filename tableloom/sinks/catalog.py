"""Catalog of datasets, runs and transforms over a folder all executors can reach.

Every change is a new entry of a Parquet log; the current state is the latest entry per dataset.
Nothing is rewritten in place, so a failed or repeated write cannot lose an entry.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, is_dataclass
from datetime import date, datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.operators import transform
from tableloom.operators.bars import ohlcv_bars
from tableloom.operators.enrich import enrich, quote_snapshot
from tableloom.operators.listing import describe, newest, page
from tableloom.plans.generate import generate
from tableloom.plans.spec import Request, check_table_name
from tableloom.sinks.export import write_snapshot
from tableloom.sinks.page_index import indexed_page, write_index, write_ordered
from tableloom.sources.csv import import_csv, source_tag

_DATASETS = (
    "dataset_id string, run_id bigint, name string, table_name string, columns_json string, row_count bigint, "
    "homogeneity int, seed bigint, source string, created_at timestamp_ntz, changed_at timestamp_ntz, deleted boolean, page_order string"
)
_RUNS = (
    "run_id bigint, name string, template_name string, row_count bigint, homogeneity int, seed bigint, "
    "created_at timestamp_ntz"
)
_TRANSFORMS = "source_dataset string, name string, config_json string, created_at timestamp_ntz"


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- tables -----------------------------------------------------------------------------

    def _log(self, table: str, schema: str) -> DataFrame:
        path = f"{self.root}/{table}"
        empty = self.spark.createDataFrame([], schema)
        if not self._exists(path):
            return empty
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)

    def _append(self, table: str, schema: str, row: tuple) -> None:
        # a folder per entry, so writers at the same time cannot disturb each other's commit
        entry = self.spark.createDataFrame([row], schema).coalesce(1)
        entry.write.mode("errorifexists").parquet(f"{self.root}/{table}/{uuid.uuid4().hex}")

    def _files(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        target, files = self._files(path)
        return files.exists(target)

    def datasets(self) -> DataFrame:
        """Current datasets: the latest entry of each, deleted ones left out."""
        log = self._log("datasets", _DATASETS)
        rest = [c for c in log.columns if c != "dataset_id"]
        latest = log.groupBy("dataset_id").agg(F.max_by(F.struct(*rest), "changed_at").alias("d"))
        return latest.select("dataset_id", "d.*").where(~F.col("deleted")).drop("changed_at", "deleted")

    def runs(self) -> DataFrame:
        return self._log("runs", _RUNS)

    def transforms(self) -> DataFrame:
        """Transforms whose source dataset still exists."""
        live = self.datasets().select(F.col("dataset_id").alias("source_dataset"))
        return self._log("transforms", _TRANSFORMS).join(live, "source_dataset", "left_semi")

    # --- listings ---------------------------------------------------------------------------

    def list_datasets(self) -> DataFrame:
        listed = self.datasets().select(
            "dataset_id", "name", "table_name", "row_count",
            F.coalesce(F.from_json("columns_json", "array<string>"), F.array().cast("array<string>")).alias("columns"),
            "homogeneity", "seed", "created_at",
        )
        return newest(listed, "created_at", ties=["dataset_id"])

    def recent(self, n: int = 5) -> DataFrame:
        return newest(self.datasets().select("name", "row_count", "created_at"), "created_at", n, ["name"])

    def totals(self, templates: int = 0) -> DataFrame:
        """Counts of datasets, templates and runs, and the rows of all datasets."""
        return self.datasets().agg(
            F.count(F.lit(1)).alias("datasets"),
            F.lit(templates).cast("bigint").alias("templates"),
            self.runs().agg(F.count(F.lit(1))).scalar().alias("runs"),
            F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
        )

    def get(self, dataset_id: str) -> dict | None:
        row = self.datasets().where(F.col("dataset_id") == dataset_id).first()
        return None if row is None else {**row.asDict(), "columns": json.loads(row.columns_json or "[]")}

    def read(self, dataset_id: str) -> DataFrame:
        entry = self.get(dataset_id)
        if entry is None:
            raise ValueError(f"dataset '{dataset_id}' not found")
        return self.spark.read.parquet(self._path(entry["table_name"]))

    def rows(self, dataset_id: str, order: Sequence[str], page_number: int = 1, per_page: int = 100) -> tuple[DataFrame, int]:
        """One page of a dataset in a fixed order, and its total row count; no rows for an unknown id.

        A dataset saved in this order has an index: the page opens the files it lies in, however deep it is.
        """
        entry = self.get(dataset_id)
        if entry is None:
            return self.spark.createDataFrame([], "none string"), 0
        if entry["page_order"] and json.loads(entry["page_order"])[: len(order)] == list(order):
            table = entry["table_name"]
            return indexed_page(self.spark, self._path(table), self._index(table), page_number, per_page), entry["row_count"]
        return page(self.read(dataset_id), order, page_number, per_page), entry["row_count"]

    def columns(self, dataset_id: str) -> list[tuple[str, str]]:
        """Column names and SQL types of a dataset; none for an unknown id."""
        return describe(self.read(dataset_id)) if self.get(dataset_id) else []

    def _path(self, table_name: str) -> str:
        return f"{self.root}/data/{check_table_name(table_name)}"

    def _index(self, table_name: str) -> str:
        return f"{self.root}/pages/{check_table_name(table_name)}"

    # --- changes ----------------------------------------------------------------------------

    def save(self, df: DataFrame, name: str, run_id=None, homogeneity=None, seed=None, source=None, page_order: Sequence[str] = ()) -> str:
        """Write ``df`` as a new snapshot, then register it with the row count of what was written.

        With ``page_order`` the snapshot is sorted by these columns and gets an index of its files for ``rows``.
        """
        dataset_id = str(uuid.uuid4())
        table = check_table_name(f"dataset_{dataset_id}")
        path = self._path(table)
        if page_order:
            write_ordered(df, path, page_order)
            rows = write_index(self.spark, path, self._index(table), page_order)
        else:
            write_snapshot(df, path)
            rows = self.spark.read.parquet(path).count()
        now, order = _now(), json.dumps(list(page_order)) if page_order else None
        entry = (dataset_id, run_id, name, table, json.dumps(df.columns), rows, homogeneity, seed, source, now, now, False, order)
        self._append("datasets", _DATASETS, entry)
        return dataset_id

    def next_run_id(self) -> int:
        """A run id nobody else has: the first free number whose folder this call creates itself."""
        run_id = (self.runs().agg(F.max("run_id")).first()[0] or 0) + 1
        while not self._reserve(f"{self.root}/run_ids/{run_id}"):
            run_id += 1
        return run_id

    def _reserve(self, path: str) -> bool:
        """Create an empty file; False if it is there already. The file system lets one of several callers win."""
        target, files = self._files(path)
        try:
            files.create(target, False).close()
        except Py4JJavaError as error:
            if files.exists(target):
                return False
            raise error
        return True

    def save_run(
        self, datasets: dict[str, DataFrame], homogeneity: int, seed: int, template: str = ""
    ) -> tuple[int, dict[str, str]]:
        """Save the datasets of one generation run under one run id."""
        run_id, ids = self.next_run_id(), {}
        for name, df in datasets.items():
            ids[name] = self.save(df, name, run_id, homogeneity, seed)
            rows = self.get(ids[name])["row_count"]
            self._append("runs", _RUNS, (run_id, name, template, rows, homogeneity, seed, _now()))
        return run_id, ids

    def generate(
        self, request: Request, as_of: date | None = None, sources: dict[str, str] | None = None
    ) -> tuple[int, dict[str, str]]:
        """Generate the datasets of a request and save them as one run.

        ``sources`` maps the names that shared keys use to dataset ids of the catalog.
        """
        tables = {name: self.read(i) for name, i in (sources or {}).items()}
        made = generate(self.spark, request, as_of, tables)
        template = next((d.template for d in request.datasets if d.template), "")
        return self.save_run(made.datasets, request.homogeneity, made.seed, template)

    def import_csv(
        self, path: str, owner: str, slug: str, file: str, name: str | None = None, max_rows: int | None = None
    ) -> str:
        """Import CSV files as a dataset that remembers where they came from."""
        rows = import_csv(self.spark, path, max_rows)
        return self.save(rows, name or f"{slug}/{file}", source=source_tag(owner, slug, file))

    def save_quotes(self, raw: DataFrame, symbols: Sequence[str], name: str | None = None) -> str:
        """Save the quotes of the asked symbols; it is an error when none is known."""
        made = self._save_some(quote_snapshot(raw, symbols), name, "No valid quote data")
        if name is None:
            self.rename(made, f"{self.get(made)['row_count']} quotes")
        return made

    def save_history(
        self,
        ticks: DataFrame,
        symbols: Sequence[str],
        period: str = "1mo",
        interval: str = "1d",
        name: str | None = None,
        **columns,
    ) -> str:
        """Save the bars of the asked symbols; it is an error when there are none."""
        history = ohlcv_bars(ticks, interval, period, symbols, **columns)
        return self._save_some(history, name or f"Bars of {len(symbols)} symbols over {period}", "no bars of the asked symbols")

    def _save_some(self, df: DataFrame, name: str | None, error: str) -> str:
        """Save once, then look at what was written: an empty dataset is removed and is an error."""
        made = self.save(df, name or "")
        if not self.get(made)["row_count"]:
            self.delete(made)
            raise ValueError(error)
        return made

    def enrich(
        self, dataset_id: str, ticker_column: str, quotes: DataFrame, columns: Sequence[str], name: str | None = None
    ) -> str:
        """Save the dataset with quote columns looked up by its ticker column."""
        made = enrich(self.read(dataset_id), ticker_column, quotes, columns)
        return self.save(made, name or f"{self.get(dataset_id)['name']} with quotes")

    def aggregate(self, dataset_id: str, name: str, group_by: Sequence[str], aggregations, **options) -> str:
        made = transform.aggregate(self.read(dataset_id), group_by, aggregations, **options)
        config = {"name": name, "group_by": list(group_by), "aggregations": aggregations, **options}
        return self._derive(made, dataset_id, name, config)

    def dedup(self, dataset_id: str, name: str, keys: Sequence[str], strategy: str = "keep_first", order_by=None) -> str:
        made = transform.dedup(self.read(dataset_id), keys, strategy, order_by)
        config = {"name": name, "keys": list(keys), "strategy": strategy, "order_by": order_by}
        return self._derive(made, dataset_id, name, config)

    def _derive(self, df: DataFrame, source: str, name: str, config: dict) -> str:
        made = self.save(df, name)
        text = json.dumps(config, default=lambda o: asdict(o) if is_dataclass(o) else str(o))
        self._append("transforms", _TRANSFORMS, (source, name, text, _now()))
        return made

    def rename(self, dataset_id: str, new_name: str) -> bool:
        return self._change(dataset_id, name=new_name)

    def delete(self, dataset_id: str) -> bool:
        """Forget the dataset and its transforms, and remove its snapshot."""
        entry = self.get(dataset_id)
        if entry is None or not self._change(dataset_id, deleted=True):
            return False
        for path in (self._path(entry["table_name"]), self._index(entry["table_name"])):
            target, files = self._files(path)
            files.delete(target, True)
        return True

    def _change(self, dataset_id: str, **change) -> bool:
        entry = self.get(dataset_id)
        if entry is None:
            return False
        entry.pop("columns")
        row = {**entry, "changed_at": _now(), "deleted": False, **change}
        names = [c.strip().split(" ")[0] for c in _DATASETS.split(",")]
        self._append("datasets", _DATASETS, tuple(row[n] for n in names))
        return True


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)
