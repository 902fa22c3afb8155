import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tableloom import session
from tableloom.operators.transform import Aggregation, OrderBy
from tableloom.plans.spec import Constraint, DatasetSpec, Field, Request, SharedKey
from tableloom.sinks import page_index
from tableloom.sinks.catalog import Catalog
from tableloom.sinks.export import export, friendly_name, write_snapshot


def test_friendly_names():
    assert friendly_name("My data: 1/2", "id", "csv") == "My_data__1_2_id.csv"


@pytest.mark.parametrize("kind", ["csv", "parquet", "jsonl"])
def test_exports(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, None), (2, 'x,"y"')], "n int, s string")
    path = export(df, str(tmp_path), "my set", "7", kind)
    assert path.endswith(f"my_set_7.{kind}")
    if kind == "jsonl":
        lines = [json.loads(line) for part in Path(path).glob("part-*") for line in part.read_text().splitlines()]
        assert sorted(lines, key=lambda r: r["n"]) == [{"n": 1, "s": None}, {"n": 2, "s": 'x,"y"'}]
    else:
        back = spark.read.parquet(path) if kind == "parquet" else spark.read.option("header", True).option("escape", '"').csv(path)
        assert {(int(r.n), r.s) for r in back.collect()} == {(1, None), (2, 'x,"y"')}
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        export(df, str(tmp_path), "my set", "7", kind)


def test_unknown_export(spark, tmp_path):
    with pytest.raises(ValueError):
        export(spark.range(1), str(tmp_path), "x", "1", "xlsx")


def test_snapshots_are_never_overwritten(spark, tmp_path):
    path = write_snapshot(spark.range(3), str(tmp_path / "s"))
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        write_snapshot(spark.range(4), path)
    assert spark.read.parquet(path).count() == 3


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "catalog"))


def test_empty_catalog(catalog):
    assert catalog.list_datasets().count() == 0 and catalog.transforms().count() == 0
    assert catalog.totals().first().asDict() == {"datasets": 0, "templates": 0, "runs": 0, "total_rows": 0}
    assert catalog.get("nope") is None and not catalog.rename("nope", "x") and not catalog.delete("nope")
    with pytest.raises(ValueError, match="not found"):
        catalog.read("nope")


def test_lifecycle(spark, catalog):
    first = catalog.save(spark.range(5), "first", source="kaggle:a/b/c.csv")
    second = catalog.save(spark.range(7).withColumn("k", F.col("id") % 2), "second")
    assert [r["name"] for r in catalog.list_datasets().collect()] == ["second", "first"]
    assert catalog.rename(first, "renamed")
    entry = catalog.get(first)
    assert (entry["name"], entry["columns"], entry["row_count"], entry["source"]) == ("renamed", ["id"], 5, "kaggle:a/b/c.csv")
    derived = catalog.aggregate(second, "by k", ["k"], [Aggregation("id", "count", "n")])
    catalog.dedup(second, "one", ["k"], "keep_last", OrderBy("id"))
    assert {(r.k, r.n) for r in catalog.read(derived).collect()} == {(0, 4), (1, 3)}
    config = json.loads(catalog.transforms().where("name = 'one'").first().config_json)
    assert config == {"name": "one", "keys": ["k"], "strategy": "keep_last", "order_by": {"column": "id", "direction": "desc"}}
    assert catalog.transforms().count() == 2 and catalog.totals().first().total_rows == 5 + 7 + 2 + 2
    assert catalog.delete(second)
    assert catalog.get(second) is None and catalog.transforms().count() == 0
    with pytest.raises(ValueError):
        catalog.read(second)
    assert catalog.read(derived).count() == 2
    assert [r["name"] for r in catalog.recent(2).collect()] == ["one", "by k"]


def test_runs_are_numbered(spark, catalog):
    one, ids = catalog.save_run({"a": spark.range(3), "b": spark.range(4)}, 50, 42, "Person")
    two, _ = catalog.save_run({"c": spark.range(1)}, 50, 43)
    assert (one, two) == (1, 2)
    runs = {(r.run_id, r["name"], r.template_name, r.row_count) for r in catalog.runs().collect()}
    assert runs == {(1, "a", "Person", 3), (1, "b", "Person", 4), (2, "c", "", 1)}
    assert catalog.get(ids["a"])["seed"] == 42


def test_run_ids_are_taken_once(spark, catalog):
    other = type(catalog)(spark, catalog.root)
    assert [catalog.next_run_id(), other.next_run_id(), catalog.next_run_id()] == [1, 2, 3]


def test_a_local_session_without_the_setting_gets_one_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "local[2]", "app-of-this-test"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    folder = session.shared_folder(Session())
    assert folder == session.shared_folder(Session()) and folder.startswith("/")


def test_shared_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert session.shared_folder(spark) == folder
    assert session.new_work_path(spark, "x") != session.new_work_path(spark, "x")


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_everything_can_be_saved(spark, catalog, tmp_path):
    fields = (Field("sym", "random_element", constraint=Constraint(values="aa,bb,cc")), Field("n", "random_int", "integer"))
    run, ids = catalog.generate(Request((DatasetSpec("made", 30, fields, "Tpl"),), seed=1))
    assert catalog.runs().first().template_name == "Tpl" and catalog.columns(ids["made"]) == [("sym", "VARCHAR"), ("n", "BIGINT")]
    rows, total = catalog.rows(ids["made"], ["n"], 2, 20)
    assert (rows.count(), total) == (10, 30) and catalog.rows("nope", ["n"])[1] == 0 and catalog.columns("nope") == []
    refs = DatasetSpec("refs", 5, (Field("n", "shared_key", "integer"),), shared_key=SharedKey("src", "n"))
    _, more = catalog.generate(Request((refs,), seed=2), sources={"src": ids["made"]})
    assert catalog.read(more["refs"]).join(catalog.read(ids["made"]), "n", "left_anti").count() == 0

    raw = spark.createDataFrame([("aa", 10.0, 8.0), ("bb", 5.0, None)], "symbol string, regularMarketPrice double, previousClose double")
    quotes = catalog.save_quotes(raw, ["aa", "zz"])
    assert catalog.get(quotes)["name"] == "1 quotes"
    with pytest.raises(ValueError, match="No valid quote data"):
        catalog.save_quotes(raw, ["zz"])
    enriched = catalog.enrich(ids["made"], "sym", catalog.read(quotes), ["change"])
    assert catalog.get(enriched)["name"] == "made with quotes" and catalog.read(enriched).count() == 30
    assert {(r.sym, r.change) for r in catalog.read(enriched).collect()} == {("aa", 2.0), ("bb", None), ("cc", None)}

    ticks = raw.select("symbol", F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.col("regularMarketPrice").alias("price"), F.lit(1).alias("volume"))
    history = catalog.save_history(ticks, ["aa"], "5d")
    assert catalog.get(history)["name"] == "Bars of 1 symbols over 5d" and catalog.read(history).count() == 1
    with pytest.raises(ValueError, match="no bars"):
        catalog.save_history(ticks, ["zz"])

    (tmp_path / "f.csv").write_text("A b,c\n1,x\n2,y\n")
    imported = catalog.import_csv(str(tmp_path / "f.csv"), "me", "set", "f.csv", max_rows=1)
    entry = catalog.get(imported)
    assert (entry["name"], entry["source"], entry["columns"], entry["row_count"]) == ("set/f.csv", "kaggle:me/set/f.csv", ["a_b", "c"], 1)


# --- pages ---------------------------------------------------------------------------------


@pytest.fixture
def paged(spark, tmp_path):
    """3000 rows in files of at most 70, half of them with one key, some without."""
    k = F.when(F.col("id") % 2 == 0, F.lit(5)).when(F.col("id") % 31 == 0, F.lit(None)).otherwise(F.col("id") % 97)
    rows = spark.range(3000).select(k.cast("int").alias("k"), "id", F.lit("x").alias("file"), F.lit(1).alias("start"))
    path, index = str(tmp_path / "rows"), str(tmp_path / "index")
    page_index.write_ordered(rows, path, ["k"], file_rows=70)
    assert page_index.write_index(spark, path, index, ["k"]) == 3000
    return rows, path, index


def test_pages_follow_the_order_and_lose_no_row(spark, paged):
    rows, path, index = paged
    found = []
    for number in range(1, 9):
        found += page_index.indexed_page(spark, path, index, number, 400).collect()
    assert len({r.id for r in found}) == len(found) == 3000 and found[0].asDict().keys() == {"k", "id", "file", "start"}
    assert [r.k for r in found] == [r.k for r in rows.orderBy("k").collect()]
    assert page_index.indexed_page(spark, path, index, 9, 400).collect() == []


def test_a_deep_page_opens_few_files(spark, paged):
    _, path, index = paged
    files = spark.read.parquet(index).collect()
    assert len(files) > 40 and max(f.rows for f in files) <= 70
    page = page_index.indexed_page(spark, path, index, 140, 20)
    assert len(page.inputFiles()) <= 3 and page.count() == 20
    with pytest.raises(ValueError):
        page_index.indexed_page(spark, path, index, 0, 20)


def test_the_index_finds_the_page_of_a_key(spark, paged):
    rows, _, index = paged
    before = rows.where("k < 60 or k is null").count()
    low, high = page_index.page_of(spark, index, [60], 100)
    assert low <= 1 + before // 100 <= high <= low + 1
    assert page_index.page_of(spark, index, [1000], 100) == (31, 31)


def test_catalog_pages_use_the_index(spark, catalog):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("n"), F.col("id").cast("string").alias("s"))
    saved = catalog.save(rows, "paged", page_order=["n"])
    page, total = catalog.rows(saved, ["n"], 3, 50)
    assert ([r.n for r in page.collect()], total) == (list(range(100, 150)), 500)
    other, _ = catalog.rows(saved, ["s"], 1, 3)
    assert [r.s for r in other.collect()] == ["0", "1", "10"]
    assert catalog.rename(saved, "new name") and catalog.rows(saved, ["n"], 10, 50)[0].first().n == 450
    assert catalog.rows(catalog.save(rows.limit(0), "none", page_order=["n"]), ["n"], 1, 5)[0].collect() == []
    assert catalog.delete(saved) and not Path(catalog._index(f"dataset_{saved}")).exists()
