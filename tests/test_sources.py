import random
import uuid
from datetime import date, datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tableloom.functions.fieldmap import field_type_for, generator_for, local_name
from tableloom.functions.labels import symbol_list
from tableloom.plans.generate import generate
from tableloom.plans.message import message_template, sample_rows
from tableloom.plans.spec import Constraint, DatasetSpec, Field, Request, check_column_name, check_table_name, dataset_specs_from_json, fields_from_json
from tableloom.registry import text
from tableloom.sources import builtin, csv_records, html, templates, xsd
from tableloom.sources.csv import import_csv, list_csv, normalize_names, source_tag
from tableloom.sources.csv_records import ends_inside
from tests.conftest import plan


@pytest.fixture
def write(tmp_path):
    def make(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
        return str(path)

    return make


# --- CSV -----------------------------------------------------------------------------------


def test_header_names():
    raw = ["First Name", "2col", "select", "a-b", "Ünï", " Trim ", "a - b", "dup", "Dup", "日本", "100%", "left", ""]
    assert normalize_names(raw) == [
        "first_name", "_2col", "_select", "ab", "uni", "trim", "a_b", "dup", "dup_1", "_", "_100", "_left", "column12",
    ]


def test_import_types_and_bad_rows(spark, write):
    path = write(
        "x.csv",
        "Id,Price,Day,When,Ok,Note,Empty,Year\n"
        '1,1.5,2024-01-02,2024-01-02 10:11:12,true,"a, ""b""",,2024\n'
        "broken,row\n"
        "2,-2,2024-02-29,2024-01-02T10:11:12.5,FALSE,,,2025\n"
        "too,many,fields,here,x,y,z,1,2\n"
        "3,1e3,,,,3,,\n",
    )
    made = import_csv(spark, path)
    assert made.dtypes == [
        ("id", "bigint"), ("price", "double"), ("day", "date"), ("_when", "timestamp_ntz"), ("ok", "boolean"),
        ("note", "string"), ("empty", "string"), ("year", "bigint"),
    ]
    rows = made.collect()
    assert [r[0] for r in rows] == [1, 2, 3] and rows[0][5] == 'a, "b"' and rows[1][2] == date(2024, 2, 29)
    assert rows[1][3] == datetime(2024, 1, 2, 10, 11, 12, 500000) and rows[1][4] is False and rows[2][1] == 1000.0
    assert made.count() == 3


@pytest.mark.parametrize(
    "values, kind, first",
    [
        (["01/02/2024"], "date", date(2024, 2, 1)), (["13/02/2024", "01/02/2024"], "date", date(2024, 2, 13)),
        (["02/13/2024", "01/02/2024"], "date", date(2024, 2, 13)), (["2024.1.2"], "date", date(2024, 1, 2)), (["24-01-02"], "date", date(2024, 1, 2)),
        (["99-01-02"], "date", date(1999, 1, 2)), (["2024-01/02"], "string", "2024-01/02"), (["2024-13-40"], "string", "2024-13-40"),
        (["01/02/2024 10:11:12"], "timestamp_ntz", datetime(2024, 2, 1, 10, 11, 12)), (["2024/01/02 10:11"], "timestamp_ntz", datetime(2024, 1, 2, 10, 11)),
        (["2024-01-02T10:11:12Z"], "timestamp", None), (["2024-01-02 10:11:12+02"], "timestamp", None),
        (["007"], "string", "007"), (["+5"], "string", "+5"), ([" 5 ", "-6"], "bigint", 5), (["99999999999999999999"], "decimal(38,0)", None),
        (["1e5"], "double", 1e5), (["1", "2.5", "NaN"], "double", 1.0), (["t", "f"], "boolean", True), (["No", "YES"], "boolean", False),
        (["true", "1"], "string", "true"), (["20240102"], "bigint", 20240102), (["1_000"], "string", "1_000"), (["5d"], "string", "5d"), (["NULL", "1"], "string", "NULL"),
    ],
)
def test_types(spark, write, values, kind, first):
    made = import_csv(spark, write("t.csv", "k,x\n" + "".join(f"{i},{v}\n" for i, v in enumerate(values))))
    assert dict(made.dtypes)["x"] == kind
    assert first is None or made.orderBy("k").first().x == first


def test_late_values_decide(spark, write):
    lines = [f"{i},,{i}" for i in range(3000)] + ["3000,7,x"]
    made = import_csv(spark, write("late.csv", "\n".join(["a,b,c", *lines])))
    assert made.dtypes == [("a", "bigint"), ("b", "bigint"), ("c", "string")] and made.count() == 3001


@pytest.mark.parametrize("sep", [",", ";", "|", "\t"])
def test_separators(spark, write, sep):
    text = "\n".join(sep.join(row) for row in (("A b", "c", "d"), ("1", "x y", "2.5"), ("2", "z:z", "3.5")))
    assert import_csv(spark, write("s.csv", text)).dtypes == [("a_b", "bigint"), ("c", "string"), ("d", "double")]


def test_header_only(spark, write):
    made = import_csv(spark, write("h.csv", "a,b\n"))
    assert made.dtypes == [("a", "string"), ("b", "string")] and made.count() == 0


def test_row_cap(spark, write):
    path = write("n.csv", "n\n" + "\n".join(map(str, range(50))))
    assert [r.n for r in import_csv(spark, path, max_rows=7).collect()] == list(range(7))
    with pytest.raises(ValueError):
        import_csv(spark, path, max_rows=0)


def test_line_breaks_in_quotes(spark, write):
    path = write("q.csv", 'id;note\n1;"two\nlines; and ""quotes"""\n2;plain\n')
    assert [tuple(r) for r in import_csv(spark, path).collect()] == [(1, 'two\nlines; and "quotes"'), (2, "plain")]


@pytest.fixture
def small_splits(spark):
    """Files of some kilobytes are read by many tasks."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _quoted(values, drawn):
    held = [str(v) for v in values]
    return ",".join('"' + v.replace('"', '""') + '"' if any(c in v for c in '",\r\n') or drawn.random() < 0.2 else v for v in held)


@pytest.mark.parametrize("seed", range(3))
def test_one_file_with_line_breaks_is_read_by_many_tasks(spark, tmp_path, small_splits, seed):
    drawn = random.Random(seed)
    end = drawn.choice(("\n", "\r\n"))
    pool = ["plain", 'say ""', '"', "a,b", "two\nlines", "crlf\r\nin it", "\n\n", "x" * 400 + "\n" + "y" * 500, 'q"\n"q', ",\n,", "long " * 30]
    rows = [(i, drawn.choice(pool), drawn.choice(pool)) for i in range(300)]
    text = end.join(["id,left,right", *(_quoted(r, drawn) for r in rows)]) + end * drawn.randrange(3)
    path = tmp_path / "broken.csv"
    path.write_bytes(text.encode())
    lines = spark.read.option("lineSep", "\n").text(str(path))
    assert lines.rdd.getNumPartitions() > 5
    assert sorted(map(tuple, import_csv(spark, str(path)).collect())) == rows
    assert sorted(map(tuple, import_csv(spark, str(path), max_rows=137).collect())) == rows[:137]


def test_splits_that_are_too_many_to_send(spark, tmp_path, small_splits, no_broadcast, monkeypatch):
    monkeypatch.setattr(csv_records, "fits_broadcast", lambda df: False)
    rows = [(i, f"a {i}\n" * (i % 40)) for i in range(150)]
    path = tmp_path / "many.csv"
    path.write_text("id,note\n" + "".join(f'{i},"{x}"\n' for i, x in rows))
    assert sorted((r.id, r.note or "") for r in import_csv(spark, str(path)).collect()) == rows


def test_values_longer_than_splits_and_files_read_in_different_ways(spark, write, tmp_path, small_splits):
    long = "\n".join(f'line {i} with a "quote"' for i in range(400))
    write("k/a.csv", "id,note\n1,x\n2,y\n")
    quoted = '"' + long.replace('"', '""') + '"'
    write("k/b.csv", f"note,id\n{quoted},3\n\nshort\n{quoted},4\nlast,5")
    (tmp_path / "k/c.csv").write_bytes(b"id,note\r6,mac\r7,old\r")
    found = sorted(map(tuple, import_csv(spark, str(tmp_path / "k")).collect()))
    assert found == [(1, "x"), (2, "y"), (3, long), (4, long), (5, "last"), (6, "mac"), (7, "old")]
    assert sorted(map(tuple, import_csv(spark, str(tmp_path / "k"), max_rows=4).collect())) == found[:4]


def test_a_quote_that_never_closes_takes_the_rest(spark, write):
    path = write("open.csv", 'id,note\n1,"a\nb"\n2,"open\nto the\nend')
    assert [tuple(r) for r in import_csv(spark, path).collect()][0] == (1, "a\nb")


@pytest.mark.parametrize(
    "line, outside, inside",
    [
        ("plain", False, True), ("", False, True), ('1,"open', True, False), ('"', True, False), ('end"', False, False), ('a,"b",c', False, False),
        ('x ""two"" y', False, True), ('1,"a ""b"" c', True, False), ('5" pipe', False, False), (',"', True, False), ('"",""', False, True),
    ],
)
def test_state_behind_a_line(line, outside, inside):
    assert (ends_inside(line, False, ","), ends_inside(line, True, ",")) == (outside, inside)


def test_files_meet_by_name(spark, write, tmp_path):
    write("m/a.csv", "id,note\n1,x\n")
    write("m/b.csv", "Note,ID\ny,2\n")
    assert sorted(map(tuple, import_csv(spark, str(tmp_path / "m")).collect())) == [(1, "x"), (2, "y")]
    write("m/c.csv", "id,other\n3,z\n")
    with pytest.raises(ValueError, match="differ in their columns"):
        import_csv(spark, str(tmp_path / "m"))


def test_listing_of_csv_files(spark, write, tmp_path):
    write("a/one.CSV", "x\n1\n")
    write("a/b/two.csv", "x\n")
    write("a/three.txt", "x\n")
    rows = {r["name"]: r["size"] for r in list_csv(spark, str(tmp_path / "a")).collect()}
    assert rows == {"one.CSV": 4, "two.csv": 2}
    assert source_tag("me", "set", "f.csv") == "kaggle:me/set/f.csv"


# --- templates -----------------------------------------------------------------------------

TEMPLATE = """<?xml version="1.0"?>
<template name="Person" category="Basic"><meta description="A person" version="2.1"/>
  <field name="id" type="integer" generator="uuid_int" unique="true"/>
  <field name="age" type="integer" generator="random_int"><constraint min="18" max="99" right_digits="x"/></field>
  <field name="email" generator="formula" formula="{{ id }}@x.org" null_probability="0.0"/>
  <field name="grown" generator="random_element" if="age &gt;= 21"><constraint values="yes,no" weights="1,3"/></field>
  <relationship type="ref" source="id" target="Other.id"/>
</template>"""


def test_templates(spark, write, tmp_path):
    write("t/person.xml", TEMPLATE)
    write("t/bare.xml", "<template><field name='x'/></template>")
    found = templates.read_templates(spark, str(tmp_path / "t"))
    listed = {r["name"]: r for r in templates.list_templates(found).collect()}
    assert listed["Person"].field_count == 4 and listed["Person"].version == "2.1"
    assert (listed["Untitled"].category, listed["Untitled"].description, listed["Untitled"].version) == ("General", "", "1.0")
    person = templates.get_template(found, "Person")
    assert person.fields[1].constraint == Constraint(min=18.0, max=99.0) and person.fields[0].unique
    assert person.fields[3].condition == "age >= 21" and person.relationships == (("ref", "id", "Other.id"),)
    assert templates.get_template(found, "person") is None
    bare = templates.get_template(found, "Untitled").fields[0]
    assert (bare.type, bare.generator, bare.constraint) == ("string", "text", Constraint())
    specs = person.datasets("p", 30, copies=2)
    made = generate(spark, Request(specs, seed=4), date(2024, 1, 1)).datasets
    assert list(made) == ["p_1", "p_2"]
    for row in made["p_1"].collect():
        assert row.email == f"{row.id}@x.org" and (row.grown in ("yes", "no")) == (row.age >= 21)


# --- XSD -----------------------------------------------------------------------------------

XSD = """<?xml version="1.0" encoding="UTF-8"?>
<xsd:schema xmlns:xsd="http://www.w3.org/2001/XMLSchema" xmlns="urn:iso">
  <xsd:element name="Document" type="Document"/>
  <xsd:element type="xsd:string"/>
  <xsd:element name="Sts" type="t:StatusCode" minOccurs="0" maxOccurs="unbounded">
    <xsd:annotation><xsd:documentation>The   status
      of it</xsd:documentation></xsd:annotation></xsd:element>
  <xsd:element name="Plain" type="Missing"/>
  <xsd:element name="Ref" ref="Inline"/>
  <xsd:element name="Inline"><xsd:simpleType><xsd:restriction><xsd:enumeration value="p"/><xsd:enumeration/></xsd:restriction></xsd:simpleType></xsd:element>
  <xsd:element name="Outer"><xsd:complexType><xsd:sequence>
    <xsd:element name="Amount" type="xsd:string"/>
    <xsd:element name="Deep"><xsd:complexType><xsd:choice><xsd:element name="iban" type="xsd:string"/></xsd:choice></xsd:complexType></xsd:element>
  </xsd:sequence></xsd:complexType></xsd:element>
  <xsd:complexType name="C"><xsd:sequence><xsd:element name="Amount" type="xsd:decimal"/><xsd:element name="Day" type="xsd:date"/></xsd:sequence></xsd:complexType>
  <xsd:simpleType name="StatusCode"><xsd:restriction><xsd:enumeration value="OK"/><xsd:enumeration value="NO"/></xsd:restriction></xsd:simpleType>
</xsd:schema>"""


def test_xsd_fields(spark, write, tmp_path):
    write("x/a.xsd", XSD)
    write("x/b.xsd", "<xs:schema xmlns:xs='http://www.w3.org/2001/XMLSchema'><xs:element name='Sts' type='StatusCode'/></xs:schema>")
    write("x/bad.xsd", "this is no xml")
    found = xsd.xsd_fields(xsd.read_xsd(spark, str(tmp_path / "x")))
    rows = {r["name"]: r for r in found.where("document LIKE '%a.xsd'").collect()}
    assert [r["name"] for r in sorted(rows.values(), key=lambda r: r.position)] == ["Sts", "Plain", "Ref", "Inline", "Outer", "Amount", "Deep", "iban", "Day"]
    sts = rows["Sts"]
    assert (sts.xsd_type, sts.min_occurs, sts.max_occurs, sts.documentation) == ("t:StatusCode", 0, "unbounded", "The status of it")
    assert sts.enumeration_values == ["OK", "NO"] and sts.mapped_generator == "random_element" and sts.namespace == "urn:iso"
    assert rows["Ref"].enumeration_values == ["p"] == rows["Inline"].enumeration_values and rows["Ref"].xsd_type == "Inline"
    assert rows["Amount"].xsd_type == "xsd:string" and rows["Amount"].mapped_generator == "pydecimal"
    assert [n["name"] for n in rows["Outer"].nested] == ["Amount", "Deep", "iban"]
    assert rows["Deep"].nested == []  # its choice lies in no sequence of its own
    other = found.where("document LIKE '%b.xsd'").collect()
    assert len(other) == 1 and other[0].enumeration_values is None
    assert found.where("document LIKE '%bad.xsd'").count() == 0


def test_document_order_with_types_first(spark):
    text = """<xs:schema xmlns:xs="u"><!-- <xs:element name="no"/> -->
      <xs:complexType name="T"><xs:sequence><xs:element name="a" type="xs:date"/><xs:element name="b"/></xs:sequence></xs:complexType>
      <xs:element name="c"><xs:complexType><xs:sequence><xs:element name="a" type="xs:int"/><xs:element name="d"/></xs:sequence></xs:complexType></xs:element>
      <xs:complexType name="U"><xs:choice><xs:element name="e"/></xs:choice></xs:complexType>
      <xs:complexType name="Empty"/><xs:element name="f"/></xs:schema>"""
    docs = spark.createDataFrame([("d", text)], "document string, xsd string")
    rows = xsd.xsd_fields(docs).orderBy("position").collect()
    assert [(r.position, r["name"]) for r in rows] == [(0, "a"), (1, "b"), (2, "c"), (4, "d"), (5, "e"), (6, "f")]
    assert rows[0].xsd_type == "xs:date"


def test_no_element_is_too_far_or_too_deep(spark):
    many = "".join(f"<xs:element name='e{i}' type='xs:int'/>" for i in range(70))
    deep = "<xs:element name='d0'>" + "".join(
        f"<xs:complexType><xs:sequence><xs:sequence><xs:element name='d{i}'>" for i in range(1, 8)
    ) + "</xs:element></xs:sequence></xs:sequence></xs:complexType>" * 7 + "</xs:element>"
    group = "<xs:group name='g'><xs:sequence><xs:element name='in_group'/></xs:sequence></xs:group>"
    simple = (
        "<xs:element name='s'><xs:complexType><xs:simpleContent><xs:restriction base='b'><xs:enumeration value='x'/></xs:restriction>"
        "</xs:simpleContent><xs:attribute name='a'><xs:simpleType><xs:restriction><xs:enumeration value='y'/></xs:restriction>"
        "</xs:simpleType></xs:attribute></xs:complexType></xs:element>"
    )
    docs = spark.createDataFrame([("d", f"<xs:schema xmlns:xs='u'>{many}{deep}{group}{simple}</xs:schema>")], "document string, xsd string")
    rows = {r["name"]: r for r in xsd.xsd_fields(docs).collect()}
    assert [r["name"] for r in sorted(rows.values(), key=lambda r: r.position)] == (
        [f"e{i}" for i in range(70)] + [f"d{i}" for i in range(8)] + ["in_group", "s"]
    )
    assert rows["e69"].mapped_generator == "random_int" and rows["s"].enumeration_values == ["x", "y"]
    assert [n["name"] for n in rows["d0"].nested] == [f"d{i}" for i in range(1, 8)] and rows["d7"].nested == []
    template = message_template(xsd.xsd_fields(docs), "msg")
    assert len(template.fields) == 80 + 28


def test_entities_stay_unresolved(spark):
    text = "<!DOCTYPE s [<!ENTITY a 'secret'>]><s xmlns='u'><element name='x'><annotation><documentation>one &a; two</documentation></annotation></element></s>"
    docs = spark.createDataFrame([("d", text), (None, None)], "document string, xsd string")
    assert [r.documentation for r in xsd.xsd_fields(docs).collect()] == ["one two"]


def test_message_template_can_be_generated(spark):
    docs = spark.createDataFrame([("d", XSD)], "document string, xsd string")
    template = message_template(xsd.xsd_fields(docs), "msg")
    by_name = {f.name: f for f in template.fields}
    assert by_name["Sts"].constraint.values == "OK,NO" and by_name["Outer_Amount"].generator == "pydecimal"
    assert by_name["Day"].type == "date" and by_name["Amount"].type == "string"
    made = generate(spark, Request(template.datasets("m", 20), seed=1), date(2024, 1, 1)).datasets["m"]
    assert made.count() == 20 and {r.Sts for r in made.collect()} == {"OK", "NO"}


def test_a_message_is_parsed_once_for_its_template(spark, tmp_path):
    def parsed(batches):
        for batch in batches:
            (tmp_path / uuid.uuid4().hex).touch()
            yield batch

    docs = spark.createDataFrame([("d", XSD)], "document string, xsd string").coalesce(1)
    template = message_template(xsd.xsd_fields(docs.mapInArrow(parsed, docs.schema)), "msg")
    assert [f.name for f in template.fields][-3:] == ["Deep", "iban", "Day"] and len(list(tmp_path.iterdir())) == 1
    two = spark.createDataFrame([("d", XSD), ("e", XSD)], "document string, xsd string")
    with pytest.raises(ValueError, match="one message"):
        message_template(xsd.xsd_fields(two), "msg")
    assert message_template(xsd.xsd_fields(two.where("document = 'none'")), "msg").fields == ()


def test_other_messages_are_not_parsed_for_a_template(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(text, "message_template", lambda fields, name: seen.append(fields) or message_template(fields, name))
    assert text.message_template_fields(spark, sf).count() == 11
    optimized = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= optimized.index("MapInArrow") < optimized.index("Filter")


def test_template_rows_parse_the_schemas_once(spark):
    docs = spark.createDataFrame([("d", XSD)], "document string, xsd string")
    made = xsd.template_rows(xsd.xsd_fields(docs))
    assert plan(made).count("MapInArrow") == 1
    rows = [(r["name"], r.child, r.generator) for r in made.where("name LIKE 'Outer%'").orderBy("position", "child").collect()]
    assert rows == [("Outer", -1, "text"), ("Outer_Amount", 0, "pydecimal"), ("Outer_Deep", 1, "text"), ("Outer_iban", 2, "iban")]


def test_schemas_leave_the_parser_in_bounded_batches(spark, sf):
    texts = [XSD] * (2 * xsd.PART_ROWS) + ["no xml", None, XSD]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["document", "xsd"])
    made = [b.column("document").to_pylist() for b in xsd._parse(iter([batch]))]
    assert [len(set(ids)) for ids in made] == [xsd.PART_ROWS, xsd.PART_ROWS, 1] and made[2] == [len(texts) - 1] * 9
    assert "hashpartitioning(p_partkey" in plan(text.xsd_nested_fields(spark, sf))
    assert "hashpartitioning(s_suppkey" in plan(text.xsd_wide_fields(spark, sf))


def test_template_files_are_bounded(spark, sf, monkeypatch):
    monkeypatch.setattr(text, "FILE_TEMPLATES", 50)
    listed = text.xml_template_listing(spark, sf)
    assert len(listed.inputFiles()) >= 4 and listed.count() == spark.read.parquet(f"{sf}/part.parquet").count() == 200


def test_demo_fields_and_samples(spark):
    demo = builtin.demo_fields(spark)
    assert demo.count() == 15 and builtin.domains(spark).count() == 5 and builtin.messages(spark).count() == 12
    template = message_template(demo, "demo")
    assert template.fields[4].constraint.values == "EUR,USD,GBP,CHF,JPY"
    rows = sample_rows(spark, [("a", "swift", None), ("b", "job", None), ("c", "random_element", ["x"])], 1, 10).collect()
    assert [tuple(r) for r in rows] == [("BOFAUS3NXXX", "[job]", "x")] * 10


@pytest.mark.parametrize(
    "name, kind, choices, generator",
    [
        ("anything", "Code", True, "random_element"), ("x", "{urn}DecimalNumber", False, "pydecimal"), ("x", "ISODateTime", False, "date_between"),
        ("x", "xs:time", False, "date_time"), ("x", "PointInTime", False, "random_int"), ("Total Amount", None, False, "pydecimal"),
        ("acct_id", "", False, "bothify"), ("account", "", False, "bban"), ("TotalAmount", "", False, "text"), ("gvn_nm", "", False, "name"),
        ("charge", "", False, "pydecimal"), ("debit", "", False, "random_element"), ("vrsn", "", False, "random_int"), ("été rate", "", False, "pydecimal"),
        ("ratée", "", False, "text"),
    ],
)
def test_generator_mapping(spark, name, kind, choices, generator):
    df = spark.createDataFrame([(name, kind)], "n string, k string")
    assert df.select(generator_for(F.col("n"), F.col("k"), F.lit(choices)).alias("g")).first().g == generator


@pytest.mark.parametrize(
    "kind, strict, broad",
    [
        ("xs:decimal", "float", "float"), ("ISODateTime", "datetime", "date"), ("ISODate", "date", "date"), ("xs:integer", "integer", "integer"),
        ("Max15NumericText", "string", "integer"), ("YesNoIndicator", "string", "boolean"), ("ActiveAmount", "string", "float"), (None, "string", "string"),
    ],
)
def test_field_types(spark, kind, strict, broad):
    df = spark.createDataFrame([(kind,)], "k string")
    row = df.select(field_type_for(F.col("k")).alias("s"), field_type_for(F.col("k"), "broad").alias("b"), local_name(F.lit("{u}p:x")).alias("l")).first()
    assert (row.s, row.b, row.l) == (strict, broad, "x")


# --- HTML ----------------------------------------------------------------------------------


def test_anchors(spark):
    pages = spark.createDataFrame(
        [
            (2, "<A class=x HREF='/d?business-domain%5B0%5D=9'> Cards </A><a href=\"/other\">no</a>"),
            (1, '<a href="/d?business-domain%5B0%5D=1&amp;x=1">Pay<b>ments</b> &amp; more</a><a href="/d?business-domain"> Cards</a><a href="/business-domain"></a>'),
        ],
        "id int, html string",
    )
    found = {r["name"]: r.href for r in html.anchors(pages, "id", "html", "business-domain").collect()}
    assert found == {"Payments & more": "/d?business-domain%5B0%5D=1&x=1", "Cards": "/d?business-domain"}
    ids = html.anchors(pages, "id", "html", "business-domain", r"business-domain%5B0%5D=(\d+)").collect()
    assert [(r["name"], r.id) for r in ids] == [("Payments & more", "1")]


def test_listing_rows(spark):
    text = """<div class="x business-area y"><a href="#"> Payments </a></div><table>
      <tr><td>pacs.008.001.12</td><td> Credit </td><td>SWIFT</td><td><a href="/message/1/download">x</a></td></tr>
      <tr><td>pacs.008.001.12</td><td>short</td></tr><tr><td>Bad.008.001.12</td><td>a</td><td>b</td></tr>
      <tr><td>pain.001.001.1</td><td>a</td><td>b</td></tr><tr><td>camt.001.001.01</td><td>a</td><td>b</td></tr></table>"""
    rows = html.listing_rows(spark.createDataFrame([(1, text)], "id int, html string"), "id", "html")
    found = {r.message_id: r for r in rows.collect()}
    assert set(found) == {"pacs.008.001.12", "camt.001.001.01"}
    first = found["pacs.008.001.12"]
    assert (first.message_name, first.submitting_org, first.business_area, first.xsd_url) == ("Credit", "SWIFT", "Payments", "/message/1/download")
    assert found["camt.001.001.01"].xsd_url is None and html.all_messages(rows, rows).count() == 2


# --- specs ---------------------------------------------------------------------------------


def test_specs_from_json():
    text = '{"name": "d", "rows": 3, "fields": [{"name": "a", "generator": "name", "constraint": {"max": 3, "odd": 1}, "extra": 1}], "shared_key": {"source_dataset": "x", "source_field": "k"}, "group_config": null}'
    (spec,) = dataset_specs_from_json(text)
    assert spec.fields == (Field("a", "name", constraint=Constraint(max=3)),) and spec.shared_key.source_field == "k"
    assert len(dataset_specs_from_json(f"[{text}, {text}]")) == 2
    grouped = '{"name": "g", "rows": 3, "group_config": {"num_groups": 2, "parent_fields": [{"name": "p", "generator": "name"}]}}'
    assert dataset_specs_from_json(grouped)[0].group_config.parent_fields[0].name == "p"
    request = Request.from_dict({"datasets": [{"name": "d", "rows": 2, "fields": [{"name": "a", "generator": "word"}]}], "seed": 3, "overlap_ratio": 0.5, "exact_fields": ["a"]})
    assert request.datasets[0].rows == 2 and request.exact_fields == ("a",) and request.homogeneity == 50
    assert fields_from_json('[{"name": "a", "generator": "name"}]') == (Field("a", "name"),)


@pytest.mark.parametrize(
    "make",
    [
        lambda: Field("bad name", "name"), lambda: Field("a", "name", null_probability=1.5), lambda: DatasetSpec("d", 0),
        lambda: DatasetSpec("d", 1, (Field("a", "name"), Field("a", "word"))), lambda: Request(()), lambda: Request((DatasetSpec("d", 1),), homogeneity=0),
        lambda: Request((DatasetSpec("d", 1), DatasetSpec("d", 1))), lambda: Request((DatasetSpec("d", 1),), overlap_ratio=2),
    ],
)
def test_bad_specs(make):
    with pytest.raises(ValueError):
        make()


def test_identifiers():
    for good in ("name", "first_name", "col123", "_private"):
        assert check_column_name(good) == good
    for bad in ("123name", "col-name", "col name", "DROP TABLE", "", "a\n"):
        with pytest.raises(ValueError):
            check_column_name(bad)
    assert check_table_name("dataset_abc-def-123")
    for bad in ("my_table", "dataset_", "dataset_xyz!"):
        with pytest.raises(ValueError):
            check_table_name(bad)


def test_symbol_list():
    assert symbol_list(" aapl, msft\n\ngoog,,") == ["AAPL", "MSFT", "GOOG"]


# --- nested HTML ---------------------------------------------------------------------------


def _rows(page):
    listing = html.Listing(page)
    return [(len(r.cells), listing.texts(r), r.download) for r in listing.rows], listing.area


def test_rows_and_cells_follow_the_tree():
    page = (
        "<table><tr><td>1<td>2<table><tr><td>a</td><td>b<td>c</tr></table><td>3 <a href='/message/9/download'>x</a></tr>"
        "<tr><th>h<td>only</table><div class='business-area'>B <a>Area &amp; more"
    )
    rows, area = _rows(page)
    assert rows == [(6, ["1", "2abc", "a"], "/message/9/download"), (3, ["a", "b", "c"], None), (1, ["only"], None)]
    assert area == "Area & more"


def test_end_tags_close_nothing_around_their_table():
    rows, _ = _rows("<table><tr><td>1<table><tr><td>a</td></td></tr></tr></div></table>still one<td>2<td>3</table>after<td>loose")
    assert [r[:2] for r in rows] == [(4, ["1astill one", "a", "2"]), (1, ["a"])]


def test_sections_nest_like_divs():
    page = (
        "<div class='views-row'><div><span class='views-field'>1</span></div><span class='views-field'>2<span>b</span></span>"
        "<div class='views-row'><span class='views-field'>i</span></div></div><span class='views-field'>outside</span>"
    )
    assert [r[:2] for r in _rows(page)[0]] == [(3, ["1", "2b", "i"]), (1, ["i"])]


@pytest.mark.parametrize("page", ["", "<", "<td>", "</table></tr>", "<!--", "<table><tr><td>" * 300, "<script>" + "<td>" * 9, "a < b <tr", "<a href='x'>" * 50])
def test_broken_pages_are_walked(page):
    _rows(page), list(html.links_of(page))


def test_depth_of_nesting_has_no_limit():
    deep = "<table><tr><td>x" * 500 + "</table>" * 500
    rows, _ = _rows(deep)
    assert [r[0] for r in rows] == list(range(500, 0, -1)) and rows[-1][1] == ["x"]
