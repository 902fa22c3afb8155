"""XSD schemas as rows of fields, and message fields as template fields.

A schema document is one row. Its elements nest to any depth, which no column type can follow, so the tree is walked
once per document by a streaming parser inside the tasks; everything after that is columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.functions.fieldmap import field_type_for, generator_for

XSD_NAMESPACE = "http://www.w3.org/2001/XMLSchema"
PART_ROWS = 1000  # documents whose fields leave a task at a time: bounds its memory
_TEXTS, _NESTED = ("name", "type", "ref", "min", "max", "doc"), ("name", "type", "min", "max")
_FIELD = (
    f"position int, {', '.join(f'{n} string' for n in _TEXTS)}, enums array<string>, "
    f"nested array<struct<{','.join(f'{n}:string' for n in _NESTED)}>>"
)


def read_xsd(spark: SparkSession, path: str) -> DataFrame:
    """``(document, xsd)``: the whole text of every schema file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("document"), F.col("value").alias("xsd"))


class _Walk:
    """The elements of one document in document order, with what stands below them."""

    def __init__(self, text: str):
        self.namespace = XSD_NAMESPACE
        self.elements: list[dict] = []
        self.type_enums: dict[str, list[str]] = {}
        self._path: list[str] = []  # local names from the root down
        self._types_open: list[tuple[int, int]] = [(-1, -1)]  # by depth: the last complex type, the last one with a sequence inside
        self._open: list[tuple[int, dict]] = []  # depth and row of the open elements
        self._types: list[str | None] = []  # names of the open simple types
        self._words: list[str] | None = None  # of the documentation that is being read
        parser = expat.ParserCreate("utf-8", "}")
        parser.buffer_text = True
        parser.StartNamespaceDeclHandler = self._declare
        parser.StartElementHandler, parser.EndElementHandler = self._start, self._end
        parser.CharacterDataHandler = self._text
        parser.DefaultHandler = lambda _: None  # entities of the document itself stay unresolved
        parser.Parse(text.encode("utf-8", "surrogatepass"), True)

    def _declare(self, prefix: str | None, uri: str | None) -> None:
        if not self._path and not prefix and uri:
            self.namespace = uri

    def _start(self, full: str, attributes: dict[str, str]) -> None:
        name = full.rpartition("}")[2]
        last, within = self._types_open[-1]
        if name == "element":
            get = attributes.get
            row = {
                "name": get("name"), "type": get("type"), "ref": get("ref"), "min": get("minOccurs"), "max": get("maxOccurs"),
                "doc": None, "enums": [], "nested": [],
            }
            if row["name"]:
                for depth, outer in self._open:
                    if depth >= within:  # and so are those further in
                        break
                    outer["nested"].append(row)
            self.elements.append(row)
            self._open.append((len(self._path), row))
        elif name == "complexType":
            last = len(self._path)
        elif name == "sequence":
            within = last
        elif name == "simpleType":
            self._types.append(attributes.get("name"))
        elif name == "enumeration" and self._path[-1:] == ["restriction"] and attributes.get("value"):
            for _, outer in self._open:
                outer["enums"].append(attributes["value"])
            for type_name in self._types:
                if type_name:
                    self.type_enums.setdefault(type_name, []).append(attributes["value"])
        elif name == "documentation" and self._open and self._path[self._open[-1][0] :] == ["element", "annotation"]:
            if self._open[-1][1]["doc"] is None:
                self._words = []
        self._path.append(name)
        self._types_open.append((last, within))

    def _end(self, _: str) -> None:
        name = self._path.pop()
        self._types_open.pop()
        if name == "element":
            self._open.pop()
        elif name == "simpleType":
            self._types.pop()
        elif name == "documentation" and self._words is not None and self._open and len(self._path) == self._open[-1][0] + 2:
            self._open[-1][1]["doc"] = " ".join("".join(self._words).split())
            self._words = None

    def _text(self, text: str) -> None:
        if self._words is not None:
            self._words.append(text)

    def fields(self) -> list[dict]:
        """Named elements, the first of each name; enums of the reference or named type, else those inside."""
        first: dict[str, dict] = {}
        for row in self.elements:
            first.setdefault(row["name"] or "", row)
        out = []
        for position, row in enumerate(self.elements):
            if not row["name"] or row["name"] == "Document" or first[row["name"]] is not row:
                continue
            if row["ref"]:
                found = first.get(_local(row["ref"]), {}).get("enums")
            else:
                found = self.type_enums.get(_local(row["type"] or ""))
            row["position"], row["choices"] = position, found or row["enums"] or None
            out.append(row)
        return out


def _local(name: str) -> str:
    return name.rpartition("}")[2].rpartition(":")[2]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per field, column by column: a row's values never meet in a Python object that Arrow has to take apart."""
    for batch in batches:
        for start in range(0, batch.num_rows, PART_ROWS):
            part = batch.slice(start, PART_ROWS)
            at, namespaces, found = [], [], []
            for i, text in enumerate(part.column("xsd").to_pylist()):
                try:
                    walk = _Walk(text or "")
                except expat.ExpatError:  # no schema, no rows
                    continue
                fields = walk.fields()
                at += [i] * len(fields)
                namespaces += [walk.namespace] * len(fields)
                found += fields
            texts = [pa.array([row[n] for row in found], pa.string()) for n in _TEXTS]
            inner = [n for row in found for n in row["nested"]]
            struct = pa.StructArray.from_arrays([pa.array([n[c] for n in inner], pa.string()) for c in _NESTED], _NESTED)
            ends = pa.array([0, *accumulate(len(row["nested"]) for row in found)], pa.int32())
            made = [
                part.column("document").take(pa.array(at, pa.int32())),
                pa.array(namespaces, pa.string()),
                pa.array([row["position"] for row in found], pa.int32()),
                *texts,
                pa.array([row["choices"] for row in found], pa.list_(pa.string())),
                pa.ListArray.from_arrays(ends, struct),
            ]
            yield pa.RecordBatch.from_arrays(made, ["document", "namespace", "position", *_TEXTS, "enums", "nested"])


def xsd_fields(documents: DataFrame, document: str = "document", xsd: str = "xsd") -> DataFrame:
    """One row per named element of every schema document, in document order, wherever it stands.

    ``position`` counts all elements; ``Document`` and unnamed elements are skipped and the first of a repeated name
    wins. Enum values come from the referenced element or the named type, else from anywhere inside the element.
    ``nested`` holds the named elements inside it that stand in a sequence of a complex type, at any depth. Texts that
    are no XML give no row.
    """
    rows = documents.select(F.col(document).alias("document"), F.col(xsd).alias("xsd"))
    kind = documents.schema[document].dataType.simpleString()
    named = rows.mapInArrow(_parse, f"document {kind}, namespace string, {_FIELD}")
    return named.select(
        "document", "namespace", "position", "name",
        F.coalesce(F.nullif("type", F.lit("")), F.col("ref"), F.lit("")).alias("xsd_type"),
        F.coalesce(F.col("min").try_cast("int"), F.lit(1)).alias("min_occurs"),
        F.coalesce("max", F.lit("1")).alias("max_occurs"),
        F.nullif("doc", F.lit("")).alias("documentation"),
        F.col("enums").alias("enumeration_values"),
        "nested",
    ).withColumn("mapped_generator", generator_for(F.col("name"), F.col("xsd_type"), F.col("enumeration_values").isNotNull()))


def nested_fields(fields: DataFrame) -> DataFrame:
    """One row per child element of the fields, numbered from 0."""
    inner = fields.select("document", F.col("name").alias("parent"), F.posexplode("nested").alias("position", "n"))
    return inner.select(
        "document", "parent", "position", F.col("n.name").alias("name"),
        F.coalesce("n.type", F.lit("")).alias("xsd_type"),
        F.coalesce(F.col("n.min").try_cast("int"), F.lit(1)).alias("min_occurs"),
        F.coalesce("n.max", F.lit("1")).alias("max_occurs"),
        generator_for(F.col("n.name"), F.col("n.type"), F.lit(False)).alias("mapped_generator"),
    )


def template_rows(fields: DataFrame, rules: str = "broad") -> DataFrame:
    """Message fields as template fields, each parent followed by its children as ``parent_child``; reads ``fields`` once."""
    own = F.struct(
        F.lit(-1).alias("child"), F.col("name").alias("label"), F.col("xsd_type").alias("kind"),
        F.array_join("enumeration_values", ",").alias("values"),
    )
    inner = F.transform(
        F.coalesce("nested", F.array()),
        lambda n, i: F.struct(i.alias("child"), n["name"].alias("label"), n["type"].alias("kind"), F.lit(None).cast("string").alias("values")),
    )
    spread = fields.select("document", "position", "name", "mapped_generator", F.explode(F.concat(F.array(own), inner)).alias("f"))
    parent = F.col("f.child") < 0
    return spread.select(
        "document", "position", F.col("f.child").alias("child"),
        F.when(parent, F.col("name")).otherwise(F.concat_ws("_", "name", "f.label")).alias("name"),
        field_type_for(F.col("f.kind"), rules).alias("type"),
        F.when(parent, F.col("mapped_generator")).otherwise(generator_for(F.col("f.label"), F.col("f.kind"), F.lit(False))).alias("generator"),
        F.col("f.values").alias("values"),
    )
