"""XML templates as DataFrames of fields, and as specs for generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.plans.spec import Constraint, Field, Template

_BOUNDS = ("min", "max", "min_age", "max_age", "values", "weights", "right_digits", "format", "start", "end")
_NUMBERS = {"min": "double", "max": "double", "min_age": "int", "max_age": "int", "right_digits": "int"}
_ATTRIBUTES = ("name", "type", "generator", "unique", "formula", "null_probability", "if")
_FIELD = (
    f"struct<{','.join(f'_{a}:string' for a in _ATTRIBUTES)},"
    f"constraint:struct<{','.join(f'_{b}:string' for b in _BOUNDS)}>>"
)
_SCHEMA = (
    "_name string, _category string, meta struct<_description:string,_version:string>, "
    f"field array<{_FIELD}>, "
    "relationship array<struct<_type:string,_source:string,_target:string>>"
)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """One row per template: name, category, description, version, fields, relationships.

    Numbers that cannot be read become NULL; absent attributes take their defaults.
    """
    none = F.array().cast(f"array<{_FIELD}>")
    raw = spark.read.format("xml").option("rowTag", "template").option("useLegacyXMLParser", True).schema(_SCHEMA).load(path)
    return raw.select(
        F.coalesce("_name", F.lit("Untitled")).alias("name"),
        F.coalesce("_category", F.lit("General")).alias("category"),
        F.coalesce("meta._description", F.lit("")).alias("description"),
        F.coalesce("meta._version", F.lit("1.0")).alias("version"),
        F.transform(F.coalesce("field", none), _field).alias("fields"),
        F.col("relationship").alias("relationships"),
    )


def _field(f: Column) -> Column:
    bounds = [
        (f["constraint"][f"_{b}"].try_cast(_NUMBERS[b]) if b in _NUMBERS else f["constraint"][f"_{b}"]).alias(b)
        for b in _BOUNDS
    ]
    return F.struct(
        F.coalesce(f["_name"], F.lit("")).alias("name"),
        F.coalesce(f["_type"], F.lit("string")).alias("type"),
        F.coalesce(f["_generator"], F.lit("text")).alias("generator"),
        (F.lower(F.coalesce(f["_unique"], F.lit("false"))) == "true").alias("unique"),
        f["_formula"].alias("formula"),
        f["_null_probability"].try_cast("double").alias("null_probability"),
        f["_if"].alias("condition"),
        F.when(f["constraint"].isNotNull(), F.struct(*bounds)).alias("constraint"),
    )


def list_templates(templates: DataFrame) -> DataFrame:
    return templates.select("name", "category", "description", "version", F.size("fields").cast("bigint").alias("field_count"))


def template_fields(templates: DataFrame) -> DataFrame:
    """One row per field, numbered in template order, with the constraint spread out."""
    exploded = templates.select("name", F.posexplode("fields").alias("position", "f"))
    return exploded.select(
        F.col("name").alias("template"),
        "position",
        F.col("f.name").alias("name"),
        *[f"f.{c}" for c in ("type", "generator", "unique", "formula", "null_probability", "condition")],
        *[F.col(f"f.constraint.{b}").alias(b) for b in _BOUNDS],
    )


def get_template(templates: DataFrame, name: str) -> Template | None:
    """The template of exactly that name as a spec, or None."""
    row = templates.where(F.col("name") == name).first()
    if row is None:
        return None
    return Template(
        name=row.name,
        category=row.category,
        description=row.description,
        version=row.version,
        fields=tuple(field_from_row(f.asDict(recursive=True)) for f in row.fields),
        relationships=tuple((r["_type"] or "", r["_source"] or "", r["_target"]) for r in row.relationships or ()),
    )


def field_from_row(raw: dict) -> Field:
    bounds = {k: v for k, v in (raw.pop("constraint", None) or {}).items() if v is not None}
    return Field(**{k: v for k, v in raw.items() if v is not None}, constraint=Constraint(**bounds))
