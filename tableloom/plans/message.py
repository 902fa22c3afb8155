"""From message schemas to templates and to tables of sample values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.functions.draw import Draws
from tableloom.functions.floats import float_text
from tableloom.plans.generate import row_numbers
from tableloom.plans.spec import Constraint, Field, Template
from tableloom.sources.xsd import template_rows

# Sample values by generator, picked at random where there are several.
SAMPLE_CHOICES = {
    "boolean": ["true", "false"],
    "currency_code": ["EUR", "USD", "GBP", "CHF", "JPY", "CAD", "AUD", "SEK", "NOK", "DKK", "PLN", "CZK"],
    "country_code": ["DE", "FR", "GB", "IT", "ES", "NL", "BE", "AT", "CH", "PL", "SE", "NO", "DK", "FI", "PT"],
    "name": ["John Smith", "Maria Garcia", "Hans Mueller", "Sophie Dubois", "Luca Rossi", "Anna Kowalski"],
    "company": ["Acme Corp", "Global Finance Ltd", "EuroBank SA", "Nordic Trade AB", "Mediterranean Shipping"],
    "swift": ["BOFAUS3NXXX"],
    "date_between": ["2024-06-01"],
    "date_time": ["2024-06-01T10:30:00"],
    "text": ["Sample text value"],
    "url": ["https://example.com"],
    "city": ["Berlin"],
    "zipcode": ["10115"],
    "street_address": ["123 Main Street"],
    "phone_number": ["+49 30 12345678"],
    "email": ["user@example.com"],
}


def message_template(fields: DataFrame, name: str, category: str = "ISO 20022", rules: str = "broad") -> Template:
    """The fields of one message as a template; a name that no column can bear is made one."""
    rows = F.collect_list(F.struct("position", "child", "name", "type", "generator", "values"))
    messages = template_rows(fields, rules).groupBy("document").agg(F.sort_array(rows).alias("rows")).limit(2).collect()
    if len(messages) > 1:
        raise ValueError("a template is made from the fields of one message; filter them by document first")
    made = []
    for row in messages[0]["rows"] if messages else ():
        bounds = Constraint(values=row["values"]) if row["values"] else Constraint()
        plain = "".join(ch if ch.isascii() and (ch.isalnum() or ch == "_") else "_" for ch in row["name"])
        made.append(Field(plain if not plain[0].isdigit() else f"_{plain}", row["generator"], row["type"], constraint=bounds))
    return Template(name=name, category=category, description=f"Generated from {name}", fields=tuple(made))


def sample_value(name: str, generator: str, choices: list[str] | None, draws: Draws) -> Column:
    """A sample text value for a message field."""
    if generator == "random_element" and choices:
        return draws.pick(choices)
    if generator in SAMPLE_CHOICES:
        return draws.pick(SAMPLE_CHOICES[generator])
    if generator == "pydecimal":
        return float_text((draws.below(99_999_999) + 1).cast("double") / F.lit(100.0))
    if generator == "random_int":
        return draws.below(1_000_000).cast("string")
    if generator == "iban":
        check = (draws.below(90, "check") + 10).cast("string")
        return F.concat(F.lit("DE"), check, F.lit("100"), (draws.below(9 * 10**9, "account") + 10**9).cast("string"))
    if generator == "bban":
        return (draws.below(90_000_000) + 10_000_000).cast("string")
    if generator == "bothify":
        return F.concat(F.lit("REF-"), draws.below(100_000).cast("string"))
    return F.lit(f"[{generator}]")


def sample_rows(
    spark: SparkSession,
    fields: list[tuple[str, str, list[str] | None]],
    seed: int,
    rows: int | None = None,
    row_ids: DataFrame | None = None,
) -> DataFrame:
    """Sample values, all text, for ``(name, generator, choices)`` fields: ``rows`` of them, or one per row id."""
    if (rows is None) == (row_ids is None):
        raise ValueError("give either a number of rows or row ids")
    base = row_numbers(spark, rows).toDF("__row_id") if row_ids is None else row_ids.toDF("__row_id")
    ids = [F.col("__row_id")]
    values = [sample_value(n, g, c, Draws((seed, "sample", n), ids)).alias(n) for n, g, c in fields]
    kept = [] if row_ids is None else [F.col("__row_id").alias("row_id")]
    return base.select(*kept, *values)
