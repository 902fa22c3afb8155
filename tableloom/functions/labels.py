"""Small text helpers: symbol lists and magnitude labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tableloom.functions.rounding import units

# Label suffix by lower bound.
MAGNITUDES = ((1e12, "T"), (1e9, "B"), (1e6, "M"))


def symbol_list(text: str) -> list[str]:
    """Symbols typed on lines or between commas: trimmed, upper case, blanks dropped."""
    return [s for s in (part.strip().upper() for part in re.split(r"[,\n]", text)) if s]


def symbol_array(text: Column) -> Column:
    """The same for a text column."""
    parts = F.transform(F.split(text, "[,\n]"), lambda s: F.upper(F.trim(s)))
    return F.filter(parts, lambda s: s != "")


def magnitude_label(amount: Column) -> Column:
    """``$1.25T``, ``$3.00B``, ``$9.99M``, else two decimals; NULL is a dash."""
    label = F.when(amount.isNull(), "—")
    for bound, suffix in MAGNITUDES:
        label = label.when(amount >= bound, F.concat(F.lit("$"), two_places(amount / bound), F.lit(suffix)))
    return label.otherwise(F.concat(F.lit("$"), F.format_number(amount, 2)))


def two_places(x: Column) -> Column:
    """Two decimals of a non-negative number by its exact value; an exact tie goes up."""
    cents = units(x, 2, ties_up=True)
    whole = F.call_function("div", cents, F.lit(100))
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
