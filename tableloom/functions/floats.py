"""Doubles as text the way a template prints them: 0.5, 10000000.0, 1e+16."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def float_text(x: Column) -> Column:
    """Plain digits from 1e-4 up to 1e16, a short exponent elsewhere."""
    size = F.abs(x)
    text = F.regexp_replace(x.cast("string"), r"\.0E", "E")
    text = F.regexp_replace(F.regexp_replace(text, r"E-(\d)$", "e-0$1"), r"E-", "e-")
    exponent = F.regexp_replace(text, r"E(\d)", "e+$1")
    return (
        F.when((size >= 1e-3) & (size < 1e7), x.cast("string"))  # printed plainly as it is
        .when(x == 0, F.lit("0.0"))
        .when((size >= 1e-4) & (size < 1e16), _plain(x, 20))
        .otherwise(exponent)
    )


def _plain(x: Column, digits: int) -> Column:
    text = F.rtrim(x.cast(f"decimal(38,{digits})").cast("string"), F.lit("0"))
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)
