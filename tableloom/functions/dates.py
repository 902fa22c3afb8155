"""Date bounds: ISO dates, ``today`` / ``now`` and offsets such as ``-5y`` or ``-30d``."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Length of each offset unit.
UNITS = {
    "y": timedelta(days=365.24),
    "M": timedelta(days=30.42),
    "w": timedelta(weeks=1),
    "d": timedelta(days=1),
    "h": timedelta(hours=1),
    "m": timedelta(minutes=1),
    "s": timedelta(seconds=1),
}
_OFFSET = re.compile(r"([+-]?\d+)([yMwdhms])")


def iso_text(moment: Column) -> Column:
    """``2024-06-01T10:30:00`` for a timestamp without zone."""
    return F.replace(moment.cast("string"), F.lit(" "), F.lit("T"))


def resolve_date(text: str, as_of: date) -> date:
    """The day that ``text`` means, seen from ``as_of``."""
    text = text.strip()
    if text in ("today", "now"):
        return as_of
    parts = _OFFSET.findall(text)
    if parts and "".join(n + u for n, u in parts) == text:
        shift = sum((int(n) * UNITS[u] for n, u in parts), timedelta())
        return (datetime(as_of.year, as_of.month, as_of.day) + shift).date()
    try:
        return date.fromisoformat(text[:10])
    except ValueError:
        raise ValueError(f"not a date or a relative date: {text!r}") from None


def years_before(day: date, years: int) -> date:
    """The same calendar day ``years`` earlier; 29 February falls back to the 28th."""
    try:
        return day.replace(year=day.year - years)
    except ValueError:
        return day.replace(year=day.year - years, day=28)
