"""Rounding of doubles by their exact binary value.

The built-in round works on the shortest decimal text of a double, so 2.675 (which is a little
less than it reads) goes up. Here the product with the scale is kept exact as a sum of two doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = float((1 << 27) + 1)
_EXACT_DIGITS = 7  # 10**7 still fits in 26 bits, so both half products below are exact


def units(x: Column, digits: int, ties_up: bool = False) -> Column:
    """The whole number of ``10**-digits`` nearest to ``x``; an exact tie goes to the even one, or up."""
    scale = F.lit(float(10**digits))
    product = x * scale
    wide = x * F.lit(_SPLIT)
    high = wide - (wide - x)
    error = (high * scale - product) + (x - high) * scale
    whole = F.floor(product)
    past_half = (product - whole - F.lit(0.5)) + error
    at_tie = F.lit(True) if ties_up else whole % 2 != 0
    return whole + F.when((past_half > 0) | ((past_half == 0) & at_tie), 1).otherwise(0)


def round_half_even(x: Column, digits: int) -> Column:
    """``x`` to ``digits`` decimals; numbers too large to have any are left alone."""
    if not 0 <= digits <= _EXACT_DIGITS:
        return F.bround(x, digits)
    small = F.abs(x) < F.lit(float(1 << 52) / 10**digits)
    return F.when(small, units(x, digits).cast("double") / F.lit(float(10**digits))).otherwise(x)
