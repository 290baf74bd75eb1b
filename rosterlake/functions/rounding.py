"""One rounding rule: to the nearest decimal of the exact binary value, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double's 53 bits in two halves whose products are exact.
_SPLIT = float(2**27 + 1)


def _halves(x: Column) -> tuple[Column, Column]:
    c = x * F.lit(_SPLIT)
    high = c - (c - x)
    return high, x - high


def rounded(x: Column, places: int) -> Column:
    """x to so many decimals (up to 22). Scaling rounds once by itself: 2.675 lies below its decimal, while 2.675 * 100 is 267.5
    exactly. What scaling lost is kept as the product's error term, and decides where the product is a tie.

    Null, NaN and infinite values stay; so do values whose scaled ones have no fraction in a double (2**52 and more).
    """
    x = x.cast("double")
    scale = float(10**places)
    p = x * F.lit(scale)
    (high, low), s_high = _halves(x), float(scale * _SPLIT) - (float(scale * _SPLIT) - scale)
    s_low = scale - s_high
    lost = ((high * F.lit(s_high) - p) + high * F.lit(s_low) + low * F.lit(s_high)) + low * F.lit(s_low)
    below = F.floor(p).cast("double")
    tie = (p - below) == 0.5
    whole = F.when(tie & (lost > 0), below + 1.0).when(tie & (lost < 0), below).otherwise(F.rint(p))
    return F.when((F.abs(p) < float(2**52)), whole / F.lit(scale)).otherwise(x)
