"""Numbers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Splits a double into halves whose products are exact.
_HALVES = float(2**27 + 1)
#: From here on a double times ten thousand has no places after the point.
_WHOLE = float(2**52)


def rounded(value: Column, places: int = 4) -> Column:
    """The double next to the value rounded to 0 to 15 places, ties to even; what counts is the value's binary number, not the decimal that it is printed as.

    The product p of value and 10**places is made exact by its rounding error e. Where p lies between two whole numbers, e says on which side the value is; with e of 0 it is a tie. Values that are too large to have such places, infinite ones and NaN are unchanged.
    """
    power = float(10**places)

    def halves(x: Column) -> tuple[Column, Column]:
        c = x * _HALVES
        high = c - (c - x)
        return high, x - high

    def of(x: Column) -> Column:
        v, p = x["v"], x["p"]
        (a, b), (c, d) = halves(v), halves(F.lit(power))
        error = ((a * c - p) + a * d + b * c) + b * d
        down = F.floor(p).cast("double")
        middle = p - down == 0.5
        whole = F.when(middle & (error > 0), down + 1.0).when(middle & (error < 0), down).otherwise(F.rint(p))
        found = whole / power
        return F.when((found == 0) & (v < 0), F.lit(-0.0)).otherwise(found)

    v = value.cast("double")
    small = F.abs(v) * power < _WHOLE
    return F.when(small, let(F.struct(v.alias("v"), (v * power).alias("p")), of)).otherwise(v)
