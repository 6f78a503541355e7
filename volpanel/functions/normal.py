"""Standard Normal density and distribution as Columns, so pricing stays inside code generation.

Spark has no ``erf``; the distribution uses G. West's published double-precision form of Hart's rational
approximation ("Better approximations to cumulative normal functions", 2005).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's coefficients, highest power first.
HART_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
HART_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
HART_SWITCH = 7.07106781186547
HART_TAIL = 0.65
SQRT_2PI = math.sqrt(2.0 * math.pi)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.lit(SQRT_2PI)


def normal_tail(a: Column) -> Column:
    """P(Z > a) for a ≥ 0. ``a`` occurs some twenty times: pass a plain column, not a long expression."""
    e = F.exp(-a * a / 2)
    centre = e * _horner(a, HART_NUMERATOR) / _horner(a, HART_DENOMINATOR)
    fraction = a + HART_TAIL
    for k in (4, 3, 2, 1):
        fraction = a + F.lit(float(k)) / fraction
    return F.when(a < HART_SWITCH, centre).otherwise(e / fraction / F.lit(SQRT_2PI))


def cdf_from_tail(x: Column, tail: Column) -> Column:
    """Distribution at ``x`` from the tail beyond |x|."""
    return F.when(x > 0, 1 - tail).otherwise(tail)


def norm_cdf(x: Column) -> Column:
    return cdf_from_tail(x, normal_tail(F.abs(x)))
