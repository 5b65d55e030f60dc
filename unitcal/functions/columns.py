"""Column expressions shared by the operators.  All of them stay inside codegen."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296


def inf() -> Column:
    return F.lit(float("inf"))


def nan() -> Column:
    return F.lit(float("nan"))


def is_finite(c: Column) -> Column:
    """True for a real number: not NULL, not NaN, not +-Infinity."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != inf())


def to_double(c: Column) -> Column:
    """Numeric text to double; text that is no number becomes NULL."""
    return c.try_cast("double")


def approximately(c: Column, reference, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Tolerance test against ``reference``: |c - ref| <= atol + rtol * |ref|."""
    ref = reference if isinstance(reference, Column) else F.lit(float(reference))
    return F.abs(c - ref) <= (F.lit(atol) + F.lit(rtol) * F.abs(ref))


def high_flag(value: Column, threshold: float, inclusive: bool = True) -> Column:
    return value >= threshold if inclusive else value > threshold


def signed_asinh(c: Column) -> Column:
    """Inverse hyperbolic sine that keeps its precision far below zero.

    The built-in loses all digits for large negative input and returns -Infinity.
    """
    return F.signum(c) * F.asinh(F.abs(c))


def draw_bits(*parts) -> Column:
    """A reproducible 32-bit draw: the first eight hex digits of md5(part:part:...)."""
    return hex_slot(F.md5(joined(*parts)), 0)


def joined(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def hex_slot(digest: Column, slot: int) -> Column:
    """The ``slot``-th group of eight hex digits of a digest, as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * slot + 1, 8), 16, 10).cast("bigint")


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


# The rational approximation of the normal tail by Hart (1968) in the
# double-precision form of West (2005).  Highest power first.
HART_NUMERATOR = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
HART_DENOMINATOR = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
HART_SWITCH = 7.07106781186547
HART_LIMIT = 37.0


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, about 1e-15 absolute error."""

    def horner(x: Column, coefficients) -> Column:
        return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))

    x = F.abs(z)
    bell = F.exp(-x * x / 2.0)
    near = bell * horner(x, HART_NUMERATOR) / horner(x, HART_DENOMINATOR)
    fraction = x + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = x + F.lit(k) / fraction
    far = bell / fraction / math.sqrt(2.0 * math.pi)
    tail = F.when(x > HART_LIMIT, F.lit(0.0)).when(x < HART_SWITCH, near).otherwise(far)
    return F.when(z > 0, 1.0 - tail).otherwise(tail)
