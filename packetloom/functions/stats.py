"""Statistical column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Greatest p-value of each severity.
SEVERITY = [(0.001, "CRITICAL"), (0.01, "HIGH"), (0.05, "MEDIUM")]


def normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal distribution, natively: a series near zero, a continued fraction beyond 2.5.

    Both converge to within 1e-13 relative error; far tails stay positive instead of vanishing as 1 - cdf would. Null stays null.
    """
    x = F.abs(z)
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    # Series: cdf - 1/2 = density * (x + x^3/3 + x^5/15 + ...), folded from its last term.
    down = lambda n: F.sequence(F.lit(n), F.lit(1), F.lit(-1))
    series = F.aggregate(down(40), F.lit(1.0), lambda sum_, k: F.lit(1.0) + sum_ * x * x / (2 * k + 1))
    near = F.lit(0.5) - density * x * series
    # Continued fraction: sf = density / (x + 1/(x + 2/(x + 3/(x + ...)))).
    far = F.greatest(x, F.lit(2.5))
    fraction = F.aggregate(down(80), far, lambda rest, k: far + k / rest)
    upper = F.when(x == math.inf, 0.0).when(x < 2.5, near).otherwise(density / fraction)
    return F.when(z >= 0, upper).otherwise(F.lit(1.0) - upper)


def p_value(z: Column, alternative: str) -> Column:
    """p of a z statistic against "two-sided", "greater" or "less"."""
    if alternative == "two-sided":
        return F.least(F.lit(1.0), normal_sf(F.abs(z)) * 2)
    if alternative == "greater":
        return normal_sf(z)
    if alternative == "less":
        return normal_sf(-z)
    raise ValueError(f"unknown alternative {alternative!r}")


def severity(p: Column) -> Column:
    out = F.lit("LOW")
    for bound, name in reversed(SEVERITY):
        out = F.when(p < bound, name).otherwise(out)
    return out


def ratio(top: Column, bottom: Column, otherwise: float | None = None) -> Column:
    """top / bottom where bottom is positive, else the other value (null by default)."""
    rest = F.lit(otherwise).cast("double")
    return F.when(bottom > 0, top / bottom).otherwise(rest)


def percent(part: Column, whole: Column, otherwise: float | None = 0.0) -> Column:
    return ratio(part * 100.0, whole, otherwise)

