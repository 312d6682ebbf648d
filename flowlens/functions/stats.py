"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chebyshev coefficients of erfc, relative error 1.2e-7 (fixed values, from public numerical literature).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = 1.0 / (1.0 + 0.5 * z)
    poly = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        poly = F.lit(c) + t * poly
    r = t * F.exp(-z * z + poly)
    return F.when(x >= 0, r).otherwise(2.0 - r)


def normal_p(t: Column) -> Column:
    """Two-sided p of a standard normal t."""
    return erfc(F.abs(t) / F.sqrt(F.lit(2.0)))


def erfc_sql(x: str) -> str:
    t, poly = f"(1.0/(1.0+0.5*abs({x})))", repr(ERFC[-1])
    for c in ERFC[-2::-1]:
        poly = f"({c!r}+{t}*{poly})"
    r = f"({t}*exp(-({x})*({x})+{poly}))"
    return f"case when {x} >= 0 then {r} else 2.0-{r} end"


def welch_t(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    return F.try_divide(m1 - m2, F.sqrt(v1 / n1 + v2 / n2))


def cohens_d(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    pooled = F.sqrt(F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))
    return F.try_divide(m1 - m2, pooled)


def verdict(p: Column) -> Column:
    """A p in words."""
    return F.when(p < 0.01, "highly significant").when(p < 0.05, "significant").when(p < 0.10, "marginal").otherwise("not significant")


def expected_false(n: Column, alpha: float = 0.05) -> Column:
    """How many of n tests would pass by chance."""
    return n * F.lit(alpha)
