"""Numeric column expressions: the normal law, index quantiles, rounding rules and window frames."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rows(by: list[str] | str, order: list[str | Column] | str, n: int | None = None, gap: int = 0) -> WindowSpec:
    """Frame of the last ``n`` rows (all so far without n), ending ``gap`` rows before the current one."""
    by, order = ([by] if isinstance(by, str) else by), ([order] if isinstance(order, str) else order)
    spec = W.partitionBy(*by).orderBy(*order)
    return spec.rowsBetween(W.unboundedPreceding if n is None else -(n - 1) - gap, -gap)


def filled(x: Column, frame: WindowSpec, n: int, value: Column) -> Column:
    """``value`` once the frame holds n values of x, else NULL."""
    return F.when(F.count(x).over(frame) == n, value)


def _poly(z: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * z + F.lit(c)
    return out


# Hart's rational approximation of the normal law (J. F. Hart, algorithm 5666), double precision.
HART_P = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_Q = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
# Acklam's rational approximation of the inverse normal law.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x computed once: long expressions would double in every use of x otherwise."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def normal_cdf(x: Column) -> Column:
    """P(Z <= x), accurate to about 1e-15."""
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    tail = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, e * _poly(a, HART_P) / _poly(a, HART_Q)).otherwise(
        e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + F.lit(0.65)))))) / 2.506628274631)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_ppf(p: Column) -> Column:
    """Inverse of normal_cdf for 0 < p < 1, else NULL: a rational start and one Newton step."""

    def start(p: Column) -> Column:
        q = p - 0.5
        middle = let(q * q, lambda r: _poly(r, ACKLAM_A) / _poly(r, ACKLAM_B)) * q
        low = let(F.sqrt(-2 * F.log(p)), lambda t: _poly(t, ACKLAM_C) / _poly(t, ACKLAM_D))
        high = let(F.sqrt(-2 * F.log(1 - p)), lambda t: -_poly(t, ACKLAM_C) / _poly(t, ACKLAM_D))
        return F.when(p < 0.02425, low).when(p > 0.97575, high).otherwise(middle)

    def improved(p: Column, x: Column) -> Column:
        step = (normal_cdf(x) - p) * F.lit(math.sqrt(2 * math.pi)) * F.exp(x * x / 2)
        return let(step, lambda s: x - s / (1 + x * s / 2))

    inside = F.when((p > 0) & (p < 1), p)
    return let(inside, lambda p: let(start(p), lambda x: improved(p, x)))


def _poly_sql(z: str, coefficients: tuple[float, ...]) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {z} + {c!r})"
    return out


def normal_cdf_sql(x: str) -> str:
    """The same law as SQL text, for engines without erf."""
    a = f"abs({x})"
    tail = f"(CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < 7.07106781186547 THEN exp(-{a} * {a} / 2) * {_poly_sql(a, HART_P)} / {_poly_sql(a, HART_Q)} ELSE exp(-{a} * {a} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65))))) / 2.506628274631 END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def index_quantile(values: Column, q: float) -> Column:
    """Element floor(n q) of a sorted array, the last one at most."""
    n = F.size(values)
    return F.element_at(values, F.least(F.floor(n * F.lit(q)).cast("int") + 1, n))


def half_away(x: Column) -> Column:
    """To the nearest integer, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def clean_zero(x: Column, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(x, digits) + F.lit(0.0)
