"""Column expressions: keys, clipping, season, quantile function, distribution formulas."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_key(c: Column, width: int = 8) -> Column:
    """One spelling of a gauge key: trimmed, without a trailing .0, zero padded."""
    bare = F.regexp_replace(F.trim(c.cast("string")), r"\.0$|^0+", "")
    return F.when(F.length(bare) > width, bare).otherwise(F.lpad(bare, width, "0"))


def clip(c: Column, lo: float, hi: float) -> Column:
    """greatest/least skip nulls, so nulls are kept apart."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def rounded(c: Column, digits: int) -> Column:
    """Half away from zero also where a half is not exact in binary (results of division)."""
    return F.round(c + F.signum(c) * 10.0 ** -(digits + 5), digits)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r over rows where both have values; null where one of them is constant (where `corr` divides by zero)."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def season(month: Column) -> dict[str, Column]:
    angle = month * F.lit(2 * math.pi / 12)
    return {"month": month, "month_sin": F.sin(angle), "month_cos": F.cos(angle)}


def resolve_columns(df: DataFrame, want: Sequence[str] | Callable[[str], bool]) -> list[str]:
    """Columns of df that are wanted, in df's or the list's order, decided at plan time."""
    return [c for c in df.columns if want(c)] if callable(want) else [c for c in want if c in df.columns]


def quantile_bin(c: Column, edges: Sequence[float]) -> Column:
    """Bin of a value, from 1, closed on the right (the first one on both sides); equal edges are one, so bins that could
    hold nothing are not numbered.  Null outside the edges, and null stays null."""
    steps = sorted(set(edges))
    inner = sum(((c > e).cast("int") for e in steps[1:-1]), F.lit(1))
    return F.when((c >= steps[0]) & (c <= steps[-1]), inner)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: a lambda variable instead of a copy of the expression at each use.

    Without it, nested polynomials grow beyond what the JVM compiles."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


# Acklam's rational approximation of the normal quantile function.
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
LOW = 0.02425


def norm_ppf(p: Column) -> Column:
    """Standard normal quantile of p in (0, 1)."""

    def middle(centre: Column) -> Column:
        return let(centre * centre, lambda s: _polynomial(s, A) / _polynomial(s, B)) * centre

    def tail(q: Column) -> Column:
        return let(F.sqrt(-2 * F.log(q)), lambda r: _polynomial(r, C) / _polynomial(r, D))

    def quantile(x: Column) -> Column:
        inside = (x > 0) & (x < 1)
        return F.when(inside & (x < LOW), tail(x)).when(inside & (x <= 1 - LOW), middle(x - 0.5)).when(inside, -tail(1 - x))

    return let(p, quantile)


def glo_cdf(x: Column, xi: Column, alpha: Column, kappa: Column) -> Column:
    """Generalised logistic distribution function, kept away from 0 and 1."""

    def share(y: Column) -> Column:
        flat = 1 / (1 + F.exp(-y))
        bent = 1 / (1 + F.pow(F.greatest(1 - kappa * y, F.lit(1e-10)), 1 / F.when(F.abs(kappa) >= 1e-6, kappa)))
        return F.when(y.isNotNull(), clip(F.when(F.abs(kappa) < 1e-6, flat).otherwise(bent), 1e-6, 1 - 1e-6))

    return let((x - xi) / F.nullif(alpha, F.lit(0.0)), share)


def glo_parameters(l1: Column, l2: Column, l3: Column, variant: str = "inverted") -> dict[str, Column]:
    """Location, scale and shape from L-moments.

    variant "inverted" takes the scale factor in the form that the results to match were made
    with; "hosking" is the published estimator, its reciprocal."""
    tau = clip(l3 / F.nullif(l2, F.lit(0.0)), -0.99, 0.99)
    kappa = -tau
    angle = F.abs(kappa) * math.pi
    small = F.abs(kappa) < 1e-6
    factor = angle / F.sin(angle) if variant == "inverted" else F.sin(angle) / angle
    raw = F.when(small, l2).otherwise(l2 * factor)
    alpha = F.when(raw <= 0, F.abs(l2)).otherwise(raw)
    xi = F.when(small, l1).otherwise(l1 - alpha * (1 / kappa - math.pi / F.sin(kappa * math.pi)))
    return {"xi": xi, "alpha": alpha, "kappa": F.when(small, F.lit(0.0)).otherwise(kappa)}


def gamma_parameters(l1: Column, l2: Column, mean: Column, variance: Column, variant: str = "plain") -> dict[str, Column]:
    """Shape and scale from the L-moment ratio, or from moments where that fails.

    variant "plain" puts t itself into the rational form; "published" puts pi t squared."""
    t = l2 / F.nullif(l1, F.lit(0.0))
    z = t if variant == "plain" else math.pi * t * t
    rational = (1 - 0.308 * z) / (z - 0.05812 * z * z + 0.01765 * z * z * z)
    usable = (t > 0) & (t < 0.5) & (rational > 0) & (rational <= 1000)
    return {
        "shape": F.when(usable, rational).otherwise(mean * mean / F.nullif(variance, F.lit(0.0))),
        "scale": F.when(usable, l1 / rational).otherwise(variance / F.nullif(mean, F.lit(0.0))),
    }
