"""Special functions that Spark lacks, vectorised over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
LARGE = 1e4  # from this shape on, terms by the thousand would be needed
NODES, WEIGHTS = np.polynomial.legendre.leggauss(96)


def _gamma_p_large(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(a, x) of large a: Gauss-Legendre quadrature of the density from x to its end on the nearer side."""
    peak = a - 1
    spread = np.sqrt(peak)
    above = x > peak
    low = np.maximum(0.0, np.minimum(peak - 12 * spread, x - 6 * spread))
    end = np.where(above, np.maximum(peak + 12 * spread, x + 6 * spread), low)
    half = (end - x) / 2
    away = (x[:, None] + half[:, None] * (NODES + 1) - peak[:, None]) / peak[:, None]
    heights = np.exp(np.maximum(peak[:, None] * (np.log1p(np.maximum(away, -1 + 1e-300)) - away), -745.0))
    stirling = (1 - 1 / (12 * peak) + 1 / (288 * peak**2)) / np.sqrt(2 * math.pi * peak)
    area = np.abs(half) * (heights @ WEIGHTS) * stirling
    return np.where(above, 1 - area, area)


def gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function P(a, x); nan for a <= 0 or x < 0."""
    a, x = np.asarray(a, float), np.asarray(x, float)
    out = np.full(np.broadcast(a, x).shape, np.nan)
    a, x = np.broadcast_to(a, out.shape), np.broadcast_to(x, out.shape)
    out[(a > 0) & (x == 0)] = 0.0
    large = (a > LARGE) & (x > 0)
    if large.any():
        out[large] = _gamma_p_large(a[large], x[large])
    series = (a > 0) & (a <= LARGE) & (x > 0) & (x < a + 1)
    if series.any():
        p, q = a[series], x[series]
        term = total = 1 / p
        k = p.copy()
        for _ in range(2000):
            k = k + 1
            term = term * q / k
            total = total + term
            if (term < total * 1e-16).all():
                break
        out[series] = total * np.exp(-q + p * np.log(q) - _lgamma(p))
    tail = (a > 0) & (a <= LARGE) & (x >= a + 1)
    if tail.any():
        p, q = a[tail], x[tail]
        b = q + 1 - p
        c, d = np.full_like(q, 1e300), 1 / b
        h = d.copy()
        for i in range(1, 2000):  # modified Lentz
            step = -i * (i - p)
            b = b + 2
            d = 1 / np.where(np.abs(step * d + b) < 1e-300, 1e-300, step * d + b)
            c = np.where(np.abs(b + step / c) < 1e-300, 1e-300, b + step / c)
            h = h * c * d
            if (np.abs(c * d - 1) < 1e-15).all():
                break
        out[tail] = 1 - np.exp(-q + p * np.log(q) - _lgamma(p)) * h
    return out


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        top = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or 1e-300)
        c = 1 + top / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    """Two-sided tail probability of Student's t."""
    return beta_i(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def _cdf(x: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
    return pd.Series(gamma_p(shape.to_numpy(float), (x / scale).to_numpy(float))).where(x.notna() & shape.notna() & scale.notna())


def gamma_cdf(x: Column, shape: Column, scale: Column) -> Column:
    return F.pandas_udf(_cdf, "double")(x, shape, scale)
