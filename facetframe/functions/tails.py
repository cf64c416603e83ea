"""Tail probabilities of Student's t and Fisher's F, vectorised.

Spark SQL has no distribution functions. These run over result rows (one per
column pair or series), never over the data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300
_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + step / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    inside = (x > 0) & (x < 1)
    xs = np.where(inside, x, 0.5)
    log_front = (_LGAMMA(a + b) - _LGAMMA(a) - _LGAMMA(b)
                 + a * np.log(xs) + b * np.log1p(-xs))
    direct = xs < (a + 1.0) / (a + b + 2.0)
    left = _beta_fraction(np.where(direct, a, b), np.where(direct, b, a),
                          np.where(direct, xs, 1.0 - xs))
    value = np.exp(log_front) * left / np.where(direct, a, b)
    value = np.where(direct, value, 1.0 - value)
    return np.where(inside, value, np.where(x <= 0, 0.0, 1.0))


def correlation_p_values(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p of a Pearson coefficient: t with n-2 degrees of freedom."""
    r = np.asarray(r, dtype=float)
    n = np.asarray(n, dtype=float)
    freedom = n - 2.0
    usable = freedom > 0
    safe = np.where(usable, freedom, 1.0)
    x = np.clip(1.0 - r * r, 0.0, 1.0)          # = freedom / (freedom + t^2)
    p = incomplete_beta(safe / 2.0, np.full_like(safe, 0.5), x)
    return np.where(usable, p, np.where(n == 2, 1.0, np.nan))


@F.pandas_udf(T.DoubleType())
def _p_of_r(r: pd.Series, n: pd.Series) -> pd.Series:
    known = r.notna() & n.notna()
    out = pd.Series(np.nan, index=r.index)
    if known.any():
        out[known] = correlation_p_values(r[known].to_numpy(), n[known].to_numpy())
    return out


@F.pandas_udf(T.DoubleType())
def _p_of_f(f: pd.Series, between: pd.Series, within: pd.Series) -> pd.Series:
    f, d1, d2 = (s.astype(float) for s in (f, between, within))
    known = f.notna() & (d1 > 0) & (d2 > 0)
    out = pd.Series(np.nan, index=f.index)
    if known.any():
        a, b, x = d2[known] / 2, d1[known] / 2, d2[known] / (d2[known] + d1[known] * f[known])
        out[known] = incomplete_beta(a.to_numpy(), b.to_numpy(), x.to_numpy())
    return out


def p_of_correlation(r: Column, n: Column) -> Column:
    return F.nanvl(_p_of_r(r, n.cast("double")), F.lit(None).cast("double"))


def p_of_f_ratio(f: Column, between_df: Column, within_df: Column) -> Column:
    p = _p_of_f(f, between_df.cast("double"), within_df.cast("double"))
    return F.nanvl(p, F.lit(None).cast("double"))
