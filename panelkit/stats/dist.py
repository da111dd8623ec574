"""Tail probabilities of the t and F distributions on result rows.

Spark has no such function; these run as Arrow-batched UDFs over test results
(one row per test), never over data rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.missing import ColumnLike, as_col

NORMAL_975 = 1.959963984540054


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / guard(1.0 + even * d)
        c = guard(1.0 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / guard(1.0 + odd * d)
        c = guard(1.0 + odd / c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1.0) < 1e-14):
            return h
    raise ArithmeticError("the continued fraction of the incomplete beta function did not settle")


def _log_gamma_step(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """log gamma(p + q) - log gamma(p), also where the two are huge and close."""
    plain = np.vectorize(math.lgamma, otypes=[float])
    big = p > 1e6
    with np.errstate(divide="ignore", invalid="ignore"):
        stirling = (p + q - 0.5) * np.log1p(q / p) + q * (np.log(p) - 1) + 1 / (12 * (p + q)) - 1 / (12 * p)
    return np.where(big, stirling, plain(p + q) - plain(p))


def beta_cdf(a, b, x, rest=None) -> np.ndarray:
    """Regularised incomplete beta function, elementwise; ``rest`` is 1 - x where the
    caller knows it better than the difference does."""
    rest = 1 - np.asarray(x, dtype=float) if rest is None else rest
    a, b, x, rest = np.broadcast_arrays(*[np.asarray(v, dtype=float) for v in (a, b, x, rest)])
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out[ok & (x == 0)] = 0.0
    out[ok & (rest == 0)] = 1.0
    mid = ok & (x > 0) & (rest > 0)
    if mid.any():
        p, q, y, z = a[mid], b[mid], x[mid], rest[mid]
        swap = y > (p + 1) / (p + q + 2)
        p2, q2, y2 = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, z, y)
        lg = np.vectorize(math.lgamma, otypes=[float])
        most, least = np.maximum(p2, q2), np.minimum(p2, q2)
        front = np.exp(
            _log_gamma_step(most, least) - lg(least) + p2 * np.log(y2) + q2 * np.log1p(-y2)
        ) / p2
        tail = front * _beta_fraction(p2, q2, y2)
        out[mid] = np.where(swap, 1 - tail, tail)
    return out


def _gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by its series or continued fraction."""
    if not (a > 0 and x >= 0):
        return math.nan
    if x == 0 or math.isinf(x):
        return float(x == 0)
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h, m = d, 0
    while True:
        m += 1
        b += 2
        d = 1 / (b - m * (m - a) * d)
        c = b - m * (m - a) / c
        h *= c * d
        if abs(c * d - 1) < 1e-15 or m > 100_000:
            return front * h


# From here on the limits (normal, chi-square) are nearer than the beta function is.
LIMIT_DF = 1e8


def t_tail(t, df) -> np.ndarray:
    """Two-sided p value of t."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    with np.errstate(invalid="ignore", divide="ignore"):
        exact = beta_cdf(np.minimum(df, LIMIT_DF) / 2, np.full_like(df, 0.5), df / (df + t * t), t * t / (df + t * t))
    limit = np.array([math.erfc(abs(x) / math.sqrt(2)) for x in t.ravel()]).reshape(t.shape)
    return np.where((df > LIMIT_DF) & ~np.isnan(t), limit, exact)


def f_tail(f, df1, df2) -> np.ndarray:
    """Upper p value of F."""
    f, df1, df2 = np.broadcast_arrays(*[np.asarray(v, dtype=float) for v in (f, df1, df2)])
    with np.errstate(invalid="ignore", divide="ignore"):
        exact = beta_cdf(np.minimum(df2, LIMIT_DF) / 2, df1 / 2, df2 / (df2 + df1 * f), df1 * f / (df2 + df1 * f))
    far = (df2 > LIMIT_DF) & ~np.isnan(f)
    limit = np.array([_gamma_tail(k / 2, k * x / 2) if on else np.nan for x, k, on in zip(f.ravel(), df1.ravel(), far.ravel())])
    return np.where(far, limit.reshape(f.shape), exact)


def p_of_t(t: ColumnLike, df: ColumnLike) -> Column:
    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(t_tail(t.to_numpy(float), df.to_numpy(float)))

    return p(as_col(t).cast("double"), as_col(df).cast("double"))


def p_of_f(f: ColumnLike, df1: ColumnLike, df2: ColumnLike) -> Column:
    @F.pandas_udf("double")
    def p(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
        return pd.Series(f_tail(f.to_numpy(float), df1.to_numpy(float), df2.to_numpy(float)))

    return p(as_col(f).cast("double"), as_col(df1).cast("double"), as_col(df2).cast("double"))
