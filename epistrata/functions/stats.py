"""Small statistics without scipy: Student's t, rational approximation, smoothing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: The coefficients of Lanczos' series for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def lgamma(x) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers."""
    x = np.asarray(x, dtype=float) - 1
    series = LANCZOS[0] + sum(c / (x + i) for i, c in enumerate(LANCZOS[1:], 1))
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * np.log(t) - t + np.log(series)


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function of arrays by its continued fraction; terms grow with the root of a and b."""
    a, b, x = (np.array(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    shape = x.shape
    a, b, x = a.ravel(), b.ravel(), x.ravel()
    out = np.where(x >= 1, 1.0, 0.0)
    at = np.flatnonzero((x > 0) & (x < 1))
    a, b, x = a[at], b[at], x[at]
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = lambda v: np.where(v == 0, 1e-300, v)
    d = 1 / tiny(1 - (a + b) * x / (a + 1))
    c, f = np.ones_like(d), d.copy()
    left = np.arange(len(at))
    for m in range(1, 20_000):
        if not len(left):
            break
        p, q, z = a[left], b[left], x[left]
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d[left] = 1 / tiny(1 + num * d[left])
            c[left] = tiny(1 + num / c[left])
            f[left] *= c[left] * d[left]
        left = left[np.abs(c[left] * d[left] - 1) > 1e-15]
    out[at] = np.where(swap, 1 - front * f, front * f)
    return out.reshape(shape)


def t_cdf(t, df) -> np.ndarray:
    t, df = np.broadcast_arrays(np.asarray(t, dtype=float), np.asarray(df, dtype=float))
    tail = beta_inc(df / 2, 0.5, df / (df + t * t)) / 2
    return np.where(t > 0, 1 - tail, tail)


def t_quantile(q, df) -> np.ndarray:
    """Inverse of ``t_cdf`` by bisection, for arrays; NaN without degrees of freedom."""
    q, df = np.broadcast_arrays(np.asarray(q, dtype=float), np.asarray(df, dtype=float))
    ok = (df > 0) & (q > 0) & (q < 1)
    safe_q, safe_df = np.where(ok, q, 0.5), np.where(ok, df, 1.0)
    lo, hi = np.full(q.shape, -1e6), np.full(q.shape, 1e6)
    for _ in range(90):
        mid = (lo + hi) / 2
        low = t_cdf(mid, safe_df) < safe_q
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return np.where(ok, (lo + hi) / 2, np.nan)


@F.pandas_udf(T.DoubleType())
def t_half_width(df: pd.Series, scale: pd.Series, confidence: pd.Series) -> pd.Series:
    """Half the width of the two-sided interval of a mean with this scale; 0 at confidence 0."""
    keys, at = np.unique(np.stack([df.to_numpy(float), confidence.to_numpy(float)]), axis=1, return_inverse=True)
    width = np.where(keys[1] > 0, t_quantile((1 + keys[1]) / 2, keys[0]), 0.0)
    return pd.Series(width[at.reshape(-1)] * scale.to_numpy(float))


@F.pandas_udf(T.DoubleType())
def binom_tail(m: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X >= m) for X ~ Binomial(n, p), as the incomplete beta function of (m, n - m + 1) at p. Null in, null out."""
    m, n, p = (x.to_numpy(float, na_value=np.nan) for x in (m, n, p))
    inner = (m > 0) & (m <= n)
    tail = beta_inc(np.where(inner, m, 1.0), np.where(inner, n - m + 1, 1.0), np.where(inner, p, 0.5))
    out = np.where(m <= 0, 1.0, np.where(m > n, 0.0, tail))
    return pd.Series(np.where(np.isnan(m) | np.isnan(n) | np.isnan(p), np.nan, out)).astype("Float64").mask(np.isnan(m) | np.isnan(n) | np.isnan(p))


def _half_up(v: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as DuckDB rounds numbers that aren't negative: scaled, to the nearest whole number, halves up."""
    v = v * 10.0**digits
    whole = np.floor(v)
    return (whole + (v - whole >= 0.5)) / 10.0**digits


@F.pandas_udf(T.StructType([T.StructField("m", T.LongType()), T.StructField("total", T.LongType())]))
def rational(share: pd.Series, most: pd.Series) -> pd.DataFrame:
    """(m, total): the fraction nearest to a share with a denominator of ``most`` or less, the smallest one of those; nulls for null, NaN and infinity.

    In Arrow batches, a denominator at a time for all rows that it can still bring nearer."""
    x, most = (v.to_numpy(float, na_value=np.nan) for v in (share, most))
    known = np.isfinite(x) & (most >= 1)
    m, total = np.zeros(len(x), dtype="int64"), np.ones(len(x), dtype="int64")
    at = np.flatnonzero(known)
    z, limit, off = x[at], most[at], np.full(len(at), np.inf)
    for k in range(1, int(limit.max(initial=0)) + 1):
        near = np.floor(z * k + 0.5)
        to = _half_up(np.abs(z - near / k), 12)
        better = (to < off) & (k <= limit)
        m[at[better]], total[at[better]] = near[better], k
        off = np.where(better, to, off)
        left = (off > 0) & (k < limit)
        if 2 * np.count_nonzero(left) < len(left):
            at, z, limit, off = at[left], z[left], limit[left], off[left]
            if not len(at):
                break
    return pd.DataFrame({c: pd.Series(v, dtype="Int64").mask(~known) for c, v in (("m", m), ("total", total))})


def savitzky_golay(values, window: int, order: int = 3) -> np.ndarray:
    """Local least-squares polynomials, edges by the nearest value; unchanged if a value is NaN or the window is 0.

    A window not above the order becomes order + 1; an even one is one longer."""
    y = np.asarray(values, dtype=float)
    if not window or np.isnan(y).any() or not len(y):
        return y
    window = order + 1 if window <= order else window
    window += 1 - window % 2
    half = window // 2
    x = np.arange(-half, half + 1)
    weights = np.linalg.pinv(np.vander(x, order + 1, increasing=True))[0]
    padded = np.r_[np.full(half, y[0]), y, np.full(half, y[-1])]
    return np.convolve(padded, weights[::-1], mode="valid")


def correlation_p(r, n) -> np.ndarray:
    """Two-sided p-value of Pearson's r over n pairs; NaN for fewer than three."""
    r, n = np.broadcast_arrays(np.asarray(r, dtype=float), np.asarray(n, dtype=float))
    safe = np.where((n > 2) & (np.abs(r) < 1), r, 0.0)
    df = np.where(n > 2, n - 2, 1.0)
    t2 = safe * safe * df / (1 - safe * safe)
    p = beta_inc(df / 2, 0.5, df / (df + t2))
    return np.where((n < 3) | np.isnan(r), np.nan, np.where(np.abs(r) >= 1, 0.0, p))


@F.pandas_udf(T.DoubleType())
def correlation_test(r: pd.Series, n: pd.Series) -> pd.Series:
    p = correlation_p(r.to_numpy(float, na_value=np.nan), n.to_numpy(float))
    return pd.Series(p).astype("Float64").mask(np.isnan(p))
