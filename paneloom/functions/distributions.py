"""Student t distribution for result rows (vectorised numpy, no data rows pass here)."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz scheme)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 400):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            out = out * step
        if np.nanmax(np.abs(step - 1.0), initial=0.0) < 1e-15:
            break
    return out


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    x = np.clip(x, 0.0, 1.0)
    flip = x > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(
            _lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb) + aa * np.log(xx) + bb * np.log1p(-xx)
        ) / aa
        val = np.where(xx <= 0.0, 0.0, front * _beta_fraction(aa, bb, xx))
    return np.where(flip, 1.0 - val, val)


def t_two_sided_p(t, df) -> np.ndarray:
    """P(|T| > |t|) with ``df`` degrees of freedom; NaN where either is unknown."""
    t, df = np.broadcast_arrays(np.asarray(t, dtype=float), np.asarray(df, dtype=float))
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & (df > 0)
    if ok.any():
        out[ok] = incomplete_beta(df[ok] / 2.0, 0.5, df[ok] / (df[ok] + t[ok] ** 2))
    return out


def t_quantile(level: float, df) -> np.ndarray:
    """Value q with P(|T| <= q) = level, by bisection on the two-sided p-value."""
    each, where = np.unique(np.asarray(df, dtype=float), return_inverse=True)
    lo, hi = np.zeros(each.shape), np.full(each.shape, 1e7)
    for _ in range(200):
        mid = (lo + hi) / 2.0
        too_low = t_two_sided_p(mid, each) > 1.0 - level
        lo, hi = np.where(too_low, mid, lo), np.where(too_low, hi, mid)
        if np.all(hi - lo <= 1e-13 * np.maximum(hi, 1.0)):
            break
    found = np.where(each > 0, (lo + hi) / 2.0, np.nan)
    return found[where.reshape(np.shape(df))]
