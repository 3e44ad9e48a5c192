"""The local smoother from power sums of blocks, against dense fits and an N x N operator."""

import numpy as np
import pandas as pd
import pytest

from paneloom.operators import localfit as LF
from paneloom.operators import plotdata as PD


def blocks_of(x, y, m):
    """Blocks of sorted x with their power sums."""
    parts = np.array_split(np.argsort(x), m)
    a, b = (np.array([f(x[p]) for p in parts]) for f in (np.min, np.max))
    half = np.where(b > a, (b - a) / 2, 1.0)
    t = [(x[p] - (a[i] + b[i]) / 2) / half[i] for i, p in enumerate(parts)]
    sums = np.array([[(u**k).sum() for k in range(LF.POWERS)] for u in t])
    mixed = np.array([[(y[p] * u**k).sum() for k in range(LF.MIXED)] for p, u in zip(parts, t)])
    return parts, a, b, np.array([float(len(p)) for p in parts]), sums, mixed


@pytest.mark.parametrize("draw", [lambda r, n: r.normal(size=n), lambda r, n: np.exp(3 * r.normal(size=n)), lambda r, n: r.integers(0, 900, n).astype(float)])
def test_blocks_give_bandwidths_and_moments(draw):
    rng = np.random.default_rng(7)
    x = np.unique(draw(rng, 5000))
    y = rng.normal(size=len(x))
    parts, a, b, w, sums, mixed = blocks_of(x, y, 100)
    for g in np.linspace(x.min(), x.max(), 40):
        d = np.abs(x - g)
        need = int(0.75 * len(x))
        h = np.sort(d)[need - 1]
        base, read = LF.bracket(a, b, w, g, need)
        near = np.sort(np.concatenate([d[parts[i]] for i in read]))
        assert near[need - int(base) - 1] == h and len(read) <= 8
        far, cross, read = LF.block_moments(a, b, sums, mixed, g, h)
        for i in read:
            u = (x[parts[i]] - g) / h
            k = np.where(np.abs(u) < 1, (1 - np.abs(u) ** 3) ** 3, 0)
            far = far + [(k * u**p).sum() for p in range(5)]
            cross = cross + [(k * u**p * y[parts[i]]).sum() for p in range(3)]
        u = (x - g) / h
        k = np.where(np.abs(u) < 1, (1 - np.abs(u) ** 3) ** 3, 0)
        assert np.allclose(far, [(k * u**p).sum() for p in range(5)], atol=1e-8 * len(x))
        assert np.allclose(cross, [(k * u**p * y).sum() for p in range(3)], atol=1e-8 * len(x))
        assert len(read) <= 3


def dense_rows(x, at, span):
    """Operator rows (value and slope) of direct fits at some places."""
    value, slope = [], []
    for g in at:
        d = np.abs(x - g)
        h = np.sort(d)[int(np.floor(len(x) * span + 1e-5)) - 1]
        k = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
        m = np.vander((x - g) / h, 3, increasing=True)
        solved = np.linalg.pinv(m.T @ (m * k[:, None]), hermitian=True) @ (m * k[:, None]).T
        value.append(solved[0])
        slope.append(solved[1] / h)
    return np.array(value), np.array(slope)


def test_band_against_the_dense_operator(spark):
    rng = np.random.default_rng(3)
    frames = []
    for f, n in (("a", 400), (None, 250)):
        x = np.round(rng.gamma(2, 2, n), 2)  # repeated x
        frames.append(pd.DataFrame({"f": f, "x": x, "y": np.sin(x) + 0.2 * rng.normal(size=n)}))
    p = pd.concat(frames)
    df = spark.createDataFrame(p).repartition(3)
    got = PD.smooth_loess(df, "x", "y", n=12, facet=["f"], band=True).toPandas()
    rows = df.selectExpr("f", "x AS __x", "y AS __y")
    fits = LF.LocalFit(rows, ["f"], 0.75, 12, 0.2).fits.toPandas()
    for part in frames:
        f, x, y = part["f"].iloc[0], part["x"].to_numpy(), part["y"].to_numpy()
        same = lambda t: t[t["f"].isna()] if f is None else t[t["f"] == f]
        mine = same(got).sort_values("point")
        at = np.sort(same(fits)[lambda t: t["point"] >= 12]["x"].to_numpy())
        assert len(at) >= 6
        value, slope = dense_rows(x, at, 0.75)
        rows_l = np.concatenate([value, slope])
        operator = LF.blend(x, at) @ rows_l
        delta = np.trace((np.eye(len(x)) - operator) @ (np.eye(len(x)) - operator).T)
        sigma = np.sqrt(((y - operator @ y) ** 2).sum() / delta)
        grid = np.linspace(x.min(), x.max(), 12)
        se = sigma * np.linalg.norm(LF.blend(grid, at) @ rows_l, axis=1)
        direct = dense_rows(x, grid, 0.75)[0]
        assert np.allclose(mine["y"], direct @ y, atol=1e-8)
        assert np.allclose(mine["se"], se, rtol=1e-7)
        # blending stays close to the operator without it
        assert np.allclose(mine["se"], sigma * np.linalg.norm(direct, axis=1), rtol=0.2)
        half = PD.t_quantile(0.95, np.array([delta])) * se
        assert np.allclose(mine["low"], mine["y"] - half, atol=1e-6) and np.allclose(mine["high"], mine["y"] + half, atol=1e-6)
