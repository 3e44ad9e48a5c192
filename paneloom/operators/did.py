"""Treatment panels, difference-in-differences and its doubly robust forms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions.scalars import flag, ratio
from paneloom.operators.linreg import ols
from paneloom.operators.verbs import exclude_unit, lagged, lookup
from paneloom.session import cut_lineage


def treatment_assign(flows: DataFrame, leader: str, item: str, shock: int, above: float | Column = 0.0) -> DataFrame:
    """importer, treated: 1 for importers the leader served in the year before the shock.

    Importers without such a flow, or with one not larger than ``above``, are
    controls (0). ``flows`` holds one element.
    """
    mine = (F.col("exporter") == leader) & (F.col("year") == shock - 1) & (F.col("item") == item)
    served = F.max(F.when(mine, flag(F.col("value") > above)))
    return flows.groupBy("importer").agg(F.coalesce(served, F.lit(0.0)).alias("treated"))


def treatment_panel(
    panel: DataFrame,
    treated: DataFrame,
    leader: str,
    shock: int,
    min_pre: int = 7,
    covariate: DataFrame | None = None,
) -> DataFrame:
    """area, year, y, d (and lag_x): rows with known outcome of units with enough pre-shock rows.

    ``panel`` has area, year, value; ``covariate`` has area, year, x and enters
    with one lag by unit. Rows without outcome or lag are dropped before the
    pre-shock rows are counted.
    """
    rows = panel.select("area", "year", F.col("value").alias("y"))
    if covariate is not None:
        rows = lookup(rows, covariate, ["area", "year"], ["x"])
        rows = lagged(rows, ["area"], "year", {"lag_x": ("x", 1)}).drop("x").where(F.col("lag_x").isNotNull())
    rows = rows.where(F.col("y").isNotNull())
    enough = rows.where(F.col("year") < shock).groupBy("area").agg(F.count("y").alias("n")).where(F.col("n") >= min_pre)
    kept = exclude_unit(rows.join(enough, "area", "left_semi"), "area", leader)
    marked = lookup(kept, treated, {"area": "importer"}, ["treated"])
    d = F.when(F.col("year") < shock, F.lit(0.0)).otherwise(F.coalesce(F.col("treated"), F.lit(0.0)))
    return marked.withColumn("d", d).drop("treated")


def did2x2(df: DataFrame, y: str, treat: str, post: str) -> DataFrame:
    """Outcome on treatment, period and their product with HC2 errors; the product is the effect."""
    return ols(df, y, [treat, post], interactions=[(treat, post)], se="hc2")


def drdid_nocov(df: DataFrame, y0: str, y1: str, d: str) -> DataFrame:
    """Difference of mean changes between treated and controls, with its influence-function error."""
    change = F.col(y1).cast("double") - F.col(y0).cast("double")
    rows = df.select(change.alias("dy"), F.col(d).cast("double").alias("d")).where(F.col("dy").isNotNull() & F.col("d").isNotNull())
    on, off = F.when(F.col("d") == 1, F.col("dy")), F.when(F.col("d") == 0, F.col("dy"))
    m = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(on).alias("n1"),
        F.count(off).alias("n0"),
        F.avg(on).alias("m1"),
        F.avg(off).alias("m0"),
        F.var_pop(on).alias("v1"),
        F.var_pop(off).alias("v0"),
    )
    n = F.col("n")
    # Sum of squared influence values over n - 1, then over n.
    squares = n * n * (ratio("v1", "n1") + ratio("v0", "n0"))
    return m.select(
        (F.col("m1") - F.col("m0")).alias("att"),
        F.sqrt(ratio(squares, (n - 1) * n)).alias("std_error"),
        n.alias("nobs"),
    )


def _dot(coefs: Sequence[float], xs: Sequence[Column]) -> Column:
    return reduce(lambda u, v: u + v, [F.lit(float(c)) * x for c, x in zip(coefs, xs)])


def drdid(df: DataFrame, y0: str, y1: str, d: str, x: Sequence[str] = (), method: str = "trad", tol: float = 1e-10) -> DataFrame:
    """Doubly robust panel difference-in-differences: att, std_error, conf_low, conf_high, nobs.

    ``trad``: logit propensity by maximum likelihood, control outcome regression
    by least squares. ``imp``: calibrated propensity and weighted outcome
    regression. Every Newton step is one distributed aggregate of k x k
    moments; rows never leave the executors.
    """
    if method not in ("trad", "imp"):
        raise ValueError(f"unknown method {method!r}")
    k = len(x) + 1
    rows = df.select(
        (F.col(y1).cast("double") - F.col(y0).cast("double")).alias("dy"),
        F.col(d).cast("double").alias("d"),
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)],
    ).dropna()
    rows = cut_lineage(rows)
    # Standardised covariates: same estimates, well-conditioned steps.
    stats = rows.agg(F.count(F.lit(1)), *[f(f"x{i}") for i in range(k - 1) for f in (F.avg, F.stddev_pop)]).first()
    n = int(stats[0])
    if not n:
        raise ValueError("both treated and control units are needed")
    xs: list[Column] = [F.lit(1.0)]
    for i in range(k - 1):
        mean, sd = stats[1 + 2 * i], stats[2 + 2 * i] or 1.0
        xs.append((F.col(f"x{i}") - F.lit(float(mean))) / F.lit(float(sd)))
    dd, dy = F.col("d"), F.col("dy")

    def sums(*cols: Column) -> np.ndarray:
        return np.array([v if v is not None else 0.0 for v in rows.agg(*[F.sum(c) for c in cols]).first()], dtype=float)

    def square(flat: np.ndarray) -> np.ndarray:
        out = np.zeros((k, k))
        out[np.triu_indices(k)] = flat
        return out + np.triu(out, 1).T

    def outer(weight: Column) -> list[Column]:
        return [weight * xs[i] * xs[j] for i in range(k) for j in range(i, k)]

    half = k * (k + 1) // 2
    share = sums(dd)[0] / n
    if not 0 < share < 1:
        raise ValueError("both treated and control units are needed")
    gamma = np.zeros(k)
    gamma[0] = np.log(share / (1 - share))

    def newton(gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Hessian, gradient and objective (to minimise) at gamma."""
        index = _dot(gamma, xs)
        if method == "trad":
            p = 1 / (1 + F.exp(-index))
            loss = F.when(index > 0, index + F.log1p(F.exp(-index))).otherwise(F.log1p(F.exp(index))) - dd * index
            got = sums(*outer(p * (1 - p)), *[(p - dd) * c for c in xs], loss)
        else:
            tilt = (1 - dd) * F.exp(index)
            got = sums(*outer(tilt), *[(tilt - dd) * c for c in xs], tilt - dd * index)
        return square(got[:half]), got[half : half + k], got[-1]

    hessian, grad, loss = newton(gamma)
    for _ in range(100):
        step = np.linalg.solve(hessian, grad)
        size = 1.0
        while True:
            trial = gamma - size * step
            h2, g2, l2 = newton(trial)
            if np.isfinite(l2) and l2 <= loss + 1e-12 * abs(loss) or size < 1e-6:
                break
            size /= 2
        gamma, hessian, grad, loss = trial, h2, g2, l2
        if np.max(np.abs(size * step)) < tol:
            break
    else:
        raise RuntimeError("the propensity model did not converge")

    index = _dot(gamma, xs)
    odds = F.exp(index)
    weight = (1 - dd) * (odds if method == "imp" else F.lit(1.0))
    got = sums(*outer(weight), *[weight * dy * c for c in xs])
    cross = square(got[:half])
    beta = np.linalg.solve(cross, got[half:])
    left = dy - _dot(beta, xs)
    w1, w0 = dd, (1 - dd) * odds
    t = sums(w1, w0, w1 * left, w0 * left)
    eta1, eta0 = t[2] / t[0], t[3] / t[1]
    mean1, mean0 = t[0] / n, t[1] / n
    inf1, inf0 = w1 * (left - eta1), w0 * (left - eta0)
    if method == "trad":
        m = sums(*[w1 * c for c in xs], *[w0 * (left - eta0) * c for c in xs], *[w0 * c for c in xs]) / n
        bread_ols, bread_ps = np.linalg.inv(cross / n), np.linalg.inv(hessian / n)
        lin_ols = lambda v: (1 - dd) * left * _dot(bread_ols @ v, xs)
        p = odds / (1 + odds)
        lin_ps = (dd - p) * _dot(bread_ps @ m[k : 2 * k], xs)
        inf1 = inf1 - lin_ols(m[:k])
        inf0 = inf0 + lin_ps - lin_ols(m[2 * k :])
    influence = inf1 / F.lit(float(mean1)) - inf0 / F.lit(float(mean0))
    se = F.stddev_samp(influence) / F.sqrt(F.lit(float(n)))
    att = F.lit(float(eta1 - eta0))
    return rows.agg(se.alias("std_error"), F.count(F.lit(1)).alias("nobs")).select(
        att.alias("att"),
        "std_error",
        (att - 1.96 * F.col("std_error")).alias("conf_low"),
        (att + 1.96 * F.col("std_error")).alias("conf_high"),
        "nobs",
    )


def drdid_long(
    df: DataFrame, unit: str, time: str, y: str, treat: str, before: int, after: int, x: Sequence[str] = (), method: str = "imp"
) -> DataFrame:
    """Doubly robust estimate from a long panel; covariates are those of the earlier period."""
    at = lambda t, c: F.max(F.when(F.col(time) == t, F.col(c)))
    wide = df.where(F.col(time).isin(before, after)).groupBy(unit).agg(
        at(before, y).alias("__y0"), at(after, y).alias("__y1"), F.max(treat).alias("__d"), *[at(before, c).alias(c) for c in x]
    )
    return drdid(wide, "__y0", "__y1", "__d", x, method)
