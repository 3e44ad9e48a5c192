"""Least squares by groups.

One distributed aggregate computes the cross-products of every group (they
combine map-side, so a group may hold any share of the rows). The k x k systems
are solved on that one-row-per-group table. Robust and clustered variances take
a second pass in which the coefficients meet the rows again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.functions.distributions import t_quantile, t_two_sided_p
from paneloom.functions.scalars import ratio
from paneloom.operators.verbs import attach, quoted

COEF_COLUMNS = ["term", "estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high", "nobs", "r2", "df"]


def _by_fields(df: DataFrame, by: Sequence[str]) -> list[T.StructField]:
    return [df.schema[c] for c in by]


def coef_schema(fields: Sequence[T.StructField], extra: Sequence[str] = ()) -> T.StructType:
    schema = T.StructType(list(fields)).add("term", "string")
    for c in COEF_COLUMNS[1:]:
        schema = schema.add(c, "long" if c == "nobs" else "double")
    for c in extra:
        schema = schema.add(c, "double")
    return schema


def coef_frame(groups: pd.DataFrame, terms: Sequence[str], beta, se, nobs, r2, df, level: float) -> pd.DataFrame:
    """Result rows of many groups at once: ``beta`` and ``se`` are groups x terms."""
    g, k = beta.shape
    with np.errstate(all="ignore"):
        stat = np.where(se > 0, beta / se, np.nan)
    wide_df = np.repeat(np.asarray(df, dtype=float), k)
    q = t_quantile(level, wide_df)
    flat_b, flat_s = beta.ravel(), se.ravel()
    out = groups.loc[groups.index.repeat(k)].reset_index(drop=True)
    return out.assign(
        term=np.tile(np.array(terms, dtype=object), g),
        estimate=flat_b,
        std_error=flat_s,
        statistic=stat.ravel(),
        p_value=t_two_sided_p(stat.ravel(), wide_df),
        conf_low=flat_b - q * flat_s,
        conf_high=flat_b + q * flat_s,
        nobs=np.repeat(np.asarray(nobs, dtype="int64"), k),
        r2=np.repeat(np.asarray(r2, dtype=float), k),
        df=wide_df,
    )


def solve_normal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Solve A beta = b for a stack of symmetric systems.

    Returns beta, the inverse and a mask of the identified terms. A term that is
    a linear combination of earlier ones is left out (its mask is False), the
    rest are estimated as if it had not been listed.
    """
    g, k = b.shape
    beta, inverse, used = np.zeros((g, k)), np.zeros((g, k, k)), np.zeros((g, k), dtype=bool)
    scale = np.sqrt(np.clip(np.einsum("gii->gi", a), 0.0, None))
    for i in range(g):
        keep: list[int] = []
        for j in range(k):
            if scale[i, j] <= 0 or not np.isfinite(scale[i, j]):
                continue
            trial = keep + [j]
            s = scale[i, trial]
            corr = a[i][np.ix_(trial, trial)] / np.outer(s, s)
            if np.linalg.eigvalsh(corr)[0] > 1e-11:
                keep = trial
        if keep:
            s = scale[i, keep]
            corr_inv = np.linalg.inv(a[i][np.ix_(keep, keep)] / np.outer(s, s))
            inv = corr_inv / np.outer(s, s)
            inverse[i][np.ix_(keep, keep)] = inv
            beta[i, keep] = inv @ b[i, keep]
            used[i, keep] = True
    return beta, inverse, used


def _symmetric(pdf: pd.DataFrame, k: int, stem: str) -> np.ndarray:
    out = np.zeros((len(pdf), k, k))
    for i in range(k):
        for j in range(i, k):
            out[:, i, j] = out[:, j, i] = pdf[f"__{stem}{i}_{j}"].to_numpy(dtype=float)
    return out


def design(
    df: DataFrame, y: str, x: Sequence[str], keep: Sequence[str] = (), interactions: Sequence[tuple[str, str]] = ()
) -> tuple[DataFrame, list[str]]:
    """Model columns ``__y``, ``__x0``... of the complete rows, and the term names."""
    exprs = [f"CAST({quoted(c)} AS DOUBLE)" for c in x]
    exprs += [f"CAST({quoted(a)} AS DOUBLE) * CAST({quoted(b)} AS DOUBLE)" for a, b in interactions]
    terms = list(x) + [f"{a}:{b}" for a, b in interactions]
    inner = [f"CAST({quoted(y)} AS DOUBLE) AS __y", *[f"{e} AS __x{i}" for i, e in enumerate(exprs)]]
    rows = df.selectExpr(*map(quoted, dict.fromkeys(keep)), *inner)
    known = " AND ".join(f"{c} IS NOT NULL" for c in rows.columns if c.startswith("__"))
    return rows.where(known), terms


def _moments(rows: DataFrame, k: int, by: Sequence[str], intercept: bool) -> DataFrame:
    names = [f"__x{i}" for i in range(k)]
    if intercept:
        # Centred, and computed without cancellation.
        cross = lambda u, v: f"covar_pop({u}, {v}) * count(1)"
        centres = ["avg(__y) AS __my", *[f"avg({c}) AS __m{i}" for i, c in enumerate(names)]]
    else:
        cross = lambda u, v: f"sum({u} * {v})"
        centres = ["0D AS __my", *[f"0D AS __m{i}" for i in range(k)]]
    aggs = ["count(1) AS __n", *centres]
    aggs += [f"{cross(names[i], names[j])} AS __a{i}_{j}" for i in range(k) for j in range(i, k)]
    aggs += [f"{cross(names[i], '__y')} AS __b{i}" for i in range(k)] + [f"{cross('__y', '__y')} AS __yy"]
    return rows.groupBy(*by).agg(*[F.expr(a) for a in aggs])


def ols(
    df: DataFrame,
    y: str,
    x: Sequence[str],
    by: Sequence[str] = (),
    intercept: bool = True,
    se: str = "classic",
    cluster: Sequence[str] = (),
    interactions: Sequence[tuple[str, str]] = (),
    conf_level: float = 0.95,
) -> DataFrame:
    """Linear regression of ``y`` on ``x`` in every group of ``by``, all groups in one job.

    ``se`` is ``classic``, ``hc2`` or ``cluster`` (by the ``cluster`` columns,
    with the G/(G-1) * (n-1)/(n-k) factor). Rows with a NULL in any model column
    are left out. R2 is uncentred when there is no intercept.
    Returns by, term, estimate, std_error, statistic, p_value, conf_low,
    conf_high, nobs, r2, df.
    """
    rows, names = design(df, y, x, [*by, *cluster], interactions)
    k = len(names)
    const = 1 if intercept else 0
    terms = (["(Intercept)"] if intercept else []) + names
    fields = _by_fields(df, by)
    moments = _moments(rows, k, by, intercept)
    by_list = list(by)

    def fit(pdf: pd.DataFrame):
        a = _symmetric(pdf, k, "a")
        b = np.stack([pdf[f"__b{i}"].to_numpy(dtype=float) for i in range(k)], axis=1)
        beta, inverse, used = solve_normal(a, b)
        centre = np.stack([pdf[f"__m{i}"].to_numpy(dtype=float) for i in range(k)], axis=1)
        n, yy = pdf["__n"].to_numpy(dtype=float), pdf["__yy"].to_numpy(dtype=float)
        ssr = np.maximum(yy - np.einsum("gi,gi->g", beta, b), 0.0)
        dof = n - used.sum(axis=1) - const
        return beta, inverse, used, centre, n, yy, ssr, dof

    def report(pdf, meat, dof_se) -> pd.DataFrame:
        """Term rows from group moments; ``meat`` is None for classical variances."""
        beta, inverse, used, centre, n, yy, ssr, dof = fit(pdf)
        g = len(pdf)
        bread = np.zeros((g, k + const, k + const))
        bread[:, const:, const:] = inverse
        if const:
            bread[:, 0, 0] = 1.0 / n
        with np.errstate(all="ignore"):
            if meat is None:
                cov = bread * np.where(dof > 0, ssr / dof, np.nan)[:, None, None]
            else:
                cov = bread @ meat @ bread
            r2 = np.where(yy > 0, 1.0 - ssr / yy, np.nan)
        if const:
            # From the centred intercept back to the intercept at x = 0.
            turn = np.tile(np.eye(k + 1), (g, 1, 1))
            turn[:, 0, 1:] = -centre
            cov = turn @ cov @ turn.transpose(0, 2, 1)
            b0 = pdf["__my"].to_numpy(dtype=float) - np.einsum("gi,gi->g", beta, centre)
            beta = np.concatenate([b0[:, None], beta], axis=1)
            used = np.concatenate([np.ones((g, 1), dtype=bool), used], axis=1)
        std = np.sqrt(np.clip(np.einsum("gii->gi", cov), 0.0, None))
        return coef_frame(
            pdf[by_list], terms, np.where(used, beta, np.nan), np.where(used, std, np.nan), n, r2, dof if dof_se is None else dof_se, conf_level
        )

    if se == "classic":

        def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield report(pdf, None, None)

        return moments.mapInPandas(finish, coef_schema(fields))

    fitted_schema = T.StructType(list(moments.schema.fields)).add("__beta", T.ArrayType(T.DoubleType())).add("__inv", T.ArrayType(T.DoubleType()))

    def with_fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                beta, inverse = fit(pdf)[:2]
                yield pdf.assign(__beta=list(beta), __inv=list(inverse.reshape(len(pdf), -1)))

    fitted = moments.mapInPandas(with_fit, fitted_schema)
    small = fitted.select(*by, "__n", "__my", *[f"__m{i}" for i in range(k)], "__beta", "__inv")
    paired = attach(rows, small, by)
    resid = "__y - __my" + "".join(f" - __beta[{i}] * (__x{i} - __m{i})" for i in range(k))
    prep = paired.selectExpr(
        *map(quoted, dict.fromkeys([*by, *cluster])), "__n", "__inv", f"{resid} AS __e", *[f"__x{i} - __m{i} AS __z{i}" for i in range(k)]
    )
    zs = (["1D"] if const else []) + [f"__z{i}" for i in range(k)]
    pairs = [(i, j) for i in range(k + const) for j in range(i, k + const)]
    if se == "hc2":
        leverage = " + ".join(["1 / __n"] * const + [f"__inv[{i * k + j}] * __z{i} * __z{j}" for i in range(k) for j in range(k)])
        weighted = prep.withColumn("__w", F.expr(f"try_divide(__e * __e, 1 - ({leverage}))"))
        meat = weighted.groupBy(*by).agg(*[F.expr(f"sum({zs[i]} * {zs[j]} * __w) AS __v{i}_{j}") for i, j in pairs])
    elif se == "cluster":
        scores = prep.groupBy(*dict.fromkeys([*by, *cluster])).agg(*[F.expr(f"sum({c} * __e) AS __s{i}") for i, c in enumerate(zs)])
        meat = scores.groupBy(*by).agg(
            F.expr("count(1) AS __g"), *[F.expr(f"sum(__s{i} * __s{j}) AS __v{i}_{j}") for i, j in pairs]
        )
    else:
        raise ValueError(f"unknown variance {se!r}")
    clustered = se == "cluster"

    def finish_robust(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                mid, dof = _symmetric(pdf, k + const, "v"), None
                if clustered:
                    g, n = pdf["__g"].to_numpy(dtype=float), pdf["__n"].to_numpy(dtype=float)
                    with np.errstate(all="ignore"):
                        mid = mid * (g / (g - 1) * (n - 1) / (n - k - const))[:, None, None]
                    dof = g - 1
                yield report(pdf, mid, dof)

    return attach(fitted.drop("__beta", "__inv"), meat, by).mapInPandas(finish_robust, coef_schema(fields))


def iv2sls(df: DataFrame, y: str, x: str, z: str, by: Sequence[str] = (), conf_level: float = 0.95) -> DataFrame:
    """Two-stage least squares with one regressor and one instrument, from a single aggregate."""
    rows, _ = design(df, y, [x, z], by)
    xc, zc, yc = F.col("__x0"), F.col("__x1"), F.col("__y")
    n = F.count(F.lit(1))
    m = rows.groupBy(*by).agg(
        n.alias("n"),
        F.avg(xc).alias("mx"),
        F.avg(yc).alias("my"),
        (F.covar_pop(zc, xc) * n).alias("szx"),
        (F.covar_pop(zc, yc) * n).alias("szy"),
        (F.var_pop(zc) * n).alias("szz"),
        (F.var_pop(xc) * n).alias("sxx"),
        (F.covar_pop(xc, yc) * n).alias("sxy"),
        (F.var_pop(yc) * n).alias("syy"),
    )
    b = ratio("szy", "szx")
    m = m.withColumn("b", b)
    m = m.withColumn("ssr", F.col("syy") - 2 * F.col("b") * F.col("sxy") + F.col("b") * F.col("b") * F.col("sxx"))
    m = m.withColumn("s2", ratio("ssr", F.col("n") - 2))
    m = m.withColumn("vb", F.col("s2") * ratio("szz", F.col("szx") * F.col("szx")))
    m = m.withColumn("va", F.col("s2") / F.col("n") + F.col("mx") * F.col("mx") * F.col("vb"))
    m = m.withColumn("r2", 1 - ratio("ssr", "syy"))
    fields, by_list = _by_fields(df, by), list(by)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                slope = pdf["b"].to_numpy(dtype=float)
                beta = np.stack([pdf["my"].to_numpy(dtype=float) - slope * pdf["mx"].to_numpy(dtype=float), slope], axis=1)
                std = np.sqrt(np.clip(np.stack([pdf["va"].to_numpy(dtype=float), pdf["vb"].to_numpy(dtype=float)], axis=1), 0, None))
                n_obs = pdf["n"].to_numpy(dtype=float)
                yield coef_frame(pdf[by_list], ["(Intercept)", x], beta, std, n_obs, pdf["r2"], n_obs - 2, conf_level)

    return m.mapInPandas(finish, coef_schema(fields))


def ols_many(
    df: DataFrame, outcomes: Sequence[str], x: Sequence[str], by: Sequence[str] = (), **options
) -> DataFrame:
    """The same regressors for several outcome columns: outcomes become a group key, one job in all."""
    long = df.unpivot([*by, *x], list(outcomes), "outcome", "__outcome_value")
    return ols(long, "__outcome_value", x, by=["outcome", *by], **options)


def with_normal_interval(coefs: DataFrame, z: float = 1.96) -> DataFrame:
    """Interval of estimate +- z standard errors."""
    half = F.col("std_error") * z
    return coefs.withColumns({"conf_low": F.col("estimate") - half, "conf_high": F.col("estimate") + half})


def coef_wide(coefs: DataFrame, model: str, models: Sequence[str]) -> DataFrame:
    """Terms in rows; estimate, standard error, nobs and R2 of each listed model in columns."""
    cols = []
    for m in models:
        mine = F.col(model) == m
        for c in ("estimate", "std_error", "nobs", "r2"):
            cols.append(F.max(F.when(mine, F.col(c))).alias(f"{c}_{m}"))
    return coefs.groupBy("term").agg(*cols)


def variance_decomposition(flows: DataFrame, by: Sequence[str], unit: str, value: str = "value", time: Sequence[str] = ()) -> DataFrame:
    """How much of the variation of totals comes from the number of links and from their average.

    Per unit: total, number of rows and mean (unknown values count as 0). Log
    links and log average are regressed on the log total without an intercept;
    the two slopes sum to 1. Returns by, part, estimate, std_error, nobs, r2.
    """
    keys = [*by, *time]
    known = F.coalesce(F.col(value), F.lit(0.0))
    units = flows.groupBy(*keys, unit).agg(F.sum(known).alias("total"), F.count(F.lit(1)).alias("links"), F.avg(known).alias("average"))
    units = units.where(F.col("total") > 0)
    parts = F.array(
        F.struct(F.lit("links").alias("part"), F.ln(F.col("links").cast("double")).alias("ly")),
        F.struct(F.lit("average").alias("part"), F.ln("average").alias("ly")),
    )
    long = units.select(*keys, F.ln("total").alias("lx"), F.inline(parts))
    fit = ols(long, "ly", ["lx"], by=[*keys, "part"], intercept=False, se="hc2")
    return fit.select(*keys, "part", "estimate", "std_error", "nobs", "r2")


def price_quantity_decomposition(prices: DataFrame, by: Sequence[str]) -> DataFrame:
    """Log price and log quantity on log value without an intercept (rows with positive quantity)."""
    rows = prices.where((F.col("quant") > 0) & (F.col("val") > 0))
    parts = F.array(
        F.struct(F.lit("price").alias("part"), F.ln("price").alias("ly")),
        F.struct(F.lit("quantity").alias("part"), F.ln("quant").alias("ly")),
    )
    long = rows.select(*by, F.ln("val").alias("lx"), F.inline(parts))
    fit = ols(long, "ly", ["lx"], by=[*by, "part"], intercept=False, se="hc2")
    return fit.select(*by, "part", "estimate", "std_error", "nobs", "r2")
