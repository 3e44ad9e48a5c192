"""Chart-ready tables. Axis limits are applied first: points outside do not enter fits or bins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.functions.distributions import t_quantile
from paneloom.functions.scalars import ratio
from paneloom.operators import localfit
from paneloom.operators.reshape import price_long
from paneloom.operators.verbs import attach

Limits = tuple[float, float] | None


def _limited(df: DataFrame, x: str, xlim: Limits, y: str | None = None, ylim: Limits = None) -> DataFrame:
    out = df.where(F.col(x).isNotNull())
    if xlim:
        out = out.where(F.col(x).between(*xlim))
    if y is not None:
        out = out.where(F.col(y).isNotNull())
        if ylim:
            out = out.where(F.col(y).between(*ylim))
    return out


def series(df: DataFrame, x: str, y: str, colour: str | None = None, facet: str | None = None) -> DataFrame:
    """x, y, colour, facet rows in drawing order."""
    cols = [F.col(c).alias(n) for c, n in ((x, "x"), (y, "y"), (colour, "colour"), (facet, "facet")) if c]
    order = [n for c, n in ((facet, "facet"), (colour, "colour"), (x, "x")) if c]
    return df.select(*cols).orderBy(*order)


def shock_series(
    flows: DataFrame, unit: str, highlight: str, shock: int, value_el: str, quantity_el: str, first_year: int | None = None, last_year: int | None = None
) -> DataFrame:
    """Price, quantity and value series of every unit and item, with the highlighted unit flagged.

    All panels of the chart come from one job.
    """
    if first_year is not None:
        flows = flows.where(F.col("year") >= first_year)
    if last_year is not None:
        flows = flows.where(F.col("year") <= last_year)
    long = price_long(flows, [unit, "year", "item"], value_el, quantity_el)
    return long.withColumns({"highlight": F.col(unit) == highlight, "shock_year": F.lit(shock)})


def scatter(df: DataFrame, x: str, y: str, facet: str | None = None, xlim: Limits = None, ylim: Limits = None) -> DataFrame:
    cols = [F.col(x).alias("x"), F.col(y).alias("y")] + ([F.col(facet).alias("facet")] if facet else [])
    return _limited(df.select(*cols), "x", xlim, "y", ylim)


def histogram(
    df: DataFrame,
    x: str,
    binwidth: float | None = None,
    bins: int = 30,
    facet: Sequence[str] = (),
    xlim: Limits = None,
    free_range: bool = False,
) -> DataFrame:
    """facet, bin, low, high, count of the non-empty bins.

    Bins are closed on the right and half a width off the multiples of the
    width, so ``binwidth=1`` centres them on whole numbers. ``bins`` divides the
    range of all values, or of each facet with ``free_range``.
    """
    rows = _limited(df.select(*facet, F.col(x).cast("double").alias("__v")), "__v", xlim)
    keys = list(facet) if free_range else []
    span = rows.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    if binwidth is not None:
        width = F.lit(float(binwidth))
    else:
        full = (F.col("__hi") - F.col("__lo")) / (bins - 1 if bins > 1 else 1)
        width = F.when(full > 0, full).otherwise(1.0)
    span = span.withColumn("__w", width)
    origin = F.col("__w") / 2 + F.floor((F.col("__lo") - F.col("__w") / 2) / F.col("__w")) * F.col("__w")
    span = span.select(*keys, "__w", origin.alias("__o"))
    placed = attach(rows, span, keys)
    number = F.greatest(F.ceil((F.col("__v") - F.col("__o")) / F.col("__w")) - 1, F.lit(0)).cast("long")
    counts = placed.groupBy(*facet, "__w", "__o", number.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    low = F.col("__o") + F.col("bin") * F.col("__w")
    return counts.select(*facet, "bin", low.alias("low"), (low + F.col("__w")).alias("high"), "count")


def _grid(span: DataFrame, facet: Sequence[str], n: int) -> DataFrame:
    """n evenly spaced points per facet between __lo and __hi."""
    step = (F.col("__hi") - F.col("__lo")) / (n - 1)
    return span.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("x", F.col("__lo") + F.col("point") * step)


def smooth_lm(
    df: DataFrame, x: str, y: str, facet: Sequence[str] = (), n: int = 80, xlim: Limits = None, ylim: Limits = None, conf_level: float = 0.95
) -> DataFrame:
    """Fitted line with confidence band at n points per facet: facet, point, x, y, se, low, high."""
    rows = _limited(df.select(*facet, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")), "__x", xlim, "__y", ylim)
    c = F.count(F.lit(1))
    m = rows.groupBy(*facet).agg(
        c.alias("__n"),
        F.avg("__x").alias("__mx"),
        F.avg("__y").alias("__my"),
        (F.var_pop("__x") * c).alias("__sxx"),
        (F.covar_pop("__x", "__y") * c).alias("__sxy"),
        (F.var_pop("__y") * c).alias("__syy"),
        F.min("__x").alias("__lo"),
        F.max("__x").alias("__hi"),
    )
    m = m.withColumn("__b", ratio("__sxy", "__sxx"))
    m = m.withColumn("__s2", ratio(F.greatest(F.col("__syy") - F.col("__b") * F.col("__sxy"), F.lit(0.0)), F.col("__n") - 2))
    m = _grid(m, facet, n)
    off = F.col("x") - F.col("__mx")
    se = F.sqrt(F.col("__s2") * (1 / F.col("__n") + ratio(off * off, "__sxx")))
    out = m.select(*facet, "point", "x", (F.col("__my") + F.col("__b") * off).alias("y"), se.alias("se"), (F.col("__n") - 2).cast("double").alias("__df"))
    schema = T.StructType(out.schema.fields[:-1]).add("low", "double").add("high", "double")

    def band(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                half = t_quantile(conf_level, pdf.pop("__df").to_numpy()) * pdf["se"]
                yield pdf.assign(low=pdf["y"] - half, high=pdf["y"] + half)

    return out.mapInPandas(band, schema)


def smooth_loess(
    df: DataFrame,
    x: str,
    y: str,
    span: float = 0.75,
    n: int = 80,
    facet: Sequence[str] = (),
    xlim: Limits = None,
    ylim: Limits = None,
    band: bool = False,
    cell: float = 0.2,
    conf_level: float = 0.95,
) -> DataFrame:
    """Local quadratic fit with tricube weights at n points per facet: facet, point, x, y, and with ``band`` se, low, high.

    Rows with the same x are summed first (distances repeat in every year and
    item). The bandwidth of a point is the exact distance to its nearest
    ``span`` share of the rows; where no row lies strictly inside (many rows at
    one x), it is the next larger distance. Every facet gets all n points; y is
    NULL where all rows are at one distance.

    The band takes the smoother's operator as blended between the vertices of
    a partition in cells of at most ``span * cell`` of the rows. Its residual
    variance is the residual sum of squares over N - 2 tr(L) + tr(L L'), which
    also is the number of degrees of freedom of the t quantile.
    """
    rows = _limited(df.select(*facet, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")), "__x", xlim, "__y", ylim)
    return localfit.smooth_loess(rows, facet, span, n, band, cell, conf_level)


def coef_series(coefs: DataFrame, term: str, time: str, keys: Sequence[str] = ()) -> DataFrame:
    """Estimate and interval of one term over time."""
    return coefs.where(F.col("term") == term).select(*keys, time, "estimate", "conf_low", "conf_high")
