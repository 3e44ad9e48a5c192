"""Summary tables and link counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.operators.verbs import order_statistics


def summary_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """variable, n, mean, sd, min, median, max of each listed column over its known values.

    The median is exact (mean of the two middle values for even counts) and
    found without sorting a variable in one task.
    """
    long = df.select(*[F.col(c).cast("double") for c in cols]).unpivot([], list(cols), "variable", "value")
    long = long.where(F.col("value").isNotNull())
    out = order_statistics(
        long,
        ["variable"],
        "value",
        0.5,
        {"lo": F.floor((F.col("n") + 1) / 2), "hi": F.floor(F.col("n") / 2) + 1},
        extra=[
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("sd"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        ],
    )
    return out.select("variable", "n", "mean", "sd", "min", ((F.col("lo") + F.col("hi")) / 2).alias("median"), "max")


def link_counts(flows: DataFrame, unit: str, by: Sequence[str], value: str = "value") -> DataFrame:
    """Active links (known values) per unit and group."""
    return flows.groupBy(unit, *by).agg(F.count(value).alias("num_of_links"))
