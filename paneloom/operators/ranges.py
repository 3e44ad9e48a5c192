"""Ranks and prefix sums over groups of any size, by range partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneloom.operators.verbs import attach
from paneloom.session import cut_lineage


def prefix_sums(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], before: dict[str, str | Column]) -> DataFrame:
    """Adds, per name of ``before``, the sum of its value over the earlier rows of the group.

    Rows are dealt to ranges of (``by``, ``order``), so a group with a third of
    all rows spans many tasks. Each range sums its own rows in order; one row
    per group and range says what lies in the ranges before. The dealt rows are
    written, so a lost executor can't deal them anew. NULL keys are a group of
    their own and NULL order values come first; the caller's order should be
    total, or rows that tie must be interchangeable.
    """
    keys = [*by, "__range"]
    ranked = [f"__order{i}" for i in range(len(order))]
    valued = {f"__value{i}": value for i, value in enumerate(before.values())}
    cols = [(F.col(o) if isinstance(o, str) else o).alias(n) for n, o in zip(ranked, order)]
    cols += [(F.col(v) if isinstance(v, str) else v).alias(n) for n, v in valued.items()]
    dealt = df.select("*", *cols).repartitionByRange(*by, *ranked)
    dealt = cut_lineage(dealt.withColumn("__range", F.spark_partition_id()))
    within = Window.partitionBy(*keys).orderBy(*ranked).rowsBetween(Window.unboundedPreceding, -1)
    own = {name: F.sum(value).over(within) for name, value in zip(before, valued)}
    totals = dealt.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in valued])
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # Without groups there is one row per range: a bounded table in one task.
    starts = totals.select(*keys, *[F.sum(v).over(earlier).alias(f"__start{v}") for v in valued])
    summed = attach(dealt.withColumns(own), starts, keys)
    zero = {name: F.coalesce(name, F.lit(0)) + F.coalesce(f"__start{v}", F.lit(0)) for name, v in zip(before, valued)}
    return summed.withColumns(zero).select(*df.columns, *before)


def ranks(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """Adds the 0-based position of each row in its group."""
    return prefix_sums(df, by, order, {name: F.lit(1).cast("long")})
