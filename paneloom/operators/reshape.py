"""Long to wide and back, and the price table built from both."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions.aggregates import sum0
from paneloom.functions.scalars import ratio


def pivot_measures(
    df: DataFrame, keys: Sequence[str], names_from: str, values_from: str, values: Sequence[str] | Mapping[str, str], agg: str = "first"
) -> DataFrame:
    """One column per listed name. ``values`` may map source names to column names.

    The explicit list saves the extra job that finds the names. ``agg`` is
    ``first`` (keys must be unique, see ``verbs.require_unique``), ``sum``,
    ``max`` or ``count``; combinations without rows stay NULL.
    """
    names = dict(values) if isinstance(values, Mapping) else {v: v for v in values}
    how = {"first": F.first, "sum": F.sum, "max": F.max, "count": F.count}[agg]
    wide = df.groupBy(*keys).pivot(names_from, list(names)).agg(how(values_from))
    return wide.withColumnsRenamed({k: v for k, v in names.items() if k != v})


def pivot_rules(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column], value: Column) -> DataFrame:
    """One column per rule holding the value of the row that satisfies it.

    Rows that satisfy no rule are dropped before the shuffle. Combinations
    without rows stay NULL.
    """
    any_rule = None
    for test in rules.values():
        any_rule = test if any_rule is None else (any_rule | test)
    return df.where(any_rule).groupBy(*keys).agg(*[F.max(F.when(test, value)).alias(name) for name, test in rules.items()])


def pivot_multi(df: DataFrame, keys: Sequence[str], names_from: str, values_from: Sequence[str], values: Sequence) -> DataFrame:
    """Several value columns at once: ``value_2007``, ``gdp_2007``, ..."""
    aggs = [
        F.max(F.when(F.col(names_from) == F.lit(v), F.col(c))).alias(f"{c}_{v}") for c in values_from for v in values
    ]
    return df.where(F.col(names_from).isin(list(values))).groupBy(*keys).agg(*aggs)


def unpivot_measures(df: DataFrame, keys: Sequence[str], name: str = "element", value: str = "value") -> DataFrame:
    """All columns but the keys to (name, value) rows."""
    return df.unpivot(list(keys), [c for c in df.columns if c not in keys], name, value)


def unpivot_prepost(df: DataFrame, keys: Sequence[str], before: str, after: str, value: str = "value") -> DataFrame:
    """Two period columns to long rows with a 0/1 ``post`` column."""
    return df.unpivot(list(keys), [before, after], "name", value).withColumn("post", F.when(F.col("name") == after, 1).otherwise(0))


def price_wide(df: DataFrame, keys: Sequence[str], value_el: str, quantity_el: str) -> DataFrame:
    """keys, val, quant, price from element rows, summed per key in one shuffle."""
    el, v = F.col("element"), F.col("value")
    return (
        df.where(el.isin(value_el, quantity_el))
        .groupBy(*keys)
        .agg(
            sum0(F.when(el == value_el, v)).alias("val"),
            sum0(F.when(el == quantity_el, v)).alias("quant"),
        )
        .withColumn("price", ratio("val", "quant"))
    )


def price_long(df: DataFrame, keys: Sequence[str], value_el: str, quantity_el: str, labels: Sequence[str] = ("Price", "Quantity", "Value")) -> DataFrame:
    """Price, quantity and value series of every key as (element, value) rows."""
    wide = price_wide(df, keys, value_el, quantity_el)
    rows = F.array(
        *[F.struct(F.lit(text).alias("element"), F.col(c).alias("value")) for text, c in zip(labels, ("price", "quant", "val"))]
    )
    return wide.select(*keys, F.inline(rows))


def price_summary_panel(df: DataFrame, unit: str, item: str, items: Mapping[str, str]) -> DataFrame:
    """Import and export price per unit, one column per item, from positive quantities only."""
    el, v = F.col("element"), F.col("value")
    totals = df.where(F.col(item).isin(list(items))).groupBy(unit, item).agg(
        *[
            sum0(F.when(el == f"{way} {kind}", v)).alias(f"{way[:3].lower()}_{kind.lower()}")
            for way in ("Import", "Export")
            for kind in ("Value", "Quantity")
        ]
    )
    prices = totals.where((F.col("imp_quantity") > 0) & (F.col("exp_quantity") > 0)).select(
        unit,
        item,
        ratio("imp_value", "imp_quantity").alias("imp_price"),
        ratio("exp_value", "exp_quantity").alias("exp_price"),
    )
    return prices.groupBy(unit).agg(
        *[
            F.max(F.when(F.col(item) == source, F.col(p))).alias(f"{p}_{short}")
            for p in ("imp_price", "exp_price")
            for source, short in items.items()
        ]
    )
