"""Quantity competition before and after one supplier leaves a market."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.functions.scalars import label_rules
from paneloom.operators.verbs import lookup


def supplier_exit(suppliers: DataFrame, market: str, supplier: str, cost: str, a: str, leaver: str, tol: float = 0.0) -> DataFrame:
    """market, supplier, q_before, q_after, diff, relation.

    The first-order conditions 2(c_i + 1) q_i + sum of the rivals' q = a give
    q_i = a / ((1 + S)(2 c_i + 1)) with S = sum of 1/(2 c_i + 1) over the market.
    S is an aggregate per market, joined back, so a market of any size is summed
    map-side. ``leaver`` is the flag column of the supplier that exits; it has
    no quantity after. ``relation`` compares the gain of the market's first
    remaining supplier (Diff1) with the gain of the row's supplier (Diff2).
    """
    weight = 1 / (2 * F.col(cost) + 1)
    gone = F.col(leaver)
    sums = suppliers.groupBy(market).agg(
        F.sum(weight).alias("__s"),
        F.sum(F.when(~gone, weight)).alias("__s_after"),
        F.min_by(F.when(~gone, weight), F.when(~gone, F.col(supplier))).alias("__w1")
    )
    rows = lookup(suppliers, sums, [market], ["__s", "__s_after", "__w1"])
    before = F.col(a) * weight / (1 + F.col("__s"))
    after = F.when(~gone, F.col(a) * weight / (1 + F.col("__s_after")))
    rows = rows.withColumns({"q_before": before, "q_after": after}).withColumn("diff", F.col("q_after") - F.col("q_before"))
    first = F.col(a) * F.col("__w1") / (1 + F.col("__s_after")) - F.col(a) * F.col("__w1") / (1 + F.col("__s"))
    gap = F.col("diff") - first
    # The three outcome labels.
    relation = label_rules([(gap > tol, "Diff1 < Diff2"), (gap < -tol, "Diff1 > Diff2"), (gap.isNotNull(), "Diff1 = Diff2")])
    return rows.select(market, supplier, "q_before", "q_after", "diff", relation.alias("relation"))
