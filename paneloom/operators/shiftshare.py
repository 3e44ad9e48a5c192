"""Shift-share exposure to a supply shock and the event-time outcomes that go with it.

Tables are long flows (exporter, importer, year, item, value) of one element,
unless an ``element`` column is named.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions.aggregates import sum0
from paneloom.functions.scalars import ratio
from paneloom.operators.linreg import ols_many
from paneloom.operators.reshape import pivot_measures
from paneloom.operators.verbs import base_period_diff, exclude_unit, first_difference, lookup, share_of_total


def exposure_share(flows: DataFrame, t0: int) -> DataFrame:
    """Share of every destination in the exporter's total of an item at ``t0``."""
    rows = flows.where(F.col("year") == t0).select("exporter", "importer", "item", "value")
    return share_of_total(rows, "value", ["exporter", "item"], "share").drop("value")


def exposure_shift(flows: DataFrame, leader: str, t0: int) -> DataFrame:
    """Change of the leader's flow to every destination, read two years after ``t0``.

    The change is against the destination's previous row.
    """
    rows = flows.where((F.col("exporter") == leader) & (F.col("year") <= t0 + 2)).select("importer", "item", "year", "value")
    moved = first_difference(rows, ["importer", "item"], "year", {"shift": "value"})
    return moved.where(F.col("year") == t0 + 2).select("importer", "item", "shift")


def exposure(flows: DataFrame, leader: str, t0: int) -> DataFrame:
    """exporter, item, exposure: minus the share-weighted sum of the leader's changes.

    Destinations the leader does not serve add nothing.
    """
    pairs = lookup(exposure_share(flows, t0), exposure_shift(flows, leader, t0), ["importer", "item"], ["shift"])
    return pairs.groupBy("exporter", "item").agg((-sum0(F.col("share") * F.col("shift"))).alias("exposure"))


def exposure_wide(flows: DataFrame, units: DataFrame, leader: str, t0: int, items: Mapping[str, str]) -> DataFrame:
    """One exposure column per item for every exporter of ``units``."""
    wide = pivot_measures(exposure(flows.where(F.col("item").isin(list(items))), leader, t0), ["exporter"], "item", "exposure", items)
    return units.select("exporter").join(wide, "exporter", "left")


def exposure_alt(flows: DataFrame, leader: str, t0: int, years: Sequence[int]) -> DataFrame:
    """Exposure of importers: the leader's share in their imports at ``t0`` times the leader's total of later years.

    One column ``exposure_<year>`` per year; importers the leader does not
    serve at ``t0`` get 0. All importers of the flows are kept.
    """
    year, v = F.col("year"), F.col("value")
    mine = (F.col("exporter") == leader) & (year == t0)
    base = flows.groupBy("importer").agg(
        F.sum(F.when(mine, v)).alias("from_leader"),
        sum0(F.when(year == t0, v)).alias("imports"),
    )
    totals = flows.where((F.col("exporter") == leader) & year.isin(list(years))).agg(
        *[sum0(F.when(year == y, v)).alias(f"t{y}") for y in years]
    )
    one = totals.select(F.struct(*totals.columns).alias("s")).scalar()
    out = base.withColumn("__t", one)
    return out.select(
        "importer",
        *[F.coalesce(ratio("from_leader", "imports") * F.col("__t")[f"t{y}"], F.lit(0.0)).alias(f"exposure_{y}") for y in years],
    )


def outcome_base_diff(panel: DataFrame, unit: str, t0: int, names: Sequence[str], name: Column | None = None) -> DataFrame:
    """Change of every outcome since ``t0``, one column per outcome name.

    ``name`` builds the outcome name of a row (item and element joined by default).
    """
    name = F.concat_ws("_", "item", "element") if name is None else name
    rows = panel.select(unit, "year", name.alias("outcome"), "value").where(F.col("outcome").isin(list(names)))
    totals = rows.groupBy(unit, "year", "outcome").agg(sum0("value").alias("total"))
    moved = base_period_diff(totals, [unit, "outcome"], "year", "total", t0, "diff")
    return pivot_measures(moved, [unit, "year"], "outcome", "diff", list(names))


def event_regression(
    panel: DataFrame, outcomes: Sequence[str], exposures: Sequence[str], unit: str, exclude: str, time: str = "year"
) -> DataFrame:
    """Every outcome on all exposures, separately for each year, without the leader; one job in all."""
    return ols_many(exclude_unit(panel, unit, exclude), outcomes, exposures, by=[time])


def first_order_panel(
    flows: DataFrame, panel: DataFrame, leader: str, item: str, year: int, t0: int, measures: Mapping[str, str]
) -> DataFrame:
    """Leader's export change to a destination beside the destination's own changes.

    ``measures`` maps elements of ``panel`` to column names. Destinations the
    leader does not serve, and unknown changes, count as 0. ``share`` is the
    destination's share in the leader's exports at ``t0``.
    """
    mine = flows.where((F.col("exporter") == leader) & (F.col("item") == item)).select("importer", "year", "value")
    shift = first_difference(mine, ["importer"], "year", {"export_diff": "value"}).where(F.col("year") == year)
    share = share_of_total(mine.where(F.col("year") == t0), "value", (), "share").select("importer", "share")
    wide = pivot_measures(panel.where(F.col("item") == item), ["area", "year"], "element", "value", measures)
    diffs = {f"{c}_diff": c for c in measures.values()}
    own = first_difference(wide, ["area"], "year", diffs).where(F.col("year") == year).select("area", *diffs)
    out = lookup(own, shift, {"area": "importer"}, ["export_diff"])
    out = lookup(out, share, {"area": "importer"}, ["share"])
    return out.fillna(0.0, [*diffs, "export_diff", "share"])
