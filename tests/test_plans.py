"""Plans of registered queries: years reach the scan, nothing is paired with everything, unused measures are not summed."""

import os

import pytest

import __spark_entry__ as entry
from paneloom.sources import panels as P

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["agg_having", "top_k_distinct", "pivot_multi_value", "unpivot_prepost", "exposure_share", "exposure_shift", "join_fixed_effects"])
def test_year_limits_reach_the_scan(spark, key):
    scans = [line for line in plan(entry.queries()[key](spark, FOLDER)).splitlines() if "orders.parquet" in line or "lineitem.parquet" in line]
    if key != "join_fixed_effects":  # its cells are staged, so only the scan of income is left
        assert any("LessThan(l_shipdate" in line for line in scans)
    else:
        assert any("LessThan(o_orderdate" in line for line in scans)


@pytest.mark.parametrize("key", ["join_prune_then_join", "filter_not_null", "agg_link_count", "fn_if_else", "fn_try_numeric", "plot_scatter", "ols_by_group"])
def test_areas_are_not_paired(spark, key):
    text = plan(entry.queries()[key](spark, FOLDER))
    assert "NestedLoop" not in text and "Cartesian" not in text and "collect_list" not in text


def test_unwanted_measures_are_not_summed(spark):
    text = plan(P.country_panel(spark, FOLDER, elements=["Production"]))
    assert "l_extendedprice" not in text and "l_quantity" in text


def test_distance_of_unknown_ends_is_null(spark):
    rows = spark.createDataFrame([("NATION_3", "NATION_3"), ("NATION_3", "nowhere"), (None, "NATION_3")], "exporter string, importer string")
    found = {(r["exporter"], r["importer"]): r["distw"] for r in P.with_distance(spark, FOLDER, rows).collect()}
    assert found == {("NATION_3", "NATION_3"): 500.0, ("NATION_3", "nowhere"): None, (None, "NATION_3"): None}
