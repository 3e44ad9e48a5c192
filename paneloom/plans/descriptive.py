"""Aggregates, windows, ordering, reshaping, networks and chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.functions import aggregates as A
from paneloom.functions import scalars as S
from paneloom.operators import describe as D
from paneloom.operators import equilibrium as E
from paneloom.operators import network as N
from paneloom.operators import plotdata as PD
from paneloom.operators import reshape as R
from paneloom.operators import verbs as V
from paneloom.plans.common import ELEMENTS, ITEMS, LEADER, SHOCK_ITEM
from paneloom.plans.registry import query, rounded, t_quantile_ctes, t_real_quantile_ctes
from paneloom.plans.tables import GRID_CTES, _link_grid
from paneloom.session import cut_lineage
from paneloom.sources import panels as P


def _element(spark, d, element, **limits):
    return P.flows(spark, d, elements=[element], **limits)


# --- aggregates ---------------------------------------------------------------


@query(
    "agg_group_sum",
    "SELECT item, CAST(year AS BIGINT) AS year, round(coalesce(sum(value), 0), 4) AS total FROM flows WHERE element = 'Export Value' GROUP BY 1, 2",
)
def agg_group_sum(spark, d):
    return rounded(_element(spark, d, "Export Value").groupBy("item", "year").agg(A.sum0("value").alias("total")), year=-1, total=4)


@query("agg_dynamic_keys", "SELECT CAST(year AS BIGINT) AS year, element, round(sum(value), 4) AS value FROM panel WHERE area = 'NATION_3' GROUP BY 1, 2")
def agg_dynamic_keys(spark, d):
    keys = ["year", "element"]
    rows = P.country_panel(spark, d).where(F.col("area") == LEADER)
    return rounded(V.total_by(rows, "value", keys, "value"), year=-1, value=4)


@query("agg_group_mean", "SELECT item, CAST(year AS BIGINT) AS year, round(avg(exp_val / nullif(exp_quant, 0)), 6) AS mean_price FROM flows_wide GROUP BY 1, 2")
def agg_group_mean(spark, d):
    rows = P.flow_cells(spark, d).withColumn("price", S.ratio("exp_val", "exp_quant"))
    return rounded(rows.groupBy("item", "year").agg(F.avg("price").alias("mean_price")), year=-1, mean_price=6)


@query("agg_row_count", "SELECT element, item, CAST(count(*) AS BIGINT) AS n FROM flows GROUP BY 1, 2")
def agg_row_count(spark, d):
    return P.flows(spark, d).groupBy("element", "item").agg(A.count_rows().alias("n"))


@query("agg_link_count", "SELECT exporter, CAST(count(value) AS BIGINT) AS num_of_links FROM links GROUP BY 1", GRID_CTES)
def agg_link_count(spark, d):
    return D.link_counts(_link_grid(spark, d), "exporter", [])


@query("agg_positive_count", "SELECT exporter, CAST(count(CASE WHEN value > 100000 THEN 1 END) AS BIGINT) AS n FROM links GROUP BY 1", GRID_CTES)
def agg_positive_count(spark, d):
    return _link_grid(spark, d).groupBy("exporter").agg(A.count_positive(F.col("value") - 100000).alias("n"))


@query(
    "agg_multi",
    """SELECT exporter, item, round(sum(value), 4) AS x_it, CAST(count(*) AS BIGINT) AS n_it, round(avg(value), 6) AS xbar_it
       FROM flows WHERE year = 1998 AND element = 'Export Quantity' GROUP BY 1, 2""",
)
def agg_multi(spark, d):
    rows = _element(spark, d, "Export Quantity", first_year=1998, last_year=1998)
    out = rows.groupBy("exporter", "item").agg(A.sum0("value").alias("x_it"), A.count_rows().alias("n_it"), F.avg("value").alias("xbar_it"))
    return rounded(out, x_it=4, xbar_it=6)


@query(
    "agg_having",
    """SELECT exporter, item, CAST(count(value) AS BIGINT) AS nonna FROM flows WHERE year < 1998 AND element = 'Export Value' AND item = 'PROMO'
       GROUP BY 1, 2 HAVING count(value) >= 60""",
)
def agg_having(spark, d):
    rows = _element(spark, d, "Export Value", last_year=1997, items=[SHOCK_ITEM])
    return rows.groupBy("exporter", "item").agg(A.count_known("value").alias("nonna")).where(F.col("nonna") >= 60)


@query(
    "agg_of_agg",
    """SELECT item, CAST(count(*) AS BIGINT) AS countries, round(avg(n), 6) AS mean_links FROM
       (SELECT exporter, item, count(value) AS n FROM flows WHERE year = 1998 AND element = 'Export Quantity' GROUP BY 1, 2) GROUP BY 1""",
)
def agg_of_agg(spark, d):
    rows = _element(spark, d, "Export Quantity", first_year=1998, last_year=1998)
    links = D.link_counts(rows, "exporter", ["item"])
    return rounded(links.groupBy("item").agg(A.count_rows().alias("countries"), F.avg("num_of_links").alias("mean_links")), mean_links=6)


@query("agg_global", "SELECT CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM panel WHERE element = 'Production'")
def agg_global(spark, d):
    rows = P.country_panel(spark, d, elements=["Production"])
    return rounded(rows.agg(A.count_rows().alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean")), total=4, mean=6)


@query(
    "agg_min_max",
    """SELECT CAST(min(7 * n_nationkey - 84) AS DOUBLE) AS "left", CAST(min(3 * n_nationkey - 36) AS DOUBLE) AS bottom,
              CAST(max(7 * n_nationkey - 84) AS DOUBLE) AS "right", CAST(max(3 * n_nationkey - 36) AS DOUBLE) AS top
       FROM nation WHERE n_name IN (SELECT importer FROM flows WHERE exporter = 'NATION_3')""",
)
def agg_min_max(spark, d):
    served = P.flows(spark, d).where(F.col("exporter") == LEADER).select(F.col("importer").alias("area")).distinct()
    return N.bounding_box(P.coordinates(spark, d).join(served, "area", "left_semi"))


@query("agg_distinct", "SELECT DISTINCT exporter, item FROM flows WHERE year = 1998")
def agg_distinct(spark, d):
    return P.flows(spark, d, first_year=1998, last_year=1998).select("exporter", "item").distinct()


@query(
    "agg_distinct_keep_all",
    """SELECT exporter, importer, item, CAST(year AS BIGINT) AS year, round(value, 4) AS value FROM
       (SELECT *, row_number() OVER (PARTITION BY exporter, item ORDER BY year, importer) AS rn FROM flows WHERE element = 'Export Value') WHERE rn = 1""",
)
def agg_distinct_keep_all(spark, d):
    rows = _element(spark, d, "Export Value").select("exporter", "importer", "item", "year", "value")
    return rounded(V.first_per_key(rows, ["exporter", "item"], ["year", "importer"]), year=-1, value=4)


PIVOT_ITEM_ELEMENT = ", ".join(
    f"sum(CASE WHEN element = '{el}' AND item = '{it}' THEN value END) AS {short}_{name}"
    for el, short in ELEMENTS.items()
    for it, name in ITEMS.items()
)
TWELVE = [f"{short}_{name}" for short in ELEMENTS.values() for name in ITEMS.values()]
TWELVE_CTE = f"twelve AS (SELECT reporter, {PIVOT_ITEM_ELEMENT} FROM mirror WHERE year = 1998 GROUP BY 1)"


def _twelve(spark, d):
    rows = P.mirrored_flows(spark, d, first_year=1998, last_year=1998).where(F.col("item").isin(list(ITEMS)))
    name = F.concat_ws("_", S.label("element", ELEMENTS), S.label("item", ITEMS))
    totals = rows.groupBy("reporter", name.alias("element_item")).agg(A.sum0("value").alias("total"))
    return R.pivot_measures(totals, ["reporter"], "element_item", "total", TWELVE)


@query(
    "summary_stats",
    """SELECT variable, CAST(count(value) AS BIGINT) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, round(min(value), 4) AS min,
              round(median(value), 4) AS median, round(max(value), 4) AS max
       FROM (UNPIVOT twelve ON COLUMNS(* EXCLUDE reporter) INTO NAME variable VALUE value) GROUP BY 1""",
    TWELVE_CTE,
)
def summary_stats(spark, d):
    return rounded(D.summary_stats(_twelve(spark, d), TWELVE), n=-1, mean=4, sd=4, min=4, median=4, max=4)


# --- windows and shares ---------------------------------------------------------


PRODUCTION = "(SELECT area, CAST(year AS BIGINT) AS year, item, value FROM panel WHERE element = 'Production')"


def _production(spark, d, cells=None):
    return P.country_panel(spark, d, cells, elements=["Production"]).select("area", "year", "item", "value")


@query("win_lag", f"SELECT area, year, item, round(value, 4) AS value, round(lag(value) OVER (PARTITION BY area, item ORDER BY year), 4) AS lag1 FROM {PRODUCTION}")
def win_lag(spark, d):
    return rounded(V.lagged(_production(spark, d), ["area", "item"], "year", {"lag1": ("value", 1)}), year=-1, value=4, lag1=4)


@query(
    "win_lag_n",
    f"""SELECT area, year, item, round(lag(value) OVER (PARTITION BY area, item ORDER BY year), 4) AS lag1,
              round(lag(value, 5) OVER (PARTITION BY area, item ORDER BY year), 4) AS lag5 FROM {PRODUCTION}""",
)
def win_lag_n(spark, d):
    out = V.lagged(_production(spark, d), ["area", "item"], "year", {"lag1": ("value", 1), "lag5": ("value", 5)})
    return rounded(out.drop("value"), year=-1, lag1=4, lag5=4)


@query(
    "win_first_difference",
    f"SELECT area, year, item, round(value - lag(value) OVER (PARTITION BY area, item ORDER BY year), 4) AS diff FROM {PRODUCTION}",
)
def win_first_difference(spark, d):
    out = V.first_difference(_production(spark, d), ["area", "item"], "year", {"diff": "value"})
    return rounded(out.drop("value"), year=-1, diff=4)


@query(
    "win_base_period_diff",
    f"""SELECT area, year, item, round(value - max(CASE WHEN year = 1997 THEN value END) OVER (PARTITION BY area, item), 4) AS diff FROM {PRODUCTION}""",
)
def win_base_period_diff(spark, d):
    out = V.base_period_diff(_production(spark, d, P.staged_cells(spark, d)), ["area", "item"], "year", "value", 1997, "diff")
    return rounded(out.drop("value"), year=-1, diff=4)


@query(
    "win_share_of_total",
    """SELECT importer, round(value / nullif(sum(value) OVER (), 0), 8) AS share FROM flows
       WHERE exporter = 'NATION_3' AND year = 1997 AND item = 'PROMO' AND element = 'Export Quantity'""",
)
def win_share_of_total(spark, d):
    rows = _element(spark, d, "Export Quantity", first_year=1997, last_year=1997).where((F.col("exporter") == LEADER) & (F.col("item") == SHOCK_ITEM))
    return rounded(V.share_of_total(rows, "value").select("importer", "share"), share=8)


@query(
    "win_group_share",
    """SELECT exporter, importer, item, CAST(year AS BIGINT) AS year, round(value / nullif(sum(value) OVER (PARTITION BY exporter, item, year), 0), 8) AS share
       FROM flows WHERE element = 'Export Value'""",
)
def win_group_share(spark, d):
    out = V.share_of_total(_element(spark, d, "Export Value"), "value", ["exporter", "item", "year"])
    return rounded(out.select("exporter", "importer", "item", "year", "share"), year=-1, share=8)


@query(
    "win_share_of_reference_row",
    """SELECT p.area, CAST(p.year AS BIGINT) AS year, p.item, round(100 * p.value / nullif(r.value, 0), 6) AS pct
       FROM panel p LEFT JOIN (SELECT year, item, value FROM panel WHERE area = 'NATION_0' AND element = 'Export Value') r ON p.year = r.year AND p.item = r.item
       WHERE element = 'Export Value'""",
)
def win_share_of_reference_row(spark, d):
    rows = P.country_panel(spark, d, elements=["Export Value"])
    out = V.share_of_reference_row(rows, "value", "area", "NATION_0", ["year", "item"])
    return rounded(out.select("area", "year", "item", "pct"), year=-1, pct=6)


# --- ordering --------------------------------------------------------------------


@query("sort_desc", "SELECT area, round(value, 4) AS value FROM panel WHERE item = 'PROMO' AND element = 'Export Value' AND year = 1998 ORDER BY value DESC")
def sort_desc(spark, d):
    rows = P.country_panel(spark, d, elements=["Export Value"], items=[SHOCK_ITEM], first_year=1998, last_year=1998)
    return rounded(rows.select("area", "value").orderBy(F.col("value").desc_nulls_last(), "area"), value=4)


@query("sort_multi", "SELECT importer, CAST(year AS BIGINT) AS year, item, round(value, 4) AS value FROM flows WHERE exporter = 'NATION_3' AND element = 'Export Value' ORDER BY 1, 2, 3")
def sort_multi(spark, d):
    rows = _element(spark, d, "Export Value").where(F.col("exporter") == LEADER).select("importer", "year", "item", "value")
    return rounded(rows.orderBy("importer", "year", "item"), year=-1, value=4)


@query(
    "top_k",
    """SELECT area, round(value, 4) AS value FROM panel WHERE item = 'PROMO' AND element = 'Export Value' AND year = 1998 ORDER BY value DESC, area LIMIT 10""",
)
def top_k(spark, d):
    rows = P.country_panel(spark, d, elements=["Export Value"], items=[SHOCK_ITEM], first_year=1998, last_year=1998)
    return rounded(V.top_k(rows.select("area", "value"), "value", 10, ["area"]), value=4)


@query(
    "top_k_distinct",
    """SELECT item, round(max(value), 4) AS value FROM panel WHERE area = 'NATION_3' AND year IN (1996, 1998) AND element = 'Export Value'
       GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4""",
)
def top_k_distinct(spark, d):
    rows = P.country_panel(spark, d, elements=["Export Value"], first_year=1996, last_year=1998)
    rows = rows.where((F.col("area") == LEADER) & F.col("year").isin(1996, 1998))
    return rounded(V.top_k_keys(rows, "item", "value", 4), value=4)


@query(
    "top_k_aggregate",
    "SELECT exporter, round(sum(value), 4) AS total FROM flows WHERE element = 'Export Value' AND year = 1998 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8",
)
def top_k_aggregate(spark, d):
    rows = _element(spark, d, "Export Value", first_year=1998, last_year=1998)
    return rounded(V.top_k(V.total_by(rows, "value", ["exporter"], "total"), "total", 8, ["exporter"]), total=4)


@query(
    "top_k_then_series",
    """SELECT area, CAST(year AS BIGINT) AS year, round(value, 4) AS value FROM panel WHERE item = 'PROMO' AND element = 'Export Quantity' AND area IN
       (SELECT area FROM panel WHERE item = 'PROMO' AND element = 'Export Value' AND year = 1996 ORDER BY value DESC, area LIMIT 4)""",
)
def top_k_then_series(spark, d):
    panel = P.country_panel(spark, d, P.staged_cells(spark, d, items=[SHOCK_ITEM])).where(F.col("item") == SHOCK_ITEM)
    best = V.top_k(panel.where("element = 'Export Value' AND year = 1996").select("area", "value"), "value", 4, ["area"])
    rows = panel.where(F.col("element") == "Export Quantity").join(best.select("area"), "area", "left_semi")
    return rounded(rows.select("area", "year", "value"), year=-1, value=4)


@query(
    "union_results",
    """SELECT 'export' AS model, item, round(sum(value), 4) AS total FROM panel WHERE element = 'Export Value' GROUP BY 2
       UNION ALL SELECT 'import', item, round(sum(value), 4) FROM panel WHERE element = 'Import Value' GROUP BY 2""",
)
def union_results(spark, d):
    panel = P.country_panel(spark, d)

    def part(model, element):
        rows = V.total_by(panel.where(F.col("element") == element), "value", ["item"], "total")
        return rows.select(F.lit(model).alias("model"), "item", "total")

    return rounded(part("export", "Export Value").unionByName(part("import", "Import Value")), total=4)


# --- reshape -----------------------------------------------------------------------


@query("unpivot_years", "SELECT area, item, element, CAST(year AS BIGINT) AS year, round(value, 4) AS value FROM panel")
def unpivot_years(spark, d):
    from paneloom.plans.tables import _wide_panel
    from paneloom.sources import files

    wide = files.normalise_columns(_wide_panel(spark, d), files.COUNTRY_FILE_NAMES).drop("area_code")
    long = files.unpivot_years(wide, ["area", "item", "element"]).where(F.col("value").isNotNull())
    return rounded(long, year=-1, value=4)


WIDE_MEASURES = ", ".join(f"round(max(CASE WHEN element = '{el}' THEN value END), 4) AS {s}" for el, s in ELEMENTS.items())


@query("pivot_measures", f"SELECT area, CAST(year AS BIGINT) AS year, item, {WIDE_MEASURES} FROM panel WHERE element <> 'Production' GROUP BY 1, 2, 3")
def pivot_measures(spark, d):
    rows = P.country_panel(spark, d).where(F.col("element").isin(list(ELEMENTS)))
    return rounded(R.pivot_measures(rows, ["area", "year", "item"], "element", "value", ELEMENTS), year=-1, **{c: 4 for c in ELEMENTS.values()})


@query("pivot_item_element", "SELECT reporter, " + ", ".join(f"round({c}, 4) AS {c}" for c in TWELVE) + " FROM twelve", TWELVE_CTE)
def pivot_item_element(spark, d):
    return rounded(_twelve(spark, d), **{c: 4 for c in TWELVE})


CATEGORY_RULES = {
    "promo_prod": ("PROMO", "Production"),
    "economy_prod": ("ECONOMY", "Production"),
    "promo_exp": ("PROMO", "Export Quantity"),
    "economy_exp": ("ECONOMY", "Export Quantity"),
    "standard_exp": ("STANDARD", "Export Quantity"),
    "promo_imp": ("PROMO", "Import Quantity"),
    "economy_imp": ("ECONOMY", "Import Quantity"),
    "standard_imp": ("STANDARD", "Import Quantity"),
}


def category_rules():
    return {name: (F.col("item") == it) & (F.col("element") == el) for name, (it, el) in CATEGORY_RULES.items()}


@query(
    "pivot_category",
    "SELECT area, CAST(year AS BIGINT) AS year, "
    + ", ".join(f"round(max(CASE WHEN item = '{it}' AND element = '{el}' THEN value END), 4) AS {n}" for n, (it, el) in CATEGORY_RULES.items())
    + " FROM panel WHERE "
    + " OR ".join(f"(item = '{it}' AND element = '{el}')" for it, el in CATEGORY_RULES.values())
    + " GROUP BY 1, 2",
)
def pivot_category(spark, d):
    out = R.pivot_rules(P.country_panel(spark, d), ["area", "year"], category_rules(), F.coalesce("value", F.lit(0.0)))
    return rounded(out, year=-1, **{c: 4 for c in CATEGORY_RULES})


@query(
    "pivot_multi_value",
    """SELECT p.area, round(max(CASE WHEN p.year = 1997 THEN value END), 4) AS value_1997, round(max(CASE WHEN p.year = 1998 THEN value END), 4) AS value_1998,
              round(max(CASE WHEN p.year = 1997 THEN gdp END), 5) AS gdp_1997, round(max(CASE WHEN p.year = 1998 THEN gdp END), 5) AS gdp_1998
       FROM panel p LEFT JOIN gdp g ON p.area = g.area AND p.year = g.year WHERE item = 'PROMO' AND element = 'Import Value' AND p.year IN (1997, 1998) GROUP BY 1""",
)
def pivot_multi_value(spark, d):
    years = {"first_year": 1997, "last_year": 1998}
    rows = P.country_panel(spark, d, elements=["Import Value"], items=[SHOCK_ITEM], **years)
    rows = V.lookup(rows, P.income(spark, d, **years), ["area", "year"], ["gdp"])
    out = R.pivot_multi(rows, ["area"], "year", ["value", "gdp"], [1997, 1998])
    return rounded(out, value_1997=4, value_1998=4, gdp_1997=5, gdp_1998=5)


@query(
    "unpivot_measures",
    """SELECT exporter, importer, CAST(year AS BIGINT) AS year, item, 'exp_val' AS element, round(exp_val, 4) AS value FROM flows_wide
       UNION ALL SELECT exporter, importer, CAST(year AS BIGINT), item, 'exp_quant', round(exp_quant, 4) FROM flows_wide""",
)
def unpivot_measures(spark, d):
    cells = P.flow_cells(spark, d).drop("exporter_code", "importer_code")
    return rounded(R.unpivot_measures(cells, ["exporter", "importer", "year", "item"]), year=-1, value=4)


PREPOST_CTE = """prepost AS (SELECT area, coalesce(max(CASE WHEN year = 1997 THEN value END), 0) AS value_1997, coalesce(max(CASE WHEN year = 1998 THEN value END), 0) AS value_1998
  FROM panel WHERE item = 'PROMO' AND element = 'Import Value' AND year IN (1997, 1998) GROUP BY 1)"""


def prepost(spark, d, cells=None):
    rows = P.country_panel(spark, d, cells, elements=["Import Value"], items=[SHOCK_ITEM], first_year=1997, last_year=1998)
    rows = rows.where(F.col("item") == SHOCK_ITEM)
    return R.pivot_multi(rows, ["area"], "year", ["value"], [1997, 1998]).fillna(0.0)


@query(
    "unpivot_prepost",
    """SELECT area, 'value_1997' AS name, round(value_1997, 4) AS value, CAST(0 AS BIGINT) AS post FROM prepost
       UNION ALL SELECT area, 'value_1998', round(value_1998, 4), 1 FROM prepost""",
    PREPOST_CTE,
)
def unpivot_prepost(spark, d):
    return rounded(R.unpivot_prepost(prepost(spark, d), ["area"], "value_1997", "value_1998"), value=4, post=-1)


PRICE_CTE = """imports AS (SELECT partner AS area, year, item, coalesce(sum(CASE WHEN element = 'Import Value' THEN value END), 0) AS v,
   coalesce(sum(CASE WHEN element = 'Import Quantity' THEN value END), 0) AS q FROM mirror WHERE element LIKE 'Import%' GROUP BY 1, 2, 3)"""
PRICE_LONG = """SELECT area, CAST(year AS BIGINT) AS year, item, 'Price' AS element, round(v / nullif(q, 0), 3) AS value FROM imports
   UNION ALL SELECT area, CAST(year AS BIGINT), item, 'Quantity', round(q, 4) FROM imports
   UNION ALL SELECT area, CAST(year AS BIGINT), item, 'Value', round(v, 4) FROM imports"""


def _round_series(df):
    digits = F.when(F.col("element") == "Price", F.round("value", 3)).otherwise(F.round("value", 4))
    return df.withColumn("value", digits)


@query("price_long", PRICE_LONG, PRICE_CTE)
def price_long(spark, d):
    m = P.mirrored_flows(spark, d).withColumnRenamed("partner", "area")
    return rounded(_round_series(R.price_long(m, ["area", "year", "item"], "Import Value", "Import Quantity")), year=-1)


PRICE_PANEL_SQL = ", ".join(
    f"round(max(CASE WHEN item = '{it}' THEN {p} END), 3) AS {p}_{s}" for p in ("imp_price", "exp_price") for it, s in ITEMS.items()
)


@query(
    "price_summary_panel",
    f"""SELECT reporter, {PRICE_PANEL_SQL} FROM (
          SELECT reporter, item, iv / iq AS imp_price, ev / eq AS exp_price FROM (
            SELECT reporter, item, sum(CASE WHEN element = 'Import Value' THEN value END) AS iv, sum(CASE WHEN element = 'Import Quantity' THEN value END) AS iq,
                   sum(CASE WHEN element = 'Export Value' THEN value END) AS ev, sum(CASE WHEN element = 'Export Quantity' THEN value END) AS eq
            FROM mirror WHERE year = 1998 AND item IN ('PROMO', 'ECONOMY', 'STANDARD') GROUP BY 1, 2) WHERE iq > 0 AND eq > 0) GROUP BY 1""",
)
def price_summary_panel(spark, d):
    rows = P.mirrored_flows(spark, d, first_year=1998, last_year=1998)
    out = R.price_summary_panel(rows, "reporter", "item", ITEMS)
    return rounded(out, **{c: 3 for c in out.columns if c != "reporter"})


# --- networks ------------------------------------------------------------------------

EDGE_CTE = "edges AS (SELECT exporter AS src, importer AS dst, value AS weight FROM flows WHERE year = 1998 AND item = 'PROMO' AND element = 'Export Value' AND value > 100000)"


def _network(spark, d):
    return P.flows(spark, d, first_year=1998, last_year=1998).where("item = 'PROMO' AND element = 'Export Value'")


@query("net_edges", "SELECT src, dst, round(weight, 4) AS weight FROM edges", EDGE_CTE)
def net_edges(spark, d):
    return rounded(N.edges(_network(spark, d), 100000), weight=4)


@query("net_ego", "SELECT src, dst, round(weight, 4) AS weight FROM edges WHERE dst = 'NATION_3'", EDGE_CTE)
def net_ego(spark, d):
    return rounded(N.edges(_network(spark, d), 100000, importer=LEADER), weight=4)


@query("net_vertices", "SELECT src AS name FROM edges UNION SELECT dst FROM edges", EDGE_CTE)
def net_vertices(spark, d):
    return N.vertices(N.edges(_network(spark, d), 100000))


@query(
    "net_degree",
    """SELECT name, CAST(sum(o) AS BIGINT) AS out_links, CAST(sum(i) AS BIGINT) AS in_links FROM
       (SELECT src AS name, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY 1""",
    EDGE_CTE,
)
def net_degree(spark, d):
    return rounded(N.degree(N.edges(_network(spark, d), 100000)), out_links=-1, in_links=-1)


GEO_SQL = """SELECT src, dst, round(weight, 4) AS weight, CAST(3 * a.n_nationkey - 36 AS DOUBLE) AS src_lat, CAST(7 * a.n_nationkey - 84 AS DOUBLE) AS src_lon,
   CAST(3 * b.n_nationkey - 36 AS DOUBLE) AS dst_lat, CAST(7 * b.n_nationkey - 84 AS DOUBLE) AS dst_lon
   FROM edges JOIN nation a ON src = a.n_name JOIN nation b ON dst = b.n_name"""


def _coords_twice(spark, d):
    """Coordinates with a second, later row for every area."""
    c = P.coordinates(spark, d)
    return c.unionByName(c.withColumns({"lat": F.col("lat") + 1, "lon": F.col("lon") + 1}))


@query("net_layout_geo", GEO_SQL, EDGE_CTE)
def net_layout_geo(spark, d):
    return rounded(N.geo_edges(N.edges(_network(spark, d), 100000), _coords_twice(spark, d), "area"), weight=4)


@query(
    "join_geo_endpoints",
    """SELECT exporter, importer, CAST(year AS BIGINT) AS year, item, round(value, 4) AS weight,
              CAST(3 * a.n_nationkey - 36 AS DOUBLE) AS src_lat, CAST(7 * a.n_nationkey - 84 AS DOUBLE) AS src_lon,
              CAST(3 * b.n_nationkey - 36 AS DOUBLE) AS dst_lat, CAST(7 * b.n_nationkey - 84 AS DOUBLE) AS dst_lon
       FROM flows JOIN nation a ON exporter = a.n_name JOIN nation b ON importer = b.n_name WHERE element = 'Export Value'""",
)
def join_geo_endpoints(spark, d):
    f = _element(spark, d, "Export Value").select(
        F.col("exporter").alias("src"), F.col("importer").alias("dst"), "year", "item", F.col("value").alias("weight")
    )
    out = N.geo_edges(f, _coords_twice(spark, d), "area").withColumnsRenamed({"src": "exporter", "dst": "importer"})
    return rounded(out, year=-1, weight=4)


# --- chart data ------------------------------------------------------------------------


@query("plot_series", "SELECT CAST(year AS BIGINT) AS x, round(sum(value), 4) AS y, item AS colour, element AS facet FROM panel GROUP BY 1, 3, 4")
def plot_series(spark, d):
    totals = V.total_by(P.country_panel(spark, d), "value", ["year", "item", "element"], "total")
    return rounded(PD.series(totals, "year", "total", "item", "element"), x=-1, y=4)


@query(
    "plot_shock_series",
    f"SELECT *, area = 'NATION_3' AS highlight, CAST(1998 AS BIGINT) AS shock_year FROM ({PRICE_LONG}) WHERE year >= 1996 AND year <= 2000",
    PRICE_CTE,
)
def plot_shock_series(spark, d):
    m = P.mirrored_flows(spark, d, first_year=1996, last_year=2000).withColumnRenamed("partner", "area")
    out = PD.shock_series(m, "area", LEADER, 1998, "Import Value", "Import Quantity", 1996, 2000)
    return rounded(_round_series(out), year=-1, shock_year=-1)


@query(
    "plot_histogram",
    """SELECT item, CAST(links - lo AS BIGINT) AS bin, CAST(links AS DOUBLE) - 0.5 AS low, CAST(links AS DOUBLE) + 0.5 AS high, CAST(count(*) AS BIGINT) AS count FROM
       (SELECT exporter, item, count(value) AS links FROM flows WHERE element = 'Export Quantity' AND year = 1998 GROUP BY 1, 2)
       CROSS JOIN (SELECT min(links) AS lo FROM (SELECT count(value) AS links FROM flows WHERE element = 'Export Quantity' AND year = 1998 GROUP BY exporter, item))
       GROUP BY 1, 2, 3, 4""",
)
def plot_histogram(spark, d):
    links = D.link_counts(_element(spark, d, "Export Quantity", first_year=1998, last_year=1998), "exporter", ["item"])
    return PD.histogram(links, "num_of_links", binwidth=1, facet=["item"])


@query(
    "plot_scatter",
    """SELECT round(ln(distw), 6) AS x, round(ln(nullif(value, 0)), 6) AS y, item AS facet FROM flows JOIN dist USING (exporter, importer)
       WHERE year = 1998 AND element = 'Export Value' AND ln(distw) BETWEEN 6.5 AND 8""",
)
def plot_scatter(spark, d):
    f = P.with_distance(spark, d, _element(spark, d, "Export Value", first_year=1998, last_year=1998))
    f = f.withColumns({"ldist": S.log_or_null("distw"), "lval": S.log_or_null("value")})
    return rounded(PD.scatter(f, "ldist", "lval", "item", xlim=(6.5, 8.0)), x=6, y=6)


LM_CTE = """pts AS (SELECT item, distw AS x, value AS y FROM flows JOIN dist USING (exporter, importer) WHERE year = 1998 AND element = 'Export Quantity' AND value BETWEEN 0 AND 200),
 lm AS (SELECT item, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS b, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, min(x) AS lo, max(x) AS hi FROM pts GROUP BY 1),
 lmgrid AS (SELECT lm.*, point, lo + point * ((hi - lo) / 79) AS gx FROM lm CROSS JOIN (SELECT unnest(generate_series(0, 79)) AS point))"""


def _quantity_by_distance(spark, d):
    return P.with_distance(spark, d, _element(spark, d, "Export Quantity", first_year=1998, last_year=1998))


@query(
    "plot_smooth_lm",
    """SELECT item, CAST(point AS BIGINT) AS point, round(gx, 4) AS x, round(my + b * (gx - mx), 6) AS y,
              round(se, 6) AS se, round(my + b * (gx - mx) - q * se, 6) AS low, round(my + b * (gx - mx) + q * se, 6) AS high
       FROM (SELECT *, CAST(n - 2 AS DOUBLE) AS df, sqrt((syy - b * sxy) / (n - 2) * (1.0 / n + (gx - mx) * (gx - mx) / sxx)) AS se FROM lmgrid) JOIN tq USING (df)""",
    LM_CTE + ", " + t_quantile_ctes("(SELECT n - 2 AS df FROM lm)"),
)
def plot_smooth_lm(spark, d):
    out = PD.smooth_lm(_quantity_by_distance(spark, d), "distw", "value", ["item"], ylim=(0.0, 200.0))
    return rounded(out, point=-1, x=4, y=6, se=6, low=6, high=6)


LOESS_CTE = """lp AS (SELECT item, ln(distw) AS x, ln(nullif(value, 0)) AS y FROM flows JOIN dist USING (exporter, importer) WHERE year = 1998 AND element = 'Export Quantity'),
 lr AS (SELECT item, min(x) AS lo, max(x) AS hi, count(*) AS n FROM lp GROUP BY 1),
 lg AS (SELECT item, n, point, lo + point * ((hi - lo) / 79) AS g FROM lr CROSS JOIN (SELECT unnest(generate_series(0, 79)) AS point)),
 ld AS (SELECT lg.item, point, g, n, x, y, abs(x - g) AS d, row_number() OVER (PARTITION BY lg.item, point ORDER BY abs(x - g)) AS rn FROM lg JOIN lp ON lp.item = lg.item),
 lh AS (SELECT item, point, d AS h FROM ld WHERE rn = greatest(CAST(floor(n * 0.75 + 0.00001) AS BIGINT), 1)),
 lw AS (SELECT ld.item, ld.point, g, y, (x - g) / h AS u, pow(1 - pow(d / h, 3), 3) AS w FROM ld JOIN lh ON ld.item = lh.item AND ld.point = lh.point WHERE d < h),
 lm2 AS (SELECT item, point, g, sum(w) AS a0, sum(w * u) AS a1, sum(w * u * u) AS a2, sum(w * u * u * u) AS a3, sum(w * u * u * u * u) AS a4,
   sum(w * y) AS b0, sum(w * u * y) AS b1, sum(w * u * u * y) AS b2 FROM lw GROUP BY 1, 2, 3)"""


def _split(level: int) -> str:
    """Cells of more than a share of the rows are cut at their median; others stay."""
    return f"""cut{level} AS (SELECT c.*, greatest(i + 1, least(j - 1, (SELECT min(seat) FROM bx WHERE bx.item = c.item AND before >= (bi + bj) / 2.0))) AS k
   FROM cell{level} c WHERE j - i >= 2 AND bj - bi > most),
 cell{level + 1} AS MATERIALIZED (SELECT item, i, j, bi, bj, most FROM cell{level} WHERE j - i < 2 OR bj - bi <= most
   UNION ALL SELECT cut{level}.item, i, k, bi, before, most FROM cut{level} JOIN bx ON bx.item = cut{level}.item AND seat = k
   UNION ALL SELECT cut{level}.item, k, j, before, bj, most FROM cut{level} JOIN bx ON bx.item = cut{level}.item AND seat = k)"""


# The operator blended between vertices: rows of x, vertices with their fits, products of the vertices' rows.
BAND_CTE = (
    """rx AS MATERIALIZED (SELECT item, x, count(*) AS n, sum(y) AS sy, sum(y * y) AS syy FROM lp GROUP BY 1, 2),
 bx AS MATERIALIZED (SELECT *, row_number() OVER w - 1 AS seat, coalesce(sum(n) OVER (PARTITION BY item ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
   lag(x) OVER w AS px FROM rx WINDOW w AS (PARTITION BY item ORDER BY x)),
 cell0 AS (SELECT item, 0 AS i, count(*) AS j, 0 AS bi, sum(n) AS bj, floor(sum(n) * 0.75 * 0.2) AS most FROM bx GROUP BY 1), """
    + ", ".join(map(_split, range(7)))
    + """, ends AS (SELECT item, lo AS v FROM lr UNION ALL SELECT item, hi FROM lr UNION ALL SELECT c.item, (x + px) / 2 FROM cell7 c JOIN bx ON bx.item = c.item AND seat = i AND i > 0),
 vx AS MATERIALIZED (SELECT item, v, row_number() OVER (PARTITION BY item ORDER BY v) - 1 AS no, lead(v) OVER (PARTITION BY item ORDER BY v) AS nv, count(*) OVER (PARTITION BY item) AS m FROM ends),
 vd AS (SELECT vx.item, no, v, abs(x - v) AS d, row_number() OVER (PARTITION BY vx.item, no ORDER BY abs(x - v)) AS rn, count(*) OVER (PARTITION BY vx.item, no) AS rows FROM vx JOIN lp ON lp.item = vx.item),
 vh AS (SELECT item, no, v, d AS h FROM vd WHERE rn = greatest(CAST(floor(rows * 0.75 + 0.00001) AS BIGINT), 1)),
 vu AS MATERIALIZED (SELECT vh.item, no, h, x, n, sy, (x - v) / h AS u, CASE WHEN abs(x - v) < h THEN pow(1 - pow(abs(x - v) / h, 3), 3) ELSE 0 END AS w FROM vh JOIN rx ON rx.item = vh.item),
 va AS (SELECT item, no, sum(n * w) AS a0, sum(n * w * u) AS a1, sum(n * w * u * u) AS a2, sum(n * w * u * u * u) AS a3, sum(n * w * u * u * u * u) AS a4 FROM vu GROUP BY 1, 2),
 vi AS (SELECT *, a0 * (a2 * a4 - a3 * a3) - a1 * (a1 * a4 - a3 * a2) + a2 * (a1 * a3 - a2 * a2) AS det FROM va),
 lent AS MATERIALIZED (SELECT item, 2 * no AS node, x, n, sy, w * ((a2 * a4 - a3 * a3) + (a2 * a3 - a1 * a4) * u + (a1 * a3 - a2 * a2) * u * u) / det AS l FROM vu JOIN vi USING (item, no)
   UNION ALL SELECT item, 2 * no + 1, x, n, sy, w * ((a2 * a3 - a1 * a4) + (a0 * a4 - a2 * a2) * u + (a1 * a2 - a0 * a3) * u * u) / det / h FROM vu JOIN vi USING (item, no)),
 held AS (SELECT item, node, sum(l * sy) AS val FROM lent GROUP BY 1, 2),
 spots AS (SELECT item, x AS g FROM rx UNION SELECT item, g FROM lg),
 placed AS (SELECT spots.item, g, no, nv - v AS wd, (g - v) / (nv - v) AS t FROM spots JOIN vx ON vx.item = spots.item AND nv IS NOT NULL AND g >= v AND (g < nv OR no = m - 2)),
 given AS MATERIALIZED (SELECT item, g, 2 * no AS node, (1 + 2 * t) * pow(1 - t, 2) AS c FROM placed UNION ALL SELECT item, g, 2 * no + 2, t * t * (3 - 2 * t) FROM placed
   UNION ALL SELECT item, g, 2 * no + 1, t * pow(1 - t, 2) * wd FROM placed UNION ALL SELECT item, g, 2 * no + 3, t * t * (t - 1) * wd FROM placed),
 gg AS MATERIALIZED (SELECT p.item, p.node AS p, q.node AS q, sum(p.n * p.l * q.l) AS v FROM lent p JOIN lent q ON q.item = p.item AND q.x = p.x GROUP BY 1, 2, 3),
 fx AS (SELECT given.item, g, sum(c * val) AS f FROM given JOIN held ON held.item = given.item AND held.node = given.node GROUP BY 1, 2),
 rs AS (SELECT rx.item, sum(syy - 2 * f * sy + n * f * f) AS rest, sum(n) AS n FROM rx JOIN fx ON fx.item = rx.item AND fx.g = rx.x GROUP BY 1),
 tr AS (SELECT lent.item, sum(n * c * l) AS tr FROM lent JOIN given ON given.item = lent.item AND given.node = lent.node AND g = x GROUP BY 1),
 norms AS MATERIALIZED (SELECT a.item, a.g, sum(a.c * b.c * v) AS s FROM given a JOIN given b ON b.item = a.item AND b.g = a.g JOIN gg ON gg.item = a.item AND gg.p = a.node AND gg.q = b.node GROUP BY 1, 2),
 ll AS (SELECT rx.item, sum(n * s) AS ll FROM rx JOIN norms ON norms.item = rx.item AND norms.g = rx.x GROUP BY 1),
 sg AS MATERIALIZED (SELECT rs.item, rest / (n - 2 * tr + ll) AS s2, n - 2 * tr + ll AS df FROM rs JOIN tr ON tr.item = rs.item JOIN ll ON ll.item = rs.item), """
    + t_real_quantile_ctes("sg")
    + """, band AS (SELECT norms.item, g, sqrt(s2 * s) AS se, q FROM norms JOIN sg ON sg.item = norms.item JOIN tq ON tq.df = sg.df)"""
)


@query(
    "plot_smooth_loess",
    """SELECT item, point, x, y, round(se, 6) AS se, round(yy - q * se, 6) AS low, round(yy + q * se, 6) AS high FROM (
       SELECT *, round(yy, 6) AS y FROM (SELECT lm2.item, CAST(point AS BIGINT) AS point, round(lm2.g, 6) AS x, se, q,
              ((b0 * (a2 * a4 - a3 * a3) - a1 * (b1 * a4 - a3 * b2) + a2 * (b1 * a3 - a2 * b2))
                  / (a0 * (a2 * a4 - a3 * a3) - a1 * (a1 * a4 - a3 * a2) + a2 * (a1 * a3 - a2 * a2))) AS yy FROM lm2 JOIN band ON band.item = lm2.item AND band.g = lm2.g))""",
    LOESS_CTE + ", " + BAND_CTE,
)
def plot_smooth_loess(spark, d):
    f = _quantity_by_distance(spark, d).withColumns({"ldist": S.log_or_null("distw"), "lval": S.log_or_null("value")})
    return rounded(PD.smooth_loess(f, "ldist", "lval", facet=["item"], band=True), point=-1, x=6, y=6, se=6, low=6, high=6)


# --- supplier exit ------------------------------------------------------------------------

EXIT_CTE = """sup AS (SELECT p_type AS market, l_suppkey AS supplier, CAST(l_suppkey % 5 AS DOUBLE) AS cost FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
 supw AS (SELECT *, 1 / (2 * cost + 1) AS w, supplier = min(supplier) OVER (PARTITION BY market) AS gone FROM sup),
 sums AS (SELECT *, sum(w) OVER (PARTITION BY market) AS s, sum(CASE WHEN NOT gone THEN w END) OVER (PARTITION BY market) AS s2 FROM supw),
 qty AS (SELECT *, 10 * w / (1 + s) AS qb, CASE WHEN NOT gone THEN 10 * w / (1 + s2) END AS qa FROM sums)"""


def suppliers(spark, d):
    line = P.table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    part = P.table(spark, d, "part").select("p_partkey", F.col("p_type").alias("market"))
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("market", F.col("l_suppkey").alias("supplier")).distinct()
    rows = cut_lineage(rows)  # read three times below and by the callers
    rows = rows.withColumns({"cost": (F.col("supplier") % 5).cast("double"), "a": F.lit(10.0)})
    first = rows.groupBy("market").agg(F.min("supplier").alias("first"))
    return V.lookup(rows, first, ["market"], ["first"]).withColumn("leaves", F.col("supplier") == F.col("first")).drop("first")


@query("join_scenarios", "SELECT market, supplier, round(qb, 8) AS q_before, round(qa, 8) AS q_after, round(qa - qb, 8) AS diff FROM qty", EXIT_CTE)
def join_scenarios(spark, d):
    rows = suppliers(spark, d)
    weight = 1 / (2 * F.col("cost") + 1)

    def scenario(part, name):
        s = part.groupBy("market").agg(F.sum(weight).alias("s"))
        return V.lookup(part, s, ["market"], ["s"]).select("market", "supplier", (F.col("a") * weight / (1 + F.col("s"))).alias(name))

    out = V.lookup(scenario(rows, "q_before"), scenario(rows.where(~F.col("leaves")), "q_after"), ["market", "supplier"], ["q_after"])
    return rounded(out.withColumn("diff", F.col("q_after") - F.col("q_before")), q_before=8, q_after=8, diff=8)


@query(
    "supplier_exit",
    """SELECT q.market, q.supplier, round(qb, 8) AS q_before, round(qa, 8) AS q_after, round(qa - qb, 8) AS diff,
              CASE WHEN qa IS NULL THEN NULL WHEN q.w > f.w THEN 'Diff1 < Diff2' WHEN q.w < f.w THEN 'Diff1 > Diff2' ELSE 'Diff1 = Diff2' END AS relation
       FROM qty q JOIN (SELECT market, arg_min(w, supplier) AS w FROM qty WHERE NOT gone GROUP BY 1) f ON q.market = f.market""",
    EXIT_CTE,
)
def supplier_exit(spark, d):
    out = E.supplier_exit(suppliers(spark, d), "market", "supplier", "cost", "a", "leaves", tol=1e-12)
    return rounded(out, q_before=8, q_after=8, diff=8)
