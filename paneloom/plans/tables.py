"""Sources, sinks, projections, predicates, joins and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.functions import aggregates as A
from paneloom.functions import scalars as S
from paneloom.operators import reshape as R
from paneloom.operators import verbs as V
from paneloom.plans.common import ITEMS, LEADER, SHOCK_ITEM, SHOCK_YEAR
from paneloom.plans.registry import query, rounded
from paneloom.session import new_folder
from paneloom.sources import files
from paneloom.sources import panels as P

YEARS = list(range(1995, 2002))
_WIDE = ", ".join(f"max(CASE WHEN year = {y} THEN value END) AS y{y}" for y in YEARS)
WIDE_CTE = f"wide AS (SELECT area, area_code, item, element, {_WIDE} FROM panel GROUP BY 1, 2, 3, 4)"
_WIDE_ROUND = ", ".join(f"round(y{y}, 4) AS y{y}" for y in YEARS)


def _wide_panel(spark, d):
    """Country panel in the wide layout of the source files, with raw headers."""
    wide = P.country_panel(spark, d).groupBy("area", "area_code", "item", "element").pivot("year", YEARS).agg(F.max("value"))
    heads = {"area": "Area", "area_code": "Area Code", "item": "Item", "element": "Element"}
    return wide.withColumnsRenamed({**heads, **{str(y): f"Y{y}" for y in YEARS}})


# --- sources and sinks --------------------------------------------------------


@query("scan_csv", f"SELECT area, CAST(area_code AS BIGINT) AS area_code, item, element, {_WIDE_ROUND} FROM wide", WIDE_CTE)
def scan_csv(spark, d):
    path = new_folder(spark, "wide-csv")
    files.write_csv(_wide_panel(spark, d), path)
    schema = files.wide_schema([("Area", "string"), ("Area Code", "integer"), ("Item", "string"), ("Element", "string")], YEARS, "Y")
    raw = files.read_csv(spark, path, schema)
    named = files.normalise_columns(raw, files.COUNTRY_FILE_NAMES)
    return rounded(named, area_code=-1, **{f"y{y}": 4 for y in YEARS})


@query("scan_parquet", "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders")
def scan_parquet(spark, d):
    return rounded(files.read_parquet(spark, f"{d}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"]), o_totalprice=2)


@query(
    "sink_parquet",
    "SELECT exporter, importer, item, element, round(value, 4) AS value, CAST(year AS BIGINT) AS year FROM flows",
)
def sink_parquet(spark, d):
    path = new_folder(spark, "flows")
    files.write_parquet(P.flows(spark, d), path, "year")
    back = files.read_parquet(spark, path, ["exporter", "importer", "item", "element", "value", "year"])
    return rounded(back, value=4, year=-1)


@query(
    "sink_csv",
    "SELECT exporter, importer, round(value, 4) AS value FROM flows WHERE year = 1998 AND item = 'PROMO' AND element = 'Export Value'",
)
def sink_csv(spark, d):
    path = new_folder(spark, "edges")
    rows = P.flows(spark, d, first_year=1998, last_year=1998).where("item = 'PROMO' AND element = 'Export Value'")
    files.write_csv(rows.select("exporter", "importer", "value"), path)
    return rounded(files.read_csv(spark, path, "exporter string, importer string, value double"), value=4)


@query(
    "sink_partitioned_series",
    """SELECT regexp_replace(item, '[,() \t/]', '_', 'g') AS item_slug, regexp_replace(area, '[,() \t/]', '_', 'g') AS area_slug,
              element, CAST(year AS BIGINT) AS year, round(value, 4) AS value FROM panel""",
)
def sink_partitioned_series(spark, d):
    path = new_folder(spark, "series")
    files.write_series(P.country_panel(spark, d), path, "item", "area")
    back = files.read_parquet(spark, path, ["item_slug", "area_slug", "element", "year", "value"])
    return rounded(back, year=-1, value=4)


@query("normalise_columns", f"SELECT area, CAST(area_code AS BIGINT) AS area_code, item, element, {_WIDE_ROUND} FROM wide", WIDE_CTE)
def normalise_columns(spark, d):
    return rounded(files.normalise_columns(_wide_panel(spark, d), files.COUNTRY_FILE_NAMES), area_code=-1, **{f"y{y}": 4 for y in YEARS})


# --- projection and predicates --------------------------------------------------


@query("select_columns", "SELECT exporter, importer, CAST(year AS BIGINT) AS year, round(value, 4) AS amount FROM flows WHERE element = 'Export Value'")
def select_columns(spark, d):
    rows = P.flows(spark, d, elements=["Export Value"])
    return rounded(rows.select("exporter", "importer", "year", F.col("value").alias("amount")), year=-1, amount=4)


@query("select_by_name_rule", f"SELECT area, {_WIDE_ROUND} FROM wide", WIDE_CTE)
def select_by_name_rule(spark, d):
    wide = files.normalise_columns(_wide_panel(spark, d), files.COUNTRY_FILE_NAMES)
    years = [c for c in wide.columns if len(c) == 5 and c.startswith("y")]
    return rounded(wide.select("area", *years), **{c: 4 for c in years})


@query(
    "mutate_columns",
    """SELECT exporter, importer, CAST(year AS BIGINT) AS year, item, round(exp_val / 1000, 7) AS val,
              round(ln(exp_val / 1000 / nullif(exp_quant, 0)), 6) AS lprice, round(100 * ln(exp_val / 1000 / nullif(exp_quant, 0)), 6) AS lprice_pct
       FROM flows_wide""",
)
def mutate_columns(spark, d):
    cells = P.flow_cells(spark, d)
    out = cells.withColumn("val", F.col("exp_val") / 1000).withColumn("lprice", S.log_or_null(S.ratio("val", "exp_quant")))
    out = out.withColumn("lprice_pct", F.col("lprice") * 100)
    return rounded(out.select("exporter", "importer", "year", "item", "val", "lprice", "lprice_pct"), year=-1, val=7, lprice=6, lprice_pct=6)


@query(
    "filter_conjunction",
    """SELECT importer, round(value, 4) AS value FROM flows
       WHERE exporter = 'NATION_3' AND year = 1998 AND item = 'PROMO' AND element = 'Export Value'""",
)
def filter_conjunction(spark, d):
    f = P.flows(spark, d, first_year=1998, last_year=1998)
    test = (F.col("exporter") == LEADER) & (F.col("item") == SHOCK_ITEM) & (F.col("element") == "Export Value")
    return rounded(f.where(test).select("importer", "value"), value=4)


@query(
    "filter_disjunction",
    """SELECT area, CAST(year AS BIGINT) AS year, item, element, round(value, 4) AS value FROM panel
       WHERE (item = 'PROMO' AND element = 'Production') OR (item = 'ECONOMY' AND element = 'Export Quantity')""",
)
def filter_disjunction(spark, d):
    item, el = F.col("item"), F.col("element")
    test = ((item == "PROMO") & (el == "Production")) | ((item == "ECONOMY") & (el == "Export Quantity"))
    return rounded(P.country_panel(spark, d).where(test).drop("area_code"), year=-1, value=4)


@query(
    "filter_in_list",
    """SELECT area, CAST(year AS BIGINT) AS year, item, element, round(value, 4) AS value FROM panel
       WHERE item IN ('PROMO', 'ECONOMY') AND area_code NOT IN (3, 7)""",
)
def filter_in_list(spark, d):
    test = F.col("item").isin("PROMO", "ECONOMY") & ~F.col("area_code").isin(3, 7)
    return rounded(P.country_panel(spark, d).where(test).drop("area_code"), year=-1, value=4)


@query(
    "filter_range",
    """SELECT exporter, importer, CAST(year AS BIGINT) AS year, item, round(value, 4) AS value FROM flows
       WHERE element = 'Export Value' AND year > 1996 AND year < 2000 AND value > 10000 AND value < 500000""",
)
def filter_range(spark, d):
    # The year range also goes to the scan as a range of the raw timestamp.
    f = P.flows(spark, d, first_year=1997, last_year=1999)
    test = (F.col("element") == "Export Value") & (F.col("value") > 10000) & (F.col("value") < 500000)
    return rounded(f.where(test).select("exporter", "importer", "year", "item", "value"), year=-1, value=4)


GRID_CTES = """links AS (
  SELECT p.exporter, p.importer, f.value FROM (SELECT DISTINCT exporter, importer FROM flows) p
  LEFT JOIN (SELECT * FROM flows WHERE element = 'Export Value' AND item = 'PROMO' AND year = 1998) f USING (exporter, importer))"""


def _link_grid(spark, d):
    """Every pair of areas that ever trades, with its 1998 value of the shock item, NULL where there is none."""
    value = F.when((F.col("item") == SHOCK_ITEM) & (F.col("year") == SHOCK_YEAR), F.col("exp_val"))
    return P.flow_cells(spark, d).groupBy("exporter", "importer").agg(F.max(value).alias("value"))


@query("filter_not_null", "SELECT exporter, importer, round(value, 4) AS value FROM links WHERE value IS NOT NULL", GRID_CTES)
def filter_not_null(spark, d):
    return rounded(_link_grid(spark, d).where(F.col("value").isNotNull()), value=4)


@query(
    "filter_regex",
    """SELECT item, element, CAST(year AS BIGINT) AS year, round(sum(value), 4) AS total FROM panel
       WHERE regexp_matches(item, 'MO|ARD') AND contains(element, 'Export') GROUP BY 1, 2, 3""",
)
def filter_regex(spark, d):
    rows = P.country_panel(spark, d).where(F.col("item").rlike("MO|ARD") & F.col("element").contains("Export"))
    return rounded(rows.groupBy("item", "element", "year").agg(F.sum("value").alias("total")), year=-1, total=4)


# Area codes in a regional classification: region hundreds, sub-regions below.
CODE_SQL = "5100 + 100 * n_regionkey + n_nationkey // 5"


def _classified(spark, d):
    code = 5100 + 100 * F.col("region_code") + F.floor(F.col("area_code") / 5)
    return P.area_codes(spark, d).select("area", code.cast("int").alias("code"))


@query(
    "filter_modulo",
    f"""SELECT code, CAST(year AS BIGINT) AS year, round(sum(value), 4) AS total
        FROM panel JOIN (SELECT n_name, CAST({CODE_SQL} AS BIGINT) AS code FROM nation) c ON area = n_name
        WHERE code % 100 = 0 AND element = 'Export Value' GROUP BY 1, 2""",
)
def filter_modulo(spark, d):
    rows = P.country_panel(spark, d, elements=["Export Value"])
    rows = V.lookup(rows, _classified(spark, d), ["area"], ["code"]).where(F.pmod("code", F.lit(100)) == 0)
    return rounded(rows.groupBy("code", "year").agg(F.sum("value").alias("total")), code=-1, year=-1, total=4)


RAW_CODE_CTE = """codes AS (SELECT n_name, CASE n_nationkey WHEN 0 THEN 252 WHEN 1 THEN 254 WHEN 2 THEN 5000 WHEN 4 THEN 5100 WHEN 5 THEN NULL ELSE n_nationkey END AS code FROM nation)"""


@query(
    "drop_aggregate_areas",
    """SELECT exporter, importer, CAST(year AS BIGINT) AS year, item, round(value, 4) AS value
       FROM flows JOIN codes a ON exporter = a.n_name JOIN codes b ON importer = b.n_name
       WHERE element = 'Export Value' AND a.code < 5000 AND a.code NOT IN (252, 254) AND b.code < 5000 AND b.code NOT IN (252, 254)""",
    RAW_CODE_CTE,
)
def drop_aggregate_areas(spark, d):
    k = F.col("area_code")
    code = F.when(k == 0, 252).when(k == 1, 254).when(k == 2, 5000).when(k == 4, 5100).when(k == 5, None).otherwise(k)
    codes = P.area_codes(spark, d).select("area", code.alias("code"))
    f = P.flows(spark, d, elements=["Export Value"])
    f = V.lookup(f, codes, {"exporter": "area"}, {"code": "reporter_code"})
    f = V.lookup(f, codes, {"importer": "area"}, {"code": "partner_code"})
    kept = V.drop_aggregate_areas(f, ["reporter_code", "partner_code"])
    return rounded(kept.select("exporter", "importer", "year", "item", "value"), year=-1, value=4)


@query(
    "exclude_unit",
    "SELECT area, CAST(year AS BIGINT) AS year, item, round(value, 4) AS value FROM panel WHERE element = 'Production' AND area <> 'NATION_3'",
)
def exclude_unit(spark, d):
    rows = V.exclude_unit(P.country_panel(spark, d, elements=["Production"]), "area", LEADER)
    return rounded(rows.select("area", "year", "item", "value"), year=-1, value=4)


@query(
    "replace_code",
    """SELECT CASE WHEN exporter = 'NATION_7' THEN 'NATION_8' ELSE exporter END AS exporter, item, round(sum(value), 4) AS total
       FROM flows WHERE element = 'Export Value' GROUP BY 1, 2""",
)
def replace_code(spark, d):
    f = P.flows(spark, d, elements=["Export Value"])
    f = f.withColumn("exporter", F.when(F.col("exporter") == "NATION_7", "NATION_8").otherwise(F.col("exporter")))
    return rounded(f.groupBy("exporter", "item").agg(F.sum("value").alias("total")), total=4)


@query(
    "sample_rows",
    """SELECT area, CAST(year AS BIGINT) AS year, item, element, round(value, 4) AS value FROM panel
       ORDER BY md5(concat_ws('|', '123', area, year, item, element)), area, panel.year, item, element LIMIT 200""",
)
def sample_rows(spark, d):
    rows = P.country_panel(spark, d)
    drawn = V.sample_rows(rows, ["area", "year", "item", "element"], 200, seed=123)
    return rounded(drawn.select("area", "year", "item", "element", "value"), year=-1, value=4)


# --- joins ------------------------------------------------------------------------


@query(
    "join_left_equi",
    """SELECT area, CAST(year AS BIGINT) AS year, item, element, round(value, 4) AS value, CAST(n_regionkey AS BIGINT) AS region_code
       FROM panel LEFT JOIN nation ON area = n_name""",
)
def join_left_equi(spark, d):
    rows = V.lookup(P.country_panel(spark, d).drop("area_code"), P.area_codes(spark, d), ["area"], ["region_code"])
    return rounded(rows, year=-1, value=4, region_code=-1)


@query(
    "join_left_multi",
    """SELECT p.area, CAST(p.year AS BIGINT) AS year, item, element, round(value, 4) AS value, round(gdp, 5) AS gdp
       FROM panel p LEFT JOIN gdp g ON p.area = g.area AND p.year = g.year""",
)
def join_left_multi(spark, d):
    rows = V.lookup(P.country_panel(spark, d).drop("area_code"), P.income(spark, d), ["area", "year"], ["gdp"])
    return rounded(rows, year=-1, value=4, gdp=5)


@query(
    "join_role_playing",
    """SELECT exporter, importer, CAST(flows.year AS BIGINT) AS year, item, element, round(value, 4) AS value,
              CAST(a.n_regionkey AS BIGINT) AS exporter_region, CAST(b.n_regionkey AS BIGINT) AS importer_region,
              distw, 1.25 * distw AS distcap, CASE WHEN exporter <> importer THEN 0.75 * distw END AS distwces, seadistance, round(ga.gdp, 5) AS exporter_gdp, round(gb.gdp, 5) AS importer_gdp
       FROM flows LEFT JOIN nation a ON exporter = a.n_name LEFT JOIN nation b ON importer = b.n_name LEFT JOIN dist USING (exporter, importer)
       LEFT JOIN sea USING (exporter, importer)
       LEFT JOIN gdp ga ON ga.area = exporter AND ga.year = flows.year LEFT JOIN gdp gb ON gb.area = importer AND gb.year = flows.year""",
)
def join_role_playing(spark, d):
    cells = P.staged_cells(spark, d)
    f = P.flows(spark, d, cells).drop("exporter_code", "importer_code")
    dist = P.distances(spark, d, cells).withColumn("distwces", S.to_number("distwces"))
    sea = P.sea_distances(spark, d, cells)
    rows = V.enrich_flows(f, P.area_codes(spark, d), dist, P.income(spark, d), sea=sea, measures=["distw", "distcap", "distwces"])
    return rounded(rows, year=-1, value=4, exporter_region=-1, importer_region=-1, exporter_gdp=5, importer_gdp=5)


@query(
    "join_prune_then_join",
    """SELECT exporter, importer, CAST(year AS BIGINT) AS year, item, round(value, 4) AS value, distw
       FROM flows LEFT JOIN dist USING (exporter, importer) WHERE element = 'Export Quantity'""",
)
def join_prune_then_join(spark, d):
    f = P.flows(spark, d, elements=["Export Quantity"]).select("exporter", "importer", "year", "item", "value")
    return rounded(P.with_distance(spark, d, f), year=-1, value=4)


@query(
    "join_right_fill",
    """SELECT n_name AS importer, round(coalesce(value, 0), 4) AS value FROM nation LEFT JOIN
       (SELECT importer, value FROM flows WHERE exporter = 'NATION_3' AND year = 1997 AND item = 'PROMO' AND element = 'Export Quantity') ON importer = n_name""",
)
def join_right_fill(spark, d):
    f = P.flows(spark, d, first_year=1997, last_year=1997).where(
        (F.col("exporter") == LEADER) & (F.col("item") == SHOCK_ITEM) & (F.col("element") == "Export Quantity")
    )
    units = P.area_codes(spark, d).select(F.col("area").alias("importer"))
    return rounded(V.fill_units(f.select("importer", "value"), units, "importer", {"value": 0.0}), value=4)


@query(
    "join_agg_back",
    """SELECT exporter, importer, item, round(value / nullif(t, 0), 8) AS share
       FROM (SELECT * FROM flows WHERE year = 1997 AND element = 'Export Value')
       JOIN (SELECT exporter, item, sum(value) AS t FROM flows WHERE year = 1997 AND element = 'Export Value' GROUP BY 1, 2) USING (exporter, item)""",
)
def join_agg_back(spark, d):
    f = P.flows(spark, d, P.staged_cells(spark, d, first_year=1997, last_year=1997)).where(F.col("element") == "Export Value")
    totals = V.total_by(f, "value", ["exporter", "item"], "t")
    out = V.lookup(f, totals, ["exporter", "item"], ["t"]).withColumn("share", S.ratio("value", "t"))
    return rounded(out.select("exporter", "importer", "item", "share"), share=8)


@query(
    "semi_join_list",
    """SELECT area, CAST(year AS BIGINT) AS year, item, round(value, 4) AS value FROM panel
       WHERE element = 'Production' AND item IN (SELECT item FROM flows WHERE exporter = 'NATION_3' AND importer = 'NATION_5' AND year = 1998)""",
)
def semi_join_list(spark, d):
    cells = P.staged_cells(spark, d)
    f = P.flows(spark, d, cells)
    traded = f.where((F.col("exporter") == LEADER) & (F.col("importer") == "NATION_5") & (F.col("year") == 1998)).select("item").distinct()
    rows = P.country_panel(spark, d, cells, elements=["Production"]).join(traded, "item", "left_semi")
    return rounded(rows.select("area", "year", "item", "value"), year=-1, value=4)


@query(
    "anti_join_list",
    """SELECT area, CAST(year AS BIGINT) AS year, item, round(value, 4) AS value FROM panel
       WHERE element = 'Production' AND area_code NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""",
)
def anti_join_list(spark, d):
    out_list = P.area_codes(spark, d).where(F.col("region_code") == 2).select("area_code")
    rows = P.country_panel(spark, d, elements=["Production"]).join(out_list, "area_code", "left_anti")
    return rounded(rows.select("area", "year", "item", "value"), year=-1, value=4)


# --- scalar functions ---------------------------------------------------------------


@query(
    "fn_log",
    """SELECT exporter, importer, CAST(year AS BIGINT) AS year, item, round(ln(nullif(exp_val, 0)), 6) AS lval,
              round(ln(exp_quant + 0.00001), 6) AS lquant FROM flows_wide""",
)
def fn_log(spark, d):
    out = P.flow_cells(spark, d).withColumns({"lval": S.log_or_null("exp_val"), "lquant": S.log_or_null(F.col("exp_quant") + 0.00001)})
    return rounded(out.select("exporter", "importer", "year", "item", "lval", "lquant"), year=-1, lval=6, lquant=6)


@query(
    "fn_arith_price",
    """SELECT area, CAST(year AS BIGINT) AS year, item, round(v / nullif(q, 0), 3) AS price, round(v / 1000, 7) AS val_thousand,
              round(100 * (v - q) / nullif(v, 0), 6) AS pct
       FROM (SELECT area, year, item, max(CASE WHEN element = 'Import Value' THEN value END) AS v, max(CASE WHEN element = 'Import Quantity' THEN value END) AS q
             FROM panel GROUP BY 1, 2, 3)""",
)
def fn_arith_price(spark, d):
    w = R.pivot_measures(P.country_panel(spark, d), ["area", "year", "item"], "element", "value", {"Import Value": "v", "Import Quantity": "q"})
    out = w.withColumns(
        {"price": S.ratio("v", "q"), "val_thousand": F.col("v") / 1000, "pct": S.ratio(100 * (F.col("v") - F.col("q")), "v")}
    )
    return rounded(out.drop("v", "q"), year=-1, price=3, val_thousand=7, pct=6)


@query(
    "fn_case_label",
    """SELECT CASE item WHEN 'PROMO' THEN 'promo' WHEN 'ECONOMY' THEN 'economy' WHEN 'STANDARD' THEN 'standard' END AS label,
              CAST(year AS BIGINT) AS year, round(sum(value), 4) AS total FROM flows WHERE element = 'Export Value' GROUP BY 1, 2""",
)
def fn_case_label(spark, d):
    f = P.flows(spark, d, elements=["Export Value"]).withColumn("label", S.label("item", ITEMS))
    return rounded(f.groupBy("label", "year").agg(F.sum("value").alias("total")), year=-1, total=4)


@query(
    "fn_case_multi",
    """SELECT CASE WHEN item = 'PROMO' AND element = 'Production' THEN 'promo_prod' WHEN item = 'ECONOMY' AND element = 'Export Quantity' THEN 'economy_exp'
                   WHEN item = 'ECONOMY' AND element = 'Import Quantity' THEN 'economy_imp' END AS category,
              CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM panel GROUP BY 1""",
)
def fn_case_multi(spark, d):
    item, el = F.col("item"), F.col("element")
    rules = [
        ((item == "PROMO") & (el == "Production"), "promo_prod"),
        ((item == "ECONOMY") & (el == "Export Quantity"), "economy_exp"),
        ((item == "ECONOMY") & (el == "Import Quantity"), "economy_imp"),
    ]
    rows = P.country_panel(spark, d).withColumn("category", S.label_rules(rules))
    return rounded(rows.groupBy("category").agg(A.count_rows().alias("n"), F.sum("value").alias("total")), total=4)


@query(
    "fn_case_range",
    f"""SELECT area, CAST(code AS BIGINT) AS code, CASE WHEN code >= 5100 AND code < 5200 THEN 'Africa' WHEN code >= 5200 AND code < 5300 THEN 'America'
               WHEN code >= 5300 AND code < 5400 THEN 'Asia' WHEN code >= 5400 AND code < 5500 THEN 'Europe' WHEN code >= 5500 AND code < 5600 THEN 'Oceania' END AS continent,
               round(sum(value), 4) AS total
        FROM panel JOIN (SELECT n_name, {CODE_SQL} AS code FROM nation) c ON area = n_name WHERE element = 'Export Value' GROUP BY 1, 2, 3""",
)
def fn_case_range(spark, d):
    rows = P.country_panel(spark, d, elements=["Export Value"])
    rows = rows.groupBy("area").agg(F.sum("value").alias("total"))
    rows = V.lookup(rows, _classified(spark, d), ["area"], ["code"])
    rows = rows.withColumn("continent", S.range_label("code", S.CONTINENT_CODE_RANGES))
    return rounded(rows.select("area", "code", "continent", "total"), code=-1, total=4)


@query(
    "fn_if_else",
    "SELECT exporter, importer, CAST(CASE WHEN value IS NULL THEN NULL WHEN value > 100000 THEN 1 ELSE 0 END AS DOUBLE) AS large FROM links",
    GRID_CTES,
)
def fn_if_else(spark, d):
    return _link_grid(spark, d).select("exporter", "importer", S.flag(F.col("value") > 100000).alias("large"))


@query("fn_replace_na", "SELECT exporter, importer, round(coalesce(value, 0), 4) AS value FROM links", GRID_CTES)
def fn_replace_na(spark, d):
    return rounded(_link_grid(spark, d).fillna({"value": 0.0}), value=4)


@query(
    "fn_concat",
    "SELECT element || '_' || item AS element_item, CAST(year AS BIGINT) AS year, round(sum(value), 4) AS total FROM panel GROUP BY 1, 2",
)
def fn_concat(spark, d):
    rows = P.country_panel(spark, d).withColumn("element_item", F.concat("element", F.lit("_"), "item"))
    return rounded(rows.groupBy("element_item", "year").agg(F.sum("value").alias("total")), year=-1, total=4)


@query(
    "fn_slug",
    """SELECT DISTINCT p_name, regexp_replace(p_name || ', ' || p_type || ' (export/import)', '[,() \t/]', '_', 'g') AS slug FROM part""",
)
def fn_slug(spark, d):
    text = F.concat("p_name", F.lit(", "), "p_type", F.lit(" (export/import)"))
    return P.table(spark, d, "part").select("p_name", S.slug(text).alias("slug")).distinct()


@query(
    "fn_remove_first",
    r"""SELECT DISTINCT p_type, p_name, regexp_replace(p_name || ' (export/import) x (export/import)', ' \(export/import\)', '') AS short,
               regexp_replace(p_type || ', a, b', ', ', '') AS joined FROM part""",
)
def fn_remove_first(spark, d):
    name = F.concat("p_name", F.lit(" (export/import) x (export/import)"))
    return (
        P.table(spark, d, "part")
        .select(
            "p_type",
            "p_name",
            S.remove_first(name, r" \(export/import\)").alias("short"),
            S.remove_first(F.concat("p_type", F.lit(", a, b")), ", ").alias("joined"),
        )
        .distinct()
    )


@query(
    "fn_replace_prefix",
    "SELECT CAST(year AS BIGINT) AS year, round(sum(value), 4) AS total FROM panel WHERE element = 'Production' GROUP BY 1",
)
def fn_replace_prefix(spark, d):
    rows = P.country_panel(spark, d, elements=["Production"]).withColumn("name", F.concat(F.lit("y"), F.col("year")))
    return rounded(rows.groupBy(S.year_of("name").alias("year")).agg(F.sum("value").alias("total")), year=-1, total=4)


@query(
    "fn_try_numeric",
    """SELECT exporter, importer, TRY_CAST(CASE WHEN exporter = importer THEN 'NA' ELSE CAST(distw AS VARCHAR) END AS DOUBLE) AS distw
       FROM dist JOIN (SELECT DISTINCT exporter, importer FROM flows) USING (exporter, importer)""",
)
def fn_try_numeric(spark, d):
    text = F.when(F.col("exporter") == F.col("importer"), "NA").otherwise(F.col("distw").cast("string"))
    return P.distances(spark, d, P.flow_cells(spark, d)).select("exporter", "importer", S.to_number(text).alias("distw"))


@query("fn_lower", "SELECT lower(item) AS item, CAST(count(*) AS BIGINT) AS n FROM panel GROUP BY 1")
def fn_lower(spark, d):
    return P.country_panel(spark, d).groupBy(F.lower("item").alias("item")).agg(A.count_rows().alias("n"))


@query("fn_length", "SELECT CAST(length(p_name) AS BIGINT) AS len, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1")
def fn_length(spark, d):
    return P.table(spark, d, "part").groupBy(F.length("p_name").cast("bigint").alias("len")).agg(A.count_rows().alias("n"))


@query("fn_negate", "SELECT area, CAST(year AS BIGINT) AS year, round(-sum(value), 4) AS minus FROM panel WHERE element = 'Import Value' GROUP BY 1, 2")
def fn_negate(spark, d):
    rows = P.country_panel(spark, d, elements=["Import Value"])
    return rounded(rows.groupBy("area", "year").agg((-F.sum("value")).alias("minus")), year=-1, minus=4)


@query("fn_interaction_key", "SELECT exporter || '^' || year AS fe, CAST(count(*) AS BIGINT) AS n, round(sum(exp_val), 4) AS total FROM flows_wide GROUP BY 1")
def fn_interaction_key(spark, d):
    rows = P.flow_cells(spark, d).groupBy(S.combined_key("exporter", "year").alias("fe"))
    return rounded(rows.agg(A.count_rows().alias("n"), F.sum("exp_val").alias("total")), total=4)


@query(
    "fn_lookup",
    """SELECT importer, CAST(3 * n_nationkey - 36 AS DOUBLE) AS lat, CAST(7 * n_nationkey - 84 AS DOUBLE) AS lon, round(sum(exp_val), 4) AS total
       FROM flows_wide JOIN nation ON importer = n_name GROUP BY 1, 2, 3""",
)
def fn_lookup(spark, d):
    totals = P.flow_cells(spark, d).groupBy("importer").agg(F.sum("exp_val").alias("total"))
    return rounded(V.lookup(totals, P.coordinates(spark, d), {"importer": "area"}, ["lat", "lon"]), total=4)
