"""Regression queries: least squares, fixed effects, decompositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.functions import scalars as S
from paneloom.operators import fixedfx as FX
from paneloom.operators import linreg as L
from paneloom.operators import plotdata as PD
from paneloom.operators import reshape as R
from paneloom.operators import verbs as V
from paneloom.plans.common import ELEMENTS, ITEMS, SHOCK_ITEM
from paneloom.plans.descriptive import CATEGORY_RULES, category_rules
from paneloom.plans.registry import ols_ctes, query, rounded, t_quantile_ctes, t_share_sql, within_rounds
from paneloom.sources import panels as P

SIX = {c: 6 for c in ("estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high", "r2", "within_r2")}


def _coefs(df, *keys, cols=("estimate", "std_error", "statistic", "nobs", "r2"), longs=()):
    """Chosen result columns, rounded; a year key becomes bigint."""
    out = df.select(*keys, "term", *cols)
    return rounded(out, **{c: SIX[c] for c in cols if c in SIX}, **{k: -1 for k in longs})


def simple_sql(source: str, keys: str = "") -> str:
    """Check of y on x with an intercept, by keys: the moment CTE of a source, or (``m``) the term rows."""
    by = f"{keys}, " if keys else ""
    if source != "m":
        group = f"GROUP BY {keys}" if keys else ""
        return (
            "m AS (SELECT *, (syy - slope * sxy) / (n - 2) AS s2, 1 - (syy - slope * sxy) / syy AS r2 FROM ("
            f"SELECT {by}count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy, "
            f"regr_slope(y, x) AS slope FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL {group}))"
        )
    return f"""
    SELECT {by}term, round(b, 6) AS estimate, round(se, 6) AS std_error, round(b / nullif(se, 0), 6) AS statistic, nobs, round(r2, 6) AS r2 FROM (
      SELECT {by}'(Intercept)' AS term, my - slope * mx AS b, sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS se, CAST(n AS BIGINT) AS nobs, r2 FROM m
      UNION ALL SELECT {by}'x', slope, sqrt(s2 / sxx), CAST(n AS BIGINT), r2 FROM m)"""


# --- log flows in 1998 as the common cross-section -----------------------------------

GRAVITY_CTE = """grav AS (SELECT exporter, importer, item, year, ln(nullif(value, 0)) AS y, ln(distw) AS x FROM flows JOIN dist USING (exporter, importer)
   WHERE element = 'Export Value')"""


def _gravity(spark, d, **limits):
    """exporter, importer, item, year, y = log value, x = log distance."""
    f = P.with_distance(spark, d, P.flows(spark, d, elements=["Export Value"], **limits))
    return f.select("exporter", "importer", "item", "year", S.log_or_null("value").alias("y"), S.log_or_null("distw").alias("x"))


AREA_CTE = """areas AS (SELECT p.area, p.year, p.item, p.value AS y, g.gdp AS x FROM (SELECT * FROM panel WHERE element = 'Production') p
   JOIN gdp g ON p.area = g.area AND p.year = g.year)"""


def _areas(spark, d):
    """area, year, item, y = production, x = income: complete in all three keys."""
    rows = P.country_panel(spark, d, elements=["Production"])
    rows = V.lookup(rows, P.income(spark, d), ["area", "year"], ["gdp"], how="inner")
    return rows.select("area", "year", "item", F.col("value").alias("y"), F.col("gdp").alias("x"))


# --- least squares ---------------------------------------------------------------------


@query("ols_simple", simple_sql("m"), GRAVITY_CTE + ", g98 AS (SELECT * FROM grav WHERE year = 1998), " + simple_sql("g98"))
def ols_simple(spark, d):
    return _coefs(L.ols(_gravity(spark, d, first_year=1998, last_year=1998), "y", ["x"]))


def terms_cte(keys: str) -> str:
    """``terms``: both coefficients of a simple regression with error and df; ``tq``: t quantiles."""
    return (
        f"terms AS (SELECT {keys}, '(Intercept)' AS term, my - slope * mx AS b, sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS se, n, CAST(n - 2 AS DOUBLE) AS df, r2 FROM m "
        f"UNION ALL SELECT {keys}, 'x', slope, sqrt(s2 / sxx), n, CAST(n - 2 AS DOUBLE), r2 FROM m), " + t_quantile_ctes("terms")
    )


TERM_SQL = """round(b, 6) AS estimate, round(se, 6) AS std_error, round(b / se, 6) AS statistic, round(1 - {share}, 6) AS p_value,
   round(b - q * se, 6) AS conf_low, round(b + q * se, 6) AS conf_high, CAST(n AS BIGINT) AS nobs, round(r2, 6) AS r2""".format(share=t_share_sql("(b / se)", "df"))
FULL = ("estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high", "nobs", "r2")


@query(
    "ols_by_group",
    f"SELECT year, term, {TERM_SQL} FROM terms JOIN tq USING (df)",
    GRAVITY_CTE + ", gy AS (SELECT CAST(year AS BIGINT) AS year, x, y FROM grav), " + simple_sql("gy", "year") + ", " + terms_cte("year"),
)
def ols_by_group(spark, d):
    return _coefs(L.ols(_gravity(spark, d), "y", ["x"], by=["year"]), "year", cols=FULL, longs=["year"])


TWO_CTE = (
    GRAVITY_CTE
    + """, two AS (SELECT grav.item, y, x AS x1, ln(g.gdp) AS x2 FROM grav JOIN gdp g ON g.area = importer AND g.year = grav.year),
 mm AS (SELECT item, count(*) AS n, var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22, covar_pop(x1, x2) * count(*) AS s12,
        covar_pop(x1, y) * count(*) AS s1y, covar_pop(x2, y) * count(*) AS s2y, var_pop(y) * count(*) AS syy FROM two GROUP BY 1),
 bb AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM mm),
 ss AS (SELECT *, (syy - b1 * s1y - b2 * s2y) AS ssr FROM bb)"""
)


@query(
    "ols_multi",
    """SELECT item, 'x' AS term, round(b1, 6) AS estimate, round(sqrt(ssr / (n - 3) * s22 / det), 6) AS std_error, CAST(n AS BIGINT) AS nobs, round(1 - ssr / syy, 6) AS r2 FROM ss
       UNION ALL SELECT item, 'lgdp', round(b2, 6), round(sqrt(ssr / (n - 3) * s11 / det), 6), CAST(n AS BIGINT), round(1 - ssr / syy, 6) FROM ss""",
    TWO_CTE,
)
def ols_multi(spark, d):
    g = V.lookup(_gravity(spark, d), P.income(spark, d), {"importer": "area", "year": "year"}, ["gdp"]).withColumn("lgdp", S.log_or_null("gdp"))
    fit = L.ols(g, "y", ["x", "lgdp"], by=["item"]).where(F.col("term") != "(Intercept)")
    return _coefs(fit, "item", cols=("estimate", "std_error", "nobs", "r2"))


UNITS_CTE = """units AS (SELECT item, exporter, ln(nullif(sum(value), 0)) AS x, ln(count(*)) AS y FROM flows WHERE element = 'Export Value' AND year = 1998 GROUP BY 1, 2),
 k1 AS (SELECT item, count(*) AS n, sum(x * y) AS sxy, sum(x * x) AS sxx, sum(y * y) AS syy FROM units GROUP BY 1),
 k2 AS (SELECT *, sxy / sxx AS b, syy - sxy * sxy / sxx AS ssr FROM k1),
 k3 AS (SELECT units.item, sum(x * x * (y - b * x) * (y - b * x) / (1 - x * x / sxx)) AS meat FROM units JOIN k2 ON units.item = k2.item GROUP BY 1)"""


def _units(spark, d):
    f = P.flows(spark, d, first_year=1998, last_year=1998).where(F.col("element") == "Export Value")
    u = f.groupBy("item", "exporter").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    return u.select("item", "exporter", S.log_or_null("total").alias("x"), F.ln(F.col("n").cast("double")).alias("y"))


@query(
    "ols_no_intercept",
    """SELECT item, 'x' AS term, round(b, 6) AS estimate, round(sqrt(ssr / (n - 1) / sxx), 6) AS std_error, CAST(n AS BIGINT) AS nobs, round(1 - ssr / syy, 6) AS r2 FROM k2""",
    UNITS_CTE,
)
def ols_no_intercept(spark, d):
    fit = L.ols(_units(spark, d), "y", ["x"], by=["item"], intercept=False)
    return _coefs(fit, "item", cols=("estimate", "std_error", "nobs", "r2"))


@query(
    "ols_robust_hc2",
    """SELECT k2.item, 'x' AS term, round(b, 6) AS estimate, round(sqrt(meat) / sxx, 6) AS std_error, CAST(n AS BIGINT) AS nobs, round(1 - ssr / syy, 6) AS r2
       FROM k2 JOIN k3 ON k2.item = k3.item""",
    UNITS_CTE,
)
def ols_robust_hc2(spark, d):
    fit = L.ols(_units(spark, d), "y", ["x"], by=["item"], intercept=False, se="hc2")
    return _coefs(fit, "item", cols=("estimate", "std_error", "nobs", "r2"))


@query(
    "ols_interaction",
    f"SELECT item, term, {TERM_SQL} FROM terms JOIN tq USING (df)",
    GRAVITY_CTE
    + """, gl AS (SELECT item, y, x, CASE WHEN grav.year >= 1998 THEN 1.0 ELSE 0.0 END AS late, ln(nullif(g.gdp, 0)) AS lgdp
   FROM grav JOIN gdp g ON g.area = importer AND g.year = grav.year),
 gx AS (SELECT *, x * late AS xl FROM gl WHERE y IS NOT NULL AND x IS NOT NULL AND lgdp IS NOT NULL), """
    + ols_ctes("gx", ["item"], {"x": "x", "late": "late", "lgdp": "lgdp", "x:late": "xl"}, robust=True)
    + ", "
    + t_quantile_ctes("terms"),
)
def ols_interaction(spark, d):
    g = V.lookup(_gravity(spark, d), P.income(spark, d), {"importer": "area", "year": "year"}, ["gdp"]).withColumn("lgdp", S.log_or_null("gdp"))
    g = g.withColumn("late", S.flag(F.col("year") >= 1998))
    fit = L.ols(g, "y", ["x", "late", "lgdp"], by=["item"], interactions=[("x", "late")], se="hc2")
    return _coefs(fit, "item", cols=("estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high", "nobs", "r2"))


MANY = list(ELEMENTS.values())
MANY_CTE = (
    "wide4 AS (SELECT area, CAST(year AS BIGINT) AS year, "
    + ", ".join(f"sum(CASE WHEN element = '{el}' THEN value END) AS {s}" for el, s in ELEMENTS.items())
    + " FROM panel GROUP BY 1, 2), long4 AS (SELECT outcome, wide4.year, v AS y, gdp AS x FROM (UNPIVOT wide4 ON "
    + ", ".join(MANY)
    + " INTO NAME outcome VALUE v) wide4 JOIN gdp ON gdp.area = wide4.area AND gdp.year = wide4.year), "
    + simple_sql("long4", "outcome, year")
)


def _many(spark, d):
    rows = P.country_panel(spark, d).where(F.col("element").isin(list(ELEMENTS)))
    wide = R.pivot_measures(rows, ["area", "year"], "element", "value", ELEMENTS, agg="sum")
    return V.lookup(wide, P.income(spark, d), ["area", "year"], {"gdp": "x"}, how="inner")


MANY_SQL = simple_sql("m", "outcome, year").replace("SELECT outcome, year", "SELECT outcome, CAST(year AS BIGINT) AS year")
for name, digits in (("b, 6) AS estimate", "b, 2) AS estimate"), ("se, 6) AS std_error", "se, 2) AS std_error")):
    MANY_SQL = MANY_SQL.replace(name, digits)


@query("ols_many_outcomes", MANY_SQL, MANY_CTE)
def ols_many_outcomes(spark, d):
    fit = L.ols_many(_many(spark, d), MANY, ["x"], by=["year"])
    cols = fit.select("outcome", "year", "term", "estimate", "std_error", "statistic", "nobs", "r2")
    return rounded(cols, year=-1, estimate=2, std_error=2, statistic=6, r2=6)


@query(
    "coef_table",
    f"""SELECT *, CASE WHEN p_value < 0.01 THEN '***' WHEN p_value < 0.05 THEN '**' WHEN p_value < 0.1 THEN '*' ELSE '' END AS stars
        FROM (SELECT item, term, {TERM_SQL} FROM terms JOIN tq USING (df))""",
    GRAVITY_CTE
    + ", gi AS (SELECT * FROM grav WHERE x IS NOT NULL AND y IS NOT NULL), "
    + simple_sql("gi", "item")
    + """, hc AS (SELECT gi.item, x - mx AS xd, pow(y - my - slope * (x - mx), 2) / (1 - 1.0 / n - pow(x - mx, 2) / sxx) AS e2, n, mx, sxx FROM gi JOIN m ON m.item = gi.item),
 v AS (SELECT item, sum(xd * xd * e2) / pow(max(sxx), 2) AS v1, sum(pow(1.0 / n - mx * xd / sxx, 2) * e2) AS v0 FROM hc GROUP BY 1),
 terms AS (SELECT m.item, '(Intercept)' AS term, my - slope * mx AS b, sqrt(v0) AS se, n, CAST(n - 2 AS DOUBLE) AS df, r2 FROM m JOIN v ON v.item = m.item
   UNION ALL SELECT m.item, 'x', slope, sqrt(v1), n, CAST(n - 2 AS DOUBLE), r2 FROM m JOIN v ON v.item = m.item), """
    + t_quantile_ctes("terms"),
)
def coef_table(spark, d):
    fit = L.ols(_gravity(spark, d), "y", ["x"], by=["item"], se="hc2")
    return _coefs(fit, "item", cols=FULL).withColumn("stars", S.stars("p_value"))


@query(
    "ci_normal",
    """SELECT year, round(slope, 6) AS estimate, round(slope - 1.96 * sqrt(s2 / sxx), 6) AS conf_low, round(slope + 1.96 * sqrt(s2 / sxx), 6) AS conf_high FROM m""",
    GRAVITY_CTE + ", gy AS (SELECT CAST(year AS BIGINT) AS year, x, y FROM grav), " + simple_sql("gy", "year"),
)
def ci_normal(spark, d):
    fit = L.with_normal_interval(L.ols(_gravity(spark, d), "y", ["x"], by=["year"])).where(F.col("term") == "x")
    return rounded(fit.select("year", "estimate", "conf_low", "conf_high"), year=-1, estimate=6, conf_low=6, conf_high=6)


@query(
    "plot_coef_series",
    "SELECT item, year, round(b, 6) AS estimate, round(b - q * se, 6) AS conf_low, round(b + q * se, 6) AS conf_high FROM terms JOIN tq USING (df) WHERE term = 'x'",
    GRAVITY_CTE + ", gy AS (SELECT item, CAST(year AS BIGINT) AS year, x, y FROM grav), " + simple_sql("gy", "item, year") + ", " + terms_cte("item, year"),
)
def plot_coef_series(spark, d):
    fit = L.ols(_gravity(spark, d), "y", ["x"], by=["item", "year"])
    return rounded(PD.coef_series(fit, "x", "year", ["item"]), year=-1, estimate=6, conf_low=6, conf_high=6)


@query(
    "coef_wide",
    "SELECT term, "
    + ", ".join(
        f"max(CASE WHEN item = '{i}' THEN estimate END) AS estimate_{i}, max(CASE WHEN item = '{i}' THEN std_error END) AS std_error_{i}, "
        f"max(CASE WHEN item = '{i}' THEN nobs END) AS nobs_{i}, max(CASE WHEN item = '{i}' THEN r2 END) AS r2_{i}"
        for i in ITEMS
    )
    + f" FROM ({simple_sql('m', 'item')}) GROUP BY 1",
    GRAVITY_CTE + ", " + simple_sql("grav", "item"),
)
def coef_wide(spark, d):
    out = L.coef_wide(L.ols(_gravity(spark, d), "y", ["x"], by=["item"]), "item", list(ITEMS))
    return rounded(out, **{c: 6 for c in out.columns if c != "term" and not c.startswith("nobs")})


IV_CTE = (
    GRAVITY_CTE
    + """, iv AS (SELECT grav.item, grav.y, ln(gi.gdp) AS x, ln(ge.gdp) AS z FROM grav JOIN gdp gi ON gi.area = importer AND gi.year = grav.year
   JOIN gdp ge ON ge.area = importer AND ge.year = grav.year - 1),
 ivm AS (SELECT item, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(z, y) / covar_pop(z, x) AS b, var_pop(z) * count(*) AS szz, covar_pop(z, x) * count(*) AS szx,
   var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy, var_pop(y) * count(*) AS syy FROM iv GROUP BY 1),
 ivs AS (SELECT *, (syy - 2 * b * sxy + b * b * sxx) / (n - 2) AS s2 FROM ivm)"""
)


@query(
    "iv_2sls",
    """SELECT item, 'lgdp' AS term, round(b, 6) AS estimate, round(sqrt(s2 * szz) / abs(szx), 6) AS std_error, CAST(n AS BIGINT) AS nobs, round(1 - s2 * (n - 2) / syy, 6) AS r2 FROM ivs
       UNION ALL SELECT item, '(Intercept)', round(my - b * mx, 6), round(sqrt(s2 / n + mx * mx * s2 * szz / (szx * szx)), 6), CAST(n AS BIGINT), round(1 - s2 * (n - 2) / syy, 6) FROM ivs""",
    IV_CTE,
)
def iv_2sls(spark, d):
    income = P.income(spark, d).withColumn("lgdp", S.log_or_null("gdp"))
    income = V.calendar_lag(income, ["area"], "year", "lgdp", "lag_lgdp")
    g = V.lookup(_gravity(spark, d), income, {"importer": "area", "year": "year"}, ["lgdp", "lag_lgdp"])
    return _coefs(L.iv2sls(g, "y", "lgdp", "lag_lgdp", by=["item"]), "item", cols=("estimate", "std_error", "nobs", "r2"))


# --- decompositions --------------------------------------------------------------------

PARTS_SQL = """
 p1 AS (SELECT {by}, part, count(*) AS n, sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, sum(y * y) AS syy, sum(y * y) - sum(x * y) * sum(x * y) / sum(x * x) AS ssr FROM parts GROUP BY {by}, part),
 p2 AS (SELECT {cols}, parts.part, sum(x * x * (y - b * x) * (y - b * x) / (1 - x * x / sxx)) AS meat FROM parts JOIN p1 ON {on} AND parts.part = p1.part GROUP BY {cols}, parts.part)"""


def _parts(by: list[str]) -> str:
    return PARTS_SQL.format(
        by=", ".join(by), cols=", ".join(f"parts.{c}" for c in by), on=" AND ".join(f"parts.{c} = p1.{c}" for c in by)
    )


@query(
    "variance_decomposition",
    """SELECT p1.item, p1.element, p1.part, round(b, 6) AS estimate, round(sqrt(meat) / sxx, 6) AS std_error, CAST(n AS BIGINT) AS nobs, round(1 - ssr / syy, 6) AS r2
       FROM p1 JOIN p2 ON p1.item = p2.item AND p1.element = p2.element AND p1.part = p2.part""",
    """tot AS (SELECT item, element, reporter, sum(value) AS t, count(*) AS n FROM mirror WHERE year = 1998 AND element LIKE '%Value' GROUP BY 1, 2, 3),
 parts AS (SELECT item, element, 'links' AS part, ln(t) AS x, ln(n) AS y FROM tot WHERE t > 0 UNION ALL SELECT item, element, 'average', ln(t), ln(t / n) FROM tot WHERE t > 0),"""
    + _parts(["item", "element"]),
)
def variance_decomposition(spark, d):
    rows = P.mirrored_flows(spark, d, first_year=1998, last_year=1998).where(F.col("element").endswith("Value"))
    return rounded(L.variance_decomposition(rows, ["item", "element"], "reporter"), estimate=6, std_error=6, r2=6)


@query(
    "price_quantity_decomposition",
    """SELECT p1.item, p1.part, round(b, 6) AS estimate, round(sqrt(meat) / sxx, 6) AS std_error, CAST(n AS BIGINT) AS nobs, round(1 - ssr / syy, 6) AS r2
       FROM p1 JOIN p2 ON p1.item = p2.item AND p1.part = p2.part""",
    """pq AS (SELECT partner, item, sum(CASE WHEN element = 'Import Value' THEN value END) AS v, sum(CASE WHEN element = 'Import Quantity' THEN value END) AS q
   FROM mirror WHERE reporter = 'NATION_5' AND year = 1998 AND element LIKE 'Import%' GROUP BY 1, 2),
 parts AS (SELECT item, 'price' AS part, ln(v) AS x, ln(v / q) AS y FROM pq WHERE q > 0 UNION ALL SELECT item, 'quantity', ln(v), ln(q) FROM pq WHERE q > 0),"""
    + _parts(["item"]),
)
def price_quantity_decomposition(spark, d):
    rows = P.mirrored_flows(spark, d, first_year=1998, last_year=1998).where(F.col("reporter") == "NATION_5")
    prices = R.price_wide(rows, ["partner", "item"], "Import Value", "Import Quantity")
    return rounded(L.price_quantity_decomposition(prices, ["item"]), estimate=6, std_error=6, r2=6)


# --- fixed effects on the complete country panel (closed forms exist) --------------------

WITHIN = """w AS (SELECT *, {y} AS yt, {x} AS xt FROM {src}),
 b0 AS (SELECT {sel}count(*) AS n, sum(xt * yt) / sum(xt * xt) AS b, sum(xt * xt) AS sxx, sum(yt * yt) AS syy, var_pop(y) * count(*) AS tss FROM w {group}),
 sc AS (SELECT w.*, b, xt * (yt - b * xt) AS s FROM w JOIN b0 ON {on})"""


def within_cte(src: str, form: str, by: str = "") -> str:
    """Within-transformed y and x by the closed form of a complete panel, slopes and scores."""
    return WITHIN.format(
        src=src,
        y=form.replace("#", "y"),
        x=form.replace("#", "x"),
        sel=f"{by}, " if by else "",
        group=f"GROUP BY {by}" if by else "",
        on=f"w.{by} = b0.{by}" if by else "true",
    )


def _m(keys: str) -> str:
    return f"avg(#) OVER (PARTITION BY {keys})" if keys else "avg(#) OVER ()"


TWO_WAY = f"# - {_m('area')} - {_m('year')} + {_m('')}"
ONE_ITEM = "one AS (SELECT * FROM areas WHERE item = 'PROMO')"
FIT_SQL = """SELECT 'x' AS term, round(b, 8) AS estimate, CAST(n AS BIGINT) AS nobs, round(1 - (syy - b * b * sxx) / syy, 6) AS within_r2 FROM b0"""
# Clustered by area, which is nested in the area effect: parameters = slope + 1 + (years - 1).
CLUSTER_SQL = """SELECT 'x' AS term, round(max(b), 8) AS estimate,
   round(sqrt((SELECT sum(q * q) FROM (SELECT sum(s) AS q FROM sc GROUP BY area)) * max(g) / (max(g) - 1) * (max(n) - 1.0) / (max(n) - 1 - max(t))) / max(sxx), 8) AS std_error,
   CAST(max(n) AS BIGINT) AS nobs FROM b0, (SELECT count(DISTINCT area) AS g, count(DISTINCT year) AS t FROM one)"""
TWO_CLUSTER_SQL = """SELECT 'x' AS term, round(b, 8) AS estimate, round(sqrt(greatest(
   (SELECT sum(q * q) FROM (SELECT sum(s) AS q FROM sc GROUP BY area)) + (SELECT sum(q * q) FROM (SELECT sum(s) AS q FROM sc GROUP BY year)) - (SELECT sum(s * s) FROM sc), 0)
   * least(g, t) / (least(g, t) - 1.0) * (n - 1.0) / (n - 2)) / sxx, 8) AS std_error, CAST(n AS BIGINT) AS nobs
   FROM b0, (SELECT count(DISTINCT area) AS g, count(DISTINCT year) AS t FROM one)"""


def _one(spark, d):
    return _areas(spark, d).where(F.col("item") == SHOCK_ITEM)


def _fe(df, *keys, cols):
    return rounded(df.select(*keys, "term", *cols), **{c: (8 if c in ("estimate", "std_error") else 6) for c in cols if c != "nobs"})


@query("fe_two_way", FIT_SQL, f"{AREA_CTE}, {ONE_ITEM}, {within_cte('one', TWO_WAY)}")
def fe_two_way(spark, d):
    return _fe(FX.feols(_one(spark, d), "y", ["x"], ["area", "year"]), cols=("estimate", "nobs", "within_r2"))


@query(
    "fe_three_way",
    FIT_SQL,
    f"{AREA_CTE}, {within_cte('areas', f'# - {_m('area')} - {_m('year')} - {_m('item')} + 2 * {_m('')}')}",
)
def fe_three_way(spark, d):
    return _fe(FX.feols(_areas(spark, d), "y", ["x"], ["year", "area", "item"]), cols=("estimate", "nobs", "within_r2"))


BLOCKS = f"# - {_m('area, item')} - {_m('year, item')} + {_m('item')}"


@query("fe_interacted", FIT_SQL, f"{AREA_CTE}, {within_cte('areas', BLOCKS)}")
def fe_interacted(spark, d):
    return _fe(FX.feols(_areas(spark, d), "y", ["x"], [("area", "item"), ("year", "item")], cluster=["area"]), cols=("estimate", "nobs", "within_r2"))


@query("fe_by_item", FIT_SQL.replace("SELECT ", "SELECT item, ", 1), f"{AREA_CTE}, {within_cte('areas', BLOCKS, 'item')}")
def fe_by_item(spark, d):
    return _fe(FX.feols(_areas(spark, d), "y", ["x"], ["area", "year"], by=["item"]), "item", cols=("estimate", "nobs", "within_r2"))


@query("fe_cluster_se", CLUSTER_SQL, f"{AREA_CTE}, {ONE_ITEM}, {within_cte('one', TWO_WAY)}")
def fe_cluster_se(spark, d):
    return _fe(FX.feols(_one(spark, d), "y", ["x"], ["area", "year"]), cols=("estimate", "std_error", "nobs"))


@query("fe_twoway_cluster_se", TWO_CLUSTER_SQL, f"{AREA_CTE}, {ONE_ITEM}, {within_cte('one', TWO_WAY)}")
def fe_twoway_cluster_se(spark, d):
    return _fe(FX.feols(_one(spark, d), "y", ["x"], ["area", "year"], cluster=["area", "year"]), cols=("estimate", "std_error", "nobs"))


@query(
    "fe_fit_stats",
    """SELECT item, CAST(n AS BIGINT) AS nobs, round(1 - (syy - b * b * sxx) / tss, 6) AS r2, round(1 - (syy - b * b * sxx) / syy, 6) AS within_r2 FROM b0""",
    f"{AREA_CTE}, {within_cte('areas', BLOCKS, 'item')}",
)
def fe_fit_stats(spark, d):
    fit = FX.feols(_areas(spark, d), "y", ["x"], ["area", "year"], by=["item"])
    return rounded(fit.select("item", "nobs", "r2", "within_r2"), r2=6, within_r2=6)


@query(
    "fe_recover",
    """SELECT 'area' AS fe, area AS level, round(avg(u) - (SELECT avg(u) FROM eff) + (SELECT avg(u) FROM eff WHERE year = 1995), 4) AS effect FROM eff GROUP BY 2
       UNION ALL SELECT 'year', CAST(year AS VARCHAR), round(avg(u) - (SELECT avg(u) FROM eff WHERE year = 1995), 4) FROM eff GROUP BY 2""",
    f"{AREA_CTE}, {ONE_ITEM}, {within_cte('one', TWO_WAY)}, eff AS (SELECT area, year, y - b * x AS u FROM sc)",
)
def fe_recover(spark, d):
    return rounded(FX.fixef(_one(spark, d), "y", ["x"], ["area", "year"]), effect=4)


# --- gravity and input-output panels ------------------------------------------------------


FE_RULES = "count(*) AS n, sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, sum(y * y) AS syy, var_pop(raw) * count(*) AS tss"


@query(
    "join_fixed_effects",
    """SELECT area, round(ln(nullif(gdp, 0)), 6) AS lgdp, round(exp_fe.effect, 6) AS exporter_fe, round(imp_fe.effect, 6) AS importer_fe
       FROM (SELECT area, gdp FROM gdp WHERE year = 1997) g LEFT JOIN exp_fe ON exp_fe.exporter = g.area LEFT JOIN imp_fe ON imp_fe.importer = g.area""",
    GRAVITY_CTE
    + ", g98 AS (SELECT exporter, importer, x, y, x AS rx, y AS ry FROM grav WHERE year = 1998 AND item = 'PROMO' AND x IS NOT NULL AND y IS NOT NULL), "
    + within_rounds("g98", ["exporter", "importer"], ["x", "y"], ["exporter", "importer", "rx", "ry"], rounds=40)
    # what the effects explain is their sum; the first importer is the reference
    + """, fit AS (SELECT exporter, importer, ry - b * rx - (y - b * x) AS f FROM within, (SELECT sum(x * y) / sum(x * x) AS b FROM within)),
 base AS (SELECT exporter, f AS f0 FROM fit WHERE importer = (SELECT min(importer) FROM fit)),
 imp_fe AS (SELECT importer, avg(f - f0) AS effect FROM fit JOIN base USING (exporter) GROUP BY 1),
 exp_fe AS (SELECT exporter, avg(f - effect) AS effect FROM fit JOIN imp_fe USING (importer) GROUP BY 1)""",
)
def join_fixed_effects(spark, d):
    g = _gravity(spark, d, first_year=1998, last_year=1998, items=[SHOCK_ITEM])
    effects = FX.fixef(g, "y", ["x"], ["exporter", "importer"])
    income = P.income(spark, d, first_year=1997, last_year=1997).withColumn("lgdp", S.log_or_null("gdp")).select("area", "lgdp")
    out = V.lookup(income, effects.where(F.col("fe") == "exporter"), {"area": "level"}, {"effect": "exporter_fe"})
    out = V.lookup(out, effects.where(F.col("fe") == "importer"), {"area": "level"}, {"effect": "importer_fe"})
    return rounded(out, lgdp=6, exporter_fe=6, importer_fe=6)


@query(
    "gravity_panel",
    """SELECT item, 'x' AS term, round(b, 8) AS estimate,
         round(sqrt(greatest(qe + qi - qp, 0) * least(ge, gi) / (least(ge, gi) - 1.0) * (n - 1.0) / (n - 2)) / sxx, 8) AS std_error,
         CAST(n AS BIGINT) AS nobs, round(1 - (syy - b * b * sxx) / tss, 6) AS r2, round(1 - (syy - b * b * sxx) / syy, 6) AS within_r2
       FROM fit JOIN (SELECT item, sum(s * s) AS qe, count(*) AS ge FROM (SELECT item, exporter, sum(s) AS s FROM sc GROUP BY 1, 2) GROUP BY 1) USING (item)
       JOIN (SELECT item, sum(s * s) AS qi, count(*) AS gi FROM (SELECT item, importer, sum(s) AS s FROM sc GROUP BY 1, 2) GROUP BY 1) USING (item)
       JOIN (SELECT item, sum(s * s) AS qp FROM (SELECT item, exporter, importer, sum(s) AS s FROM sc GROUP BY 1, 2, 3) GROUP BY 1) USING (item)""",
    GRAVITY_CTE
    + ", gp AS (SELECT exporter, importer, item, year, x, y, y AS raw FROM grav WHERE year >= 1996 AND x IS NOT NULL AND y IS NOT NULL), "
    + within_rounds("gp", ["item, exporter, year", "item, importer, year"], ["x", "y"], ["exporter", "importer", "item", "year", "raw"], rounds=40)
    + f", fit AS (SELECT item, {FE_RULES} FROM within GROUP BY 1), sc AS (SELECT item, exporter, importer, x * (y - b * x) AS s FROM within JOIN fit USING (item))",
)
def gravity_panel(spark, d):
    g = _gravity(spark, d, first_year=1996)
    fit = FX.feols(g, "y", ["x"], [("exporter", "year"), ("importer", "year")], by=["item"], cluster=["exporter", "importer"])
    return _fe(fit, "item", cols=("estimate", "std_error", "nobs", "r2", "within_r2"))


@query(
    "gravity_by_year",
    """SELECT item, year, term, round(b, 8) AS estimate, round(se, 8) AS std_error, round(b - 1.96 * se, 6) AS conf_low, round(b + 1.96 * se, 6) AS conf_high, nobs FROM (
         SELECT item, CAST(year AS BIGINT) AS year, 'x' AS term, b, CAST(n AS BIGINT) AS nobs,
           sqrt(qe * ge / (ge - 1.0) * (n - 1.0) / (n - 1 - gi)) / sxx AS se
         FROM fit JOIN (SELECT item, year, sum(s * s) AS qe, count(*) AS ge FROM (SELECT item, year, exporter, sum(s) AS s FROM sc GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (item, year)
         JOIN (SELECT item, year, count(DISTINCT importer) AS gi FROM within GROUP BY 1, 2) USING (item, year))""",
    GRAVITY_CTE
    + ", gp AS (SELECT exporter, importer, item, year, x, y, y AS raw FROM grav WHERE x IS NOT NULL AND y IS NOT NULL), "
    + within_rounds("gp", ["item, year, exporter", "item, year, importer"], ["x", "y"], ["exporter", "importer", "item", "year", "raw"], rounds=40)
    + f", fit AS (SELECT item, year, {FE_RULES} FROM within GROUP BY 1, 2), sc AS (SELECT item, year, exporter, importer, x * (y - b * x) AS s FROM within JOIN fit USING (item, year))",
)
def gravity_by_year(spark, d):
    fit = L.with_normal_interval(FX.feols(_gravity(spark, d), "y", ["x"], ["exporter", "importer"], by=["item", "year"]))
    return rounded(_fe(fit, "item", "year", cols=("estimate", "std_error", "conf_low", "conf_high", "nobs")), year=-1)


IO_XS = ["promo_domestic", "promo_imp", "economy_domestic", "standard_imp", "economy_imp", "lag1_gdp"]
IO_CTE = (
    "io0 AS (SELECT area, year, "
    + ", ".join(f"coalesce(max(CASE WHEN item = '{it}' AND element = '{el}' THEN coalesce(value, 0) END), 0) AS {n}" for n, (it, el) in CATEGORY_RULES.items())
    + " FROM panel WHERE "
    + " OR ".join(f"(item = '{it}' AND element = '{el}')" for it, el in CATEGORY_RULES.values())
    + """ GROUP BY 1, 2),
 io1 AS (SELECT io0.*, promo_prod - promo_exp AS promo_domestic, economy_prod - economy_exp - standard_exp AS economy_domestic,
   lag(gdp) OVER (PARTITION BY io0.area ORDER BY io0.year) AS lag1_gdp FROM io0 LEFT JOIN gdp ON gdp.area = io0.area AND gdp.year = io0.year),
 io2 AS (SELECT io1.*, lower(item) AS good, coalesce(value, 0) AS y FROM io1 JOIN panel ON panel.area = io1.area AND panel.year = io1.year
   WHERE item IN ('LARGE', 'MEDIUM', 'SMALL') AND element = 'Production' AND lag1_gdp IS NOT NULL), """
    + within_rounds("io2", ["good, area", "good, year"], ["y", *IO_XS], ["good", "area", "year"], rounds=20)
    + ", "
    + ols_ctes("within", ["good"], {x: x for x in IO_XS}, intercept=False, cluster="area", params="6 + count(DISTINCT year)")
)


@query(
    "io_panel",
    """SELECT good, term, round(b, 8) AS estimate, round(se, 8) AS std_error, CAST(n AS BIGINT) AS nobs, round(r2, 6) AS within_r2 FROM terms""",
    IO_CTE,
)
def io_panel(spark, d):
    panel = P.country_panel(spark, d, P.staged_cells(spark, d))
    inputs = R.pivot_rules(panel, ["area", "year"], category_rules(), F.coalesce("value", F.lit(0.0))).fillna(0.0)
    inputs = inputs.withColumns(
        {
            "promo_domestic": F.col("promo_prod") - F.col("promo_exp"),
            "economy_domestic": F.col("economy_prod") - F.col("economy_exp") - F.col("standard_exp"),
        }
    )
    final = {name: (F.col("item") == it) & (F.col("element") == "Production") for name, it in (("large", "LARGE"), ("medium", "MEDIUM"), ("small", "SMALL"))}
    goods = R.pivot_rules(panel, ["area", "year"], final, F.coalesce("value", F.lit(0.0)))
    rows = V.lookup(inputs, goods, ["area", "year"], list(final))
    rows = V.lookup(rows, P.income(spark, d), ["area", "year"], ["gdp"])
    rows = V.lagged(rows, ["area"], "year", {"lag1_gdp": ("gdp", 1)})
    long = rows.unpivot(["area", "year", *IO_XS], list(final), "good", "output")
    fit = FX.feols(long, "output", IO_XS, ["area", "year"], by=["good"])
    return _fe(fit, "good", cols=("estimate", "std_error", "nobs", "within_r2"))
