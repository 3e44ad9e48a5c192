"""Shift-share, difference-in-differences and synthetic control queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.functions import scalars as S
from paneloom.operators import did as DID
from paneloom.operators import shiftshare as SS
from paneloom.operators import synth as G
from paneloom.operators import verbs as V
from paneloom.plans.common import ELEMENTS, ITEMS, LEADER, SHOCK_ITEM, SHOCK_YEAR, T0
from paneloom.plans.descriptive import PREPOST_CTE, prepost
from paneloom.plans.registry import ols_ctes, query, rounded, t_quantile_ctes
from paneloom.sources import panels as P


def _values(spark, d, element="Export Value", cells=None, **limits):
    return P.flows(spark, d, cells, elements=[element], **limits).select("exporter", "importer", "year", "item", "value")


# --- shift-share ------------------------------------------------------------------

SHARE_CTE = """share AS (SELECT exporter, importer, item, value / nullif(sum(value) OVER (PARTITION BY exporter, item), 0) AS share
   FROM flows WHERE element = 'Export Value' AND year = 1997),
 shift AS (SELECT importer, item, d AS shift FROM (SELECT importer, item, year, value - lag(value) OVER (PARTITION BY importer, item ORDER BY year) AS d
   FROM flows WHERE exporter = 'NATION_3' AND element = 'Export Value') WHERE year = 1999),
 expo AS (SELECT exporter, item, -coalesce(sum(share * shift), 0) AS exposure FROM share LEFT JOIN shift USING (importer, item) GROUP BY 1, 2)"""


@query("exposure_share", "SELECT exporter, importer, item, round(share, 8) AS share FROM share", SHARE_CTE)
def exposure_share(spark, d):
    return rounded(SS.exposure_share(_values(spark, d, first_year=T0, last_year=T0), T0), share=8)


@query("exposure_shift", "SELECT importer, item, round(shift, 4) AS shift FROM shift", SHARE_CTE)
def exposure_shift(spark, d):
    return rounded(SS.exposure_shift(_values(spark, d, last_year=T0 + 2), LEADER, T0), shift=4)


@query("exposure_index", "SELECT exporter, item, round(exposure, 4) AS exposure FROM expo", SHARE_CTE)
def exposure_index(spark, d):
    cells = P.staged_cells(spark, d, last_year=T0 + 2)
    return rounded(SS.exposure(_values(spark, d, cells=cells), LEADER, T0), exposure=4)


@query(
    "exposure_wide",
    "SELECT n_name AS exporter, "
    + ", ".join(f"round(max(CASE WHEN item = '{i}' THEN exposure END), 4) AS {s}" for i, s in ITEMS.items())
    + " FROM nation LEFT JOIN expo ON n_name = exporter GROUP BY 1",
    SHARE_CTE,
)
def exposure_wide(spark, d):
    units = P.area_codes(spark, d).select(F.col("area").alias("exporter"))
    cells = P.staged_cells(spark, d, items=list(ITEMS), last_year=T0 + 2)
    return rounded(SS.exposure_wide(_values(spark, d, cells=cells), units, LEADER, T0, ITEMS), **{s: 4 for s in ITEMS.values()})


@query(
    "exposure_alt",
    """SELECT importer, round(coalesce(mine / nullif(total, 0), 0) * (SELECT sum(value) FROM ev WHERE exporter = 'NATION_3' AND year = 1998), 4) AS exposure_1998,
              round(coalesce(mine / nullif(total, 0), 0) * (SELECT sum(value) FROM ev WHERE exporter = 'NATION_3' AND year = 1999), 4) AS exposure_1999
       FROM (SELECT importer, sum(CASE WHEN exporter = 'NATION_3' AND year = 1997 THEN value END) AS mine, sum(CASE WHEN year = 1997 THEN value END) AS total FROM ev GROUP BY 1)""",
    "ev AS (SELECT * FROM flows WHERE element = 'Export Value' AND item = 'PROMO')",
)
def exposure_alt(spark, d):
    rows = _values(spark, d, items=[SHOCK_ITEM])
    return rounded(SS.exposure_alt(rows, LEADER, T0, [1998, 1999]), exposure_1998=4, exposure_1999=4)


OUTCOMES = [f"{el}_{it}" for it in ITEMS.values() for el in ELEMENTS.values()]
OUT_CTE = """tot AS (SELECT reporter, year, element, item, sum(value) AS t FROM mirror GROUP BY 1, 2, 3, 4),
 bd AS (SELECT *, t - max(CASE WHEN year = 1997 THEN t END) OVER (PARTITION BY reporter, element, item) AS d FROM tot)"""


def _outcomes(spark, d, cells):
    name = F.concat_ws("_", S.label("element", ELEMENTS), S.label("item", ITEMS))
    m = P.mirrored_flows(spark, d, cells).where(F.col("item").isin(list(ITEMS)))
    return SS.outcome_base_diff(m, "reporter", T0, OUTCOMES, name)


@query(
    "outcome_base_diff",
    "SELECT reporter, CAST(year AS BIGINT) AS year, "
    + ", ".join(
        f"round(max(CASE WHEN element = '{el}' AND item = '{it}' THEN d END), 4) AS {es}_{its}" for it, its in ITEMS.items() for el, es in ELEMENTS.items()
    )
    + " FROM bd WHERE item IN ('PROMO', 'ECONOMY', 'STANDARD') GROUP BY 1, 2",
    OUT_CTE,
)
def outcome_base_diff(spark, d):
    return rounded(_outcomes(spark, d, P.staged_cells(spark, d, items=list(ITEMS))), year=-1, **{c: 4 for c in OUTCOMES})


EVENT_CTE = (
    f"{SHARE_CTE}, {OUT_CTE}, ex AS (SELECT n_name AS reporter, "
    + ", ".join(f"coalesce(max(CASE WHEN item = '{i}' THEN exposure END), 0) AS ss_{s}" for i, s in ITEMS.items())
    + " FROM nation LEFT JOIN expo ON n_name = exporter GROUP BY 1), ev AS (SELECT CASE element "
    + " ".join(f"WHEN '{el}' THEN '{s}'" for el, s in ELEMENTS.items())
    + " END || '_' || CASE item "
    + " ".join(f"WHEN '{i}' THEN '{s}'" for i, s in ITEMS.items())
    + " END AS outcome, CAST(year AS BIGINT) AS year, d AS y, "
    + ", ".join(f"ss_{s}" for s in ITEMS.values())
    + f" FROM bd JOIN ex USING (reporter) WHERE reporter <> '{LEADER}' AND d IS NOT NULL AND item IN {tuple(ITEMS)}), "
    + ols_ctes("ev", ["outcome", "year"], {f"ss_{s}": f"ss_{s}" for s in ITEMS.values()})
    + ", "
    + t_quantile_ctes("terms")
)


@query(
    "event_regression",
    """SELECT outcome, year, term, round(b, 4) AS estimate, round(se, 4) AS std_error, round(b - q * se, 4) AS conf_low, round(b + q * se, 4) AS conf_high,
              CAST(n AS BIGINT) AS nobs, round(r2, 4) AS r2 FROM terms JOIN tq USING (df)""",
    EVENT_CTE,
)
def event_regression(spark, d):
    units = P.area_codes(spark, d).select(F.col("area").alias("exporter"))
    cells = P.staged_cells(spark, d, items=list(ITEMS))
    expo = SS.exposure_wide(_values(spark, d, cells=cells), units, LEADER, T0, ITEMS).withColumnsRenamed({s: f"ss_{s}" for s in ITEMS.values()})
    xs = [f"ss_{s}" for s in ITEMS.values()]
    panel = V.lookup(_outcomes(spark, d, cells), expo, {"reporter": "exporter"}, xs).fillna(0.0, xs)
    fit = SS.event_regression(panel, OUTCOMES, xs, "reporter", LEADER)
    cols = ("estimate", "std_error", "conf_low", "conf_high", "nobs", "r2")
    return rounded(fit.select("outcome", "year", "term", *cols), year=-1, **{c: 4 for c in cols if c != "nobs"})


MEASURES = {"Production": "prod", "Import Quantity": "imp_quant", "Export Quantity": "exp_quant", "Import Value": "imp_val", "Export Value": "exp_val"}


@query(
    "first_order_panel",
    """SELECT o.area, round(coalesce(prod_d, 0), 4) AS prod_diff, round(coalesce(iq_d, 0), 4) AS imp_quant_diff, round(coalesce(eq_d, 0), 4) AS exp_quant_diff,
              round(coalesce(iv_d, 0), 4) AS imp_val_diff, round(coalesce(ev_d, 0), 4) AS exp_val_diff, round(coalesce(l.d, 0), 4) AS export_diff, round(coalesce(s.share, 0), 8) AS share
       FROM (SELECT area, year, prod - lag(prod) OVER w AS prod_d, iq - lag(iq) OVER w AS iq_d, eq - lag(eq) OVER w AS eq_d, iv - lag(iv) OVER w AS iv_d, ev - lag(ev) OVER w AS ev_d
             FROM pw WINDOW w AS (PARTITION BY area ORDER BY year)) o
       LEFT JOIN (SELECT importer, year, value - lag(value) OVER (PARTITION BY importer ORDER BY year) AS d FROM lead) l ON l.importer = o.area AND l.year = 1998
       LEFT JOIN (SELECT importer, value / nullif(sum(value) OVER (), 0) AS share FROM lead WHERE year = 1997) s ON s.importer = o.area
       WHERE o.year = 1998""",
    """lead AS (SELECT importer, year, value FROM flows WHERE exporter = 'NATION_3' AND item = 'PROMO' AND element = 'Export Quantity'),
 pw AS (SELECT area, year, max(CASE WHEN element = 'Production' THEN value END) AS prod, max(CASE WHEN element = 'Import Quantity' THEN value END) AS iq,
   max(CASE WHEN element = 'Export Quantity' THEN value END) AS eq, max(CASE WHEN element = 'Import Value' THEN value END) AS iv,
   max(CASE WHEN element = 'Export Value' THEN value END) AS ev FROM panel WHERE item = 'PROMO' GROUP BY 1, 2)""",
)
def first_order_panel(spark, d):
    cells = P.staged_cells(spark, d, items=[SHOCK_ITEM], last_year=SHOCK_YEAR)
    out = SS.first_order_panel(_values(spark, d, "Export Quantity", cells), P.country_panel(spark, d, cells), LEADER, SHOCK_ITEM, 1998, T0, MEASURES)
    return rounded(out, export_diff=4, share=8, **{f"{c}_diff": 4 for c in MEASURES.values()})


# --- treatment and difference-in-differences ------------------------------------------

TREAT_CTE = """treat AS (SELECT importer, coalesce(max(CASE WHEN exporter = 'NATION_3' AND year = 1997 AND item = 'PROMO' THEN CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END END), 0.0) AS treated
   FROM flows WHERE element = 'Export Quantity' GROUP BY 1)"""


@query("treatment_assign", "SELECT importer, CAST(treated AS DOUBLE) AS treated FROM treat", TREAT_CTE)
def treatment_assign(spark, d):
    return DID.treatment_assign(_values(spark, d, "Export Quantity"), LEADER, SHOCK_ITEM, SHOCK_YEAR)


@query(
    "treatment_panel",
    """SELECT area, CAST(year AS BIGINT) AS year, round(y, 4) AS y, round(lag_x, 5) AS lag_x, CAST(CASE WHEN year < 1998 THEN 0.0 ELSE coalesce(treated, 0.0) END AS DOUBLE) AS d FROM
       (SELECT *, count(CASE WHEN year < 1998 THEN y END) OVER (PARTITION BY area) AS pre FROM
          (SELECT p.area, p.year, p.value AS y, lag(gdp) OVER (PARTITION BY p.area ORDER BY p.year) AS lag_x FROM panel p
           LEFT JOIN gdp g ON g.area = p.area AND g.year = p.year WHERE item = 'PROMO' AND element = 'Production') WHERE lag_x IS NOT NULL AND y IS NOT NULL)
       LEFT JOIN treat ON importer = area WHERE pre >= 2 AND area <> 'NATION_3'""",
    TREAT_CTE,
)
def treatment_panel(spark, d):
    cells = P.staged_cells(spark, d, items=[SHOCK_ITEM])
    rows = P.country_panel(spark, d, cells, elements=["Production"])
    treated = DID.treatment_assign(_values(spark, d, "Export Quantity", cells), LEADER, SHOCK_ITEM, SHOCK_YEAR)
    covariate = P.income(spark, d).withColumnRenamed("gdp", "x")
    out = DID.treatment_panel(rows, treated, LEADER, SHOCK_YEAR, min_pre=2, covariate=covariate)
    return rounded(out, year=-1, y=4, lag_x=5)


# Stronger treatment for the estimators: more than the leader's mean flow, so that controls remain.
STRONG_CTE = """strong AS (SELECT n_name AS area, CASE WHEN value > (SELECT avg(value) FROM l) THEN 1.0 ELSE 0.0 END AS treat FROM nation LEFT JOIN l ON importer = n_name)"""
L_CTE = "l AS (SELECT importer, value FROM flows WHERE exporter = 'NATION_3' AND year = 1997 AND item = 'PROMO' AND element = 'Export Quantity')"


def _strong(spark, d, cells):
    flows = _values(spark, d, "Export Quantity", cells)
    mine = flows.where((F.col("exporter") == LEADER) & (F.col("year") == T0) & (F.col("item") == SHOCK_ITEM))
    return DID.treatment_assign(flows, LEADER, SHOCK_ITEM, SHOCK_YEAR, above=mine.agg(F.avg("value")).scalar())


def _prepost(spark, d):
    cells = P.staged_cells(spark, d, items=[SHOCK_ITEM], first_year=T0, last_year=SHOCK_YEAR)
    return V.lookup(prepost(spark, d, cells), _strong(spark, d, cells), {"area": "importer"}, ["treated"])


DID_CTE = f"{PREPOST_CTE}, {L_CTE}, {STRONG_CTE}, pp AS (SELECT p.area, value_1997 AS y0, value_1998 AS y1, treat FROM prepost p JOIN strong s ON s.area = p.area)"


@query(
    "did_2x2",
    """SELECT term, round(estimate, 4) AS estimate, round(std_error, 4) AS std_error, CAST((SELECT 2 * count(*) FROM pp) AS BIGINT) AS nobs FROM (
         SELECT '(Intercept)' AS term, m00 AS estimate, sqrt(v00) AS std_error FROM c
         UNION ALL SELECT 'treated', m10 - m00, sqrt(v10 + v00) FROM c
         UNION ALL SELECT 'post', m01 - m00, sqrt(v01 + v00) FROM c
         UNION ALL SELECT 'treated:post', m11 - m10 - m01 + m00, sqrt(v11 + v10 + v01 + v00) FROM c)""",
    DID_CTE
    + """, c AS (SELECT avg(y0) FILTER (treat = 0) AS m00, avg(y0) FILTER (treat = 1) AS m10, avg(y1) FILTER (treat = 0) AS m01, avg(y1) FILTER (treat = 1) AS m11,
  var_samp(y0) FILTER (treat = 0) / count(*) FILTER (treat = 0) AS v00, var_samp(y0) FILTER (treat = 1) / count(*) FILTER (treat = 1) AS v10,
  var_samp(y1) FILTER (treat = 0) / count(*) FILTER (treat = 0) AS v01, var_samp(y1) FILTER (treat = 1) / count(*) FILTER (treat = 1) AS v11 FROM pp)""",
)
def did_2x2(spark, d):
    from paneloom.operators.reshape import unpivot_prepost

    rows = unpivot_prepost(_prepost(spark, d), ["area", "treated"], "value_1997", "value_1998")
    return rounded(DID.did2x2(rows, "value", "treated", "post").select("term", "estimate", "std_error", "nobs"), estimate=4, std_error=4)


@query(
    "drdid_nocov",
    """SELECT round(m1 - m0, 4) AS att, round(sqrt(n * n * (v1 / n1 + v0 / n0) / ((n - 1) * n)), 4) AS std_error, CAST(n AS BIGINT) AS nobs FROM (
         SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (treat = 1) AS n1, count(*) FILTER (treat = 0) AS n0, avg(y1 - y0) FILTER (treat = 1) AS m1, avg(y1 - y0) FILTER (treat = 0) AS m0,
                var_pop(y1 - y0) FILTER (treat = 1) AS v1, var_pop(y1 - y0) FILTER (treat = 0) AS v0 FROM pp)""",
    DID_CTE,
)
def drdid_nocov(spark, d):
    return rounded(DID.drdid_nocov(_prepost(spark, d), "value_1997", "value_1998", "treated"), att=4, std_error=4)


def _income_at(spark, d, year, name="gdp"):
    return P.income(spark, d, first_year=year, last_year=year).select("area", F.col("gdp").alias(name))


def drdid_ctes(method: str, steps: int = 25) -> str:
    """CTEs up to ``effect`` (att, se, n) over ``dr`` (dy, d, x): Newton steps for the propensity, then influence values."""
    trad = method == "trad"
    rest, weight = ("p - d", "p * (1 - p)") if trad else ("w - d", "w")
    inner = "1 / (1 + exp(-(a + b * z))) AS p" if trad else "(1 - d) * exp(a + b * z) AS w"
    out = ["dz AS MATERIALIZED (SELECT dy, d, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS z FROM dr)"]
    out.append("nt0 AS (SELECT ln(avg(d) / (1 - avg(d))) AS a, CAST(0 AS DOUBLE) AS b FROM dz)")
    sums = f"sum({weight}) AS h1, sum({weight} * z) AS h2, sum({weight} * z * z) AS h3, sum({rest}) AS g1, sum(({rest}) * z) AS g2"
    for k in range(steps):
        rows = f"SELECT a, b, {sums} FROM (SELECT d, z, a, b, {inner} FROM dz, nt{k}) GROUP BY a, b"
        out.append(f"nt{k + 1} AS MATERIALIZED (SELECT a - (h3 * g1 - h2 * g2) / (h1 * h3 - h2 * h2) AS a, b - (h1 * g2 - h2 * g1) / (h1 * h3 - h2 * h2) AS b FROM ({rows}))")
    out.append(f"dw AS MATERIALIZED (SELECT dz.*, (1 - d) * exp(a + b * z) AS w0, 1 / (1 + exp(-(a + b * z))) AS p FROM dz, nt{steps})")
    ow = "(1 - d)" if trad else "w0"
    out.append(f"""co AS (SELECT (s3 * t1 - s2 * t2) / (s1 * s3 - s2 * s2) AS b0, (s1 * t2 - s2 * t1) / (s1 * s3 - s2 * s2) AS b1, s1, s2, s3, s1 * s3 - s2 * s2 AS det FROM
   (SELECT sum({ow}) AS s1, sum({ow} * z) AS s2, sum({ow} * z * z) AS s3, sum({ow} * dy) AS t1, sum({ow} * z * dy) AS t2 FROM dw))""")
    out.append("dl AS MATERIALIZED (SELECT dw.*, dy - b0 - b1 * z AS u FROM dw, co)")
    out.append("eta AS (SELECT sum(d * u) / sum(d) AS e1, sum(w0 * u) / sum(w0) AS e0, avg(d) AS m1, avg(w0) AS m0, count(*) AS n FROM dl)")
    one, none = "d * (u - e1)", "w0 * (u - e0)"
    more = ""
    if trad:
        # both nuisance models add what their scores lend
        lent = lambda f, g: f"(1 - d) * u * n * ((s3 * {f} - s2 * {g}) + (s1 * {g} - s2 * {f}) * z) / det"
        out.append("""lend AS (SELECT avg(d) AS c1, avg(d * z) AS c2, avg(w0 * (u - e0)) AS q1, avg(w0 * (u - e0) * z) AS q2, avg(w0) AS k1, avg(w0 * z) AS k2,
   sum(p * (1 - p)) AS h1, sum(p * (1 - p) * z) AS h2, sum(p * (1 - p) * z * z) AS h3 FROM dl, eta)""")
        one = f"{one} - {lent('c1', 'c2')}"
        none = f"{none} + (d - p) * n * ((h3 * q1 - h2 * q2) + (h1 * q2 - h2 * q1) * z) / (h1 * h3 - h2 * h2) - {lent('k1', 'k2')}"
        more = ", co, lend"
    out.append(f"inf AS (SELECT ({one}) / m1 - ({none}) / m0 AS i, e1 - e0 AS att, n FROM dl, eta{more})")
    out.append("effect AS (SELECT any_value(att) AS att, stddev_samp(i) / sqrt(any_value(n)) AS se, any_value(n) AS n FROM inf)")
    return ", ".join(out)


EFFECT_SQL = """SELECT round(att, 4) AS att, round(se, 4) AS std_error, round(att - 1.96 * se, 4) AS conf_low, round(att + 1.96 * se, 4) AS conf_high,
   CAST(n AS BIGINT) AS nobs FROM effect"""
DR_CTE = (
    DID_CTE
    + ", dr AS (SELECT y1 - y0 AS dy, CAST(treat AS DOUBLE) AS d, gdp AS x FROM pp JOIN gdp ON gdp.area = pp.area AND gdp.year = 1997 WHERE y1 - y0 IS NOT NULL AND treat IS NOT NULL AND gdp IS NOT NULL), "
)


@query("drdid_panel", EFFECT_SQL, DR_CTE + drdid_ctes("trad"))
def drdid_panel(spark, d):
    rows = V.lookup(_prepost(spark, d), _income_at(spark, d, T0), ["area"], ["gdp"])
    return rounded(DID.drdid(rows, "value_1997", "value_1998", "treated", ["gdp"]), att=4, std_error=4, conf_low=4, conf_high=4)


@query("drdid_formula", EFFECT_SQL, DR_CTE + drdid_ctes("imp"))
def drdid_formula(spark, d):
    cells = P.staged_cells(spark, d, items=[SHOCK_ITEM], first_year=T0, last_year=SHOCK_YEAR)
    rows = P.country_panel(spark, d, cells, elements=["Import Value"])
    rows = V.lookup(rows, _strong(spark, d, cells), {"area": "importer"}, ["treated"])
    rows = V.lookup(rows, P.income(spark, d, first_year=T0, last_year=SHOCK_YEAR), ["area", "year"], ["gdp"])
    out = DID.drdid_long(rows, "area", "year", "value", "treated", T0, SHOCK_YEAR, ["gdp"])
    return rounded(out, att=4, std_error=4, conf_low=4, conf_high=4)


# --- synthetic control ------------------------------------------------------------------


def _synth_panel(spark, d, covariate=False, element="Production"):
    cells = P.staged_cells(spark, d, items=[SHOCK_ITEM])
    rows = P.country_panel(spark, d, cells, elements=[element])
    cov = P.income(spark, d).withColumnRenamed("gdp", "x") if covariate else None
    return DID.treatment_panel(rows, _strong(spark, d, cells), LEADER, SHOCK_YEAR, min_pre=2, covariate=cov)


def _gsc(spark, d, **options):
    return G.gsc(_synth_panel(spark, d), "area", "year", "y", "d", **{"r": (0, 5), **options})


def _factor_ctes(source: str) -> str:
    """SQL of models with no and with one factor, per group ``g`` and kind of effects ``force``.

    ``source`` has g, force, area, year, y, treat; controls are complete. The
    leading eigenvector comes from repeated squaring of the moment matrix.
    ``picked`` holds the counterfactual under the rank with the lower left-out
    error; larger ranks need more pre-periods than these tables have.
    """
    squares = ", ".join(
        f"""sq{i + 1} AS (SELECT g, force, years, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b) / big)) AS m FROM (
    SELECT *, list_max(list_transform(m, lambda a: list_dot_product(a, a))) AS big FROM sq{i}))"""
        for i in range(14)
    )
    k = "PARTITION BY g, force"
    return f"""src AS ({source}),
 xi AS (SELECT g, force, year, CASE WHEN force = 'two-way' THEN avg(y) ELSE 0 END AS xi FROM src WHERE treat = 0 GROUP BY 1, 2, 3),
 c1 AS (SELECT src.g, src.force, area, src.year, y - xi AS y FROM src JOIN xi ON xi.g = src.g AND xi.force = src.force AND xi.year = src.year WHERE treat = 0),
 cc AS (SELECT g, force, area, year, y - CASE WHEN force = 'none' THEN 0 ELSE avg(y) OVER ({k}, area) END AS c FROM c1),
 pr AS (SELECT a.g, a.force, a.year AS t, b.year AS s, sum(a.c * b.c) AS v FROM cc a JOIN cc b ON a.g = b.g AND a.force = b.force AND a.area = b.area GROUP BY 1, 2, 3, 4),
 ro AS (SELECT g, force, t, list(v ORDER BY s) AS r FROM pr GROUP BY 1, 2, 3),
 sq0 AS (SELECT g, force, list(t ORDER BY t) AS years, list(r ORDER BY t) AS m FROM ro GROUP BY 1, 2),
 {squares},
 ff AS (SELECT g, force, unnest(years) AS year, unnest(v) * sqrt(len(years)) / sqrt(list_dot_product(v, v)) AS f FROM (
    SELECT g, force, years, list_extract(m, list_position(n, list_max(n))) AS v FROM (SELECT *, list_transform(m, lambda a: list_dot_product(a, a)) AS n FROM sq14))),
 tr AS (SELECT src.g, src.force, area, src.year, y, xi, y - xi AS u, f, CASE WHEN src.year < 1998 THEN 1 END AS pre FROM src JOIN xi ON xi.g = src.g AND xi.force = src.force AND xi.year = src.year
    JOIN ff ON ff.g = src.g AND ff.force = src.force AND ff.year = src.year WHERE treat = 1),
 lo AS (SELECT g, force, area, count(*) AS n, avg(u) AS mu, avg(f) AS mf, sum(f * f) AS ff, sum(f * u) AS fu, regr_slope(u, f) AS b, regr_sxx(u, f) AS sxx FROM tr WHERE pre = 1 GROUP BY 1, 2, 3),
 ft AS (SELECT tr.*, n, xi + CASE WHEN tr.force = 'none' THEN 0 ELSE mu END AS y0_0, xi + CASE WHEN tr.force = 'none' THEN f * fu / lo.ff ELSE mu + b * (f - mf) END AS y0_1,
    CASE WHEN tr.force = 'none' THEN 0 ELSE 1.0 / n END AS h0, CASE WHEN tr.force = 'none' THEN f * f / lo.ff ELSE 1.0 / n + (f - mf) * (f - mf) / sxx END AS h1
    FROM tr JOIN lo ON lo.g = tr.g AND lo.force = tr.force AND lo.area = tr.area),
 cv AS (SELECT g, force, min(n) AS least, avg(pow((y - y0_0) / (1 - h0), 2)) AS e0, avg(pow((y - y0_1) / (1 - h1), 2)) AS e1 FROM ft WHERE pre = 1 GROUP BY 1, 2),
 picked AS (SELECT ft.*, CASE WHEN least >= 3 AND e0 - e1 > 0.05 * e0 THEN y0_1 ELSE y0_0 END AS y0 FROM ft JOIN cv ON cv.g = ft.g AND cv.force = ft.force)"""


def _synth_source(forces: str = "('two-way')") -> str:
    return f"""SELECT '' AS g, force, p.area, CAST(p.year AS BIGINT) AS year, value AS y, treat FROM panel p JOIN strong s ON s.area = p.area
    CROSS JOIN (VALUES {forces}) AS k(force) WHERE item = 'PROMO' AND element = 'Production' AND value IS NOT NULL AND p.area <> 'NATION_3'"""


SYNTH_CTE = f"{L_CTE}, {STRONG_CTE}, {_factor_ctes(_synth_source())}"
MANY_CTE = f"""{L_CTE}, {STRONG_CTE}, {_factor_ctes("""SELECT item || '/' || element AS g, 'two-way' AS force, p.area, CAST(p.year AS BIGINT) AS year, value AS y, treat
    FROM panel p JOIN strong s ON s.area = p.area WHERE item IN ('PROMO', 'ECONOMY', 'STANDARD') AND element <> 'Production' AND value IS NOT NULL AND p.area <> 'NATION_3'""")}"""


@query(
    "gsc_fit",
    "SELECT area, year, CAST(year - 1998 AS BIGINT) AS rel_time, round(y, 4) AS y, round(y0_1, 4) AS y0, force FROM ft",
    f"{L_CTE}, {STRONG_CTE}, {_factor_ctes(_synth_source(chr(44).join(f'({chr(39)}{x}{chr(39)})' for x in ('none', 'unit', 'two-way'))))}",
)
def gsc_fit(spark, d):
    """Counterfactual of every treated area under each kind of effects, one factor."""
    panel = _synth_panel(spark, d)
    out = None
    for force in ("none", "unit", "two-way"):
        part = G.gsc(panel, "area", "year", "y", "d", force=force, r=1, cv=False).gaps.withColumn("force", F.lit(force))
        out = part if out is None else out.unionByName(part)
    return rounded(out, year=-1, rel_time=-1, y=4, y0=4)


@query(
    "gsc_cv",
    """SELECT r, round(CASE r WHEN 0 THEN e0 WHEN 1 THEN CASE WHEN least >= 3 THEN e1 END END, 2) AS mspe FROM cv CROSS JOIN (SELECT CAST(unnest(range(6)) AS BIGINT) AS r)""",
    SYNTH_CTE,
)
def gsc_cv(spark, d):
    return rounded(_gsc(spark, d).cv, r=-1, mspe=2)


# Without factors the model is two-way: control slopes and period effects, then unit effects from pre-periods.
def _two_way_ctes(x: str) -> str:
    """SQL of the effect by period; ``x`` is the lagged-income column or 0."""
    source = f"""SELECT area, year, y, {x} AS x FROM (SELECT p.area, p.year, p.value AS y, lag(gdp) OVER (PARTITION BY p.area ORDER BY p.year) AS lag_x FROM panel p
      LEFT JOIN gdp g ON g.area = p.area AND g.year = p.year WHERE item = 'PROMO' AND element = 'Production')"""
    within = "{0} - avg({0}) OVER (PARTITION BY area) - avg({0}) OVER (PARTITION BY year) + avg({0}) OVER ()"
    return f"""{L_CTE}, {STRONG_CTE},
 tp AS (SELECT s.*, treat FROM ({source}) s JOIN strong ON strong.area = s.area WHERE x IS NOT NULL AND y IS NOT NULL AND s.area <> 'NATION_3'),
 cw AS (SELECT {within.format('x')} AS xt, {within.format('y')} AS yt FROM tp WHERE treat = 0),
 sl AS (SELECT coalesce(sum(xt * yt) / nullif(sum(xt * xt), 0), 0) AS b FROM cw),
 xi AS (SELECT year, avg(y) - (SELECT b FROM sl) * avg(x) AS xi FROM tp WHERE treat = 0 GROUP BY 1),
 tr AS (SELECT area, tp.year, y - (SELECT b FROM sl) * x - xi AS u FROM tp JOIN xi ON xi.year = tp.year WHERE treat = 1),
 al AS (SELECT area, avg(u) AS a FROM tr WHERE year < 1998 GROUP BY 1),
 att AS (SELECT CAST(year - 1998 AS BIGINT) AS rel_time, avg(u - a) AS att, CAST(count(*) AS BIGINT) AS n_treated FROM tr JOIN al ON al.area = tr.area GROUP BY 1)"""


@query("gsc_covariates", "SELECT rel_time, round(att, 4) AS att, n_treated FROM att", _two_way_ctes("lag_x"))
def gsc_covariates(spark, d):
    fit = G.gsc(_synth_panel(spark, d, covariate=True), "area", "year", "y", "d", r=0, cv=False, x=["lag_x"])
    return rounded(fit.att, rel_time=-1, att=4)


@query(
    "gsc_att",
    """SELECT CAST(year - 1998 AS BIGINT) AS rel_time, round(avg(y - y0), 4) AS att, CAST(count(*) AS BIGINT) AS n_treated,
              round((SELECT avg(y - y0) FROM picked WHERE year >= 1998), 4) AS att_avg FROM picked GROUP BY 1""",
    SYNTH_CTE,
)
def gsc_att(spark, d):
    fit = _gsc(spark, d)
    return rounded(V.attach(fit.att, fit.att_avg, []), rel_time=-1, att=4, att_avg=4)


@query("gsc_counterfactual", "SELECT year, round(avg(y), 4) AS y, round(avg(y0), 4) AS y0 FROM picked GROUP BY 1", SYNTH_CTE)
def gsc_counterfactual(spark, d):
    return rounded(_gsc(spark, d).counterfactual, year=-1, y=4, y0=4)


@query("gsc_bootstrap")
def gsc_bootstrap(spark, d):
    return rounded(_gsc(spark, d, boot=1000, seed=1).att, rel_time=-1, att=4, se=4, conf_low=4, conf_high=4)


@query(
    "gsc_many",
    """SELECT split_part(g, '/', 1) AS item, split_part(g, '/', 2) AS element, CAST(year - 1998 AS BIGINT) AS rel_time, round(avg(y - y0), 4) AS att,
              CAST(count(*) AS BIGINT) AS n_treated FROM picked GROUP BY 1, 2, 3""",
    MANY_CTE,
)
def gsc_many(spark, d):
    """Three items by four elements in one run; the treatment is computed once."""
    cells = P.staged_cells(spark, d, items=list(ITEMS))
    panel = P.country_panel(spark, d, cells).where(F.col("item").isin(list(ITEMS)) & F.col("element").isin(list(ELEMENTS)))
    treated = _strong(spark, d, cells)
    rows = panel.select("area", "year", "item", "element", F.col("value").alias("y")).where(F.col("area") != LEADER)
    rows = V.lookup(rows, treated, {"area": "importer"}, ["treated"])
    rows = rows.withColumn("d", F.when(F.col("year") < SHOCK_YEAR, 0.0).otherwise(F.coalesce("treated", F.lit(0.0))))
    fit = G.gsc(rows, "area", "year", "y", "d", r=(0, 5), by=["item", "element"])
    return rounded(fit.att, rel_time=-1, att=4)


@query(
    "gsc_cumulative",
    "SELECT rel_time, round(sum(att) OVER (ORDER BY rel_time), 4) AS catt FROM att WHERE rel_time >= 0",
    _two_way_ctes("0.0"),
)
def gsc_cumulative(spark, d):
    return rounded(G.cumulative_att(_gsc(spark, d, r=0, cv=False).att), rel_time=-1, catt=4)
