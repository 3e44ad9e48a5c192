"""Query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# Panel tables in SQL; every check starts from these.
BASE_SQL = """
WITH flows_wide AS (
  SELECT sn.n_name AS exporter, sn.n_nationkey AS exporter_code, cn.n_name AS importer, cn.n_nationkey AS importer_code,
         CAST(year(l_shipdate) AS INT) AS year, p_type AS item,
         SUM(l_extendedprice * (1 - l_discount)) AS exp_val, SUM(l_quantity) AS exp_quant
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation cn ON c_nationkey = cn.n_nationkey
  GROUP BY 1, 2, 3, 4, 5, 6),
flows AS (
  SELECT exporter, exporter_code, importer, importer_code, year, item, 'Export Value' AS element, exp_val AS value FROM flows_wide
  UNION ALL
  SELECT exporter, exporter_code, importer, importer_code, year, item, 'Export Quantity', exp_quant FROM flows_wide),
mirror AS (
  SELECT exporter AS reporter, importer AS partner, year, item, element, value FROM flows
  UNION ALL
  SELECT importer, exporter, year, item, replace(element, 'Export', 'Import'), value FROM flows),
panel AS (
  SELECT exporter AS area, exporter_code AS area_code, year, item, 'Production' AS element, SUM(exp_quant) AS value FROM flows_wide GROUP BY 1, 2, 3, 4
  UNION ALL SELECT exporter, exporter_code, year, item, 'Export Quantity', SUM(exp_quant) FROM flows_wide WHERE exporter <> importer GROUP BY 1, 2, 3, 4
  UNION ALL SELECT exporter, exporter_code, year, item, 'Export Value', SUM(exp_val) FROM flows_wide WHERE exporter <> importer GROUP BY 1, 2, 3, 4
  UNION ALL SELECT importer, importer_code, year, item, 'Import Quantity', SUM(exp_quant) FROM flows_wide WHERE exporter <> importer GROUP BY 1, 2, 3, 4
  UNION ALL SELECT importer, importer_code, year, item, 'Import Value', SUM(exp_val) FROM flows_wide WHERE exporter <> importer GROUP BY 1, 2, 3, 4),
gdp AS (
  SELECT n_name AS area, CAST(year(o_orderdate) AS INT) AS year, SUM(o_totalprice) / 1000 AS gdp
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
dist AS (
  SELECT a.n_name AS exporter, b.n_name AS importer,
         CAST(500 + 100 * abs(a.n_nationkey - b.n_nationkey) + CASE WHEN a.n_regionkey <> b.n_regionkey THEN 1000 ELSE 0 END AS DOUBLE) AS distw
  FROM nation a CROSS JOIN nation b),
sea AS (SELECT exporter, importer, 2 * distw AS seadistance FROM dist WHERE distw > 1000)
"""


def query(key: str, sql: str | None = None, ctes: str = ""):
    """Register a query; ``sql`` is its check, on top of the base tables and ``ctes``."""

    def add(fn: Query) -> Query:
        if key in _QUERIES:
            raise ValueError(f"query {key} registered twice")
        _QUERIES[key] = fn
        if sql is not None:
            _SQL[key] = BASE_SQL + (", " + ctes.strip().rstrip(",") if ctes.strip() else "") + "\n" + sql.strip()
        return fn

    return add


def t_share_sql(t: str, df: str) -> str:
    """P(|T| <= t) for whole degrees of freedom, by its finite sum in powers of df / (df + t^2)."""
    c2 = f"({df} / ({df} + {t} * {t}))"
    even = f"exp(lgamma(2 * k + 1) - 2 * k * ln(2) - 2 * lgamma(k + 1) + k * ln({c2}))"
    odd = f"exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2) + k * ln({c2}))"
    sine = f"abs({t}) / sqrt({df} + {t} * {t})"
    total = lambda term, n: f"coalesce(list_sum(list_transform(range(0, CAST({n} AS BIGINT)), lambda k: {term})), 0)"
    return (
        f"(CASE WHEN CAST({df} AS BIGINT) % 2 = 0 THEN {sine} * {total(even, f'{df} / 2')} "
        f"ELSE 2 / pi() * (atan(abs({t}) / sqrt({df})) + {sine} * sqrt({c2}) * {total(odd, f'floor(({df} - 1) / 2)')}) END)"
    )


def t_quantile_ctes(source: str, level: float = 0.95, steps: int = 12) -> str:
    """``tq`` (df, q): quantiles for the df of a source, by Newton steps, which rise to q as the share is concave."""
    slope = "2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + q * q / df, -(df + 1) / 2)"
    out = [f"tq0 AS (SELECT DISTINCT CAST(df AS DOUBLE) AS df, CAST(1 AS DOUBLE) AS q FROM {source})"]
    for k in range(steps):
        out.append(f"tq{k + 1} AS MATERIALIZED (SELECT df, q + ({level} - {t_share_sql('q', 'df')}) / ({slope}) AS q FROM tq{k})")
    return ", ".join(out) + f", tq AS (SELECT df, q FROM tq{steps})"


def t_real_quantile_ctes(source: str, level: float = 0.95, steps: int = 12, terms: int = 200) -> str:
    """``tq`` (df, q) for degrees of freedom of any size, the share by its power series in q^2 / (df + q^2)."""
    y = "(q * q / (df + q * q))"
    factor = f"exp(lgamma((df + 1) / 2 + k) - lgamma((df + 1) / 2) - lgamma(1.5 + k) + lgamma(1.5) + k * ln({y}))"
    front = f"exp(0.5 * ln({y}) + df / 2 * ln(1 - {y}) + lgamma((df + 1) / 2) - lgamma(df / 2) - lgamma(0.5)) * 2"
    share = f"({front} * list_sum(list_transform(range(0, {terms}), lambda k: {factor})))"
    slope = "2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + q * q / df, -(df + 1) / 2)"
    out = [f"tq0 AS (SELECT DISTINCT CAST(df AS DOUBLE) AS df, CAST(1 AS DOUBLE) AS q FROM {source})"]
    for k in range(steps):
        out.append(f"tq{k + 1} AS MATERIALIZED (SELECT df, q + ({level} - {share}) / ({slope}) AS q FROM tq{k})")
    return ", ".join(out) + f", tq AS (SELECT df, q FROM tq{steps})"


def within_rounds(source: str, keys: list[str], cols: list[str], rest: list[str], rounds: int = 14) -> str:
    """CTEs that take off the means by each key in turn, ``rounds`` times; the last is ``within``."""
    out, last = [], source
    for k in range(rounds * len(keys)):
        by = keys[k % len(keys)]
        name = "within" if k == rounds * len(keys) - 1 else f"within{k}"
        means = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {by}) AS {c}" for c in cols)
        out.append(f"{name} AS MATERIALIZED (SELECT {', '.join(rest)}, {means} FROM {last})")
        last = name
    return ", ".join(out)


def ols_ctes(source: str, keys: list[str], xs: dict[str, str], robust: bool = False, intercept: bool = True, cluster: str = "", params: str = "") -> str:
    """CTE ``terms`` (keys, term, b, se, n, df, r2): regression of y on a constant and ``xs`` (term: column) by group.

    Regressors are made orthogonal one after the other (z), so that slopes,
    errors and leverages are sums over z; R holds what was taken off. Errors
    are classical, HC2 (``robust``) or by ``cluster``, with ``params`` the
    number of parameters as an aggregate.
    """
    by = ", ".join(keys)
    cols = (["1.0"] if intercept else []) + list(xs.values())
    k = len(cols) - 1
    out = [f"o0 AS MATERIALIZED (SELECT *, {cols[0]} AS z0 FROM {source})"]
    for j in range(1, k + 1):
        share = lambda i: f"sum({cols[j]} * z{i}) OVER g / nullif(sum(z{i} * z{i}) OVER g, 0)"
        out.append(f"p{j} AS (SELECT *, {', '.join(f'{share(i)} AS r{i}_{j}' for i in range(j))} FROM o{j - 1} WINDOW g AS (PARTITION BY {by}))")
        out.append(f"o{j} AS MATERIALIZED (SELECT *, {cols[j]} - {' - '.join(f'r{i}_{j} * z{i}' for i in range(j))} AS z{j} FROM p{j})")
    slopes = ", ".join(f"sum(y * z{j}) OVER g / nullif(sum(z{j} * z{j}) OVER g, 0) AS c{j}, sum(z{j} * z{j}) OVER g AS d{j}" for j in range(k + 1))
    out.append(f"oy AS MATERIALIZED (SELECT *, {slopes}, count(*) OVER g AS n, avg(y) OVER g AS my FROM o{k} WINDOW g AS (PARTITION BY {by}))")
    rest = "y - " + " - ".join(f"c{j} * z{j}" for j in range(k + 1))
    inverse = {(j, j): "1.0" for j in range(k + 1)}  # of R, as text
    for j in range(k, -1, -1):
        for m in range(j + 1, k + 1):
            inverse[j, m] = "-(" + " + ".join(f"r{j}_{i} * {inverse[i, m]}" for i in range(j + 1, m + 1)) + ")"
    lever = " + ".join(f"z{j} * z{j} / d{j}" for j in range(k + 1))
    lent = [" + ".join(f"{inverse[j, m]} * z{m} / d{m}" for m in range(j, k + 1)) for j in range(k + 1)]
    fits = [" + ".join(f"{inverse[j, m]} * c{m}" for m in range(j, k + 1)) for j in range(k + 1)]
    known = ", ".join(f"{fits[j]} AS b{j}, {lent[j]} AS w{j}" for j in range(k + 1))
    out.append(f"oe AS MATERIALIZED (SELECT *, {rest} AS e, 1 - ({lever}) AS free, {known} FROM oy)")
    if cluster:
        scores = ", ".join(f"sum(w{j} * e) AS s{j}" for j in range(k + 1))
        out.append(f"oc AS (SELECT {by}, {cluster}, {scores} FROM oe GROUP BY {by}, {cluster})")
        squares = ", ".join(f"sum(s{j} * s{j}) AS v{j}" for j in range(k + 1))
        out.append(f"ov AS (SELECT {by}, count(*) AS g, {squares} FROM oc GROUP BY {by})")
        out.append(f"op AS (SELECT {by}, count(*) AS n, {params} AS params FROM oe GROUP BY {by})")
        out.append(f"of AS (SELECT {by}, {', '.join(f'v{j} * g / (g - 1.0) * (n - 1.0) / (n - params) AS v{j}' for j in range(k + 1))} FROM ov JOIN op USING ({by}))")
        slopes = ", ".join(f"any_value(b{j}) AS b{j}" for j in range(k + 1))
        fit = f"SELECT {by}, any_value(n) AS n, 1 - sum(e * e) / nullif(sum((y - my) * (y - my)), 0) AS r2, {slopes} FROM oe GROUP BY {by}"
        out.append(f"og AS MATERIALIZED (SELECT * FROM ({fit}) JOIN of USING ({by}))")
    errors = ", ".join(
        f"any_value(b{j}) AS b{j}, " + (f"sum(w{j} * w{j} * e * e / free) AS v{j}" if robust else f"sum(w{j} * w{j}) * sum(e * e) / (any_value(n) - {k + 1}) AS v{j}")
        for j in range(k + 1)
    )
    if not cluster:
        out.append(f"og AS MATERIALIZED (SELECT {by}, any_value(n) AS n, 1 - sum(e * e) / nullif(sum((y - my) * (y - my)), 0) AS r2, {errors} FROM oe GROUP BY {by})")
    names = (["(Intercept)"] if intercept else []) + list(xs)
    rows = " UNION ALL ".join(f"SELECT {by}, '{names[j]}' AS term, b{j} AS b, sqrt(v{j}) AS se, n, CAST(n - {k + 1} AS DOUBLE) AS df, r2 FROM og" for j in range(k + 1))
    return ", ".join([*out, f"terms AS ({rows})"])


def _load() -> None:
    from paneloom.plans import causal, descriptive, regressions, tables  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named columns; whole-number columns (``=-1``) become bigint."""
    return df.withColumns(
        {c: (F.col(c).cast("bigint") if d < 0 else F.round(F.col(c), d)) for c, d in digits.items()}
    )
