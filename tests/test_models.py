import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneloom.functions.distributions import t_quantile, t_two_sided_p
from paneloom.operators import did as DID
from paneloom.operators import fixedfx as FX
from paneloom.operators import linreg as L
from paneloom.operators import synth as G


def test_t_distribution():
    # Published table values.
    assert np.allclose(t_quantile(0.95, [1, 5, 30, 1000]), [12.7062, 2.5706, 2.0423, 1.9623], atol=1e-4)
    assert np.allclose(t_two_sided_p([2.0, 0.0], [10, 3]), [0.07338803, 1.0], atol=1e-7)


@pytest.fixture(scope="module")
def cross_section(spark):
    rng = np.random.default_rng(3)
    n = 600
    p = pd.DataFrame({"g": rng.integers(0, 3, n), "c": rng.integers(0, 20, n), "x1": rng.normal(5, 2, n), "x2": rng.normal(size=n)})
    p["y"] = 1e6 + 2 * p.x1 - p.x2 + rng.normal(size=n) * (1 + p.x2.abs())
    return p, spark.createDataFrame(p).repartition(5)


def dense_ols(x, y, kind, cluster=None):
    a = np.linalg.inv(x.T @ x)
    b = a @ x.T @ y
    e = y - x @ b
    n, k = x.shape
    if kind == "classic":
        v = a * (e @ e) / (n - k)
    elif kind == "hc2":
        h = np.einsum("ij,jk,ik->i", x, a, x)
        v = a @ (x.T * (e**2 / (1 - h))) @ x @ a
    else:
        groups = np.unique(cluster)
        s = np.stack([x[cluster == u].T @ e[cluster == u] for u in groups])
        v = a @ s.T @ s @ a * len(groups) / (len(groups) - 1) * (n - 1) / (n - k)
    return b, np.sqrt(np.diag(v))


@pytest.mark.parametrize("kind", ["classic", "hc2", "cluster"])
def test_ols_against_dense(cross_section, kind):
    p, df = cross_section
    out = L.ols(df, "y", ["x1", "x2"], by=["g"], se=kind, cluster=["c"] if kind == "cluster" else ()).toPandas()
    for g, part in p.groupby("g"):
        x = np.column_stack([np.ones(len(part)), part.x1, part.x2])
        b, s = dense_ols(x, part.y.to_numpy(), kind, part.c.to_numpy())
        mine = out[out.g == g].set_index("term").loc[["(Intercept)", "x1", "x2"]]
        assert np.allclose(mine.estimate, b, rtol=1e-7) and np.allclose(mine.std_error, s, rtol=1e-5)


def test_ols_options(cross_section, spark):
    p, df = cross_section
    inter = L.ols(df, "y", ["x1", "x2"], interactions=[("x1", "x2")], se="hc2").toPandas().set_index("term")
    x = np.column_stack([np.ones(len(p)), p.x1, p.x2, p.x1 * p.x2])
    b, s = dense_ols(x, p.y.to_numpy(), "hc2")
    assert np.allclose(inter.estimate[["(Intercept)", "x1", "x2", "x1:x2"]], b, rtol=1e-6)
    assert np.allclose(inter.std_error[["(Intercept)", "x1", "x2", "x1:x2"]], s, rtol=1e-5)
    copy = L.ols(df.withColumn("x3", F.col("x1") * 2), "y", ["x1", "x3"]).toPandas().set_index("term")
    assert np.isnan(copy.estimate["x3"]) and np.isfinite(copy.estimate["x1"])
    parts = df.unionByName(df.limit(1).withColumn("y", F.lit(None).cast("double")))
    assert L.ols(parts, "y", ["x1"]).first().nobs == len(p)


def test_iv_against_matrices(spark):
    rng = np.random.default_rng(4)
    n = 500
    z, u = rng.normal(size=n), rng.normal(size=n)
    x = z + u + rng.normal(size=n)
    y = 1 + 2 * x + 3 * u + rng.normal(size=n)
    out = L.iv2sls(spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": z})), "y", "x", "z").toPandas().set_index("term")
    zm, xm = np.column_stack([np.ones(n), z]), np.column_stack([np.ones(n), x])
    inv = np.linalg.inv(zm.T @ xm)
    b = inv @ zm.T @ y
    e = y - xm @ b
    v = inv @ (zm.T @ zm) @ inv.T * (e @ e) / (n - 2)
    assert np.allclose(out.estimate[["(Intercept)", "x"]], b) and np.allclose(out.std_error[["(Intercept)", "x"]], np.sqrt(np.diag(v)))
    assert abs(b[1] - 2) < abs(dense_ols(xm, y, "classic")[0][1] - 2)


def test_decomposition_slopes_sum_to_one(spark):
    rng = np.random.default_rng(9)
    rows = [("i", f"u{u}", float(v)) for u in range(30) for v in rng.lognormal(3, 1, rng.integers(1, 15))]
    df = spark.createDataFrame([*rows, ("i", "u0", None)], "item string, unit string, value double")
    out = L.variance_decomposition(df, ["item"], "unit").toPandas()
    assert abs(out.estimate.sum() - 1) < 1e-10


# --- fixed effects -------------------------------------------------------------------


@pytest.fixture(scope="module")
def unbalanced(spark):
    rng = np.random.default_rng(42)
    n, t = 40, 20
    rows = [(g, i, s, i % 7) for g in range(2) for i in range(n) for s in range(t) if rng.random() > 0.15]
    p = pd.DataFrame(rows, columns=["g", "i", "t", "c"])
    a, b = rng.normal(size=n), rng.normal(size=t)
    p["x1"] = rng.normal(size=len(p)) + a[p.i]
    p["x2"] = rng.normal(size=len(p)) + b[p.t]
    p["y"] = 2 * p.x1 - p.x2 + a[p.i] + b[p.t] + rng.normal(size=len(p))
    return p, spark.createDataFrame(p).repartition(4)


def dense_fe(p, keys, clusters, params):
    d = np.column_stack([p.x1, p.x2] + [pd.get_dummies(p[k]).to_numpy(dtype=float)[:, (q > 0) :] for q, k in enumerate(keys)])
    e = p.y - d @ np.linalg.lstsq(d, p.y, rcond=None)[0]
    z = d[:, 2:]
    x = np.column_stack([v - z @ np.linalg.lstsq(z, v, rcond=None)[0] for v in (p.x1, p.x2)])
    inv = np.linalg.inv(x.T @ x)
    n = len(p)

    def part(c):
        s = np.stack([x[c == u].T @ e[c == u] for u in np.unique(c)])
        return inv @ s.T @ s @ inv

    cov = sum(part(p[c].to_numpy()) for c in clusters)
    if len(clusters) == 2:
        cov = cov - part((p[clusters[0]].astype(str) + "/" + p[clusters[1]].astype(str)).to_numpy())
    g = min(p[c].nunique() for c in clusters)
    return inv @ x.T @ p.y, np.sqrt(np.diag(cov * g / (g - 1) * (n - 1) / (n - params)))


def check_fe(out, dense):
    mine = out.set_index("term").loc[["x1", "x2"]]
    assert np.allclose(mine.estimate, dense[0], atol=1e-8) and np.allclose(mine.std_error, dense[1], atol=1e-7)


def test_two_way_by_group(unbalanced):
    p, df = unbalanced
    out = FX.feols(df, "y", ["x1", "x2"], ["i", "t"], by=["g"]).toPandas()
    for g, part in p.groupby("g"):
        check_fe(out[out.g == g], dense_fe(part, ["i", "t"], ["i"], 2 + 1 + part.t.nunique() - 1))


def test_two_way_clusters_and_interacted_keys(unbalanced):
    p, df = unbalanced
    p = p.assign(ig=p.i * 100 + p.g, tg=p.t * 100 + p.g)
    out = FX.feols(df, "y", ["x1", "x2"], [("i", "g"), ("t", "g")], cluster=["i", "t"]).toPandas()
    check_fe(out, dense_fe(p, ["ig", "tg"], ["i", "t"], 3))


def test_three_way(unbalanced):
    p, df = unbalanced
    out = FX.feols(df, "y", ["x1", "x2"], ["i", "t", "g"], cluster=["c"]).toPandas()
    check_fe(out, dense_fe(p, ["i", "t", "g"], ["c"], 2 + 40 + 20 + 2 - 2))


def test_duplicate_cells_singletons_and_recovery(unbalanced, spark):
    p, df = unbalanced
    twice = df.unionByName(df.withColumn("y", F.col("y") + 1))  # two rows per cell
    q = pd.concat([p, p.assign(y=p.y + 1)])
    out = FX.feols(twice, "y", ["x1", "x2"], ["i", "t"], cluster=["i"]).toPandas()
    check_fe(out, dense_fe(q, ["i", "t"], ["i"], 2 + 1 + 19))
    lone = df.unionByName(df.limit(1).withColumns({"i": F.lit(999).cast("long"), "y": F.lit(1e3)}))
    base = FX.feols(df, "y", ["x1", "x2"], ["i", "t"]).toPandas().estimate
    assert np.allclose(FX.feols(lone, "y", ["x1", "x2"], ["i", "t"]).toPandas().estimate, base, atol=1e-7)
    eff = FX.fixef(df, "y", ["x1", "x2"], ["i", "t"]).toPandas()
    merged = p.merge(eff[eff.fe == "i"].assign(i=lambda e: e.level.astype(int))[["i", "effect"]], on="i")
    merged = merged.merge(eff[eff.fe == "t"].assign(t=lambda e: e.level.astype(int))[["t", "effect"]], on="t", suffixes=("_i", "_t"))
    b = FX.feols(df, "y", ["x1", "x2"], ["i", "t"]).toPandas().set_index("term").estimate
    resid = merged.y - b["x1"] * merged.x1 - b["x2"] * merged.x2 - merged.effect_i - merged.effect_t
    assert np.abs(resid.groupby(merged.i).mean()).max() < 1e-7 and np.abs(resid.groupby(merged.t).mean()).max() < 1e-7
    assert eff[(eff.fe == "t") & (eff.level == "0")].effect.iloc[0] == 0


# --- difference-in-differences ----------------------------------------------------------


@pytest.fixture(scope="module")
def confounded(spark):
    rng = np.random.default_rng(42)
    n = 2000
    x = rng.normal(size=(n, 2))
    d = (rng.random(n) < 1 / (1 + np.exp(-(0.5 * x[:, 0] - 0.5 * x[:, 1])))).astype(float)
    y0 = x[:, 0] + rng.normal(size=n)
    y1 = y0 + 1 + 2 * x[:, 0] - x[:, 1] + 3 * d + rng.normal(size=n)
    p = pd.DataFrame({"y0": y0, "y1": y1, "d": d, "x1": x[:, 0] * 1000 + 5e4, "x2": x[:, 1]})
    return p, spark.createDataFrame(p)


def dense_drdid(p, method):
    """Matrix form of the published estimators."""
    n = len(p)
    x = np.column_stack([np.ones(n), (p.x1 - p.x1.mean()) / 1000, p.x2])
    d, dy = p.d.to_numpy(), (p.y1 - p.y0).to_numpy()
    g = np.zeros(3)
    for _ in range(100):
        if method == "trad":
            q = 1 / (1 + np.exp(-x @ g))
            h, s = (x.T * (q * (1 - q))) @ x, x.T @ (q - d)
        else:
            w = (1 - d) * np.exp(x @ g)
            h, s = (x.T * w) @ x, x.T @ (w - d)
        g = g - np.linalg.solve(h, s)
    odds = np.exp(x @ g)
    w = (1 - d) * (odds if method == "imp" else 1)
    b = np.linalg.solve((x.T * w) @ x, x.T @ (w * dy))
    e, w1, w0 = dy - x @ b, d, (1 - d) * odds
    t1, t0 = (w1 * e).sum() / w1.sum(), (w0 * e).sum() / w0.sum()
    i1, i0 = w1 * (e - t1), w0 * (e - t0)
    if method == "trad":
        lo = ((1 - d) * e)[:, None] * x @ np.linalg.inv((x.T * (1 - d)) @ x / n)
        lp = (d - odds / (1 + odds))[:, None] * x @ np.linalg.inv(h / n)
        i1 = i1 - lo @ (w1[:, None] * x).mean(0)
        i0 = i0 + lp @ ((w0 * (e - t0))[:, None] * x).mean(0) - lo @ (w0[:, None] * x).mean(0)
    inf = i1 / w1.mean() - i0 / w0.mean()
    return t1 - t0, inf.std(ddof=1) / np.sqrt(n)


@pytest.mark.parametrize("method", ["trad", "imp"])
def test_drdid(confounded, method):
    p, df = confounded
    row = DID.drdid(df, "y0", "y1", "d", ["x1", "x2"], method).first()
    att, se = dense_drdid(p, method)
    assert abs(row.att - att) < 1e-7 and abs(row.std_error - se) < 1e-7
    naive = DID.drdid_nocov(df, "y0", "y1", "d").first()
    assert abs(row.att - 3) < 0.2 < abs(naive.att - 3)
    plain = DID.drdid(df, "y0", "y1", "d", [], method).first()
    assert abs(plain.att - naive.att) < 1e-9 and abs(plain.std_error - naive.std_error) < 1e-9


# --- synthetic control --------------------------------------------------------------------


@pytest.fixture(scope="module")
def factor_panel(spark):
    rng = np.random.default_rng(42)
    n, t, t0 = 50, 25, 15
    f, lam = rng.normal(size=(t, 2)), rng.normal(size=(n, 2))
    a, xi = rng.normal(size=n), rng.normal(size=t)
    rows = []
    for i in range(n):
        for s in range(t):
            on = i < 8 and s >= t0
            x = rng.normal() + lam[i] @ f[s] * 0.5
            rows.append((f"u{i:02d}", 2000 + s, a[i] + xi[s] + lam[i] @ f[s] + 2.0 * on + 0.3 * rng.normal(), int(on), x))
    p = pd.DataFrame(rows, columns=["u", "t", "y", "d", "x"])
    p["y2"] = p.y + 1.5 * p.x
    return p, spark.createDataFrame(p).repartition(4)


def dense_gaps(p, r):
    """Two-way factor model of the controls by SVD and treated loadings by least squares."""
    wide = p.pivot(index="u", columns="t", values="y")
    on = p.groupby("u").d.max() == 1
    co, tr = wide[~on].to_numpy(), wide[on].to_numpy()
    xi = co.mean(0)
    c = co - xi
    c = c - c.mean(1, keepdims=True)
    f = np.linalg.svd(c, full_matrices=False)[2][:r].T
    z = np.column_stack([np.ones(len(xi)), f])
    pre = np.arange(len(xi)) < 15
    load = np.linalg.lstsq(z[pre], (tr - xi)[:, pre].T, rcond=None)[0]
    return tr - xi - (z @ load).T


def test_factor_model(factor_panel):
    p, df = factor_panel
    fit = G.gsc(df, "u", "t", "y", "d")
    assert fit.chosen.first().r == 2
    gaps = dense_gaps(p, 2)
    att = fit.att.toPandas().sort_values("rel_time").att
    assert np.allclose(att, gaps.mean(0), atol=1e-8)
    assert abs(fit.att_avg.first().att_avg - 2) < 0.15
    cf = fit.counterfactual.toPandas().sort_values("t")
    assert np.allclose(cf.y - cf.y0, gaps.mean(0), atol=1e-8)


def test_no_factors_is_plain_did(factor_panel):
    p, df = factor_panel
    m = p.assign(post=p.t >= 2015, tr=p.groupby("u").d.transform("max") == 1).groupby(["tr", "post"]).y.mean()
    did = m[True][True] - m[True][False] - m[False][True] + m[False][False]
    assert abs(G.gsc(df, "u", "t", "y", "d", r=0, cv=False).att_avg.first().att_avg - did) < 1e-9


def test_leave_one_period_out_error(factor_panel):
    p, df = factor_panel
    row = G.gsc(df, "u", "t", "y", "d", r=(1, 1)).cv.first()
    wide = p.pivot(index="u", columns="t", values="y")
    on = p.groupby("u").d.max() == 1
    co, tr = wide[~on].to_numpy(), wide[on].to_numpy()
    xi = co.mean(0)
    c = co - xi - (co - xi).mean(1, keepdims=True)
    z = np.column_stack([np.ones(25), np.linalg.svd(c, full_matrices=False)[2][0]])
    err = []
    for s in range(15):
        keep = [k for k in range(15) if k != s]
        load = np.linalg.lstsq(z[keep], (tr - xi)[:, keep].T, rcond=None)[0]
        err.append((tr - xi)[:, s] - z[s] @ load)
    assert abs(row.mspe - np.mean(np.square(err))) < 1e-9


def test_covariate_and_groups(factor_panel):
    p, df = factor_panel
    fit = G.gsc(df, "u", "t", "y2", "d", x=["x"])
    row = fit.chosen.first()
    assert row.r == 2 and abs(row.beta_x - 1.5) < 0.05 and abs(fit.att_avg.first().att_avg - 2) < 0.15
    both = df.withColumn("k", F.lit("a")).unionByName(df.withColumns({"k": F.lit("b"), "y": F.col("y") * 10}))
    out = {r.k: r.att_avg for r in G.gsc(both, "u", "t", "y", "d", r=2, cv=False, by=["k"]).att_avg.collect()}
    assert abs(out["b"] - 10 * out["a"]) < 1e-7


def test_bootstrap_interval_and_missing_cells(factor_panel):
    p, df = factor_panel
    fit = G.gsc(df, "u", "t", "y", "d", r=2, cv=False, boot=40, seed=1)
    row = fit.att_avg.first()
    assert row.conf_low < 2 < row.conf_high and 0 < row.se < 0.3
    again = G.gsc(df.repartition(7), "u", "t", "y", "d", r=2, cv=False, boot=40, seed=1).att_avg.first()
    assert abs(again.se - row.se) < 1e-9
    holes = df.where(F.pmod(F.xxhash64("u", "t"), F.lit(15)) > 0)
    assert abs(G.gsc(holes, "u", "t", "y", "d", r=2, cv=False).att_avg.first().att_avg - 2) < 0.2


def test_bootstrap_error_against_dense(factor_panel):
    """The standard error is that of the same resampling in dense numpy (independent draws, many of them)."""
    p, df = factor_panel
    wide = p.pivot(index="u", columns="t", values="y")
    on = p.groupby("u").d.max() == 1
    co, tr = wide[~on].to_numpy(), wide[on].to_numpy()
    pre, rng = np.arange(25) < 15, np.random.default_rng(0)

    def model(c):
        xi = c.mean(0)
        within = c - xi - (c - xi).mean(1, keepdims=True)
        return xi, np.column_stack([np.ones(25), np.linalg.svd(within, full_matrices=False)[2][:2].T])

    def gap(m, y, use):
        xi, z = m
        return y - xi - (z @ np.linalg.lstsq(z[use], (y - xi)[:, use].T, rcond=None)[0]).T

    m = model(co)
    e = gap(m, co, np.ones(25, dtype=bool))
    missed = np.stack([gap(model(np.delete(co, i, 0)), co[i : i + 1], pre)[0] for i in range(len(co))])
    base = tr - gap(m, tr, pre)
    draws = []
    for _ in range(2000):
        c = co - e + e[rng.integers(len(co), size=len(co))]
        draws.append(gap(model(c), base + missed[rng.integers(len(co), size=len(tr))], pre)[:, 15:].mean())
    got = G.gsc(df, "u", "t", "y", "d", r=2, cv=False, boot=500, seed=3).att_avg.first().se
    assert abs(got / np.std(draws, ddof=1) - 1) < 0.15


def test_several_onsets_and_unused_groups(factor_panel):
    """A second group does not change the draws of the first; groups without treated units give no rows."""
    p, df = factor_panel
    late = df.withColumn("d", F.when((F.col("u") == "u00") & (F.col("t") < 2018), 0).otherwise(F.col("d")))
    alone = G.gsc(late.withColumn("k", F.lit("a")), "u", "t", "y", "d", r=2, cv=False, boot=20, by=["k"]).att_avg.first()
    other = late.where("t < 2020").withColumns({"k": F.lit("b"), "y": F.col("y") * 3})
    idle = df.where("d = 0 AND u > 'u10'").withColumn("k", F.lit("c"))
    both = G.gsc(late.withColumn("k", F.lit("a")).unionByName(other).unionByName(idle), "u", "t", "y", "d", r=2, cv=False, boot=20, by=["k"])
    rows = {r.k: r for r in both.att_avg.collect()}
    assert set(rows) == {"a", "b"}
    assert abs(rows["a"].se - alone.se) < 1e-9 and abs(rows["a"].att_avg - alone.att_avg) < 1e-9


def test_many_periods_and_many_groups(spark):
    rng = np.random.default_rng(3)
    f = rng.normal(size=600)
    long = [(f"u{i:02d}", s, float(rng.normal() + (i % 5) * f[s] + (i < 3 and s >= 500) * 2.0 + 0.1 * rng.normal()), int(i < 3 and s >= 500)) for i in range(20) for s in range(600)]
    fit = G.gsc(spark.createDataFrame(long, "u string, t int, y double, d int"), "u", "t", "y", "d", r=1, cv=False)
    assert abs(fit.att_avg.first().att_avg - 2) < 0.3
    many = [
        (f"g{g:03d}", f"u{i}", s, float(g + i + s + (i == 0 and s >= 4) * g), int(i == 0 and s >= 4)) for g in range(200) for i in range(4) for s in range(6)
    ]
    groups = G.gsc(spark.createDataFrame(many, "g string, u string, t int, y double, d int"), "u", "t", "y", "d", r=0, cv=False, by=["g"])
    got = {r.g: r.att_avg for r in groups.att_avg.collect()}
    assert len(got) == 200 and all(abs(got[f"g{g:03d}"] - g) < 1e-8 for g in range(200))


def test_too_few_periods_or_controls(factor_panel):
    p, df = factor_panel
    short = df.where("t >= 2013")
    with pytest.raises(ValueError, match="4 known pre-periods"):
        G.gsc(short, "u", "t", "y", "d", r=2, cv=False)
    with pytest.raises(ValueError, match="needs more than"):
        G.gsc(df.where("t < 2017"), "u", "t", "y", "d", r=20, cv=False)
    with pytest.raises(ValueError, match="without a control"):
        G.gsc(df.where("u < 'u08'"), "u", "t", "y", "d", r=0, cv=False)


def test_drdid_needs_both_arms(spark):
    from paneloom.operators import did

    rows = spark.createDataFrame([(1.0, 2.0, 1.0, 0.5), (2.0, 3.0, 1.0, 0.7)], "y0 double, y1 double, d double, x double")
    for part in (rows, rows.where("false")):
        with pytest.raises(ValueError, match="control"):
            did.drdid(part, "y0", "y1", "d", ["x"])
