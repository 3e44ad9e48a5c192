import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneloom.functions import aggregates as A
from paneloom.functions import scalars as S
from paneloom.operators import describe as D
from paneloom.operators import equilibrium as E
from paneloom.operators import network as N
from paneloom.operators import plotdata as PD
from paneloom.operators import reshape as R
from paneloom.operators import verbs as V


def test_all_null_group(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0)], "g string, v double")
    row = df.groupBy("g").agg(A.sum0("v").alias("s"), A.count_known("v").alias("n"), F.avg("v").alias("m"), A.count_rows().alias("r")).where("g = 'a'").first()
    assert (row.s, row.n, row.m, row.r) == (0.0, 0, None, 2)


def test_missing_base_year(spark):
    df = spark.createDataFrame([("a", 1997, 1.0), ("a", 1998, 3.0), ("b", 1998, 5.0)], "g string, year int, v double")
    out = {(r.g, r.year): r.d for r in V.base_period_diff(df, ["g"], "year", "v", 1997, "d").collect()}
    assert out == {("a", 1997): 0.0, ("a", 1998): 2.0, ("b", 1998): None}


def test_zero_quantity(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, None), (6.0, 2.0)], "v double, q double")
    assert [r[0] for r in df.select(S.ratio("v", "q").alias("p")).collect()] == [None, None, 3.0]
    assert df.where("q > 0").count() == 1


def test_duplicate_pivot_keys(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0)], "k string, n string, v double")
    with pytest.raises(ValueError):
        V.require_unique(df, ["k", "n"])
    assert V.require_unique(df.limit(1), ["k", "n"]).count() == 1


def test_null_join_keys(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    dim = spark.createDataFrame([(None, 10), ("a", 20)], "k string, y int")
    plain = {r.x: r.y for r in V.lookup(left, dim, ["k"], ["y"]).collect()}
    safe = {r.x: r.y for r in V.lookup(left, dim, ["k"], ["y"], null_safe=True).collect()}
    assert plain == {1: None, 2: 20} and safe == {1: 10, 2: 20}


def test_area_codes(spark):
    df = spark.createDataFrame([(c,) for c in (4999, 5000, 252, 254, 5100, 5101, None)], "code int")
    assert [r.code for r in V.drop_aggregate_areas(df, ["code"]).collect()] == [4999]
    assert [r.code for r in df.where(F.pmod("code", F.lit(100)) == 0).orderBy("code").collect()] == [5000, 5100]
    got = {r.code: r.c for r in df.select("code", S.range_label("code", S.CONTINENT_CODE_RANGES).alias("c")).collect()}
    assert got[5100] == "Africa" and got[5101] == "Africa" and got[4999] is None and got[None] is None


def test_names(spark):
    df = spark.createDataFrame([("A, b (export/import) (export/import)",), ("x/y z",)], "s string")
    slugs = [r[0] for r in df.select(S.slug("s")).collect()]
    assert slugs == ["A__b__export_import___export_import_", "x_y_z"]
    first = [r[0] for r in df.select(S.remove_first("s", r" \(export/import\)")).collect()]
    assert first == ["A, b (export/import)", "x/y z"]


def test_flag_keeps_null(spark):
    df = spark.createDataFrame([(None,), (0.0,), (2.0,)], "v double")
    assert [r[0] for r in df.select(S.flag(F.col("v") > 0)).collect()] == [None, 0.0, 1.0]


def test_ties_and_first_rows(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 1.0), ("d", None)], "k string, v double")
    assert [r.k for r in V.top_k(df, "v", 2, ["k"]).collect()] == ["a", "b"]
    rows = spark.createDataFrame([(1, 3, "x"), (1, 2, "y"), (2, 9, "z")], "k int, o int, t string").repartition(3)
    assert {(r.k, r.t) for r in V.first_per_key(rows, ["k"], ["o"]).collect()} == {(1, "y"), (2, "z")}


def test_year_gap(spark):
    df = spark.createDataFrame([("a", 2000, 1.0), ("a", 2002, 4.0)], "u string, year int, v double")
    positional = V.lagged(df, ["u"], "year", {"l": ("v", 1)}).where("year = 2002").first().l
    calendar = V.calendar_lag(df, ["u"], "year", "v", "l").where("year = 2002").first().l
    assert positional == 1.0 and calendar is None


def test_sample_is_repeatable(spark):
    df = spark.range(1000).toDF("id")
    a = {r.id for r in V.sample_rows(df.repartition(7), ["id"], 50, seed=3).collect()}
    b = {r.id for r in V.sample_rows(df.repartition(2), ["id"], 50, seed=3).collect()}
    assert len(a) == 50 and a == b and a != {r.id for r in V.sample_rows(df, ["id"], 50, seed=4).collect()}


@pytest.mark.parametrize("kind", ["smooth", "ties", "heavy"])
def test_order_statistics_are_exact(spark, kind):
    rng = np.random.default_rng(7)
    n = 60_000
    v = {"smooth": rng.normal(size=n), "ties": rng.integers(0, 5, n).astype(float), "heavy": np.exp(6 * rng.normal(size=n))}[kind]
    g = np.where(np.arange(n) % 3 == 0, "hot", "rest")
    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v})).repartition(5)
    out = V.order_statistics(df, ["g"], "v", 0.5, {"k": F.floor((F.col("n") + 1) / 2)}, accuracy=500).collect()
    assert {r.g: r.k for r in out} == {u: np.sort(v[g == u])[(np.sum(g == u) + 1) // 2 - 1] for u in ("hot", "rest")}


def test_order_statistics_of_small_groups_take_the_same_path(spark):
    rng = np.random.default_rng(3)
    sizes = {f"g{n}": n for n in (1, 2, 3, 10, 999, 1000, 1001, 5000)}
    values = {g: np.round(rng.normal(size=n), 1) for g, n in sizes.items()}
    df = spark.createDataFrame(pd.DataFrame([(g, float(x)) for g, v in values.items() for x in v], columns=["g", "v"])).repartition(3)
    n = F.col("n")
    ranks = {"low": F.lit(1), "k": F.floor((n + 1) / 2), "high": n, "out": n + 1}
    out = {r.g: (r.low, r.k, r.high, r.out) for r in V.order_statistics(df, ["g"], "v", 0.5, ranks, accuracy=500).collect()}
    assert out == {g: (v.min(), np.sort(v)[(len(v) + 1) // 2 - 1], v.max(), None) for g, v in values.items()}


def test_summary_stats(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, np.nan, 10.0], "b": [5.0, np.nan, np.nan, 5.0]})
    df = spark.createDataFrame([(1.0, 5.0), (2.0, None), (None, None), (10.0, 5.0)], "a double, b double")
    for r in D.summary_stats(df, ["a", "b"]).collect():
        s = pdf[r.variable]
        want = [s.count(), s.mean(), s.std(), s.min(), s.median(), s.max()]
        assert np.allclose([r.n, r["mean"], r.sd, r["min"], r["median"], r["max"]], want)


def test_shares_sum_to_one_and_round_trip(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 2.0)], "u string, n string, v double")
    sums = V.share_of_total(df, "v", ["u"]).groupBy("u").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in sums)
    back = R.unpivot_measures(R.pivot_measures(df, ["u"], "n", "v", ["x", "y"]), ["u"], "n", "v").where("v IS NOT NULL")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_supplier_exit(spark):
    rows = [("m", 1, 1.0, 1.0, False), ("m", 2, 2.0, 1.0, False), ("m", 3, 3.0, 1.0, True)]
    df = spark.createDataFrame(rows, "m string, s int, c double, a double, gone boolean")
    out = {r.s: r for r in E.supplier_exit(df, "m", "s", "c", "a", "gone").collect()}
    assert abs(out[1].q_before - 35 / 176) < 1e-12 and out[3].q_after is None
    for s, c in ((1, 1.0), (2, 2.0)):  # first-order conditions before and after
        rivals = sum(out[o].q_before for o in out if o != s)
        assert abs(2 * (c + 1) * out[s].q_before + rivals - 1) < 1e-12
        rivals = sum(out[o].q_after for o in (1, 2) if o != s)
        assert abs(2 * (c + 1) * out[s].q_after + rivals - 1) < 1e-12
    assert out[1].relation == "Diff1 = Diff2" and out[2].relation == "Diff1 > Diff2"


def test_edges_and_degree(spark):
    f = spark.createDataFrame([("a", "b", 5.0), ("a", "c", None), ("b", "a", 1.0)], "exporter string, importer string, value double")
    e = N.edges(f, 0.5)
    assert {(r.name, r.out_links, r.in_links) for r in N.degree(e).collect()} == {("a", 1, 1), ("b", 1, 1)}
    assert {r.name for r in N.vertices(e).collect()} == {"a", "b"}


def test_histogram(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=2000)
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    out = PD.histogram(df, "v", bins=30).toPandas().sort_values("bin")
    width = (v.max() - v.min()) / 29
    start = width / 2 + np.floor((v.min() - width / 2) / width) * width
    edges = start + width * np.arange(32)
    want = np.histogram(-v, bins=np.sort(-edges))[0][::-1]  # right-closed bins
    assert out["count"].sum() == 2000
    assert dict(zip(out["bin"], out["count"])) == {i: c for i, c in enumerate(want) if c}


def test_loess(spark):
    rng = np.random.default_rng(5)
    x = np.sort(rng.uniform(0, 10, 150))
    y = np.sin(x) + 0.1 * rng.normal(size=150)
    df = spark.createDataFrame(pd.DataFrame({"f": "a", "x": x, "y": y})).repartition(4)
    out = PD.smooth_loess(df, "x", "y", n=20, facet=["f"]).toPandas().sort_values("point")
    want = []
    for g in np.linspace(x.min(), x.max(), 20):
        d = np.abs(x - g)
        h = np.sort(d)[int(np.floor(150 * 0.75 + 1e-5)) - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
        m = np.vander(x - g, 3, increasing=True)
        want.append(np.linalg.lstsq(m * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0][0])
    assert np.allclose(out["y"], want, atol=1e-8)


def test_loess_returns_every_point(spark):
    heavy = [("heavy", 5.0, float(i)) for i in range(90)] + [("heavy", float(i), 2.0) for i in range(10) if i != 5]
    df = spark.createDataFrame(heavy + [("one", 3.0, 1.0), ("one", 3.0, 2.0)], "f string, x double, y double").repartition(3)
    out = PD.smooth_loess(df, "x", "y", n=10, facet=["f"]).toPandas()
    assert out.groupby("f").size().to_dict() == {"heavy": 10, "one": 10}
    assert out[out.f == "heavy"].y.notna().all() and out[out.f == "one"].y.isna().all()
    at = out[(out.f == "heavy") & (out.x == 5.0)].y.item()  # nothing but the tied rows lies inside the next distance
    assert abs(at - 44.5) < 1e-9


def test_axis_limits_come_first(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (4.0, 1000.0)], "x double, y double")
    line = PD.smooth_lm(df, "x", "y", n=3, ylim=(0.0, 10.0)).orderBy("point").collect()
    assert [round(r.y, 9) for r in line] == [0.0, 1.5, 3.0]


def test_smallest_draws(spark):
    rows = [(i, f"{i * 2654435761 % 2**32:08x}" + "0" * 24) for i in range(500)] + [(i, "7" * 32) for i in range(500, 560)]
    df = spark.createDataFrame(rows, "i int, h string").repartition(5)
    for n in (0, 1, 37, 250, 559, 560, 900):
        got = [r.h for r in V.smallest_draws(df, "h", n, ["i"], digits=1, few=3).collect()]
        assert sorted(got) == sorted(h for _, h in rows)[:n]
