"""Fixed effects on awkward panels: long chains, disconnected blocks, groups that settle at different times."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from paneloom.operators import fixedfx as FX
from paneloom.operators import network as N
from paneloom.session import cut_lineage, drop_stage, stage_scope, stages


def panel(cells, seed=0):
    rng = np.random.default_rng(seed)
    p = pd.DataFrame(cells, columns=["i", "t"])
    a = rng.normal(size=p.i.max() + 1)
    p["x"] = rng.normal(size=len(p)) + a[p.i]
    return p.assign(y=2 * p.x + a[p.i] + 0.1 * p.t + rng.normal(size=len(p)))


CHAIN = [(i, t) for i in range(10) for t in range(10) if abs(i - t) <= 1]


def dense(p, keys=("i", "t")):
    """Slope, its classical error and the rank of the effects."""
    z = np.column_stack([pd.get_dummies(p[k]).to_numpy(dtype=float) for k in keys])
    x, y = (v - z @ np.linalg.lstsq(z, v, rcond=None)[0] for v in (p.x.to_numpy(), p.y.to_numpy()))
    b, rank = x @ y / (x @ x), np.linalg.matrix_rank(z)
    return b, np.sqrt(((y - b * x) ** 2).sum() / (len(p) - rank - 1) / (x @ x)), rank


def alternations(p, tol=1e-10):
    """Projections that plain alternation needs for the slower of both variables."""
    most = 0
    for v in (p.x, p.y):
        levels, n, calm = {"i": pd.Series(0.0, p.i.unique()), "t": pd.Series(0.0, p.t.unique())}, 0, 0
        while not calm:
            for k, other in (("i", "t"), ("t", "i")):
                new = (v - p[other].map(levels[other])).groupby(p[k]).mean()
                calm, n = n > 1 and (new - levels[k]).abs().max() / v.std() <= tol, n + 1
                levels[k] = new
                if calm:
                    break
        most = max(most, n)
    return most


def test_chain_settles_in_half_of_the_rounds(spark):
    p = panel(CHAIN)
    before = len(stages(spark))
    prob = FX._Cells(spark.createDataFrame(p), "y", ["x"], ["i", "t"], [], [])
    levels = prob.solve(1e-10, 1000)
    assert prob.rounds <= alternations(p) / 2
    assert len(stages(spark)) - before <= 1 + len(levels)  # the cells and the levels; rounds are dropped
    beta = FX.feols_from(prob, levels).first()["__beta"][0]
    assert abs(beta - dense(p)[0]) < 1e-8


def test_groups_settle_apart(spark):
    full = [(i, t) for i in range(8) for t in range(6)]
    parts = {"chain": panel(CHAIN, 1), None: panel(full, 2), "some": panel([c for k, c in enumerate(full) if k % 5], 3)}
    df = spark.createDataFrame(pd.concat([p.assign(g=g) for g, p in parts.items()])).repartition(3)
    got = {r["g"]: r["estimate"] for r in FX.feols(df.where("g IS NOT NULL"), "y", ["x"], ["i", "t"], by=["g"]).collect()}
    assert got.keys() == {"chain", "some"}
    assert all(abs(b - dense(parts[g])[0]) < 1e-8 for g, b in got.items())


def test_disconnected_blocks(spark):
    blocks = [(i, t) for i in range(10) for t in range(4) if (i + t) % 4] + [(i, t) for i in range(10, 16) for t in range(4, 9) if (i + t) % 3]
    p = panel(blocks, 4)
    df = spark.createDataFrame(p)
    b, se, rank = dense(p)
    assert rank == p.i.nunique() + p.t.nunique() - 2
    out = FX.feols(df, "y", ["x"], ["i", "t"], cluster=[]).first()
    assert abs(out["estimate"] - b) < 1e-8 and abs(out["std_error"] - se) < 1e-8
    eff = FX.fixef(df, "y", ["x"], ["i", "t"]).toPandas()
    assert len(eff) == p.i.nunique() + p.t.nunique()
    of = {k: eff[eff.fe == k].assign(level=lambda e: e.level.astype(int)).set_index("level").effect for k in ("i", "t")}
    assert of["t"][0] == 0 and of["t"][4] == 0  # one reference level in each block
    rest = p.y - b * p.x - p.i.map(of["i"]) - p.t.map(of["t"])
    assert rest.groupby(p.i).mean().abs().max() < 1e-8 and rest.groupby(p.t).mean().abs().max() < 1e-8


def test_interacted_keys_lose_one_level_a_year(spark):
    rng = np.random.default_rng(5)
    rows = [(i, j, s) for i in range(6) for j in range(6) for s in range(3) if rng.random() > 0.3]
    p = pd.DataFrame(rows, columns=["i", "j", "s"])
    p["x"], p["e"] = rng.normal(size=len(p)), rng.normal(size=len(p))
    p["y"] = p.x + p.i * p.s + p.j + p.e
    p["is"], p["js"] = p.i * 10 + p.s, p.j * 10 + p.s
    b, se, rank = dense(p, ("is", "js"))
    out = FX.feols(spark.createDataFrame(p), "y", ["x"], [("i", "s"), ("j", "s")], cluster=[]).first()
    assert rank <= p["is"].nunique() + p["js"].nunique() - 3
    assert abs(out["estimate"] - b) < 1e-8 and abs(out["std_error"] - se) < 1e-8


def test_empty_panel(spark):
    df = spark.createDataFrame(panel(CHAIN)).where("false")
    assert FX.feols(df, "y", ["x"], ["i", "t"], by=["t"]).count() == 0


def test_connected_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 480)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    root = {n: n for pair in links for n in pair}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = N.connected_components(spark.createDataFrame(links, "src long, dst long")).collect()
    assert {r["name"]: r["component"] for r in got} == root and len(got) == len(root)


def test_stages_end_with_their_scope(spark):
    before = stages(spark)
    with stage_scope(spark):
        one = cut_lineage(spark.range(5).withColumn("v", F.lit(1)))
        two = cut_lineage(one.where("id > 1"))
        drop_stage(one)
        assert two.count() == 3 and len(stages(spark)) == len(before) + 1
    assert stages(spark) == before
