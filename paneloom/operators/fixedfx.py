"""Regressions with many-level fixed effects.

The rows are first summed to cells (one per combination of effect and cluster
keys), each holding its row count, means and centred co-moments. All later work
is on cells and level tables; the rows are read once. The first key's levels are
eliminated, the others found by conjugate gradients: every round joins small
level tables (one row per effect level) to the cells and sums what is left, once
per key. Groups that have settled leave the rounds. The cells stay spread by
their full key, so a level that covers a third of the rows is summed map-side
like any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.operators.linreg import _by_fields, _symmetric, coef_frame, coef_schema, design, solve_normal
from paneloom.operators.network import connected_components
from paneloom.operators.verbs import attach, lookup, quoted
from paneloom.session import append_stage, cut_lineage, drop_stage

Key = str | Sequence[str]


def _tuple(key: Key) -> tuple[str, ...]:
    return (key,) if isinstance(key, str) else tuple(key)


class _Cells:
    """Cells of a fixed-effect problem and the projections on their levels."""

    def __init__(self, df: DataFrame, y: str, x: Sequence[str], fe: Sequence[Key], by: Sequence[str], cluster: Sequence[Key]):
        self.by = list(by)
        self.fe = [_tuple(k) for k in fe]
        self.cluster = [_tuple(k) for k in cluster]
        self.keys = list(dict.fromkeys([*by, *[c for k in self.fe + self.cluster for c in k]]))
        rows, self.terms = design(df, y, x, self.keys)
        for c in self.keys:
            rows = rows.where(F.col(c).isNotNull())
        self.k = len(self.terms)
        self.vars = ["y", *[f"x{i}" for i in range(self.k)]]
        self.pairs = [(p, q) for i, p in enumerate(self.vars) for q in self.vars[i:]]
        # Expressions are given as SQL text: models with many regressors have hundreds of them.
        self.cells = cut_lineage(
            rows.groupBy(*self.keys).agg(
                F.expr("count(1) AS __n"),
                *[F.expr(f"avg(__{p}) AS __m_{p}") for p in self.vars],
                *[F.expr(f"covar_pop(__{p}, __{q}) * count(1) AS __w_{p}_{q}") for p, q in self.pairs],
            )
        )

    def level_keys(self, i: int) -> list[str]:
        return list(dict.fromkeys([*self.by, *self.fe[i]]))

    def remainder(self, levels: dict[int, DataFrame], skip: int | None = None) -> tuple[DataFrame, dict[str, str]]:
        """Cells joined to the level effects (but ``skip``), and per variable what the effects leave over."""
        d = self.cells
        left = {p: f"__m_{p}" for p in self.vars}
        for i, table in levels.items():
            if i == skip:
                continue
            d = lookup(d, table, self.level_keys(i), {f"__f_{p}": f"__f{i}_{p}" for p in self.vars}, how="inner")
            left = {p: f"{left[p]} - __f{i}_{p}" for p in self.vars}
        return d, left

    def project(self, i: int, levels: dict[int, DataFrame]) -> DataFrame:
        """Level means of what the other effects leave over."""
        d, left = self.remainder(levels, skip=i)
        return d.groupBy(*self.level_keys(i)).agg(*[F.expr(f"sum(__n * ({left[p]})) / sum(__n) AS __f_{p}") for p in self.vars])

    def solve(self, tol: float, max_iter: int) -> dict[int, DataFrame]:
        """Levels of every effect at convergence; ``self.rounds`` counts the tables written on the way.

        The levels u of all keys but the first solve S u = b, where S sums, by
        level, what the cells keep of u after the first key's means are taken
        off. Conjugate gradients with the row counts as preconditioner take one
        pass by the first key and one by each other key in a round, as many as
        alternating projections, but need about the square root of their
        rounds. Both sums of a round come from one reduction. All variables of
        all groups go together, each with step lengths of its own.

        A group has settled once its remaining level means are below ``tol``
        times the spread of every variable (or below rounding); its levels are
        put aside and its cells leave by the join. When half of the groups
        have left, the cells of the others are written anew.
        """
        q = len(self.fe)
        self.rounds = 1
        if q == 1:
            return {0: cut_lineage(self.project(0, {}))}
        each = lambda text: [text.format(p=p) for p in self.vars]
        first, others = self.level_keys(0), {i: self.level_keys(i) for i in range(1, q)}
        scale = cut_lineage(
            self.cells.groupBy(*self.by).agg(
                *[
                    F.expr(f"pow({tol}, 2) * (sum(__w_{p}_{p}) + var_pop(__m_{p}) * sum(__n)) + 1e-28D * sum(__n * __m_{p} * __m_{p}) AS __e_{p}")
                    for p in self.vars
                ]
            )
        )
        cells = self.cells
        means = cut_lineage(cells.groupBy(*first).agg(*[F.expr(t) for t in each("sum(__n * __m_{p}) / sum(__n) AS __t_{p}")]))
        met = lookup(cells, means, first, [f"__t_{p}" for p in self.vars], how="inner")
        state, done = {}, dict.fromkeys(others)
        for i, keys in others.items():
            start = met.groupBy(*keys).agg(F.expr("sum(__n) AS __n"), *[F.expr(t) for t in each("sum(__n * (__m_{p} - __t_{p})) AS __r_{p}")])
            state[i] = cut_lineage(start.selectExpr("*", *[f"0D AS __{c}_{p}" for c in "xpsga" for p in self.vars]))
        drop_stage(means)
        self.rounds += 1 + len(others)
        groups = None
        for _ in range(max_iter):
            # what is left of each group, and which groups have settled
            left = [t.groupBy(*self.by).agg(*[F.expr(x) for x in each("sum(__r_{p} * __r_{p} / __n) AS __c_{p}")]) for t in state.values()]
            total = self._added(left, [f"__c_{p}" for p in self.vars])
            small = " AND ".join(each("__c_{p} <= __e_{p}"))
            judged = cut_lineage(attach(total, scale, self.by).selectExpr(*map(quoted, self.by), f"({small}) AS __settled"))
            counts = {r["__settled"]: r["count"] for r in judged.groupBy("__settled").count().collect()}
            if counts.get(True):
                for i, keys in others.items():
                    over = attach(state[i], judged.where("__settled"), self.by)
                    done[i] = append_stage(over.selectExpr(*map(quoted, keys), *each("__x_{p} AS __f_{p}")), done[i])
            active = counts.get(False, 0)
            if not active:
                for i, keys in others.items():
                    if done[i] is None:  # no rows, no groups
                        done[i] = cut_lineage(state[i].selectExpr(*map(quoted, keys), *each("__x_{p} AS __f_{p}")))
                drop_stage(judged, scale, *[getattr(t, "_read", t) for t in state.values()])
                break
            if counts.get(True):
                going = judged.where("NOT __settled").drop("__settled")
                state = {i: self._kept(t, going) for i, t in state.items()}
                groups = groups or sum(counts.values())
                if 2 * active <= groups:
                    smaller = cut_lineage(self._kept(cells, going))
                    drop_stage(cells if cells is not self.cells else None)
                    cells, groups = smaller, active
            state = self._round(cells, state, first, others)
            drop_stage(judged)
        else:
            raise RuntimeError(f"effects did not settle in {max_iter} rounds")
        drop_stage(cells if cells is not self.cells else None)
        self.rounds += 1
        return {0: cut_lineage(self.project(0, done))} | done

    def _kept(self, table: DataFrame, groups: DataFrame) -> DataFrame:
        """Rows of some groups; the stage that they are read from goes along."""
        if not self.by:
            return table
        out = attach(table, groups, self.by)
        out._read = getattr(table, "_read", table)
        return out

    def _added(self, tables: list[DataFrame], sums: list[str]) -> DataFrame:
        """Per-group sums of several tables, added up."""
        if len(tables) == 1:
            return tables[0]
        whole = tables[0]
        for t in tables[1:]:
            whole = whole.unionByName(t)
        return whole.groupBy(*self.by).agg(*[F.expr(f"sum({c}) AS {c}") for c in sums])

    def _round(self, cells: DataFrame, state: dict[int, DataFrame], first: list[str], others: dict[int, list[str]]) -> dict[int, DataFrame]:
        """One round of conjugate gradients: S times the preconditioned rest, one reduction, all updates."""
        each = lambda text: [text.format(p=p) for p in self.vars]
        met, u = cells, {p: [] for p in self.vars}
        for i, keys in others.items():
            table = state[i].selectExpr(*map(quoted, keys), *[f"__r_{p} / __n AS __u{i}_{p}" for p in self.vars])
            met = lookup(met, table, keys, [f"__u{i}_{p}" for p in self.vars], how="inner")
            for p in self.vars:
                u[p].append(f"__u{i}_{p}")
        step = {p: " + ".join(names) for p, names in u.items()}
        means = cut_lineage(met.groupBy(*first).agg(*[F.expr(f"sum(__n * ({step[p]})) / sum(__n) AS __t_{p}") for p in self.vars]))
        met = lookup(met, means, first, [f"__t_{p}" for p in self.vars], how="inner")
        applied = {}
        for i, keys in others.items():
            summed = met.groupBy(*keys).agg(*[F.expr(f"sum(__n * ({step[p]} - __t_{p})) AS __w_{p}") for p in self.vars])
            applied[i] = cut_lineage(lookup(state[i], summed, keys, [f"__w_{p}" for p in self.vars], how="inner"))
            self.rounds += 1
        self.rounds += 1
        drop_stage(means, *[getattr(t, "_read", t) for t in state.values()])
        sums = [x for p in self.vars for x in (f"__c_{p}", f"__d_{p}")]
        products = each("sum(__r_{p} * __r_{p} / __n) AS __c_{p}") + each("sum(__w_{p} * __r_{p} / __n) AS __d_{p}")
        steps = self._added([t.groupBy(*self.by).agg(*[F.expr(x) for x in products]) for t in applied.values()], sums)
        out = {}
        for i, keys in others.items():
            t = attach(applied[i], steps, self.by)
            # g and a are the last rest and step length of the group, 0 before the first round
            t = t.selectExpr("*", *each("coalesce(try_divide(__c_{p}, __g_{p}), 0D) AS __b_{p}"))
            t = t.selectExpr("*", *each("coalesce(try_divide(__c_{p}, __d_{p} - coalesce(try_divide(__b_{p} * __c_{p}, __a_{p}), 0D)), 0D) AS __l_{p}"))
            t = t.selectExpr("*", *each("__r_{p} / __n + __b_{p} * __p_{p} AS __np_{p}"), *each("__w_{p} + __b_{p} * __s_{p} AS __ns_{p}"))
            new = each("__x_{p} + __l_{p} * __np_{p} AS __x_{p}") + each("__r_{p} - __l_{p} * __ns_{p} AS __r_{p}")
            new += each("__np_{p} AS __p_{p}") + each("__ns_{p} AS __s_{p}") + each("__c_{p} AS __g_{p}") + each("__l_{p} AS __a_{p}")
            out[i] = t.selectExpr(*map(quoted, keys), "__n", *new)
            out[i]._read = applied[i]
        return out

    def pieces(self, i: int, j: int) -> tuple[DataFrame, DataFrame]:
        """Connected components of the graph of two keys' levels: per key, by, its levels and their component.

        A group in which one level meets all levels of the other key is one
        component; only the links of other groups are followed.
        """
        a, b = self.level_keys(i), self.level_keys(j)
        links = cut_lineage(self.cells.select(*dict.fromkeys([*a, *b])).distinct())
        sizes = links.select(*b).distinct().groupBy(*self.by).agg(F.count(F.lit(1)).alias("__all"))
        met = links.groupBy(*a).agg(F.count(F.lit(1)).alias("__met"))
        whole = cut_lineage(attach(met, sizes, self.by).groupBy(*self.by).agg(F.max(F.col("__met") == F.col("__all")).alias("__whole")))
        found = None
        if not whole.where("NOT __whole").isEmpty():
            name = lambda side, keys: F.concat(F.lit(side), F.to_json(F.struct(*[F.col(c).alias(f"k{n}") for n, c in enumerate(keys)])))
            followed = attach(links, whole, self.by).where("NOT __whole")
            found = cut_lineage(connected_components(followed.select(name("a", a).alias("src"), name("b", b).alias("dst"))))
        out = []
        for side, keys in (("a", a), ("b", b)):
            levels = links.select(*keys).distinct()
            if found is None:
                out.append(levels.withColumn("component", F.lit("")))
                continue
            named = lookup(levels.withColumn("__name", name(side, keys)), found, {"__name": "name"}, ["component"])
            out.append(named.select(*keys, F.coalesce("component", F.lit("")).alias("component")))
        return out[0], out[1]

    def lost(self, i: int) -> DataFrame:
        """by, lost: levels of key i that those of an earlier key already express.

        That is one per component of the graph of the two keys, which is exact
        for two keys; with more, the earlier key with the most components
        counts, a lower bound.
        """
        counts = None
        for j in range(i):
            one = self.pieces(i, j)[0].groupBy(*self.by).agg(F.countDistinct("component").alias("lost"))
            counts = one if counts is None else counts.unionByName(one)
        return counts.groupBy(*self.by).agg(F.max("lost").alias("lost"))


def feols(
    df: DataFrame,
    y: str,
    x: Sequence[str],
    fe: Sequence[Key],
    by: Sequence[str] = (),
    cluster: Sequence[Key] | None = None,
    small_sample: bool = True,
    count_effects: str = "nested",
    tol: float = 1e-10,
    max_iter: int = 1000,
    conf_level: float = 0.95,
) -> DataFrame:
    """Linear regression with fixed effects, for every group of ``by`` in one run.

    ``fe`` lists effect keys; a tuple is an interacted key. ``cluster`` defaults
    to the first effect; one or two cluster keys are supported (the two-way
    variance is V(a) + V(b) - V(ab)); ``[]`` gives classical standard errors.
    ``count_effects`` says which effect levels count as parameters in the
    small-sample factor: ``nested`` leaves out effects nested in a cluster key
    (the key's columns are among the effect's), ``full`` counts all, ``none`` no
    level. Returns the columns of ``ols`` and within_r2.
    """
    cluster = [_tuple(fe[0])] if cluster is None else [_tuple(c) for c in cluster]
    if len(cluster) > 2:
        raise ValueError("at most two cluster keys")
    prob = _Cells(df, y, x, fe, by, cluster)
    levels = prob.solve(tol, max_iter)
    d, left = prob.remainder(levels)
    # Within means of a cell; rows inside a cell add the centred co-moments.
    cells = d.selectExpr(
        *map(quoted, prob.keys),
        "__n",
        "__m_y",
        *[f"{left[p]} AS __r_{p}" for p in prob.vars],
        *[f"__w_{p}_{q}" for p, q in prob.pairs],
    )
    k = prob.k
    names = {v: i for i, v in enumerate(prob.vars[1:])}

    def cross(p: str, q: str) -> tuple[Column, str]:
        """Sum of within products of two variables, and its column name."""
        name = "__yy" if q == "y" else (f"__b{names[q]}" if p == "y" else f"__a{names[p]}_{names[q]}")
        return F.expr(f"sum(__w_{p}_{q} + __n * __r_{p} * __r_{q}) AS {name}"), name

    products = [cross(p, q) for p, q in prob.pairs]
    sandwiches = cluster + ([tuple(dict.fromkeys(cluster[0] + cluster[1]))] if len(cluster) == 2 else [])
    # Cross-products per cluster hold all that the scores need, so the cells are summed before slopes are known.
    total = F.expr("sum(__w_y_y) + sum(__n * __m_y * __m_y) - sum(__n * __m_y) * sum(__n * __m_y) / sum(__n) AS __tss")
    moments = cells.groupBy(*prob.by).agg(F.expr("sum(__n) AS __n"), total, *[c for c, _ in products])
    per_cluster = [
        cells.groupBy(*dict.fromkeys([*by, *key])).agg(*[c for c, name in products if name != "__yy"]) for key in sandwiches
    ]
    for i, table in levels.items():
        moments = attach(moments, table.groupBy(*prob.by).agg(F.count(F.lit(1)).alias(f"__g{i}")), prob.by)
    counted = count_effects != "none" or not cluster
    for i in range(1, len(prob.fe)):
        moments = attach(moments, prob.lost(i).withColumnRenamed("lost", f"__lost{i}"), prob.by) if counted else moments.withColumn(f"__lost{i}", F.lit(1))

    fields, by_list, terms = _by_fields(df, by), list(by), prob.terms
    fe_keys, clusters, q = prob.fe, cluster, len(prob.fe)
    nested = [any(set(c) <= set(key) for c in clusters) for key in fe_keys]
    fit_schema = T.StructType(list(moments.schema.fields)).add("__beta", T.ArrayType(T.DoubleType()))

    def fit(pdf: pd.DataFrame):
        a = _symmetric(pdf, k, "a")
        b = np.stack([pdf[f"__b{i}"].to_numpy(dtype=float) for i in range(k)], axis=1)
        return *solve_normal(a, b), b

    def with_beta(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(__beta=list(fit(pdf)[0]))

    fitted_moments = cut_lineage(moments.mapInPandas(with_beta, fit_schema))
    final = fitted_moments.drop("__beta")
    for c, table in enumerate(per_cluster):
        table = attach(table, fitted_moments.select(*by, "__beta"), by)
        pair = lambda i, j: f"__a{min(i, j)}_{max(i, j)}"
        scores = [f"__b{i} - (" + " + ".join(f"__beta[{j}] * {pair(i, j)}" for j in range(k)) + f") AS __s{i}" for i in range(k)]
        meat = table.selectExpr(*map(quoted, by), *scores).groupBy(*by).agg(
            F.expr(f"count(1) AS __c{c}"),
            *[F.expr(f"sum(__s{i} * __s{j}) AS __v{c}_{i}_{j}") for i in range(k) for j in range(i, k)],
        )
        final = attach(final, meat, by)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            beta, inverse, used, b = fit(pdf)
            nobs, yy, tss = (pdf[c].to_numpy(dtype=float) for c in ("__n", "__yy", "__tss"))
            ssr = np.maximum(yy - np.einsum("gi,gi->g", beta, b), 0.0)
            sizes = np.stack([pdf[f"__g{i}"].to_numpy(dtype=float) for i in range(q)], axis=1)
            # levels of a later key that earlier keys express: one per component of their graph
            lost = np.stack([np.zeros(len(pdf)), *[pdf[f"__lost{i}"].to_numpy(dtype=float) for i in range(1, q)]], axis=1)
            slopes = used.sum(axis=1)
            every = slopes + (sizes - lost).sum(axis=1)
            if count_effects == "none":
                params = slopes
            elif count_effects == "nested" and clusters:
                free = [i for i in range(q) if not nested[i]]
                params = slopes + ((sizes - lost)[:, free].sum(axis=1) + lost[:, free[0]] if free else 1)
            else:
                params = every
            with np.errstate(all="ignore"):
                if clusters:
                    cov = 0.0
                    groups = np.stack([pdf[f"__c{c}"].to_numpy(dtype=float) for c in range(len(clusters))], axis=1).min(axis=1)
                    for c in range(len(sandwiches)):
                        sign = -1.0 if c == 2 else 1.0
                        cov = cov + sign * inverse @ _symmetric(pdf, k, f"v{c}_") @ inverse
                    if small_sample:
                        cov = cov * (groups / (groups - 1) * (nobs - 1) / (nobs - params))[:, None, None]
                    dof = groups - 1
                else:
                    dof = nobs - every
                    cov = inverse * np.where(dof > 0, ssr / dof, np.nan)[:, None, None]
                r2 = np.where(tss > 0, 1 - ssr / tss, np.nan)
                within_r2 = np.where(yy > 0, 1 - ssr / yy, np.nan)
            std = np.sqrt(np.clip(np.einsum("gii->gi", cov), 0.0, None))
            out = coef_frame(
                pdf[by_list], terms, np.where(used, beta, np.nan), np.where(used, std, np.nan), nobs, r2, dof, conf_level
            )
            yield out.assign(within_r2=np.repeat(within_r2, k))

    return final.mapInPandas(finish, coef_schema(fields, ["within_r2"]))


def fixef(
    df: DataFrame, y: str, x: Sequence[str], fe: Sequence[Key], by: Sequence[str] = (), tol: float = 1e-10, max_iter: int = 1000
) -> DataFrame:
    """Level effects: by, fe (key name), level, effect.

    Effects of two keys are determined up to a constant for each connected
    component of the graph of their levels. In each component that a later key
    forms with the first one, the key's first level (in sort order) is set to 0
    and the first key's levels take the shift.
    """
    prob = _Cells(df, y, x, fe, by, [])
    levels = prob.solve(tol, max_iter)
    coefs = cut_lineage(feols_from(prob, levels))
    tables = {}
    for i, table in levels.items():
        effect = F.col("__f_y")
        for j in range(prob.k):
            effect = effect - F.col("__beta")[j] * F.col(f"__f_x{j}")
        level = F.concat_ws("^", *[F.col(c).cast("string") for c in prob.fe[i]])
        tables[i] = attach(table, coefs, prob.by).select(*prob.level_keys(i), level.alias("__level"), effect.alias("__effect"))
    for i in range(1, len(tables)):
        own, first = prob.pieces(i, 0)
        keys = [*prob.by, "component"]
        mine = lookup(tables[i], own, prob.level_keys(i), ["component"])
        base = cut_lineage(mine.groupBy(*keys).agg(F.min_by("__effect", "__level").alias("__base")))
        tables[i] = attach(mine, base, keys).withColumn("__effect", F.col("__effect") - F.col("__base")).drop("__base", "component")
        shifted = attach(lookup(tables[0], first, prob.level_keys(0), ["component"]), base, keys)
        tables[0] = shifted.withColumn("__effect", F.col("__effect") + F.col("__base")).drop("__base", "component")
    out = None
    for i, t in tables.items():
        named = t.select(*prob.by, F.lit("^".join(prob.fe[i])).alias("fe"), F.col("__level").alias("level"), F.col("__effect").alias("effect"))
        out = named if out is None else out.unionByName(named)
    return out


def feols_from(prob: _Cells, levels: dict[int, DataFrame]) -> DataFrame:
    """by, __beta: slopes from solved levels."""
    d, left = prob.remainder(levels)
    k = prob.k
    names = {v: i for i, v in enumerate(prob.vars[1:])}
    moments = d.groupBy(*prob.by).agg(
        *[
            F.expr(f"sum(__w_{p}_{q} + __n * ({left[p]}) * ({left[q]})) AS " + (f"__b{names[q]}" if p == "y" else f"__a{names[p]}_{names[q]}"))
            for p, q in prob.pairs
            if q != "y"
        ]
    )
    by_list = prob.by
    schema = T.StructType([moments.schema[c] for c in by_list]).add("__beta", T.ArrayType(T.DoubleType()))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                b = np.stack([pdf[f"__b{i}"].to_numpy(dtype=float) for i in range(k)], axis=1)
                yield pdf[by_list].assign(__beta=list(solve_normal(_symmetric(pdf, k, "a"), b)[0]))

    return moments.mapInPandas(fit, schema)
