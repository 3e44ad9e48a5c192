"""Local quadratic smoothing of any number of rows, with a confidence band.

The rows of a facet are put in order of x and cut into blocks of near equal
count. With tricube weights a row's share in a local fit is a polynomial of its
distance on either side of the point, so a block that lies whole on one side
within the bandwidth enters by its power sums alone. Only the few blocks that
hold the point or an edge of its bandwidth are read row by row, and the same
holds for the search of the bandwidth. A row thus meets a handful of points,
whatever the span.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.functions.distributions import t_quantile
from paneloom.operators.ranges import prefix_sums
from paneloom.operators.verbs import attach, lookup, order_statistics, quoted
from paneloom.session import cut_lineage

#: Tricube weight on the side s of the point: (1 - s u^3)^3, as factors of u^0, u^3, u^6, u^9.
TRICUBE = ((0, 1, 0), (3, -3, 1), (6, 3, 0), (9, -1, 1))

#: Powers of x that the weights times u^4 need, and of y times x with u^2.
POWERS, MIXED = 14, 12

#: Rows of a task's share in the pass for the band.
CHUNK = 250_000


def bracket(a: np.ndarray, b: np.ndarray, w: np.ndarray, x: float, need: float) -> tuple[float, np.ndarray]:
    """Weight surely nearer to x than its need-th nearest row, and the blocks that may hold that row.

    Blocks are sorted spans [a, b] of weight w. Of the distances of all block
    ends, lo is the largest that the touched blocks can't fill, hi the least
    that whole blocks fill; the row lies between.
    """
    far = np.maximum(np.abs(a - x), np.abs(b - x))
    near = np.where((a <= x) & (x <= b), 0.0, np.minimum(np.abs(a - x), np.abs(b - x)))
    by_near, by_far = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
    touched, whole = np.cumsum(w[by_near]), np.cumsum(w[by_far])
    hi = far[by_far[np.searchsorted(whole, need)]]
    steps = np.concatenate([near, far])
    under = steps[np.concatenate(([0.0], touched))[np.searchsorted(near[by_near], steps, "right")] < need]
    lo = under.max() if len(under) else -1.0
    inside = far <= lo
    return float(w[inside].sum()), np.flatnonzero(~inside & (near <= hi))


def block_moments(a: np.ndarray, b: np.ndarray, sums: np.ndarray, mixed: np.ndarray, x: float, h: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted moments of u = (x_i - x) / h up to 4, those with y up to 2, of whole blocks; and the blocks to read by row."""
    touched = (b > x - h) & (a < x + h)
    right, left = touched & (a >= x) & (b <= x + h), touched & (b <= x) & (a >= x - h)
    far, cross = np.zeros(5), np.zeros(3)
    for side, take in ((1.0, right), (-1.0, left & ~right)):
        c, half = (a[take] + b[take]) / 2, np.where(b[take] > a[take], (b[take] - a[take]) / 2, 1.0)
        start, step = (c - x) / h, half / h
        for target, known, most in ((far, sums[take], POWERS), (cross, mixed[take], MIXED)):
            power = [sum(comb(m, j) * start ** (m - j) * step**j * known[:, j] for j in range(m + 1)).sum() for m in range(most)]
            for k in range(len(target)):
                target[k] += sum(f * side**s * power[k + m] for m, f, s in TRICUBE)
    return far, cross, np.flatnonzero(touched & ~right & ~left)


def vertices(a: np.ndarray, b: np.ndarray, w: np.ndarray, most: float) -> list[float]:
    """Ends of the cells of a partition: a cell of more than ``most`` rows is cut between blocks at its median."""
    before = np.concatenate(([0.0], np.cumsum(w)))

    def cut(i: int, j: int) -> list[float]:
        if j - i < 2 or before[j] - before[i] <= most:
            return []
        k = int(np.clip(np.searchsorted(before, (before[i] + before[j]) / 2), i + 1, j - 1))
        return [*cut(i, k), (b[k - 1] + a[k]) / 2, *cut(k, j)]

    return [a[0], *cut(0, len(a)), b[-1]]


def blend(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic weights of each vertex's value and slope at x: one row per x, values then slopes."""
    out = np.zeros((len(x), 2 * len(at)))
    if len(at) == 1 or at[-1] <= at[0]:
        out[:, 0] = 1.0
        return out
    k = np.clip(np.searchsorted(at, x, "right") - 1, 0, len(at) - 2)
    width, row = at[k + 1] - at[k], np.arange(len(x))
    t = (x - at[k]) / width
    out[row, k] = (1 + 2 * t) * (1 - t) ** 2
    out[row, k + 1] = t * t * (3 - 2 * t)
    out[row, len(at) + k] = t * (1 - t) ** 2 * width
    out[row, len(at) + k + 1] = t * t * (t - 1) * width
    return out


def operator_rows(x: np.ndarray, at: np.ndarray, h: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """What one row at x adds to each vertex's value and slope per unit of y."""
    u = (x[:, None] - at) / h
    weight = np.where(np.abs(u) < 1, (1 - np.abs(u) ** 3) ** 3, 0.0)
    basis = np.stack([weight, weight * u, weight * u * u], axis=-1)
    value = np.einsum("vk,nvk->nv", inverse[:, 0], basis)
    slope = np.einsum("vk,nvk->nv", inverse[:, 1], basis) / h
    return np.concatenate([value, slope], axis=1)


def _solved(a: np.ndarray) -> np.ndarray:
    """Pseudo-inverses of the 3 x 3 matrices of moments a0 to a4."""
    return np.linalg.pinv(np.stack([[a[:, i + j] for j in range(3)] for i in range(3)]).transpose(2, 0, 1), hermitian=True)


class LocalFit:
    """Fits at n grid points of each facet (and at the vertices of a partition, for the band).

    ``rows`` has facet columns, __x and __y without NULLs.
    """

    def __init__(self, rows: DataFrame, facet: Sequence[str], span: float, n: int, cell: float | None = None, blocks: int = 1024):
        self.facet, self.keys = list(facet), list(facet) or ["__all"]
        if not facet:
            rows = rows.withColumn("__all", F.lit(0))
        keys = self.keys
        rows = rows.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__n"), F.sum("__y").alias("__sy"), F.sum(F.col("__y") * F.col("__y")).alias("__syy"))
        placed = prefix_sums(rows, keys, ["__x"], {"__before": "__n"})
        whole = cut_lineage(rows.groupBy(*keys).agg(F.sum("__n").alias("__total")))
        placed = attach(placed, whole, keys).withColumn("__block", F.expr(f"cast(floor(__before * {float(blocks)}D / __total) as long)"))
        self.placed = cut_lineage(placed)
        ends = self.placed.groupBy(*keys, "__block").agg(F.min("__x").alias("__a"), F.max("__x").alias("__b"))
        ends = cut_lineage(ends)
        local = attach(self.placed, ends, [*keys, "__block"]).withColumn("__t", F.expr("(__x - (__a + __b) / 2) / CASE WHEN __b > __a THEN (__b - __a) / 2 ELSE 1D END"))
        power = lambda k: " * ".join(["1D", *["__t"] * k])
        self.blocks = cut_lineage(
            local.groupBy(*keys, "__block", "__a", "__b", "__total").agg(
                F.sum("__n").alias("__w"),
                F.array(*[F.expr(f"sum(__n * {power(k)})") for k in range(POWERS)]).alias("__sums"),
                F.array(*[F.expr(f"sum(__sy * {power(k)})") for k in range(MIXED)]).alias("__mixed"),
            )
        )
        self.points = self._points(span, n, cell)
        self.fits = self._fits()

    def _read(self, points: DataFrame) -> DataFrame:
        """The rows of the blocks that each point names in ``__read``."""
        named = points.withColumn("__block", F.explode("__read")).drop("__read")
        return lookup(self.placed, named, [*self.keys, "__block"], how="inner", null_safe=True)

    def _points(self, span: float, n: int, cell: float | None) -> DataFrame:
        """facet, point, x, __h: grid points from 0, vertices from n; the bandwidth is the distance of the nearest span share.

        Where no row lies strictly inside (many rows at one x), it is the next
        larger distance; NULL if there is none.
        """
        keys = self.keys

        def plan(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("__a")
            a, b, w = (group[c].to_numpy(float) for c in ("__a", "__b", "__w"))
            total = w.sum()
            need = max(np.floor(total * span + 1e-5), 1.0)
            at = list(a[0] + np.arange(n) * ((b[-1] - a[0]) / (n - 1))) + (vertices(a, b, w, np.floor(total * span * cell)) if cell else [])
            base, read = zip(*[bracket(a, b, w, x, need) for x in at])
            number = group["__block"].to_numpy()
            known = {"point": range(len(at)), "x": at, "__need": [int(need - s) for s in base], "__held": base, "__read": [number[r] for r in read]}
            return pd.DataFrame(known).assign(**dict(zip(keys, key)))[[*keys, *known]]

        extra = "point int, x double, __need long, __held double, __read array<bigint>"
        planned = cut_lineage(self.blocks.groupBy(*keys).applyInPandas(plan, self._ddl(extra)))
        met = self._read(planned).withColumn("__d", F.abs(F.col("__x") - F.col("x")))
        by = [*keys, "point", "x", "__need", "__held"]
        reach = order_statistics(met, by, "__d", span, {"__h": F.col("__need")}, [F.min("__d").alias("__least")], weight="__n", slices=512)
        reach = cut_lineage(reach.drop("n"))
        lone = reach.where("__held = 0 AND __least >= __h").select(*keys, "point", "x", "__h")
        beyond = attach(self.blocks.select(*keys, "__block", "__a", "__b"), lone, keys)
        sides = [
            beyond.where("__b > x + __h").groupBy(*keys, "point", "x", "__h").agg(F.min_by("__block", "__b").alias("__edge")),
            beyond.where("__a < x - __h").groupBy(*keys, "point", "x", "__h").agg(F.max_by("__block", "__a").alias("__edge")),
        ]
        edges = sides[0].union(sides[1]).groupBy(*keys, "point", "x", "__h").agg(F.collect_set("__edge").alias("__read"))
        apart = F.abs(F.col("__x") - F.col("x"))
        further = self._read(edges).where(apart > F.col("__h")).groupBy(*keys, "point").agg(F.min(apart).alias("__next"))
        out = lookup(reach, further, [*keys, "point"], ["__next"], null_safe=True)
        width = F.when((F.col("__held") == 0) & (F.col("__least") >= F.col("__h")), F.col("__next")).otherwise(F.col("__h"))
        return cut_lineage(out.select(*keys, "point", "x", width.alias("__h")))

    def _ddl(self, extra: str) -> T.StructType:
        return T.StructType([*[self.placed.schema[c] for c in self.keys], *T.StructType.fromDDL(extra).fields])

    def _fits(self) -> DataFrame:
        """facet, point, x, __h, y, slope and the inverse of the moment matrix."""
        keys = self.keys

        def whole_blocks(key: tuple, group: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("__a")
            a, b = (group[c].to_numpy(float) for c in ("__a", "__b"))
            sums, mixed = (np.stack(group[c].to_list()) if len(group) else np.zeros((0, k)) for c, k in (("__sums", POWERS), ("__mixed", MIXED)))
            number, out = group["__block"].to_numpy(), []
            for point, x, h in points[["point", "x", "__h"]].itertuples(index=False):
                far, cross, read = block_moments(a, b, sums, mixed, x, h)
                out.append((*key, point, x, h, [*far, *cross], number[read]))
            return pd.DataFrame(out, columns=[*keys, "point", "x", "__h", "__moments", "__read"])

        known = self.points.where("__h > 0")
        met = self.blocks.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInPandas(
            whole_blocks, self._ddl("point int, x double, __h double, __moments array<double>, __read array<bigint>")
        )
        met = cut_lineage(met)
        near = self._read(met.drop("__moments")).withColumn("__d", F.abs(F.col("__x") - F.col("x"))).where("__d < __h")
        near = near.selectExpr(*map(quoted, keys), "point", "__n", "__sy", "(__x - x) / __h AS __u", "pow(1 - pow(__d / __h, 3), 3) AS __w")
        power = lambda k: " * ".join(["__w"] + ["__u"] * k)
        sums = [F.expr(f"sum({power(k)} * __n)") for k in range(5)] + [F.expr(f"sum({power(k)} * __sy)") for k in range(3)]
        direct = near.groupBy(*keys, "point").agg(F.array(*sums).alias("__direct"))
        added = lookup(met, direct, [*keys, "point"], ["__direct"], null_safe=True).drop("__read")

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                direct = np.stack([np.zeros(8) if d is None else np.asarray(d) for d in pdf["__direct"]])
                moments = np.stack(pdf["__moments"].to_list()) + direct
                inverse = _solved(moments[:, :5])
                beta = np.einsum("gij,gj->gi", inverse, moments[:, 5:])
                yield pdf[[*keys, "point", "x", "__h"]].assign(y=beta[:, 0], slope=beta[:, 1] / pdf["__h"].to_numpy(), inverse=list(inverse.reshape(-1, 9)))

        return cut_lineage(added.mapInPandas(solve, self._ddl("point int, x double, __h double, y double, slope double, inverse array<double>")))

    def line(self, n: int) -> DataFrame:
        """facet, point, x, y of the grid; y is NULL where all rows are at one distance."""
        grid = self.points.where(F.col("point") < n).select(*self.keys, "point", "x")
        return lookup(grid, self.fits, [*self.keys, "point"], ["y"], null_safe=True)

    def band(self, n: int) -> DataFrame:
        """facet, point, norm, variance, df: length of the operator's row, residual variance and its degrees of freedom.

        The operator is blended from those at the vertices, so its traces need
        the products of the vertices' rows only: G of the rows that they lend,
        H of the weights that they are given. One pass over chunks of rows sums
        G, H, the trace and the residuals.
        """
        keys = self.keys
        model = self.fits.where(F.col("point") >= n).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("point", "x", "__h", "y", "slope", "inverse"))).alias("__v"))
        chunked = self.placed.withColumn("__chunk", F.expr(f"__before div {CHUNK}"))
        models = cut_lineage(attach(chunked.select(*keys, "__chunk").distinct(), model, keys))

        def sums(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            out = [*keys, "__sums"]
            if not len(known) or not len(rows):
                return pd.DataFrame(columns=out)
            v = known["__v"].iloc[0]
            at, h, y, slope = (np.array([r[c] for r in v], float) for c in ("x", "__h", "y", "slope"))
            inverse = np.array([r["inverse"] for r in v], float).reshape(-1, 3, 3)
            x, count, sy, syy = (rows[c].to_numpy(float) for c in ("__x", "__n", "__sy", "__syy"))
            given, lent = blend(x, at), operator_rows(x, at, h, inverse)
            fit = given @ np.concatenate([y, slope])
            rest = (syy - 2 * fit * sy + fit * fit * count).sum()
            trace = (count * (given * lent).sum(axis=1)).sum()
            g, hh = (lent * count[:, None]).T @ lent, (given * count[:, None]).T @ given
            return pd.DataFrame([(*key[:-1], [rest, trace, count.sum(), *g.ravel(), *hh.ravel()])], columns=out)

        parts = chunked.groupBy(*keys, "__chunk").cogroup(models.groupBy(*keys, "__chunk")).applyInPandas(sums, self._ddl("__sums array<double>"))
        total = parts.select(*keys, F.posexplode("__sums").alias("__at", "__s")).groupBy(*keys, "__at").agg(F.sum("__s").alias("__s"))
        total = total.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__at", "__s"))).alias("__total"))
        grid = attach(attach(self.points.where(F.col("point") < n).select(*keys, "point", "x"), total.select(*keys, F.col("__total.__s").alias("__total")), keys), model, keys)

        def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for x, total, v in zip(pdf["x"], pdf["__total"], pdf["__v"]):
                    at, size = np.array([r["x"] for r in v], float), 2 * len(v)
                    rest, trace, count = total[:3]
                    g, hh = (np.asarray(total[3 + k * size**2 : 3 + (k + 1) * size**2]).reshape(size, size) for k in range(2))
                    df = count - 2 * trace + (g * hh).sum()
                    given = blend(np.array([x]), at)[0]
                    out.append((np.sqrt(max(given @ g @ given, 0.0)), rest / df if df > 0 else np.nan, df))
                yield pdf[[*keys, "point"]].assign(**dict(zip(("norm", "variance", "df"), np.array(out).reshape(-1, 3).T)))

        return grid.mapInPandas(finish, self._ddl("point int, norm double, variance double, df double"))


def smooth_loess(rows: DataFrame, facet: Sequence[str], span: float, n: int, band: bool, cell: float, conf_level: float) -> DataFrame:
    """facet, point, x, y (and se, low, high) of the local smoother over ``rows`` (facet, __x, __y)."""
    fit = LocalFit(rows, facet, span, n, cell if band else None)
    line = fit.line(n)
    if not band:
        return line.select(*facet, "point", "x", "y")
    out = lookup(line, fit.band(n), [*fit.keys, "point"], ["norm", "variance", "df"], null_safe=True)
    out = out.withColumn("se", F.col("norm") * F.sqrt(F.greatest("variance", F.lit(0.0))))
    plain = T.StructType([*[out.schema[c] for c in facet], *T.StructType.fromDDL("point int, x double, y double, se double, low double, high double").fields])

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                half = t_quantile(conf_level, pdf["df"].to_numpy(float)) * pdf["se"]
                yield pdf.assign(low=pdf["y"] - half, high=pdf["y"] + half)[[f.name for f in plain]]

    return out.mapInPandas(ends, plain)
