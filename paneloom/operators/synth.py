"""Generalised synthetic control: interactive fixed effects for treated panels.

Data model: one row per (group, unit) holding the unit's series as arrays on the
time grid of its group. Rows stay distributed. What the factor model needs from
the controls is one moment table per group (count, mean and scatter of the
stacked series), built from per-task partial moments in strips of matrix rows
that are merged on the executors. The T x T eigenproblems are solved there too,
one (group, rank) per call; models are a table that is joined to the rows, so
the driver sees neither moments nor models, however many groups there are.
Unbalanced controls are filled by expectation-maximisation rounds, each one
distributed pass over the groups that have not settled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.operators.ranges import ranks
from paneloom.operators.verbs import lookup
from paneloom.session import cut_lineage

#: Matrix rows of one strip of a moment matrix, and numbers a task holds before it hands partial moments on.
STRIP = 32
HELD_NUMBERS = 1 << 24

#: Controls of a stratum of the bootstrap, and neighbouring controls that one call leaves out in turn.
STRATUM, LEFT_OUT_CALL = 256, 64
_ARRAY = T.ArrayType(T.DoubleType())


@dataclass
class Moments:
    """Count, mean and centred scatter of stacked control series."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    def merge(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        gap = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n)
        return Moments(n, self.mean + gap * (other.n / n), scatter)

    def without(self, z: np.ndarray) -> "Moments":
        gap = z - self.mean
        n = self.n - 1
        return Moments(n, (self.n * self.mean - z) / n, self.scatter - np.outer(gap, gap) * (self.n / n))


def block_moments(z: np.ndarray) -> Moments:
    mean = z.mean(axis=0)
    c = z - mean
    return Moments(len(z), mean, c.T @ c)


@dataclass
class Factors:
    """A solved factor model: period effects, factors (T x r) and covariate slopes."""

    xi: np.ndarray
    f: np.ndarray
    beta: np.ndarray
    unit_effect: bool

    def regressors(self) -> np.ndarray:
        """Columns a unit's adjusted series is regressed on."""
        ones = np.ones((len(self.xi), 1)) if self.unit_effect else np.zeros((len(self.xi), 0))
        return np.concatenate([ones, self.f], axis=1)


def solve_factors(m: Moments, periods: int, r: int, force: str, tol: float = 1e-11, max_iter: int = 5000) -> Factors:
    """Factor model of the controls from their moments alone.

    With covariates the slopes and the factors are updated in turn; both steps
    need only blocks of the moment matrix.
    """
    k = m.mean.size // periods - 1
    scatter, mean = m.scatter, m.mean
    if force != "two-way":
        scatter = scatter + m.n * np.outer(mean, mean)
    turn = np.eye(periods)
    if force in ("unit", "two-way"):
        turn = turn - 1.0 / periods
    block = lambda i, j: turn @ scatter[i * periods : (i + 1) * periods, j * periods : (j + 1) * periods] @ turn
    blocks = [[block(i, j) for j in range(k + 1)] for i in range(k + 1)]

    def top(beta: np.ndarray) -> np.ndarray:
        if r == 0:
            return np.zeros((periods, 0))
        w = np.concatenate([[1.0], -beta])
        g = sum(w[i] * w[j] * blocks[i][j] for i in range(k + 1) for j in range(k + 1))
        return math.sqrt(periods) * np.linalg.eigh((g + g.T) / 2)[1][:, ::-1][:, :r]

    def slopes(f: np.ndarray) -> np.ndarray:
        off = np.eye(periods) - f @ f.T / periods
        a = np.array([[np.sum(off * blocks[i][j]) for j in range(1, k + 1)] for i in range(1, k + 1)])
        b = np.array([np.sum(off * blocks[i][0]) for i in range(1, k + 1)])
        return np.linalg.lstsq(a, b, rcond=None)[0]

    beta = np.zeros(k)
    f = top(beta)
    if k:
        beta = slopes(np.zeros((periods, 0)))
        for _ in range(max_iter):
            f = top(beta)
            new = slopes(f)
            moved = np.max(np.abs(new - beta) / np.maximum(np.abs(beta), 1e-12))
            beta = new
            if moved < tol or not r:
                break
        else:
            raise RuntimeError(f"covariate slopes did not settle in {max_iter} rounds")
        f = top(beta)
    parts = mean.reshape(k + 1, periods)
    xi = parts[0] - (beta @ parts[1:] if k else 0.0) if force == "two-way" else np.zeros(periods)
    return Factors(xi, f, beta, force in ("unit", "two-way"))


def _stack(pdf: pd.DataFrame, k: int) -> np.ndarray:
    """rows x (1 + k) x periods; unknown values are NaN."""
    cols = [np.array([np.asarray(v, dtype=float) for v in pdf[c]]) for c in ["__y", *[f"__x{i}" for i in range(k)]]]
    return np.stack(cols, axis=1)


def _adjusted(z: np.ndarray, model: Factors) -> np.ndarray:
    """Outcome net of covariates and period effects."""
    y = z[:, 0, :] - model.xi
    for i, b in enumerate(model.beta):
        y = y - b * z[:, 1 + i, :]
    return y


def _project(y: np.ndarray, use: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fit of every row of ``y`` on ``c`` over its used periods; also the inverse normal matrices."""
    p = c.shape[1]
    if p == 0:
        return np.zeros_like(y), np.zeros((len(y), 0, 0))
    w = use.astype(float)
    a = np.einsum("bt,tp,tq->bpq", w, c, c)
    b = np.einsum("bt,tp->bp", np.where(use, y, 0.0), c)
    inv = np.linalg.pinv(a)
    return np.einsum("bpq,bq->bp", inv, b) @ c.T, inv


def _fill(z: np.ndarray, model: Factors | None) -> np.ndarray:
    """Series with unknown cells replaced: by the model's fit, or by the unit mean at the start."""
    known = ~np.isnan(z).any(axis=1)
    if known.all():
        return z
    out = z.copy()
    for v in range(1, z.shape[1]):
        cell = np.where(known, z[:, v, :], np.nan)
        out[:, v, :] = np.where(known, z[:, v, :], np.nanmean(cell, axis=1)[:, None])
    if model is None:
        y = np.where(known, z[:, 0, :], np.nan)
        fit = np.tile(np.nanmean(y, axis=1)[:, None], (1, z.shape[2]))
    else:
        adj = _adjusted(out, model)
        fit = _project(adj, known, model.regressors())[0] + model.xi
        for i, b in enumerate(model.beta):
            fit = fit + b * out[:, 1 + i, :]
    out[:, 0, :] = np.where(known, z[:, 0, :], fit)
    return out


_MODEL = ["__xi", "__f", "__beta"]


def _schema(text: str) -> str:
    return text.replace(" array", " array<double>")


def _model(row, unit_effect: bool) -> Factors:
    xi = np.asarray(row["__xi"], dtype=float)
    return Factors(xi, np.asarray(row["__f"], dtype=float).reshape(len(xi), -1), np.asarray(row["__beta"], dtype=float), unit_effect)


def _moments_of(row) -> Moments:
    mean = np.asarray(row["__mean"], dtype=float)
    return Moments(int(row["__n"]), mean, np.asarray(row["__scatter"], dtype=float).reshape(mean.size, mean.size))


def _strips(found: dict[tuple, Moments], keys: Sequence[str]) -> pd.DataFrame:
    rows = []
    for key, m in found.items():
        for s in range(0, m.mean.size, STRIP):
            part = m.scatter[s : s + STRIP].ravel()
            rows.append({**dict(zip(keys, key)), "__s": s, "__n": m.n, "__mean": m.mean, "__part": part})
    return pd.DataFrame(rows)


def _strip_schema(second: str) -> str:
    return _schema(f"__g string,{second} int,__s int,__n long,__mean array,__part array")


def moment_strips(rows: DataFrame, second: str, stack) -> DataFrame:
    """Moments of the series of every (``__g``, ``second``), in strips of matrix rows.

    ``stack`` makes the (rows x numbers) matrix of one part of a batch. A task
    merges its own rows and hands over when it holds many numbers; each strip
    of each matrix is then merged by itself, so no call holds a pile of whole
    matrices.
    """
    keys = ["__g", second]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, Moments] = {}
        held = 0
        for pdf in batches:
            for key, part in pdf.groupby(keys):
                m = block_moments(stack(part))
                held += 0 if key in found else m.scatter.size
                found[key] = found[key].merge(m) if key in found else m
                if held > HELD_NUMBERS:
                    yield _strips(found, keys)
                    found, held = {}, 0
        if found:
            yield _strips(found, keys)

    return merged_strips(rows.mapInPandas(partial, _strip_schema(second)), second)


def merged_strips(parts: DataFrame, second: str) -> DataFrame:
    """One row for each strip of every (``__g``, ``second``) from those of its parts."""

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, s = 0, int(key[2])
        for more, other, part in zip(pdf["__n"], pdf["__mean"], pdf["__part"]):
            if n == 0:
                n, mean, total = int(more), np.array(other), np.array(part)
                continue
            gap = np.asarray(other) - mean
            total += part + np.outer(gap[s : s + STRIP], gap).ravel() * (n * more / (n + more))
            mean += gap * (more / (n + more))
            n += int(more)
        return pd.DataFrame([{"__g": key[0], second: int(key[1]), "__s": s, "__n": n, "__mean": mean, "__part": total}])

    return parts.groupBy("__g", second, "__s").applyInPandas(merge, _strip_schema(second))


def _join_strips(pdf: pd.DataFrame) -> Moments:
    pdf = pdf.sort_values("__s")
    mean = np.asarray(pdf["__mean"].iloc[0], dtype=float)
    return Moments(int(pdf["__n"].iloc[0]), mean, np.concatenate(pdf["__part"].to_list()).reshape(mean.size, mean.size))


_STATE = _schema("__g string,__r int,__n long,__mean array,__scatter array,__xi array,__f array,__beta array,__settled boolean")


def _state_row(g: str, r: int, m: Moments, model: Factors, settled: bool) -> pd.DataFrame:
    named = {"__g": g, "__r": r, "__n": m.n, "__mean": m.mean, "__scatter": m.scatter.ravel()}
    return pd.DataFrame([{**named, "__xi": model.xi, "__f": model.f.ravel(), "__beta": model.beta, "__settled": settled}])


class Panel:
    """Unit rows of a treatment panel, each on the time grid of its group."""

    def __init__(self, panel: DataFrame, unit: str, time: str, y: str, d: str, x: Sequence[str] = (), by: Sequence[str] = ()):
        self.unit, self.time, self.by, self.k = unit, time, list(by), len(x)
        g = F.to_json(F.struct(*by)) if by else F.lit("")
        values = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in (y, *x)]
        # One entry per period of the unit; a repeated period is an error.
        entry = F.struct(F.col(time).alias("key"), F.array(*values).alias("value"))
        series = cut_lineage(
            panel.withColumn("__g", g)
            .groupBy("__g", *by, unit)
            .agg(F.min(F.when(F.col(d) > 0, F.col(time))).alias("__onset"), F.map_from_entries(F.collect_list(entry)).alias("__series"))
        )
        times = series.select("__g", F.explode(F.map_keys("__series")).alias("__t")).distinct()
        grids = times.groupBy("__g").agg(F.array_sort(F.collect_list("__t")).alias("__grid"))
        names = ["__y", *[f"__x{i}" for i in range(self.k)]]
        away = F.date_diff if isinstance(panel.schema[time].dataType, T.DateType) else lambda a, b: (a - b).cast("int")

        def known(cell: Column) -> Column:
            out = F.lit(True)
            for c in names:
                out = out & cell[c].isNotNull()
            return out

        def on_grid(i: int) -> Column:
            return F.transform("__grid", lambda t: F.try_element_at(F.col("__series"), t)[i])

        laid = lookup(series, grids, ["__g"], ["__grid"], how="inner").select(
            "__g", *by, unit, "__onset", "__grid",
            (F.array_position("__grid", F.col("__onset")) - 1).cast("int").alias("__at"),
            F.transform("__grid", lambda t: away(t, F.col("__onset"))).alias("__rel"),
            *[on_grid(i).alias(c) for i, c in enumerate(names)],
        )
        cells = F.arrays_zip("__grid", *names)
        self.units = cut_lineage(
            laid.withColumns(
                {
                    "__full": F.forall(cells, known),
                    "__pre": F.size(F.filter(cells, lambda c: known(c) & (c["__grid"] < F.col("__onset")))),
                    "__any": F.exists(cells, known),
                }
            )
        )
        # Units without one known cell say nothing; they are no donors.
        self.controls = self.units.where(F.col("__onset").isNull() & F.col("__any"))
        self.treated = self.units.where(F.col("__onset").isNotNull())
        self.groups = self.units.select("__g", *by).distinct()

    def check(self, rank: int, spare: int) -> None:
        """Say so where a group has too few periods or arms for ``rank``, or a treated unit fewer than ``spare`` pre-periods."""
        arms = self.units.groupBy("__g").agg(
            F.max(F.size("__grid")).alias("t"),
            F.count_if(F.col("__onset").isNull() & F.col("__any")).alias("co"),
            F.count("__onset").alias("tr"),
            F.min(F.when(F.col("__onset").isNotNull(), F.col("__pre"))).alias("least"),
        )
        short, bare, few = F.col("t") <= rank, (F.col("tr") > 0) & (F.col("co") == 0), F.col("least") < spare
        for row in arms.where(short | bare | few).limit(1).collect():
            if row["t"] <= rank:
                raise ValueError(f"r = {rank} needs more than {row['t']} periods{_names([row], '__g')}")
            if row["tr"] and not row["co"]:
                raise ValueError(f"treated units without a control{_names([row], '__g')}")
            lacking = self.treated.where(F.col("__pre") < spare).select("__g", F.col(self.unit).cast("string").alias("u")).limit(5).collect()
            raise ValueError(f"r = {rank} needs {spare} known pre-periods{_names(lacking, '__g', 'u')}")

    def usable_ranks(self, ranks: Sequence[int], force: str) -> DataFrame:
        """__g, __r: ranks that leave every treated unit of the group a spare pre-period."""
        least = self.treated.groupBy("__g").agg(F.min("__pre").alias("__least"))
        wanted = least.withColumn("__r", F.explode(F.array(*map(F.lit, ranks))))
        return cut_lineage(wanted.where(F.col("__least") > F.col("__r") + int(force != "none")).select("__g", "__r"))

    def solve(self, wanted: DataFrame, force: str, tol: float = 1e-8, max_rounds: int = 500) -> DataFrame:
        """Moments and factor model of every group and rank of ``wanted``, one row each."""
        k, unit_effect = self.k, force != "none"

        def filled(with_model: bool):
            return lambda part: _fill(_stack(part, k), _model(part.iloc[0], unit_effect) if with_model else None).reshape(len(part), -1)

        def solved(m: Moments, r: int) -> Factors:
            return solve_factors(m, m.mean.size // (k + 1), r, force)

        def start(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            m, r = _join_strips(pdf), int(key[1])
            return _state_row(key[0], r, m, solved(m, r), bool(pdf["__whole"].iloc[0]))

        def step(key: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            if new.empty:
                return old
            m, before, r = _join_strips(new), _moments_of(old.iloc[0]), int(key[1])
            pairs = ((m.scatter, before.scatter), (m.mean, before.mean))
            moved = sum(np.max(np.abs(u - v)) / max(np.max(np.abs(v)), 1e-300) for u, v in pairs)
            return _state_row(key[0], r, m, solved(m, r), bool(moved < tol))

        whole = self.controls.groupBy("__g").agg(F.bool_and("__full").alias("__whole"))
        first = moment_strips(self.controls.withColumn("__r", F.lit(0)), "__r", filled(False)).drop("__r")
        first = lookup(lookup(first, whole, ["__g"], ["__whole"], how="inner"), wanted, ["__g"], ["__r"], how="inner")
        state, pending = _watched(first.groupBy("__g", "__r").applyInPandas(start, _STATE))
        for _ in range(max_rounds):
            if not pending:
                return state
            models = state.where(~F.col("__settled")).select("__g", "__r", *_MODEL)
            rows = lookup(self.controls, models, ["__g"], ["__r", *_MODEL], how="inner")
            new = moment_strips(rows, "__r", filled(True))
            state, pending = _watched(new.groupBy("__g", "__r").cogroup(state.groupBy("__g", "__r")).applyInPandas(step, _STATE))
        raise RuntimeError("filling of unbalanced controls did not settle")

    def loo_errors(self, state: DataFrame, force: str) -> DataFrame:
        """__g, r, mspe: leave-one-period-out error over the treated units' pre-periods.

        The left-out prediction follows in closed form from the leverage of the
        period. A rank that leaves some treated unit without a spare pre-period
        has no error and is never chosen.
        """
        k, unit_effect = self.k, force != "none"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for (g, r), part in pdf.groupby(["__g", "__r"]):
                    z = _stack(part, k)
                    model = _model(part.iloc[0], unit_effect)
                    pre = (np.arange(z.shape[2])[None, :] < part["__at"].to_numpy()[:, None]) & ~np.isnan(z).any(axis=1)
                    c = model.regressors()
                    y = _adjusted(z, model)
                    fit, inv = _project(y, pre, c)
                    spare = pre.sum(axis=1) - c.shape[1]
                    lev = np.einsum("tp,bpq,tq->bt", c, inv, c) if c.shape[1] else np.zeros_like(y)
                    with np.errstate(all="ignore"):
                        e = np.where(pre & (1 - lev > 1e-9), (y - fit) / (1 - lev), 0.0)
                    sse = np.where(spare >= 1, np.square(e).sum(axis=1), np.inf)
                    out.append({"__g": g, "r": int(r), "sse": float(sse.sum()), "n": int(pre.sum())})
                if out:
                    yield pd.DataFrame(out)

        rows = lookup(self.treated, state, ["__g"], ["__r", *_MODEL], how="inner")
        errors = rows.mapInPandas(run, _schema("__g string,r int,sse double,n long")).groupBy("__g", "r").agg((F.sum("sse") / F.sum("n")).alias("mspe"))
        return errors.withColumn("mspe", F.when(F.col("mspe") < F.lit(float("inf")), F.col("mspe")))

    def named(self, df: DataFrame) -> DataFrame:
        """Replace the internal group key by the ``by`` columns."""
        if not self.by:
            return df.drop("__g")
        return lookup(df, self.groups, ["__g"], self.by, how="inner").select(*self.by, *[c for c in df.columns if c not in ("__g", *self.by)])


def _names(rows: Sequence, *columns: str) -> str:
    """Where: up to a handful of groups or units, as text of an error."""
    found = ", ".join(" ".join(str(row[c]) for c in columns if row[c]) for row in rows)
    return f" (at {found})" if found.strip(", ") else ""


def _watched(state: DataFrame) -> tuple[DataFrame, int]:
    """The written state, and how many of its rows have not settled."""
    seen = Observation()
    written = cut_lineage(state.observe(seen, F.count_if(~F.col("__settled")).alias("pending")))
    return written, seen.get["pending"] or 0


def _gap_rows(part: pd.DataFrame, k: int, model: Factors, onset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Observed mask, outcome and counterfactual of treated rows."""
    z = _stack(part, k)
    known = ~np.isnan(z).any(axis=1)
    pre = known & (np.arange(z.shape[2])[None, :] < onset[:, None])
    y = _adjusted(z, model)
    fit = _project(y, pre, model.regressors())[0] + model.xi
    for i, b in enumerate(model.beta):
        fit = fit + b * z[:, 1 + i, :]
    return known, z[:, 0, :], fit


def choose_rank(ranks: Sequence[int], errors: Sequence[float | None], min_gain: float) -> int | None:
    """Go up only where the error falls by more than ``min_gain`` of the best so far; None if no rank has one."""
    best, lowest = None, math.inf
    for r, mspe in sorted(zip(ranks, errors)):
        if mspe is None or math.isnan(mspe):
            continue
        if best is None or lowest - mspe > min_gain * lowest:
            best = r
        lowest = min(mspe, lowest)
    return best


@dataclass
class SynthResult:
    """Lazy result tables of a fit."""

    gaps: DataFrame  # by, unit, time, rel_time, y, y0
    att: DataFrame  # by, rel_time, att, n_treated (, se, conf_low, conf_high)
    att_avg: DataFrame  # by, att_avg (, se, conf_low, conf_high)
    counterfactual: DataFrame  # by, time, y, y0
    cv: DataFrame  # by, r, mspe
    chosen: DataFrame  # by, r, and one slope per covariate


def gsc(
    panel: DataFrame,
    unit: str,
    time: str,
    y: str,
    d: str,
    force: str = "two-way",
    r: int | tuple[int, int] = (0, 5),
    cv: bool = True,
    x: Sequence[str] = (),
    boot: int = 0,
    seed: int = 0,
    by: Sequence[str] = (),
    min_gain: float = 0.05,
) -> SynthResult:
    """Generalised synthetic control of every group of ``by`` in one run.

    ``force`` is ``none``, ``unit`` or ``two-way``. The number of factors is
    searched in ``r`` by leave-one-period-out error when ``cv``, else the first
    number is used. ``boot`` parametric bootstrap draws add standard errors; their
    prediction errors come from the controls that the draws ask for, each left
    out of the fit once.

    Groups without a treated unit give no rows. A ``ValueError`` says so where
    a group has treated units but no control, not more periods than the smallest
    ``r``, or a treated unit without one known pre-period more than the model of
    the smallest ``r`` has loadings. Larger ranks that lack such a period get no
    error in ``cv`` and are not chosen.
    """
    if force not in ("none", "unit", "two-way"):
        raise ValueError(f"unknown force {force!r}")
    low, high = (r, r) if isinstance(r, int) else r
    data = Panel(panel, unit, time, y, d, x, by)
    ranks = list(range(low, high + 1)) if cv else [low]
    data.check(low, low + (force != "none") + 1)
    wanted = data.usable_ranks(ranks, force)
    state = data.solve(wanted, force)
    every = data.treated.select("__g").distinct().withColumn("r", F.explode(F.array(*map(F.lit, ranks))))
    errors = cut_lineage(lookup(every, data.loo_errors(state, force), ["__g", "r"], ["mspe"]))
    best = state
    if cv:
        pick_schema = _schema("__g string,__best int")

        def pick(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            rank = choose_rank(pdf["r"].tolist(), pdf["mspe"].tolist(), min_gain)
            return pd.DataFrame([] if rank is None else [{"__g": key[0], "__best": rank}], columns=["__g", "__best"])

        picked = errors.groupBy("__g").applyInPandas(pick, pick_schema)
        best = cut_lineage(lookup(state, picked, {"__g": "__g", "__r": "__best"}, [], how="inner"))
    k, by_list, unit_effect = len(x), list(by), force != "none"
    passed = ["__g", *by_list, unit, "__grid", "__rel", "__y"]
    gap_schema = T.StructType([data.units.schema[c] for c in passed]).add("__y0", _ARRAY)

    def gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby("__g"):
                known, _, fit = _gap_rows(part, k, _model(part.iloc[0], unit_effect), part["__at"].to_numpy())
                yield part[passed].assign(__y0=list(np.where(known, fit, np.nan)))

    arrays = lookup(data.treated, best, ["__g"], _MODEL, how="inner").mapInPandas(gaps, gap_schema)
    cell = F.explode(F.arrays_zip("__grid", "__rel", "__y", "__y0")).alias("c")
    gap = arrays.select("__g", *by, unit, cell).select(
        "__g", *by, unit, F.col("c.__grid").alias(time), F.col("c.__rel").alias("rel_time"), F.col("c.__y").alias("y"), F.col("c.__y0").alias("y0")
    )
    gap = gap.where(~F.isnan("y0"))
    effect = F.col("y") - F.col("y0")
    att = gap.groupBy("__g", "rel_time").agg(F.avg(effect).alias("att"), F.count(F.lit(1)).alias("n_treated"))
    avg = gap.where(F.col("rel_time") >= 0).groupBy("__g").agg(F.avg(effect).alias("att_avg"))
    if boot:
        draws = _bootstrap(data, best, force, boot, seed)
        se = draws.groupBy("__g", "rel_time").agg(F.stddev_samp("att").alias("se"))
        after = draws.where(F.col("rel_time") >= 0).groupBy("__g", "b").agg((F.sum("total") / F.sum("n")).alias("a"))
        att = _interval(lookup(att, se, ["__g", "rel_time"], ["se"]), "att")
        avg = _interval(lookup(avg, after.groupBy("__g").agg(F.stddev_samp("a").alias("se")), ["__g"], ["se"]), "att_avg")
    cf = gap.groupBy("__g", time).agg(F.avg("y").alias("y"), F.avg("y0").alias("y0"))
    chosen = best.select("__g", F.col("__r").alias("r"), *[F.col("__beta")[i].alias(f"beta_{c}") for i, c in enumerate(x)])
    return SynthResult(gap.drop("__g"), *[data.named(t) for t in (att, avg, cf, errors, chosen)])


def _interval(df: DataFrame, estimate: str) -> DataFrame:
    half = 1.96 * F.col("se")
    return df.withColumns({"conf_low": F.col(estimate) - half, "conf_high": F.col(estimate) + half})


def cumulative_att(att: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Running sum of the effect from the shock on (one row per period, so windows are tiny)."""
    w = Window.partitionBy(*by).orderBy("rel_time").rowsBetween(Window.unboundedPreceding, 0)
    return att.where(F.col("rel_time") >= 0).select(*by, "rel_time", F.sum("att").over(w).alias("catt"))


def _bootstrap(data: Panel, best: DataFrame, force: str, boot: int, seed: int) -> DataFrame:
    """__g, b, rel_time, att, total, n of every draw under no effect.

    Each draw gives every control the in-sample residual series of a random
    control, and every treated unit the prediction-error series of a random
    control that was left out of the fit (for the treated unit's own onset);
    the model is solved again on that panel. Controls are dealt to strata of
    about ``STRATUM`` units by hash and draw their donors inside, so one call
    makes a range of draws of a stratum and hands over moments: units times
    draws never are rows. Any control can be left out; those that some draw asks
    for are. Draws depend on the seed, the group and the unit only.
    """
    k, unit_effect = data.k, force != "none"
    name = F.col(data.unit).cast("string").alias("__unit")
    onsets = data.treated.groupBy("__g").agg(F.array_sort(F.collect_set("__at")).alias("__onsets"))
    best = lookup(best, onsets, ["__g"], ["__onsets"], how="inner")
    xs = [f"__x{i}" for i in range(k)]

    def residuals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Filled series, fit and in-sample residual of each control."""
        for pdf in batches:
            for g, part in pdf.groupby("__g"):
                model = _model(part.iloc[0], unit_effect)
                z = _fill(_stack(part, k), model)
                adj = _adjusted(z, model)
                e = adj - _project(adj, np.ones(adj.shape, dtype=bool), model.regressors())[0]
                flat = z.reshape(len(part), -1)
                yield pd.DataFrame({"__g": g, "__unit": part["__unit"].to_numpy(), "__z": list(flat), "__fit": list(z[:, 0, :] - e), "__e": list(e)})

    rows = lookup(data.controls.select("__g", name, "__y", *xs), best, ["__g"], _MODEL, how="inner")
    controls = rows.mapInPandas(residuals, _schema("__g string,__unit string,__z array,__fit array,__e array"))
    controls = cut_lineage(controls)
    total = controls.groupBy("__g").agg(F.count(F.lit(1)).alias("__total"))
    controls = cut_lineage(lookup(ranks(controls, ["__g"], ["__unit"], "__no"), total, ["__g"], ["__total"], how="inner"))

    def left_out(key: tuple, pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        """Prediction errors of controls under the model of all others, one series per onset."""
        out = []
        if len(state) and int(state["__n"].iloc[0]) > 1:
            m, r = _moments_of(state.iloc[0]), int(state["__r"].iloc[0])
            periods = m.mean.size // (k + 1)
            for no, z in zip(pdf["__no"], pdf["__z"]):
                left = solve_factors(m.without(np.asarray(z, dtype=float)), periods, r, force)
                a = _adjusted(np.asarray(z, dtype=float).reshape(1, k + 1, periods), left)
                for at in state["__onsets"].iloc[0]:
                    fit = _project(a, (np.arange(periods) < at)[None, :], left.regressors())[0]
                    out.append((key[0], int(at), int(no), (a - fit)[0]))
        return pd.DataFrame(out, columns=["__g", "__at", "__no", "__err"])

    def treated_fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby("__g"):
                fit = _gap_rows(part, k, _model(part.iloc[0], unit_effect), part["__at"].to_numpy())[2]
                yield part[["__g", "__unit", "__at", "__rel", "__y", *xs]].assign(__fit=list(fit))

    series = data.treated.select("__g", name, "__at", "__rel", "__y", *xs)
    fitted = lookup(series, best, ["__g"], _MODEL, how="inner").mapInPandas(treated_fit, T.StructType(series.schema.fields).add("__fit", _ARRAY))
    # Every treated unit in every draw, with the number of the control whose prediction error it gets.
    again = lookup(cut_lineage(fitted), total, ["__g"], ["__total"], how="inner").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(boot - 1))))
    again = again.withColumn("__no", F.pmod(F.xxhash64(F.lit(seed), F.lit(2), "b", "__g", "__unit"), F.col("__total")))
    asked = again.select("__g", "__no").distinct()
    chosen = lookup(controls, asked, ["__g", "__no"], [], how="inner").select("__g", "__z", "__no", F.expr(f"__no div {LEFT_OUT_CALL}").alias("__slot"))
    chosen = cut_lineage(chosen)
    calls = chosen.select(F.col("__g").alias("__of"), F.col("__slot").alias("__call")).distinct()
    models = lookup(calls, best, {"__of": "__g"}, ["__r", "__n", "__mean", "__scatter", "__onsets"], how="inner")
    missed = chosen.groupBy("__g", "__slot").cogroup(models.groupBy("__of", "__call")).applyInPandas(left_out, _schema("__g string,__at int,__no long,__err array"))
    missed = cut_lineage(missed)

    # Controls of a stratum draw donors among themselves; a call covers a range of draws and hands over moments only.
    width = best.agg(F.max(F.size("__mean"))).first()[0] or 1
    at_once = int(np.clip(HELD_NUMBERS // width**2, 1, 250))
    ranges = F.explode(F.sequence(F.lit(0), F.lit((boot - 1) // at_once))).alias("__range")
    stratum = F.pmod(F.xxhash64(F.lit(seed), F.lit(1), "__unit"), F.ceil(F.col("__total") / STRATUM)).cast("int").alias("__stratum")
    dealt = controls.select("__g", "__unit", "__fit", "__z", "__e", stratum, ranges)

    def stratum_draws(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g, part, first = key[0], int(key[1]), int(key[2]) * at_once
        pdf = pdf.sort_values("__unit")
        fit, e, z = (np.stack(pdf[c].to_list()) for c in ("__fit", "__e", "__z"))
        found = {}
        for b in range(first, min(first + at_once, boot)):
            rng = np.random.default_rng([seed & 0xFFFFFFFF, crc32(g.encode()), part, b])
            donor = rng.integers(len(pdf), size=len(pdf))
            found[g, b] = block_moments(np.concatenate([fit + e[donor], z[:, fit.shape[1] :]], axis=1))
        return _strips(found, ["__g", "b"])

    parts = dealt.groupBy("__g", "__stratum", "__range").applyInPandas(stratum_draws, _strip_schema("b"))
    parts = lookup(merged_strips(parts, "b"), best, ["__g"], ["__r"], how="inner")

    def solve_draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = _join_strips(pdf)
        model = solve_factors(m, m.mean.size // (k + 1), int(pdf["__r"].iloc[0]), force)
        return pd.DataFrame([{"__g": key[0], "b": int(key[1]), "__xi": model.xi, "__f": model.f.ravel(), "__beta": model.beta}])

    solved = parts.groupBy("__g", "b").applyInPandas(solve_draw, _schema("__g string,b int,__xi array,__f array,__beta array"))

    met = lookup(again.drop("__total"), missed, ["__g", "__at", "__no"], ["__err"], how="inner")
    joined = lookup(met, solved, ["__g", "b"], _MODEL, how="inner")

    def gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (g, b), part in pdf.groupby(["__g", "b"]):
                known = ~np.isnan(_stack(part, k)).any(axis=1)
                star = np.stack(part["__fit"].to_list()) + np.stack(part["__err"].to_list())
                made = part.assign(__y=list(np.where(known, star, np.nan)))
                seen, obs, fit = _gap_rows(made, k, _model(part.iloc[0], unit_effect), part["__at"].to_numpy())
                i, t = np.nonzero(seen)
                rel = np.stack(part["__rel"].to_list())
                yield pd.DataFrame({"__g": g, "b": b, "rel_time": rel[i, t], "gap": obs[i, t] - fit[i, t]})

    draws = joined.mapInPandas(gaps, _schema("__g string,b int,rel_time int,gap double"))
    return cut_lineage(
        draws.groupBy("__g", "b", "rel_time").agg(F.avg("gap").alias("att"), F.sum("gap").alias("total"), F.count(F.lit(1)).alias("n"))
    )
