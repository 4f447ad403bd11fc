"""Interrupted time series, rank tests and dynamic panels."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.estimators.linear import Fit, chi2_sf, demeaned, moments, normal_p, ols, solve
from panelkiln.operators.reshape import sum_below


def its(df: DataFrame, y: str, terms: Sequence[str] = ("seq", "post", "after"), covariates: Sequence[str] = (), unit: str | None = None) -> Fit:
    """Level and slope changes by least squares; with a unit, within units."""
    xs = [*terms, *covariates]
    if unit is None:
        return ols(df, y, xs)
    base = df.dropna(subset=[y, *xs]).select(unit, *[F.col(c).cast("double").alias(c) for c in (y, *xs)])
    within = demeaned(base, unit, [y, *xs])
    m, n = moments(within, [*xs, y])
    beta = solve(m[:-1, :-1], m[:-1, -1])
    rss = m[-1, -1] - beta @ m[:-1, -1]
    units = base.select(unit).distinct().count()
    return Fit(xs, beta, np.linalg.pinv(m[:-1, :-1], hermitian=True) * rss / max(1, n - units - len(xs)), n, 1 - rss / m[-1, -1] if m[-1, -1] > 0 else None)


def its_specs(df: DataFrame, y: str, covariates: Sequence[str], unit: str) -> dict[str, Fit]:
    return {"plain": its(df, y), "covariates": its(df, y, covariates=covariates), "unit": its(df, y, unit=unit), "unit_covariates": its(df, y, covariates=covariates, unit=unit)}


def average_ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Ranks with ties averaged. Equal values are counted first; the running sum is over distinct values, in ranges of them."""
    by = sum_below(df.groupBy(value).agg(F.count("*").alias("_n")), value, "_n", "_below")
    return df.join(by.select(value, (F.col("_below") + (F.col("_n") + 1) / 2).alias(name), F.col("_n").alias(f"{name}_ties")), value)


def rank_sum(df: DataFrame, value: str, group: str) -> DataFrame:
    """Wilcoxon's rank sum of group 1, U, and z with ties and continuity corrected."""
    base = df.where(F.col(value).isNotNull())
    by = base.groupBy(value).agg(F.count("*").alias("_n"), F.sum(F.col(group)).alias("_one"))
    ranked = sum_below(by, value, "_n", "_below").withColumn("_r", F.col("_below") + (F.col("_n") + 1) / 2)
    one = ranked.agg(F.sum("_n").alias("n"), F.sum("_one").alias("n1"), F.sum(F.col("_r") * F.col("_one")).alias("w"), F.sum(F.col("_n").cast("double") ** 3 - F.col("_n")).alias("_ties"))
    n, n1 = F.col("n"), F.col("n1")
    n0 = n - n1
    u = F.col("w") - n1 * (n1 + 1) / 2
    gap = u - n1 * n0 / 2
    spread = F.sqrt(n1 * n0 / 12 * (n + 1 - F.col("_ties") / (n * (n - 1))))
    return one.select("n", "n1", "w", u.alias("u"), ((gap - F.signum(gap) * 0.5) / spread).alias("z"))


@dataclass
class Gmm:
    """Two-step estimates. error: with the finite-sample correction; plain_error: of the two steps alone."""

    names: list[str]
    beta: np.ndarray
    error: np.ndarray
    plain_error: np.ndarray
    sargan: tuple[float, int, float]
    m1: tuple[float, float]
    m2: tuple[float, float]
    units: int
    n: int


@dataclass(frozen=True)
class Model:
    """y on its lag, the endogenous, the late (values of the period before) and xs; lags of the instruments; period effects or none."""

    y: str
    xs: tuple[str, ...] = ()
    late: tuple[str, ...] = ()
    endogenous: tuple[str, ...] = ()
    lags: tuple[int, int] = (2, 3)
    collapse: bool = False
    effects: str = "twoways"


class Design:
    """Instruments and regressors of a model whose complete rows are at the places ``first`` to ``last`` of the calendar."""

    def __init__(self, model: Model, columns: list[str], first: int, last: int):
        self.model, self.first = model, first
        self.at = {c: columns.index(c) for c in (model.y, *model.endogenous, *model.late, *model.xs)}
        self.periods = list(range(first + 2, last + 1))
        lagged = (model.y, *model.endogenous)
        self.gmm = [(c, t, k) for c in lagged for t in ([None] if model.collapse else self.periods) for k in range(model.lags[0], model.lags[1] + 1) if t is None or t - k >= first]
        self.own = [*model.endogenous, *model.late, *model.xs]
        trend = model.effects == "twoways"
        self.extra = 1 + max(0, len(self.periods) - 1) if trend else 0
        self.names = [f"lag_{model.y}", *model.endogenous, *(f"lag_of_{c}" for c in model.late), *model.xs]
        self.n_x, self.n_z = len(self.names) + self.extra, len(self.gmm) + len(model.late) + len(model.xs) + self.extra

    def complete(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of y, endogenous, late and xs, whether a row has them all) by unit and period of the calendar."""
        late = v[:, :, [self.at[c] for c in self.model.late]]
        late = np.concatenate([np.full_like(late[:, :1], np.nan), late[:, :-1]], 1)
        now = lambda cs: v[:, :, [self.at[c] for c in cs]]
        values = np.concatenate([now((self.model.y, *self.model.endogenous)), late, now(self.model.xs)], 2)
        return values, np.isfinite(values).all(2)

    def blocks(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Z, X, y and which rows are usable, by unit and differenced period; unusable rows are zero."""
        values, there = self.complete(v)
        values = np.where(there[:, :, None], values, 0.0)
        t = np.array(self.periods, int)
        ok = there[:, t] & there[:, t - 1] & there[:, t - 2]
        n, p, levels = len(v), len(t), 1 + len(self.model.endogenous)
        change = values[:, t] - values[:, t - 1]
        x, z = np.zeros((n, p, self.n_x)), np.zeros((n, p, self.n_z))
        x[:, :, 0] = values[:, t - 1, 0] - values[:, t - 2, 0]
        x[:, :, 1 : len(self.names)] = change[:, :, 1:]
        lagged = [self.model.y, *self.model.endogenous]
        for i, (c, when, k) in enumerate(self.gmm):
            j = lagged.index(c)
            if when is None:
                far = t - k >= self.first
                z[:, far, i] = values[:, t[far] - k, j]
            else:
                z[:, when - self.first - 2, i] = values[:, when - k, j]
        z[:, :, len(self.gmm) : self.n_z - self.extra] = change[:, :, levels:]
        if self.extra:
            for block, width in ((x, self.n_x), (z, self.n_z)):
                block[:, :, width - self.extra] = 1.0
                block[:, np.arange(1, p), width - self.extra + np.arange(1, p)] = 1.0
        return z * ok[:, :, None], x * ok[:, :, None], change[:, :, 0] * ok, ok


class Dealt:
    """A panel's units, each a row of lists of at most a calendar, kept until ``release``; each pass streams them once for all models."""

    def __init__(self, df: DataFrame, columns: Sequence[str], unit: str, time: str):
        self.columns = list(columns)
        base = df.select(F.col(unit).alias("u"), F.col(time).cast("long").alias("t"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(self.columns)]).where("u IS NOT NULL AND t IS NOT NULL")
        held = F.collect_list(F.struct("t", *[f"v{i}" for i in range(len(self.columns))])).alias("held")
        self.frame = base.groupBy("u").agg(held).select("held").persist()
        span = self.frame.agg(F.min(F.array_min("held.t")).alias("a"), F.max(F.array_max("held.t")).alias("b")).first()
        self.first, self.size = int(span["a"] or 0), int(span["b"] or 0) - int(span["a"] or 0) + 1

    def release(self) -> None:
        self.frame.unpersist()

    def sums(self, make: Callable[[np.ndarray], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        """By model, the sum over units of what ``make`` returns for some units' values (unit, period, column)."""
        schema, first, size, width = pa.schema([("model", pa.string()), ("at", pa.int32()), ("v", pa.float64())]), self.first, self.size, len(self.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                for start in range(0, batch.num_rows, 128):
                    held = batch.column(0).slice(start, 128)
                    rows = held.flatten()
                    unit = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy(zero_copy_only=False))
                    v = np.full((len(held), size, width), np.nan)
                    at = rows.field("t").to_numpy() - first
                    for i in range(width):
                        v[unit, at, i] = rows.field(f"v{i}").to_numpy(zero_copy_only=False)
                    for name, x in make(v).items():
                        total[name] = total[name] + x if name in total else x
            for name, x in total.items():
                some = np.flatnonzero(x)
                last = len(x) - 1
                some = some if len(some) and some[-1] == last else np.append(some, last)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(x[some])], schema=schema)

        found: dict[str, dict[int, float]] = {}
        # The entries of a small system for each model.
        for name, at, x in self.frame.mapInArrow(run, "model string, at int, v double").groupBy("model", "at").agg(F.sum("v")).collect():
            found.setdefault(name, {})[at] = x
        out = {}
        for name, entries in found.items():
            out[name] = np.zeros(max(entries) + 1)
            out[name][list(entries)] = list(entries.values())
        return out


def fit_gmm(dealt: Dealt, models: dict[str, Model]) -> dict[str, Gmm]:
    """Two-step difference GMM of each model, with overidentification and serial correlation tests; four passes for all of them.

    Instruments of a unit: levels of y and of the endogenous at the stated lags - a column per period and lag, or one
    per lag if collapsed -, own differences of late and xs, and period dummies. Errors take in that the second step's
    weights rest on the first step's coefficients: with P = Z'X and g = Z'e of a unit (e of the first step) and
    v = W Z'e of the second, the derivative of the estimate by these is A X'Z W times the sum of P (g v) + g (v P).
    """
    columns = dealt.columns
    plain = {name: Design(m, columns, 0, dealt.size - 1) for name, m in models.items()}
    there = dealt.sums(lambda v: {name: np.append(d.complete(v)[1].sum(0).astype(float), 1.0) for name, d in plain.items()})
    designs = {}
    for name, m in models.items():
        seen = np.flatnonzero(there[name][:-1]) if name in there else []
        designs[name] = Design(m, columns, int(seen[0]), int(seen[-1])) if len(seen) else Design(m, columns, 0, 1)
    flat = lambda a: a.reshape(-1, a.shape[-1])
    inv = lambda a: np.linalg.pinv(a, hermitian=True)

    def first(v: np.ndarray) -> dict[str, np.ndarray]:
        out = {}
        for name, d in designs.items():
            z, x, y, ok = d.blocks(v)
            # Neighbouring differences share an error.
            h = 2.0 * z
            h[:, 1:] -= z[:, :-1]
            h[:, :-1] -= z[:, 1:]
            out[name] = np.concatenate([(flat(z).T @ flat(x)).ravel(), flat(z).T @ y.ravel(), (flat(z).T @ (flat(h) * ok.reshape(-1, 1))).ravel(), [ok.sum(), ok.any(1).sum(), 1.0]])
        return out

    moments_ = dealt.sums(first)
    state = {}
    for name, d in designs.items():
        s, a, b = moments_.get(name, np.zeros(d.n_z * (d.n_x + 1 + d.n_z) + 3)), d.n_z * d.n_x, d.n_z * (d.n_x + 1)
        zx, zy, zhz = s[:a].reshape(d.n_z, d.n_x), s[a:b], s[b:-3].reshape(d.n_z, d.n_z)
        w1 = inv(zhz)
        a1 = inv(zx.T @ w1 @ zx)
        state[name] = {"zx": zx, "zy": zy, "w1": w1, "a1": a1, "b1": a1 @ zx.T @ w1 @ zy, "n": int(s[-3]), "units": int(s[-2])}

    def spread(v: np.ndarray) -> dict[str, np.ndarray]:
        out = {}
        for name, d in designs.items():
            z, x, y, _ = d.blocks(v)
            g = np.einsum("npz,np->nz", z, y - x @ state[name]["b1"], optimize=True)
            out[name] = np.append((g.T @ g).ravel(), 1.0)
        return out

    for name, o in dealt.sums(spread).items():
        s, n_z = state[name], designs[name].n_z
        s["omega"] = o[:-1].reshape(n_z, n_z)
        s["w2"] = inv(s["omega"])
        s["a2"] = inv(s["zx"].T @ s["w2"] @ s["zx"])
        s["b2"] = s["a2"] @ s["zx"].T @ s["w2"] @ s["zy"]
        s["v"] = s["w2"] @ (s["zy"] - s["zx"] @ s["b2"])

    def last(v: np.ndarray) -> dict[str, np.ndarray]:
        out = {}
        for name, d in designs.items():
            if "v" not in state[name]:
                continue
            s = state[name]
            z, x, y, ok = d.blocks(v)
            e1, e2 = (y - x @ s["b1"]) * ok, (y - x @ s["b2"]) * ok
            p = np.einsum("npz,npx->nzx", z, x, optimize=True)
            g1, g2 = (np.einsum("npz,np->nz", z, e, optimize=True) for e in (e1, e2))
            parts = [(np.einsum("nzx,n->zx", p, g1 @ s["v"], optimize=True) + g1.T @ np.einsum("nzx,z->nx", p, s["v"], optimize=True)).ravel()]
            for lag in (1, 2):
                before = np.zeros_like(e2)
                before[:, lag:] = e2[:, :-lag] if e2.shape[1] > lag else before[:, lag:]
                before *= ok
                c = (before * e2).sum(1)
                parts += [[c.sum(), (c * c).sum()], np.einsum("np,npx->x", before, x, optimize=True), c @ g2]
            out[name] = np.concatenate([*parts, [1.0]])
        return out

    found, result = dealt.sums(last), {}
    for name, d in designs.items():
        k, s = len(d.names), state[name]
        nan = np.full(k, np.nan)
        if name not in found or not s["n"]:
            result[name] = Gmm(d.names, nan, nan, nan, (float("nan"), 0, float("nan")), (float("nan"),) * 2, (float("nan"),) * 2, 0, 0)
            continue
        v, zx, w2, a2 = found[name], s["zx"], s["w2"], s["a2"]
        slope = a2 @ zx.T @ w2 @ v[: zx.size].reshape(zx.shape)
        one = s["a1"] @ zx.T @ s["w1"]
        cov = a2 + slope @ a2 + a2 @ slope.T + slope @ (one @ s["omega"] @ one.T) @ slope.T
        g = s["zy"] - zx @ s["b2"]
        stat, over = float(g @ w2 @ g), int(np.linalg.matrix_rank(s["omega"], hermitian=True)) - d.n_x
        serial, at = [], zx.size
        for _ in range(2):
            c, cc, q, ze = v[at], v[at + 1], v[at + 2 : at + 2 + d.n_x], v[at + 2 + d.n_x : at + 2 + d.n_x + d.n_z]
            at += 2 + d.n_x + d.n_z
            var = cc - 2 * q @ a2 @ zx.T @ w2 @ ze + q @ cov @ q
            m = float(c / var**0.5) if var > 0 else float("nan")
            serial.append((m, normal_p(m) if m == m else float("nan")))
        error, bare = (np.sqrt(np.maximum(np.diag(c), 0))[:k] for c in (cov, a2))
        result[name] = Gmm(d.names, s["b2"][:k], error, bare, (stat, over, chi2_sf(stat, over) if over > 0 else float("nan")), serial[0], serial[1], s["units"], s["n"])
    return result


def difference_gmm(df: DataFrame, y: str, xs: Sequence[str], unit: str, time: str, lags: tuple[int, int] = (2, 3), effects: str = "twoways", endogenous: Sequence[str] = (), collapse: bool = False) -> Gmm:
    """One model of a panel; time is an integer."""
    return fit_models(df, {"": Model(y, tuple(xs), (), tuple(endogenous), lags, collapse, effects)}, unit, time)[""]


def gmm_models(velocity: Sequence[str] = ("lines_added", "commits"), debt: Sequence[str] = ("cognitive_complexity", "static_analysis_warnings"), exogenous: Sequence[str] = ("post_event",)) -> dict[str, Model]:
    """Each velocity on each debt of the month before, and each debt on each velocity of the month, which is instrumented by its lags."""
    late = {f"{v} on {q}": Model(v, tuple(exogenous), (q,), (), (2, 2)) for v in velocity for q in debt}
    return late | {f"{q} on {v}": Model(q, tuple(exogenous), (), (v,), (2, 3), True) for q in debt for v in velocity}


def fit_models(df: DataFrame, models: dict[str, Model], unit: str, time: str) -> dict[str, Gmm]:
    """A GMM fit per model, all from one reading of the panel."""
    used = dict.fromkeys(c for m in models.values() for c in (m.y, *m.endogenous, *m.late, *m.xs))
    dealt = Dealt(df, list(used), unit, time)
    try:
        return fit_gmm(dealt, models)
    finally:
        dealt.release()
