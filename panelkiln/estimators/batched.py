"""Estimators for many panels at once: labels of panels, outcomes or settings are keys of every sum.

``gather`` reads its rows once. A row belongs to one label or to each of a list of
them; the rows of a unit under a label become one row of lists, at most a calendar
long. Every pass after that streams these units in Arrow batches, adds them to a
vector of sums per label and shuffles a row per (label, entry) and task; the
driver solves a small system per label. No units are joined with each other, and
no plan grows with the number of labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkiln.estimators.linear import Fit, chi2_sf, normal_p, wald

#: What a unit without a cohort, or a row without a time since treatment, has in its place.
NONE = -(1 << 31)
#: Units that are worked on at once: some arrays have a row for each and a column for each cell of a calendar by cohorts.
UNITS = 256


@dataclass
class Flat:
    """Units of one label in a batch: rows of all units after each other, ``unit`` numbering their units from 0."""

    n: int
    key: np.ndarray
    cluster: np.ndarray
    cohort: np.ndarray
    unit: np.ndarray
    at: np.ndarray
    on: np.ndarray
    rel: np.ndarray
    y: np.ndarray
    x: np.ndarray

    def where(self, keep: np.ndarray) -> Flat:
        return Flat(self.n, self.key, self.cluster, self.cohort, *(v[keep] for v in (self.unit, self.at, self.on, self.rel, self.y, self.x)))

    def by_unit(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.unit, v, self.n)

    def counts(self, periods: int) -> np.ndarray:
        """Rows by unit and period."""
        return np.bincount(self.unit * periods + self.at, minlength=self.n * periods).reshape(self.n, periods).astype(float)

    def means(self, v: np.ndarray) -> np.ndarray:
        """Each column's mean by unit, NaN for a unit without rows."""
        n = np.bincount(self.unit, minlength=self.n)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.stack([self.by_unit(c) / n for c in v.T], 1) if v.shape[1] else np.zeros((self.n, 0))


def flats(batch: pa.RecordBatch, covariates: int) -> Iterator[tuple[str, Flat]]:
    """A batch's units by label, UNITS at most at a time."""
    for i in range(0, batch.num_rows, UNITS):
        yield from _flats(batch.slice(i, UNITS), covariates)


def _flats(batch: pa.RecordBatch, covariates: int) -> Iterator[tuple[str, Flat]]:
    label, key, cluster, cohort = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
    held = batch.column(4)
    sizes, rows = held.value_lengths().to_numpy(zero_copy_only=False), held.flatten()
    field = lambda name: rows.field(name).to_numpy(zero_copy_only=False)
    x = np.stack([field(f"x{j}") for j in range(covariates)], 1) if covariates else np.zeros((len(rows), 0))
    columns = [field(c) for c in ("i", "on", "r", "y")]
    for name in np.unique(label):
        mine = label == name
        pick = np.repeat(mine, sizes)
        unit = np.repeat(np.arange(mine.sum()), sizes[mine])
        yield str(name), Flat(int(mine.sum()), key[mine], cluster[mine], cohort[mine], unit, *(c[pick] for c in columns), x[pick])


@dataclass
class Units:
    """Gathered units: a row per label and unit. times and cohorts: the calendar's values, by place."""

    frame: DataFrame
    times: list
    cohorts: list
    covariates: list[str]
    rows: DataFrame
    clustered: bool

    @cached_property
    def labels(self) -> list[str]:
        return sorted(r[0] for r in self.frame.select("label").distinct().collect())

    def sizes(self) -> DataFrame:
        """(label, rows, units)"""
        return self.frame.groupBy("label").agg(F.sum(F.size("held")).alias("rows"), F.count("*").alias("units"))

    def release(self) -> None:
        self.frame.unpersist()
        self.rows.unpersist()

    def sums(self, make: Callable[[str, Flat], np.ndarray], size: int) -> dict[str, np.ndarray]:
        """By label, the sum over batches of what ``make`` returns."""
        schema, p = pa.schema([("label", pa.string()), ("at", pa.int32()), ("v", pa.float64())]), len(self.covariates)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                for label, flat in flats(batch, p):
                    v = make(label, flat)
                    total[label] = total[label] + v if label in total else v
            for label, v in total.items():
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(v[at])], schema=schema)

        out = {label: np.zeros(size) for label in self.labels}
        # Labels x entries of one system each.
        for label, at, v in self.frame.mapInArrow(run, "label string, at int, v double").groupBy("label", "at").agg(F.sum("v")).collect():
            out[label][at] = v
        return out

    def of_clusters(self, make: Callable[[str, Flat], np.ndarray], size: int) -> dict[str, np.ndarray]:
        """By label, the product of ``size`` values per cluster with themselves; ``make`` returns a row of them per unit, and the number of clusters."""
        if not self.clustered:
            return self.sums(lambda label, f: np.append(((v := make(label, f)).T @ v).ravel(), f.n), size * size + 1)
        schema, p = pa.schema([("label", pa.string()), ("cluster", pa.int64()), ("v", pa.list_(pa.float64()))]), len(self.covariates)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for label, flat in flats(batch, p):
                    which, at = np.unique(flat.cluster, return_inverse=True)
                    total = np.zeros((len(which), size))
                    np.add.at(total, at, make(label, flat))
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(which), pa.string()), pa.array(which), pa.array(list(total), pa.list_(pa.float64()))], schema=schema)

        def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                label = batch.column(0).to_numpy(zero_copy_only=False)
                v = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], 1)
                for name in np.unique(label):
                    s = v[label == name]
                    total[name] = total.get(name, 0) + np.append((s.T @ s).ravel(), len(s))
            for name, t in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(t), pa.string()), pa.array(np.arange(len(t)), pa.int32()), pa.array(t)], names=["label", "at", "v"])

        each = self.frame.mapInArrow(run, "label string, cluster long, v array<double>").groupBy("label", "cluster").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(size)])
        out = {label: np.zeros(size * size + 1) for label in self.labels}
        for label, at, v in each.drop("cluster").mapInArrow(square, "label string, at int, v double").groupBy("label", "at").agg(F.sum("v")).collect():
            out[label][at] = v
        return out


def _place(values: Sequence, c: Column) -> Column:
    """The place of a value in a list, from 0; NULL for others."""
    at = F.array_position(F.array(*[F.lit(v) for v in values]), c) if values else F.lit(0)
    return F.when(at > 0, (at - 1).cast("int"))


def gather(df: DataFrame, y: str, unit: str, time: str, cohort: str | None, treated: Column | None = None, rel: str | None = None, covariates: Sequence[str] = (), label: str | None = None, cluster: str | None = None) -> Units:
    """The panel's units. label: a column with the name of a row's panel, or with a list of such names; none makes one panel named ''.

    Rows without y, unit, time or a covariate are left out. treated: whether a row counts as treated; rel: its time since
    treatment. A unit has one cohort (its greatest, if rows differ). Rows and units are kept in memory and on disk until ``release``.
    """
    base = df.dropna(subset=[y, unit, time, *covariates])
    kind = base.schema[label].dataType.typeName() if label else ""
    name = F.explode(F.col(label).cast("array<string>")) if kind == "array" else F.col(label).cast("string") if label else F.lit("")
    number = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(NONE)) if c else F.lit(NONE)
    on = F.coalesce(treated, F.lit(False)) if treated is not None else F.lit(False)
    one = base.select(
        name.alias("label"), F.col(unit).alias("u"), F.col(time).alias("t"), (F.col(cohort) if cohort else F.lit(None).cast("int")).alias("g"), on.alias("on"), number(rel).alias("r"), F.col(y).cast("double").alias("y"),
        F.xxhash64(cluster or unit).alias("cluster"), *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(covariates)],
    ).persist()
    # A calendar's values each.
    seen = one.agg(F.collect_set("t"), F.collect_set("g")).first()
    times, cohorts = sorted(seen[0]), sorted(seen[1])
    held = F.collect_list(F.struct(_place(times, F.col("t")).alias("i"), "on", "r", "y", *[f"x{j}" for j in range(len(covariates))])).alias("held")
    units = one.groupBy("label", "u").agg(F.coalesce(_place(cohorts, F.max("g")), F.lit(-1)).alias("cohort"), F.max("cluster").alias("cluster"), held)
    frame = units.select("label", F.xxhash64("u").alias("key"), "cluster", "cohort", "held").persist()
    return Units(frame, times, cohorts, list(covariates), one, cluster is not None)


# Least squares within units


@dataclass
class Within:
    """Coefficients of terms beside unit and period effects; covariances: classical, and clustered."""

    names: list[str]
    beta: np.ndarray
    classical: np.ndarray
    clustered: np.ndarray
    n: int

    def fit(self) -> Fit:
        return Fit(self.names, self.beta, self.clustered, self.n)


#: Of a unit's rows the columns of the terms.
Terms = Callable[[Flat], np.ndarray]


def rel_terms(bounds: Sequence[tuple[int, int]]) -> Terms:
    """A dummy for each range of times since treatment."""

    def terms(f: Flat) -> np.ndarray:
        return np.stack([(f.rel != NONE) & (f.rel >= a) & (f.rel <= b) for a, b in bounds], 1).astype(float) if bounds else np.zeros((len(f.y), 0))

    return terms


def _moments(f: Flat, v: np.ndarray, periods: int) -> np.ndarray:
    """Products of within-unit columns, a dummy per period and those of ``v``, and the rows by period."""
    k = periods + v.shape[1]
    c, inside = f.counts(periods), v - f.means(v)[f.unit]
    n = c.sum(1)
    out = np.zeros((k, k))
    out[:periods, :periods] = np.diag(c.sum(0)) - (c / np.maximum(n, 1)[:, None]).T @ c
    for j in range(v.shape[1]):
        out[:periods, periods + j] = out[periods + j, :periods] = np.bincount(f.at, inside[:, j], periods)
    out[periods:, periods:] = inside.T @ inside
    return np.concatenate([out.ravel(), c.sum(0), [len(f.y), (n > 0).sum()]])


def _solved(m: np.ndarray, periods: int, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(coefficients of periods and terms, the inverse, which periods have rows, the rank). The first period with rows is the base."""
    k = periods + terms + 1
    full, rows = m[: k * k].reshape(k, k), m[k * k : k * k + periods]
    have = np.flatnonzero(rows)
    keep = np.concatenate([have[1:], np.arange(periods, k - 1)]).astype(int)
    inverse, beta = np.zeros((k - 1, k - 1)), np.zeros(k - 1)
    if len(keep):
        inverse[np.ix_(keep, keep)] = np.linalg.pinv(full[np.ix_(keep, keep)], rcond=1e-10, hermitian=True)
        beta = inverse @ full[:-1, -1]
    return beta, inverse, rows > 0, int(np.linalg.matrix_rank(inverse, hermitian=True)) if len(keep) else 0


def within(units: Units, names: Sequence[str], terms: Terms, clean: bool = False) -> dict[str, Within]:
    """y on the terms and covariates with unit and period effects, by label; over untreated rows only if ``clean``."""
    periods, names = len(units.times), [*names, *units.covariates]
    k = periods + len(names)
    used = (lambda f: f.where(~f.on)) if clean else (lambda f: f)

    def columns(f: Flat) -> np.ndarray:
        return np.concatenate([terms(f), f.x], 1)

    def first(label: str, f: Flat) -> np.ndarray:
        f = used(f)
        return _moments(f, np.concatenate([columns(f), f.y[:, None]], 1), periods)

    m = units.sums(first, (k + 1) ** 2 + periods + 2)
    solved = {label: _solved(v, periods, len(names)) for label, v in m.items()}

    def scores(label: str, f: Flat) -> np.ndarray:
        f, beta = used(f), solved[label][0]
        v = columns(f)
        inside = v - f.means(v)[f.unit]
        fitted = beta[f.at] + v @ beta[periods:]
        e = f.y - fitted
        e = e - f.means(e[:, None])[f.unit, 0]
        # A unit's residuals sum to zero, so its period columns need no demeaning.
        out = np.zeros((f.n, k))
        np.add.at(out, (f.unit, f.at), e)
        out[:, periods:] = np.stack([f.by_unit(c * e) for c in inside.T], 1) if len(names) else out[:, periods:]
        return out

    meat, out = units.of_clusters(scores, k), {}
    for label, (beta, inverse, _, rank) in solved.items():
        full = m[label][: (k + 1) ** 2].reshape(k + 1, k + 1)
        n, some = m[label][-2:]
        groups, left = meat[label][-1], full[-1, -1] - beta @ full[:-1, -1]
        spread = inverse @ meat[label][:-1].reshape(k, k) @ inverse * (groups / (groups - 1) if groups > 1 else 1)
        free = max(1, n - some - rank)
        pick = slice(periods, k)
        out[label] = Within(list(names), beta[pick], (inverse * left / free)[pick, pick], spread[pick, pick], int(n))
    return out


# Imputation


@dataclass
class Effects:
    """Means of effects by target, their covariance over clusters, the treated rows of each and those without effect."""

    names: list[str]
    estimate: np.ndarray
    cov: np.ndarray
    n: np.ndarray
    dropped: int


def imputation(units: Units, horizons: Sequence[int] = (), static: bool = True) -> dict[str, Effects]:
    """Effects of treated rows: y less what unit and period effects and covariates, fitted on untreated rows, predict.

    Targets: the mean over all treated rows, and by time since treatment. An estimate is a weighted sum of outcomes:
    1/N on treated rows of the target, and on untreated rows what the fitted effects pass on: with g the sum of the
    target's within-unit regressors and v = X'X^-1 g, minus v by the row's demeaned regressors, and the share of its unit.
    A unit's untreated residuals sum to zero, so of that weight only the row's own period and covariates count in the
    unit's score. Treated residuals are taken from their cohort-and-period mean.
    """
    periods, p, cohorts = len(units.times), len(units.covariates), len(units.cohorts) + 1
    names = [*(["treat"] if static else []), *[f"tau{h}" for h in horizons]]
    k, wide = len(names), periods + p
    m = units.sums(lambda label, f: _moments(c := f.where(~f.on), np.concatenate([c.x, c.y[:, None]], 1), periods), (wide + 1) ** 2 + periods + 2)
    solved = {}
    for label, v in m.items():
        beta, inverse, have, _ = _solved(v, periods, p)
        beta[:periods][~have] = np.nan
        solved[label] = beta, inverse

    def parts(label: str, f: Flat) -> tuple[Flat, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(untreated rows, their number by unit, covariates' means, all rows' gaps, hits by target)."""
        beta, clean = solved[label][0], f.where(~f.on)
        rest = f.y - beta[f.at] - f.x @ beta[periods:]
        gap = rest - clean.means(rest[~f.on][:, None])[f.unit, 0]
        ok = f.on & np.isfinite(gap)
        hits = np.stack([*([ok] if static else []), *[ok & (f.rel == h) for h in horizons]], 1) if k else np.zeros((len(f.y), 0), bool)
        return clean, np.bincount(clean.unit, minlength=f.n), clean.means(f.x[~f.on]), gap, hits

    def second(label: str, f: Flat) -> np.ndarray:
        clean, n0, mean, gap, hits = parts(label, f)
        g = np.zeros((k, wide))
        for j in range(k):
            h = hits[:, j]
            share = f.by_unit(h.astype(float)) / np.maximum(n0, 1)
            g[j, :periods] = np.bincount(f.at[h], minlength=periods) - np.bincount(clean.at, share[clean.unit], periods)
            g[j, periods:] = (f.x[h] - mean[f.unit[h]]).sum(0)
        ok = f.on & np.isfinite(gap)
        cell = (f.cohort[f.unit[ok]] + 1) * periods + f.at[ok]
        cells = [np.bincount(cell, w, cohorts * periods) for w in (gap[ok], np.ones(int(ok.sum())))]
        return np.concatenate([hits.sum(0), [gap[hits[:, j]].sum() for j in range(k)], g.ravel(), *cells, [(f.on & ~ok).sum()]])

    s = units.sums(second, 2 * k + k * wide + 2 * cohorts * periods + 1)
    lean, means = {}, {}
    for label, v in s.items():
        lean[label] = v[2 * k : 2 * k + k * wide].reshape(k, wide) @ solved[label][1].T
        total, n = v[2 * k + k * wide : -1].reshape(2, -1)
        means[label] = total / np.maximum(n, 1)

    def scores(label: str, f: Flat) -> np.ndarray:
        clean, _, _, gap, hits = parts(label, f)
        above = gap - means[label][(f.cohort[f.unit] + 1) * periods + f.at]
        out = np.zeros((f.n, k))
        for j in range(k):
            h, v = hits[:, j], lean[label][j]
            out[:, j] = f.by_unit(np.where(h, above, 0.0))
            out[:, j] -= clean.by_unit((v[clean.at] + clean.x @ v[periods:]) * gap[~f.on])
        return out / np.maximum(1, s[label][:k])

    squares, out = units.of_clusters(scores, k), {}
    for label, v in s.items():
        n = v[:k]
        with np.errstate(invalid="ignore", divide="ignore"):
            out[label] = Effects(names, v[k : 2 * k] / n, squares[label][:-1].reshape(k, k), n.astype(int), int(v[-1]))
    return out


# Group-time effects


@dataclass
class GroupTime:
    """Cells (cohort, t) and their means. att, error, treated and control have a value per cell, NaN where it can't be
    estimated; names, estimate and cov are of the aggregates ``simple`` and, by time since treatment, ``rel_..``."""

    cells: list[tuple[int, int]]
    att: np.ndarray
    error: np.ndarray
    treated: np.ndarray
    control: np.ndarray
    names: list[str]
    estimate: np.ndarray
    cov: np.ndarray
    clustered: np.ndarray
    draws: np.ndarray

    def band(self, level: float = 0.95) -> float:
        """The multiple of all errors that holds for all aggregates by time at once, from the multiplier draws."""
        error = np.sqrt(np.diag(self.cov))[1:]
        t = np.abs(self.draws[:, 1:][:, error > 0]) / error[error > 0]
        return float(np.quantile(t.max(1), level)) if t.size else float("nan")


def _sign(key: np.ndarray, draws: int) -> np.ndarray:
    """A fair +1 or -1 for each unit and draw, by hash."""
    h = key.view(np.uint64)[:, None] + np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
    return ((h >> np.uint64(63)).astype(np.int8) * 2 - 1).astype(float)


def group_time(units: Units, anticipation: int = 1, against: str = "notyet", base: str = "varying", weigh: str = "cell", draws: int = 0, steps: int = 30) -> dict[str, GroupTime]:
    """ATT(g, t) of units that are there at t and at its base period, doubly robust in the covariates of the base period.

    A cell regresses its controls' differences on the covariates (and a constant) and fits a logit of being treated; its
    effect is the treated mean of what the regression leaves, less that of the controls by their odds. All cells of all
    labels go through each pass together; the logit takes a pass a Newton step. Without covariates that is the
    difference of mean differences. times and cohorts are integers; controls and base periods are as in ``did.group_time``.

    A unit's influence on a cell is known once its sums are; errors are roots of sums of squares, so those of aggregates
    follow from the unit's weighted sum, with its part in the weights. weigh: by the cell's treated units (cell), or by
    the cohort's units of the label (cohort). draws: multiplier draws of the aggregates.
    """
    place = {t: i for i, t in enumerate(units.times)}
    q, periods, cohorts = 1 + len(units.covariates), len(units.times), len(units.cohorts)
    cells, at, start, group, limit = [], [], [], [], []
    for j, g in enumerate(units.cohorts):
        for t in units.times:
            b = g - 1 - anticipation if base == "universal" or t >= g - anticipation else t - 1
            if b in place and b != t:
                cells.append((g, t))
                at.append(place[t])
                start.append(place[b])
                group.append(j)
                limit.append(max(t, b) + anticipation)
    at, start, group, limit = (np.array(v, int) for v in (at, start, group, limit))
    cohort_at, kk = np.array([*units.cohorts, 0]), len(cells)

    def held(f: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(differences, whether treated, whether control, constant and covariates at the base) by unit and cell."""
        y = np.full((f.n, periods), np.nan)
        y[f.unit, f.at] = f.y
        x = np.full((f.n, periods, q - 1), np.nan)
        x[f.unit, f.at] = f.x
        d = y[:, at] - y[:, start]
        ok = np.isfinite(d)
        mine = f.cohort[:, None] == group
        later = f.cohort[:, None] < 0
        if against == "notyet":
            later = later | (cohort_at[f.cohort][:, None] > limit)
        z = np.concatenate([np.ones((f.n, kk, 1)), np.nan_to_num(x[:, start])], 2)
        return np.where(ok, d, 0.0), (ok & mine).astype(float), (ok & ~mine & later).astype(float), z

    outer = lambda w, z: np.einsum("nk,nkp,nkq->kpq", w, z, z, optimize=True)

    def first(label: str, f: Flat) -> np.ndarray:
        d, tr, ct, z = held(f)
        return np.concatenate([tr.sum(0), ct.sum(0), outer(ct, z).ravel(), np.einsum("nk,nkp->kp", ct * d, z).ravel(), np.bincount(f.cohort + 1, minlength=cohorts + 1)])

    s = units.sums(first, 2 * kk + kk * q * q + kk * q + cohorts + 1)
    n1, n0 = ({label: v[a * kk : (a + 1) * kk] for label, v in s.items()} for a in (0, 1))
    solve = lambda a, b: np.einsum("kpq,kq->kp", np.linalg.pinv(a, hermitian=True), b)
    bread, line, odds = {}, {}, {}
    for label, v in s.items():
        xx = v[2 * kk : 2 * kk + kk * q * q].reshape(kk, q, q)
        bread[label] = np.linalg.pinv(xx, hermitian=True)
        line[label] = solve(xx, v[2 * kk + kk * q * q : 2 * kk + kk * q * (q + 1)].reshape(kk, q))
        odds[label] = np.zeros((kk, q))
        odds[label][:, 0] = np.log(np.maximum(n1[label], 1e-9) / np.maximum(n0[label], 1e-9))

    def chance(z: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.clip(1 / (1 + np.exp(-np.clip(np.einsum("nkp,kp->nk", z, b), -30, 30))), 1e-9, 1 - 1e-9)

    def newton(label: str, f: Flat) -> np.ndarray:
        d, tr, ct, z = held(f)
        p, w = chance(z, odds[label]), tr + ct
        return np.concatenate([outer(w * p * (1 - p), z).ravel(), np.einsum("nk,nkp->kp", tr - w * p, z).ravel()])

    # With a constant alone the start is the answer.
    hessian = {label: (n1[label] * n0[label] / np.maximum(n1[label] + n0[label], 1)).reshape(kk, 1, 1) for label in s}
    for _ in range(steps if q > 1 else 0):
        m, moved = units.sums(newton, kk * q * (q + 1)), 0.0
        for label, v in m.items():
            hessian[label] = v[: kk * q * q].reshape(kk, q, q)
            change = solve(hessian[label], v[kk * q * q :].reshape(kk, q))
            change = np.where(((n1[label] > 0) & (n0[label] > 0))[:, None], np.clip(change, -5, 5), 0.0)
            odds[label] += change
            moved = max(moved, float(np.abs(change).max(initial=0)))
        if moved < 1e-9:
            break
    slope = {label: np.linalg.pinv(h, hermitian=True) for label, h in hessian.items()}

    def weights(label: str, f: Flat):
        d, tr, ct, z = held(f)
        p = chance(z, odds[label])
        return d - np.einsum("nkp,kp->nk", z, line[label]), tr, ct, z, p, ct * p / (1 - p)

    def third(label: str, f: Flat) -> np.ndarray:
        e, tr, ct, z, p, wc = weights(label, f)
        along = lambda w: np.einsum("nk,nkp->kp", w, z).ravel()
        return np.concatenate([wc.sum(0), (tr * e).sum(0), (wc * e).sum(0), along(tr), along(wc), along(wc * e)])

    t3 = units.sums(third, 3 * kk + 3 * kk * q)
    names = ["simple", *[f"rel_{r}" for r in sorted({t - g for g, t in cells})]]
    rel = np.array([t - g for g, t in cells], int)
    member = np.stack([rel >= 0, *[rel == int(n[4:]) for n in names[1:]]], 1).astype(float) if kk else np.zeros((0, 1))
    done, out = {}, {}
    for label, v in t3.items():
        ok = (n1[label] > 0) & (n0[label] > 0)
        sc, st, se = v[:kk], v[kk : 2 * kk], v[2 * kk : 3 * kk]
        m1, m3, m2 = v[3 * kk :].reshape(3, kk, q)
        s1, sc = np.where(ok, n1[label], 1.0), np.where(ok, sc, 1.0)
        a, b = st / s1, se / sc
        att = np.where(ok, a - b, 0.0)
        size = s[label][-cohorts:][group] if weigh == "cohort" and kk else n1[label]
        mass = np.where(ok, size, 0.0)[:, None] * member
        total = mass.sum(0)
        estimate = (mass * att[:, None]).sum(0) / np.maximum(total, 1e-300)
        share = mass / np.maximum(total, 1e-300)
        pull = np.where(ok, 1.0, 0.0)[:, None] * member * (att[:, None] - estimate) / np.maximum(total, 1e-300)
        done[label] = ok, s1, sc, a, b, m1, m2 - b[:, None] * m3, m3, share, pull
        out[label] = [att, estimate, total]

    def influence(label: str, f: Flat) -> tuple[np.ndarray, np.ndarray]:
        """By unit, of cells and of aggregates."""
        ok, s1, sc, a, b, m1, m2, m3, share, pull = done[label]
        e, tr, ct, z, p, wc = weights(label, f)
        through = lambda w, by, to: w * np.einsum("nkp,kpq,kq->nk", z, by, to, optimize=True)
        mine = (tr * (e - a) - through(ct * e, bread[label], m1)) / s1
        mine -= (wc * (e - b) + through(tr - (tr + ct) * p, slope[label], m2) - through(ct * e, bread[label], m3)) / sc
        mine = np.where(ok, mine, 0.0)
        part = (f.cohort[:, None] == group).astype(float) if weigh == "cohort" else tr
        return mine, mine @ share + part @ pull

    r = len(names)

    def squares(label: str, f: Flat) -> np.ndarray:
        mine, agg = influence(label, f)
        return np.concatenate([(mine**2).sum(0), (agg.T @ agg).ravel(), (_sign(f.key, draws).T @ agg).ravel() if draws else []])

    t4 = units.sums(squares, kk + r * r + draws * r)
    clusters = units.of_clusters(lambda label, f: influence(label, f)[1], r)
    result = {}
    for label, v in t4.items():
        ok, (att, estimate, total) = done[label][0], out[label]
        some, nan = total > 0, np.full(kk, np.nan)
        cov, wide = v[kk : kk + r * r].reshape(r, r), clusters[label][:-1].reshape(r, r)
        result[label] = GroupTime(
            cells, np.where(ok, att, nan), np.where(ok, np.sqrt(v[:kk]), nan), n1[label].astype(int), n0[label].astype(int),
            [n for n, x in zip(names, some, strict=True) if x], estimate[some], cov[np.ix_(some, some)], wide[np.ix_(some, some)], v[kk + r * r :].reshape(draws, r)[:, some],
        )
    return result


# Tests of leads


def joint_tests(beta: np.ndarray, full: np.ndarray, clustered: np.ndarray) -> dict[str, tuple[float, int, float]]:
    """Wald tests of all being zero: with the full covariance, the clustered one, and the clustered one's diagonal.

    A pseudo-inverse serves where a covariance is singular, with its rank for degrees of freedom.
    """
    error = np.sqrt(np.maximum(np.diag(clustered), 0))
    some = error > 0
    z = float(((beta[some] / error[some]) ** 2).sum())
    return {"full": wald(beta, full), "clustered": wald(beta, clustered), "diagonal": (z, int(some.sum()), chi2_sf(z, int(some.sum())) if some.any() else float("nan"))}


def lead_tests(units: Units, leads: Sequence[int] = range(-6, -1), lags: Sequence[int] = range(7), anticipation: int = 1) -> list[tuple[str, str, str, int, float, int, float]]:
    """(label, method, test, leads, statistic, degrees of freedom, p) for two-way fixed effects, group-time effects and imputation.

    Two-way: leads and lags together, the outermost cumulative; imputation: leads among untreated rows; group-time: the
    aggregates by time since treatment, from the first lead to the one before treatment.
    """
    low, high = min(leads), max(lags)
    bounds = [(h if h > low else NONE + 1, h) for h in leads] + [(h, h if h < high else -NONE - 1) for h in lags]
    names, k = [f"lead_{-h}" for h in leads] + [f"lag_{h}" for h in lags], len(leads)
    found = {"two-way": within(units, names, rel_terms(bounds)), "imputation": within(units, names[:k], rel_terms([(h, h) for h in leads]), clean=True)}
    out = []
    for method, fits in found.items():
        for label, w in fits.items():
            out += [(label, method, test, k, *v) for test, v in joint_tests(w.beta[:k], w.classical[:k, :k], w.clustered[:k, :k]).items()]
    for label, g in group_time(units, anticipation).items():
        pick = [i for i, n in enumerate(g.names) if n.startswith("rel_") and low <= int(n[4:]) < 0]
        which = np.ix_(pick, pick)
        out += [(label, "group-time", test, len(pick), *v) for test, v in joint_tests(g.estimate[pick], g.cov[which], g.clustered[which]).items()]
    return out


def effect_rows(effects: dict[str, Effects]) -> list[tuple]:
    """(label, term, estimate, std_error, conf_low, conf_high, p_value, n, dropped)"""
    out = []
    for label, e in effects.items():
        for j, name in enumerate(e.names):
            n = int(e.n[j])
            b, s = (float(e.estimate[j]), float(max(0.0, e.cov[j, j]) ** 0.5)) if n else (None, None)
            out.append((label, name, b, s, b - 1.96 * s if n else None, b + 1.96 * s if n else None, normal_p(b / s) if n and s else None, n, e.dropped))
    return out
