"""Difference in differences on unit-by-time panels: two-way fixed effects, imputation, group-time effects."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkiln.estimators import batched
from panelkiln.estimators.linear import Fit, chi2_sf, clustered, demeaned, moments, solve, wald
from panelkiln.operators.quantiles import quantiles


def _periods(df: DataFrame, time: str) -> list:
    """The panel's periods: as many as the calendar has."""
    return [r[0] for r in df.select(time).distinct().orderBy(time).collect()]


def twfe(df: DataFrame, y: str, xs: Sequence[str], unit: str, time: str, errors: str = "cluster") -> Fit:
    """y on xs with unit and time effects: within units by demeaning, times as dummies (less one).

    errors: cluster (by unit) or iid.
    """
    base = df.dropna(subset=[y, unit, time, *xs]).select(unit, time, *[F.col(c).cast("double").alias(c) for c in (y, *xs)])
    times = _periods(base, time)
    dummies = {f"_d{i}": (F.col(time) == t).cast("double") for i, t in enumerate(times[1:])}
    names = [*xs, *dummies]
    within = demeaned(base.withColumns(dummies), unit, [y, *names])
    m, n = moments(within, [*names, y])
    xx, xy, yy = m[:-1, :-1], m[:-1, -1], m[-1, -1]
    beta = solve(xx, xy)
    if errors == "cluster":
        fitted = sum((F.col(c) * float(b) for c, b in zip(names, beta, strict=True)), F.lit(0.0))
        cov = clustered(within, unit, names, F.col(y) - fitted, xx)
    else:
        units = base.select(unit).distinct().count()
        cov = np.linalg.pinv(xx, hermitian=True) * (yy - beta @ xy) / max(1, n - units - len(names))
    k = len(xs)
    return Fit(list(xs), beta[:k], cov[:k, :k], n, 1 - (yy - beta @ xy) / yy if yy > 0 else None)


def twfe_balanced(df: DataFrame, y: str, x: str, unit: str, time: str) -> DataFrame:
    """The coefficient on a balanced panel without covariates: both demeaned twice; plain aggregates joined back."""
    means = lambda by, s: df.groupBy(by).agg(F.avg(x).alias(f"_x{s}"), F.avg(y).alias(f"_y{s}"))
    total = df.agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    joined = df.join(means(unit, "u"), unit).join(means(time, "t"), time).crossJoin(F.broadcast(total))  # one row
    a, b = (F.col(c) - F.col(f"_{s}u") - F.col(f"_{s}t") + F.col(f"_m{s}") for c, s in ((x, "x"), (y, "y")))
    return joined.agg((F.sum(a * b) / F.sum(a * a)).alias("estimate"), F.count("*").alias("n"))


def event_study(df: DataFrame, y: str, unit: str, time: str, rel: str, k: int = 6, base: int = -1, covariates: Sequence[str] = ()) -> Fit:
    """Leads and lags from -k to k less the base, the outermost cumulative; rel is NULL for the never treated."""
    terms = {}
    for j in range(-k, k + 1):
        if j != base:
            hit = F.col(rel) <= j if j == -k else F.col(rel) >= j if j == k else F.col(rel) == j
            terms[f"rel_{j}"] = F.coalesce(hit, F.lit(False)).cast("double")
    return twfe(df.withColumns(terms), y, [*terms, *covariates], unit, time)


def imputation_static(df: DataFrame, y: str, unit: str, time: str, treated: Column, cohort: str, covariates: Sequence[str] = ()) -> DataFrame:
    """(term, estimate, std_error, conf_low, conf_high, n, dropped): the mean effect over treated rows."""
    return _imputed(df, y, unit, time, treated, cohort, None, (), True, covariates)


def imputation_dynamic(df: DataFrame, y: str, unit: str, time: str, treated: Column, cohort: str, rel: str, horizons: Sequence[int] = range(7), covariates: Sequence[str] = ()) -> DataFrame:
    """The mean effect by time since treatment."""
    return _imputed(df, y, unit, time, treated, cohort, rel, horizons, False, covariates)


#: Columns of ``imputation_table``.
EFFECTS = "label string, term string, estimate double, std_error double, conf_low double, conf_high double, p_value double, n long, dropped long"


def imputation_table(df: DataFrame, y: str, unit: str, time: str, treated: Column, cohort: str, label: str, rel: str | None = None, horizons: Sequence[int] = (), covariates: Sequence[str] = ()) -> DataFrame:
    """Static effects, and those of ``horizons``, of all panels that ``label`` names (a name or a list of names by row), from one reading of the rows."""
    units = batched.gather(df, y, unit, time, cohort, treated, rel, covariates, label)
    try:
        found = batched.effect_rows(batched.imputation(units, horizons))
    finally:
        units.release()
    return df.sparkSession.createDataFrame(found, EFFECTS)


def event_time_table(df: DataFrame, y: str, unit: str, time: str, treated: Column, cohort: str, rel: str, k: int = 6, covariates: Sequence[str] = ()) -> DataFrame:
    """One table of terms -k to k (-1 left out): leads from the pretrend regression on untreated rows, horizons from imputation."""
    kept = df.persist()
    try:
        after = imputation_dynamic(kept, y, unit, time, treated, cohort, rel, range(k + 1), covariates)
        fit, _ = pretrends(kept, y, unit, time, treated, rel, range(-k, -1), covariates)
    finally:
        kept.unpersist()
    before = [(f"pre{h}", b, s, b - 1.96 * s, b + 1.96 * s, p, None, None) for h, (_, b, s, p) in zip(range(-k, -1), fit.rows(), strict=True)]
    leads = df.sparkSession.createDataFrame(before, after.schema)
    return leads.unionByName(after).withColumn("time", F.regexp_extract("term", r"-?[0-9]+$", 0).cast("int"))


def _imputed(df: DataFrame, y: str, unit: str, time: str, treated: Column, cohort: str, rel: str | None, horizons: Sequence[int], static: bool, covariates: Sequence[str]) -> DataFrame:
    units = batched.gather(df, y, unit, time, cohort, treated, rel, covariates)
    try:
        found = batched.effect_rows(batched.imputation(units, horizons, static))
    finally:
        units.release()
    return df.sparkSession.createDataFrame([r[1:] for r in found], EFFECTS.removeprefix("label string, "))


def pretrends(df: DataFrame, y: str, unit: str, time: str, treated: Column, rel: str, leads: Sequence[int] = range(-6, -1), covariates: Sequence[str] = ()) -> tuple[Fit, tuple[float, int, float]]:
    """Lead dummies among untreated rows with unit and time effects, and the Wald test that all are zero."""
    clean = df.where(~F.coalesce(treated, F.lit(False)))
    terms = {f"pre{h}": F.coalesce(F.col(rel) == h, F.lit(False)).cast("double") for h in leads}
    fit = twfe(clean.withColumns(terms), y, [*terms, *covariates], unit, time)
    k = len(terms)
    return Fit(fit.names[:k], fit.beta[:k], fit.cov[:k, :k], fit.n), wald(fit.beta[:k], fit.cov[:k, :k])


def pretrend_tests(fit: Fit) -> dict[str, tuple[float, int, float]]:
    """The Wald test with the full covariance and with its diagonal alone."""
    z = fit.beta[fit.error > 0] / fit.error[fit.error > 0]
    diagonal = float((z**2).sum())
    return {"full": wald(fit.beta, fit.cov), "diagonal": (diagonal, len(z), chi2_sf(diagonal, len(z)) if len(z) else float("nan"))}


def group_time(df: DataFrame, y: str, unit: str, time: str, cohort: str, anticipation: int = 1, against: str = "notyet", base: str = "varying", covariates: Sequence[str] = ()) -> DataFrame:
    """ATT(g, t) from mean long differences, treated less controls; doubly robust with covariates.

    time and cohort are integers (month ids), cohort NULL for the never treated. Controls: not treated by t plus
    anticipation, or never. Differences start from g - 1 - anticipation; with a varying base (the default of the
    usual packages) those before treatment start from the period before, with a universal one all from the same.
    Units are read once and never joined; errors are those of sums over independent units.
    """
    units = batched.gather(df, y, unit, time, cohort, covariates=covariates)
    try:
        found = batched.group_time(units, anticipation, against, base)
    finally:
        units.release()
    rows = [(*cell, cell[1] - cell[0], float(a), float(e), int(n), int(m)) for g in found.values() for cell, a, e, n, m in zip(g.cells, g.att, g.error, g.treated, g.control, strict=True) if n and m]
    return df.sparkSession.createDataFrame(rows, "cohort int, t int, rel int, att double, std_error double, n_treated long, n_control long")


def group_time_table(df: DataFrame, y: str, unit: str, time: str, cohort: str, label: str | None = None, covariates: Sequence[str] = (), weigh: str = "cell", draws: int = 0, cluster: str | None = None) -> DataFrame:
    """(label, term, estimate, std_error, conf_low, conf_high, band_low, band_high): group-time effects in one number, and by time since treatment.

    Errors take in that the weights are estimated too. With multiplier draws, bands hold for all times of a label at once.
    """
    units = batched.gather(df, y, unit, time, cohort, covariates=covariates, label=label, cluster=cluster)
    try:
        found = batched.group_time(units, weigh=weigh, draws=draws)
    finally:
        units.release()
    rows = []
    for name, g in found.items():
        times = g.band() if draws and len(g.names) > 1 else None
        for term, b, v in zip(g.names, g.estimate, np.diag(g.clustered), strict=True):
            s = float(max(v, 0.0) ** 0.5)
            wide = times * s if times is not None and term != "simple" else None
            rows.append((name, term, float(b), s, b - 1.96 * s, b + 1.96 * s, b - wide if wide is not None else None, b + wide if wide is not None else None))
    rows = [tuple(float(x) if isinstance(x, np.floating) else x for x in r) for r in rows]
    return df.sparkSession.createDataFrame(rows, "label string, term string, estimate double, std_error double, conf_low double, conf_high double, band_low double, band_high double")


def lead_table(df: DataFrame, y: str, unit: str, time: str, cohort: str, treated: Column, rel: str, label: str | None = None, covariates: Sequence[str] = (), cluster: str | None = None) -> DataFrame:
    """(label, method, test, leads, statistic, df, p_value): joint tests of the leads of three methods, with three covariances each."""
    units = batched.gather(df, y, unit, time, cohort, treated, rel, covariates, label, cluster)
    try:
        rows = batched.lead_tests(units)
    finally:
        units.release()
    return df.sparkSession.createDataFrame(rows, "label string, method string, test string, leads int, statistic double, df int, p_value double")


def aggregate_att(cells: DataFrame, how: str = "simple") -> DataFrame:
    """Means over cells weighted by treated units: over all t >= g (simple), or by time since treatment (dynamic)."""
    if how == "dynamic":
        return cells.groupBy("rel").agg((F.sum(F.col("att") * F.col("n_treated")) / F.sum("n_treated")).alias("att"), F.sum("n_treated").alias("n"))
    return cells.where("rel >= 0").agg((F.sum(F.col("att") * F.col("n_treated")) / F.sum("n_treated")).alias("att"), F.sum("n_treated").alias("n"))


def did_2x2(df: DataFrame, y: str, treated: str, post: str) -> DataFrame:
    """Means of the four cells and their double difference."""
    cell = lambda a, b: F.avg(F.when((F.col(treated) == a) & (F.col(post) == b), F.col(y)))
    out = df.agg(cell(1, 1).alias("t_post"), cell(1, 0).alias("t_pre"), cell(0, 1).alias("c_post"), cell(0, 0).alias("c_pre"))
    return out.withColumn("did", (F.col("t_post") - F.col("t_pre")) - (F.col("c_post") - F.col("c_pre")))


def heterogeneity(df: DataFrame, y: str, x: str, unit: str, time: str, by: str) -> dict[str, Fit]:
    """Effects below and from the median of a unit's value on."""
    cut = quantiles(df.select(unit, by).distinct(), [by], [0.5]).first()["value"]
    half = F.when(F.col(by) < cut, "low").when(F.col(by) >= cut, "high")
    units = batched.gather(df.withColumn("_half", half).where("_half IS NOT NULL"), y, unit, time, None, covariates=[x], label="_half")
    try:
        return {name: w.fit() for name, w in batched.within(units, [], batched.rel_terms([])).items()}
    finally:
        units.release()


def optional_covariates(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Those that exist and have no NULL."""
    have = [n for n in names if n in df.columns]
    if not have:
        return []
    row = df.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in have]).first()
    return [n for n in have if row[n] == 0]
