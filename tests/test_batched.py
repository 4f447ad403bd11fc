"""Batched estimators against dense algebra, label by label."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkiln.estimators import batched, did, linear


def panel(seed: int, units: int = 60, periods: int = 8):
    """An unbalanced panel of two cohorts and never treated units; x moves the outcome and the chance of treatment."""
    rng = np.random.default_rng(seed)
    out = []
    for u in range(units):
        level = rng.normal()
        g = int(rng.choice([4, 6])) if rng.random() < 1 / (1 + np.exp(-level)) else None
        for t in range(periods):
            if rng.random() < 0.93:
                x = float(level + 0.3 * rng.normal())
                y = level + 0.2 * t + 0.4 * x * t + (1.5 if g is not None and t >= g else 0) + rng.normal()
                out.append((u, t, g, float(y), x, f"c{u % 17}"))
    return out


def frame(spark, data, label="a"):
    df = spark.createDataFrame([(*r, label) for r in data], "u int, t int, g int, y double, x double, cl string, label string")
    return df.withColumns({"post": F.coalesce(F.col("t") >= F.col("g"), F.lit(False)), "rel": F.col("t") - F.col("g")})


def logit(z, d):
    b = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]), z.T @ (d - p))
    return b


def dense_cells(data, covariates, weigh, anticipation=1):
    """Cells, influence of each unit on each, and of aggregates, by the textbook's means."""
    us = sorted({r[0] for r in data})
    y, x, g = {}, {}, {}
    for u, t, c, v, w, _ in data:
        y[u, t], x[u, t], g[u] = v, w, c
    times, n = sorted({r[1] for r in data}), len(us)
    cells, att, psi, member = [], [], [], []
    for c in sorted({v for v in g.values() if v is not None}):
        for t in times:
            b = c - 1 - anticipation if t >= c - anticipation else t - 1
            if b not in times or b == t:
                continue
            both = [u for u in us if (u, t) in y and (u, b) in y and (g[u] == c or g[u] is None or g[u] > max(t, b) + anticipation)]
            d = np.array([float(g[u] == c) for u in both])
            if not both or d.sum() in (0, len(both)):
                continue
            dy = np.array([y[u, t] - y[u, b] for u in both])
            z = np.array([[1.0, *([x[u, b]] if covariates else [])] for u in both])
            p = 1 / (1 + np.exp(-z @ logit(z, d)))
            m = len(both)
            xx = np.linalg.inv((z * (1 - d)[:, None]).T @ z / m)
            beta = xx @ (z.T @ ((1 - d) * dy) / m)
            e = dy - z @ beta
            lin_or = (z * ((1 - d) * e)[:, None]) @ xx
            lin_ps = (z * (d - p)[:, None]) @ np.linalg.inv((z * (p * (1 - p))[:, None]).T @ z / m)
            wt, wc = d, p * (1 - d) / (1 - p)
            et, ec = (wt * e).mean() / wt.mean(), (wc * e).mean() / wc.mean()
            one = (wt * e - wt * et - lin_or @ (wt[:, None] * z).mean(0)) / wt.mean()
            two = (wc * e - wc * ec + lin_ps @ ((wc * (e - ec))[:, None] * z).mean(0) - lin_or @ (wc[:, None] * z).mean(0)) / wc.mean()
            inf = np.zeros(n)
            inf[[us.index(u) for u in both]] = (one - two) / m
            cells.append((c, t))
            att.append(et - ec)
            psi.append(inf)
            who = [float(g[u] == c) for u in us] if weigh == "cohort" else [float(g[u] == c and u in both) for u in us]
            member.append(who)
    att, psi, member = np.array(att), np.array(psi), np.array(member)
    out = {}
    for name in ["simple", *sorted({t - c for c, t in cells})]:
        pick = np.array([t >= c if name == "simple" else t - c == name for c, t in cells])
        p = member[pick].mean(1)
        w = p / p.sum()
        by = (member[pick] - p[:, None]) / p.sum() - np.outer(p, (member[pick] - p[:, None]).sum(0)) / p.sum() ** 2
        out[name if name == "simple" else f"rel_{name}"] = (float(w @ att[pick]), w @ psi[pick] + att[pick] @ by / n)
    return cells, att, psi, out


@pytest.mark.parametrize("covariates", [[], ["x"]])
@pytest.mark.parametrize("weigh", ["cell", "cohort"])
def test_group_time_equals_dense(spark, covariates, weigh):
    sets = {"a": panel(1), "b": panel(2, 45)}
    df = frame(spark, sets["a"], "a").unionByName(frame(spark, sets["b"], "b"))
    units = batched.gather(df, "y", "u", "t", "g", covariates=covariates, label="label", cluster="cl")
    found = batched.group_time(units, weigh=weigh, draws=400)
    units.release()
    assert set(found) == {"a", "b"}
    for label, got in found.items():
        cells, att, psi, aggregates = dense_cells(sets[label], covariates, weigh)
        have = {c: (a, e) for c, a, e in zip(got.cells, got.att, got.error, strict=True) if a == a}
        assert set(have) == set(cells)
        assert np.allclose([have[c][0] for c in cells], att, atol=1e-7)
        assert np.allclose([have[c][1] for c in cells], np.sqrt((psi**2).sum(1)), atol=1e-7)
        assert got.names[0] == "simple" and set(got.names) == set(aggregates)
        assert np.allclose(got.estimate, [aggregates[n][0] for n in got.names], atol=1e-7)
        all_psi = np.stack([aggregates[n][1] for n in got.names])
        assert np.allclose(got.cov, all_psi @ all_psi.T, atol=1e-8)
        clusters = [f"c{u % 17}" for u in sorted({r[0] for r in sets[label]})]
        by = np.stack([all_psi[:, [c == k for c in clusters]].sum(1) for k in sorted(set(clusters))], 1)
        assert np.allclose(got.clustered, by @ by.T, atol=1e-8)
        assert np.allclose(got.draws.std(0), np.sqrt(np.diag(got.cov)), rtol=0.25) and 1.96 < got.band() < 4.5


def test_group_time_recovers_the_effect(spark):
    """x drives both outcome paths and treatment: means of differences are off, the doubly robust effect isn't."""
    df = frame(spark, panel(7, 900))
    rows = {c: {r["term"]: r for r in did.group_time_table(df, "y", "u", "t", "g", covariates=v).collect()} for c, v in (("plain", []), ("robust", ["x"]))}
    robust = rows["robust"]["simple"]
    assert abs(robust["estimate"] - 1.5) < 3 * robust["std_error"] < 0.6
    assert abs(rows["plain"]["simple"]["estimate"] - 1.5) > 5 * rows["plain"]["simple"]["std_error"]


def dense_within(data, columns):
    us, ts = sorted({r[0] for r in data}), sorted({r[1] for r in data})
    x = np.array([[*c, *[r[0] == u for u in us], *[r[1] == t for t in ts[1:]]] for r, c in zip(data, columns, strict=True)], float)
    y = np.array([r[3] for r in data])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e, bread = y - x @ beta, np.linalg.pinv(x.T @ x)
    scores = {}
    for i, r in enumerate(data):
        scores[r[5]] = scores.get(r[5], 0) + x[i] * e[i]
    meat, k = sum(np.outer(s, s) for s in scores.values()), len(columns[0])
    rank = np.linalg.matrix_rank(x)
    return beta[:k], (bread * (e @ e) / (len(y) - rank))[:k, :k], (bread @ meat @ bread * len(scores) / (len(scores) - 1))[:k, :k]


def test_lead_tests_equal_dense(spark):
    data = panel(3)
    df = frame(spark, data)
    got = {(r["method"], r["test"]): r for r in did.lead_table(df, "y", "u", "t", "g", F.col("post"), "rel", "label", ["x"], "cl").collect()}
    assert len(got) == 9
    leads, lags = range(-6, -1), range(7)

    def dummies(r):
        rel = None if r[2] is None else r[1] - r[2]
        return [float(rel is not None and (rel <= h if h == -6 else rel == h)) for h in leads] + [float(rel is not None and (rel >= h if h == 6 else rel == h)) for h in lags] + [r[4]]

    clean = [r for r in data if r[2] is None or r[1] < r[2]]
    found = {"two-way": dense_within(data, [dummies(r) for r in data]), "imputation": dense_within(clean, [[float(r[2] is not None and r[1] - r[2] == h) for h in leads] + [r[4]] for r in clean])}
    for method, (beta, classical, clustered) in found.items():
        for test, want in batched.joint_tests(beta[:5], classical[:5, :5], clustered[:5, :5]).items():
            r = got[method, test]
            assert (r["leads"], r["df"]) == (5, want[1]) and abs(r["statistic"] - want[0]) < 1e-5 * max(1, want[0])
    _, _, _, aggregates = dense_cells(data, True, "cell")
    names = [f"rel_{h}" for h in range(-6, 0) if f"rel_{h}" in aggregates]
    beta, psi = np.array([aggregates[n][0] for n in names]), np.stack([aggregates[n][1] for n in names])
    stat, rank, p = linear.wald(beta, psi @ psi.T)
    r = got["group-time", "full"]
    assert r["leads"] == len(names) and r["df"] == rank and abs(r["statistic"] - stat) < 1e-4 * stat and abs(r["p_value"] - p) < 1e-6


def test_imputation_by_label_equals_alone(spark):
    a, b = frame(spark, panel(1), "a"), frame(spark, panel(2), "b")
    both = did.imputation_table(a.unionByName(b).withColumn("labels", F.array("label", F.lit("all"))).withColumn("u", F.concat("label", "u")), "y", "u", "t", F.col("post"), "g", "labels", "rel", range(3), ["x"])
    got = {(r["label"], r["term"]): r for r in both.collect()}
    assert {k[0] for k in got} == {"a", "b", "all"}
    for name, df in (("a", a), ("b", b)):
        for r in [did.imputation_static(df, "y", "u", "t", F.col("post"), "g", ["x"]).first(), *did.imputation_dynamic(df, "y", "u", "t", F.col("post"), "g", "rel", range(3), ["x"]).collect()]:
            mine = got[name, r["term"]]
            assert mine["n"] == r["n"] and abs(mine["estimate"] - r["estimate"]) < 1e-9 and abs(mine["std_error"] - r["std_error"]) < 1e-9


def test_empty_panels(spark):
    df = frame(spark, panel(1)).where("u < 0")
    assert did.group_time(df, "y", "u", "t", "g").collect() == []
    assert did.imputation_table(df, "y", "u", "t", F.col("post"), "g", "label").collect() == []
    assert did.imputation_static(frame(spark, panel(1)).where("g IS NULL"), "y", "u", "t", F.col("post"), "g").first()["n"] == 0


def test_units_are_worked_on_a_few_at_a_time(spark):
    """However many units a batch has, no array has a row for more than UNITS of them; what is added up stays."""
    data = spark.range(1200).selectExpr("id AS u", "explode(sequence(0, 3)) AS t", "IF(id % 3 = 0, 2, NULL) AS g").selectExpr("*", "CAST(u % 7 + t AS DOUBLE) AS y")
    units = batched.gather(data.coalesce(1), "y", "u", "t", "g")
    try:
        kept = units.frame.toArrow().combine_chunks()
        pieces = [f for batch in kept.to_batches() for _, f in batched.flats(batch, 0)]
        sums = units.sums(lambda label, f: np.array([f.n, f.n <= batched.UNITS, f.y.sum(), len(f.y), f.unit.max() < f.n]), 5)[""]
    finally:
        units.release()
    assert max(f.n for f in pieces) <= batched.UNITS < 1200
    assert sum(f.n for f in pieces) == 1200 and sorted(k for f in pieces for k in f.key.tolist()) == sorted(kept["key"].to_pylist())
    assert sum(f.y.sum() for f in pieces) == sums[2] == sum(u % 7 + t for u in range(1200) for t in range(4)) and sums[0] == 1200 and sums[3] == 4800
