"""Estimators against dense least squares and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkiln.estimators import did, linear
from panelkiln.estimators import panel as panels


def tiny(drop: bool):
    rng = np.random.default_rng(4)
    out = []
    for u in range(12):
        g = {0: 3, 1: 5}.get(u % 3)
        for t in range(7):
            if not (drop and u == 4 and t == 2):
                out.append((u, t, g, float(u + 0.3 * t + (2.0 if g is not None and t >= g else 0) + rng.normal()), float(rng.normal())))
    return out


def frame(spark, data):
    df = spark.createDataFrame(data, "u int, t int, g int, y double, x double")
    return df.withColumns({"post": F.coalesce(F.col("t") >= F.col("g"), F.lit(False)).cast("double"), "rel": F.col("t") - F.col("g")})


def dense(data, cols):
    us, ts = sorted({d[0] for d in data}), sorted({d[1] for d in data})
    x = np.array([[*c, *[d[0] == u for u in us], *[d[1] == t for t in ts[1:]]] for d, c in zip(data, cols, strict=True)], float)
    return x


@pytest.mark.parametrize("drop", [False, True])
def test_twfe_equals_dummies(spark, drop):
    data = tiny(drop)
    cols = [[float(d[2] is not None and d[1] >= d[2]), d[4]] for d in data]
    x, y = dense(data, cols), np.array([d[3] for d in data])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    fit = did.twfe(frame(spark, data), "y", ["post", "x"], "u", "t")
    assert np.allclose(fit.beta, beta[:2])
    e = y - x @ beta
    scores = np.array([sum(x[i] * e[i] for i, d in enumerate(data) if d[0] == u) for u in range(12)])
    bread = np.linalg.pinv(x.T @ x)
    cov = bread @ scores.T @ scores @ bread * 12 / 11
    assert np.allclose(fit.cov, cov[:2, :2], atol=1e-8)


@pytest.mark.parametrize("drop", [False, True])
def test_imputation_equals_dummies(spark, drop):
    data = tiny(drop)
    clean = [d for d in data if d[2] is None or d[1] < d[2]]
    x = dense(clean, [[d[4]] for d in clean])
    beta = np.linalg.lstsq(x, np.array([d[3] for d in clean]), rcond=None)[0]
    us, ts = sorted({d[0] for d in clean}), sorted({d[1] for d in clean})
    treated = [d for d in data if d[2] is not None and d[1] >= d[2]]
    tau = [d[3] - np.array([d[4], *[d[0] == u for u in us], *[d[1] == t for t in ts[1:]]], float) @ beta for d in treated]
    df = frame(spark, data)
    got = did.imputation_static(df, "y", "u", "t", F.col("post") == 1, "g", ["x"]).first()
    assert abs(got["estimate"] - np.mean(tau)) < 1e-8 and got["n"] == len(treated) and got["std_error"] > 0
    by = {r["term"]: r for r in did.imputation_dynamic(df, "y", "u", "t", F.col("post") == 1, "g", "rel", range(3), ["x"]).collect()}
    for h in range(3):
        assert abs(by[f"tau{h}"]["estimate"] - np.mean([v for v, d in zip(tau, treated, strict=True) if d[1] - d[2] == h])) < 1e-8


def test_imputation_error_is_that_of_its_weights(spark):
    """The estimate is linear in outcomes; its weights, found by unit outcomes, give the clustered error."""
    data = [d for d in tiny(True) if d[0] < 6]
    df = frame(spark, data)
    got = did.imputation_static(df, "y", "u", "t", F.col("post") == 1, "g").first()
    clean = [i for i, d in enumerate(data) if d[2] is None or d[1] < d[2]]
    treated = [i for i in range(len(data)) if i not in clean]
    x = dense(data, [[] for _ in data])
    weights = np.zeros(len(data))
    weights[treated] = 1 / len(treated)
    weights[clean] = -np.linalg.pinv(x[clean]).T @ x[treated].sum(0) / len(treated)
    y = np.array([d[3] for d in data])
    beta = np.linalg.lstsq(x[clean], y[clean], rcond=None)[0]
    eps = y - x @ beta
    cells = {}
    for i in treated:
        cells.setdefault((data[i][2], data[i][1]), []).append(eps[i])
    for i in treated:
        eps[i] -= np.mean(cells[data[i][2], data[i][1]])
    se = sum(sum(weights[i] * eps[i] for i, d in enumerate(data) if d[0] == u) ** 2 for u in range(6)) ** 0.5
    assert abs(got["estimate"] - weights @ y) < 1e-8
    assert abs(got["std_error"] - se) < 1e-8


def test_balanced_closed_form(spark):
    df = frame(spark, tiny(False))
    assert abs(did.twfe_balanced(df, "y", "post", "u", "t").first()["estimate"] - did.twfe(df, "y", ["post"], "u", "t").beta[0]) < 1e-8


def test_chi_squared_and_wald():
    for x, k, p in ((3.841459, 1, 0.05), (18.307038, 10, 0.05), (0.5, 4, 0.973501), (60.0, 20, 7.12e-6)):
        assert abs(linear.chi2_sf(x, k) - p) < 1e-6
    stat, rank, p = linear.wald(np.array([1.0, 2.0]), np.array([[1.0, 0.0], [0.0, 4.0]]))
    assert abs(stat - 2) < 1e-12 and rank == 2 and abs(p - np.exp(-1)) < 1e-12


def test_wide_moments_equal_sql_sums(spark):
    df = spark.range(200).select(*[((F.col("id") * (k + 3)) % 17).cast("double").alias(f"c{k}") for k in range(10)])
    m, n = linear.moments(df, df.columns)
    x = df.toPandas().to_numpy()
    assert n == 200 and np.allclose(m, x.T @ x)
    assert np.allclose(linear.moments(df, df.columns[:5])[0], m[:5, :5])


def test_gmm_finds_the_persistence(spark):
    rng = np.random.default_rng(1)
    rows = []
    for u in range(400):
        a, y = rng.normal(), rng.normal()
        for t in range(7):
            x = rng.normal()
            y = 0.5 * y + 1.0 * x + a + rng.normal() * 0.5
            rows.append((u, t, float(y), float(x)))
    g = panels.difference_gmm(spark.createDataFrame(rows, "u int, t int, y double, x double"), "y", ["x"], "u", "t")
    assert abs(g.beta[0] - 0.5) < 0.1 and abs(g.beta[1] - 1.0) < 0.1 and (g.error > 0).all()
    assert g.m1[1] < 0.05 < g.m2[1] and g.sargan[2] > 0.01


def test_its_with_units(spark):
    rows = [(u, s, float(s > 6), max(0, s - 6), 2.0 * u + 0.5 * s + 3.0 * (s > 6) - 0.25 * max(0, s - 6)) for u in range(4) for s in range(1, 14)]
    df = spark.createDataFrame(rows, "u int, seq int, post double, after int, y double")
    assert np.allclose(panels.its(df, "y", unit="u").beta, [0.5, 3.0, -0.25])


def dense_gmm(rows, collapse):
    """Two steps and the corrected covariance on stacked matrices: y on its lag and x, period effects; rows: (u, t, y, x)."""
    held = {(u, t): (y, x) for u, t, y, x in rows}
    us, ts = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    periods = list(range(ts[0] + 2, ts[-1] + 1))
    columns = [(t, k) for t in ([None] if collapse else periods) for k in (2, 3) if t is None or t - k >= ts[0]]
    blocks = []
    for u in us:
        zs, xs, ys, when = [], [], [], []
        for t in periods:
            if not all((u, t - k) in held for k in range(3)):
                continue
            level = [held[u, t - k][0] if (u, t - k) in held and when_ in (None, t) else 0.0 for when_, k in columns]
            dx = held[u, t][1] - held[u, t - 1][1]
            extra = [1.0, *[float(t == p) for p in periods[1:]]]
            zs.append([*level, dx, *extra])
            xs.append([held[u, t - 1][0] - held[u, t - 2][0], dx, *extra])
            ys.append(held[u, t][0] - held[u, t - 1][0])
            when.append(t)
        if ys:
            w = np.array(when)
            blocks.append((np.array(zs), np.array(xs), np.array(ys), 2.0 * np.eye(len(w)) - (np.abs(w[:, None] - w) == 1)))
    inv = lambda a: np.linalg.pinv(a, hermitian=True)
    zx, zy = sum(z.T @ x for z, x, _, _ in blocks), sum(z.T @ y for z, _, y, _ in blocks)
    w1 = inv(sum(z.T @ h @ z for z, _, _, h in blocks))
    a1 = inv(zx.T @ w1 @ zx)
    b1 = a1 @ zx.T @ w1 @ zy
    omega = sum(np.outer(g := z.T @ (y - x @ b1), g) for z, x, y, _ in blocks)
    w2 = inv(omega)
    a2 = inv(zx.T @ w2 @ zx)
    b2 = a2 @ zx.T @ w2 @ zy
    d = np.zeros((len(b2), len(b2)))
    for j in range(len(b2)):
        turn = -sum(z.T @ (np.outer(x[:, j], y - x @ b1) + np.outer(y - x @ b1, x[:, j])) @ z for z, x, y, _ in blocks)
        d[:, j] = -a2 @ zx.T @ w2 @ turn @ w2 @ (zy - zx @ b2)
    v1 = a1 @ zx.T @ w1 @ omega @ w1 @ zx @ a1
    return b2, a2, a2 + d @ a2 + a2 @ d.T + d @ v1 @ d.T, sum(len(y) for _, _, y, _ in blocks)


@pytest.mark.parametrize("collapse", [False, True])
def test_gmm_errors_equal_dense(spark, collapse):
    rng = np.random.default_rng(3)
    rows = []
    for u in range(70):
        a, y = rng.normal(), rng.normal()
        for t in range(7):
            x = rng.normal()
            y = 0.4 * y + 0.8 * x + a + rng.normal()
            if rng.random() < 0.95:
                rows.append((u, t, float(y), float(x)))
    df = spark.createDataFrame(rows, "u int, t int, y double, x double")
    g = panels.difference_gmm(df, "y", ["x"], "u", "t", collapse=collapse)
    beta, plain, corrected, n = dense_gmm(rows, collapse)
    assert g.n == n and np.allclose(g.beta, beta[:2], atol=1e-7)
    assert np.allclose(g.plain_error, np.sqrt(np.diag(plain))[:2], atol=1e-7) and np.allclose(g.error, np.sqrt(np.diag(corrected))[:2], atol=1e-7)
    # The correction matters here.
    assert (g.error > 1.002 * g.plain_error).any()
    both = panels.fit_models(df, {"a": panels.Model("y", ("x",), collapse=collapse), "b": panels.Model("x", (), ("y",))}, "u", "t")
    assert np.allclose(both["a"].error, g.error) and both["b"].names == ["lag_x", "lag_of_y"] and both["b"].n < n
