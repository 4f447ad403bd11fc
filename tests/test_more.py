"""Settings, matching of overlapping sides, checks, sums by ranges, sinks and estimators against dense algebra."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkiln.estimators import did
from panelkiln.estimators import panel as panels
from panelkiln.functions import periods, values
from panelkiln.operators import cohorts, matching, qc, quality, reshape, similarity
from panelkiln.sources import tables


def test_a_unit_among_its_controls_takes_no_place(spark):
    t = spark.createDataFrame([("g", "A", 0.5)], "p string, repo_name string, score double")
    c = spark.createDataFrame([("g", n, 0.5) for n in "ABCD"] + [("g", "E", 9.0)], "p string, repo_name string, score double")
    got = matching.nearest(t, c, ["p"]).orderBy("match_rank").collect()
    assert [(r["control"], r["distance"]) for r in got] == [("B", 0.0), ("C", 0.0), ("D", 0.0)]
    line = spark.createDataFrame([("g", f"u{i:02}", float(i)) for i in range(30)], "p string, repo_name string, score double")
    for r in matching.nearest(line, line, ["p"], k=2).collect():
        i = int(r["treatment"][1:])
        want = sorted((abs(i - j), f"u{j:02}") for j in range(30) if j != i)[:2]
        assert (r["distance"], r["control"]) == want[r["match_rank"] - 1]


def test_settings_bind_rows_or_units(spark):
    rows = [
        ("t1", 1, "2024-10", "2024-08", 5.0, None, True, 90, "Go"),
        ("t1", 1, "2024-10", "2025-07", 12.0, True, False, 90, "Go"),
        ("t1", 1, "2024-10", "2025-05", 0.0, False, False, 90, "Go"),
        ("t2", 1, "2025-03", "2025-08", 1.0, False, False, None, "Other"),
        ("c1", 0, None, "2025-05", 3.0, None, None, None, "Go"),
        ("c1", 0, None, "2025-08", 0.0, None, None, None, "Go"),
        ("c2", 0, None, "2025-05", 20.0, None, None, None, "Python"),
    ]
    panel = spark.createDataFrame(rows, "repo_name string, is_treatment int, event string, time string, commits double, high_confidence boolean, other_agents boolean, adopter_pct int, language_group string")
    pairs = spark.createDataFrame([("t1", "c1"), ("t2", "c2")], "treatment_repo string, control_repo string")
    settings = cohorts.settings()
    assert len(settings) == 16
    got = {k: sorted((r["repo_name"], r["time"]) for r in cohorts.apply_setting(panel, pairs, s).collect()) for k, s in settings.items()}
    every = sorted((r[0], r[3]) for r in rows)
    unit = lambda *names: [x for x in every if x[0] in names]
    assert got["all"] == every
    assert got["truncated"] == [x for x in every if x[1] <= "2025-06"]  # controls too
    assert got["active"] == [(r[0], r[3]) for r in sorted(rows, key=lambda r: (r[0], r[3])) if r[4] > 0]
    assert got["very_active"] == [("c2", "2025-05"), ("t1", "2025-07")]
    assert got["config_changes"] == [x for x in every if x not in (("t1", "2025-05"), ("t2", "2025-08"))]  # unknown stays
    assert got["low_confidence"] == [x for x in every if x != ("t1", "2025-07")]
    assert got["adopters_80"] == got["with_others"] == got["before_release"] == got["go"] == unit("t1", "c1")
    assert got["only_one"] == got["after_release"] == got["made_default"] == unit("t2", "c2")
    assert got["javascript"] == got["python"] == got["rust"] == []
    label = spark.createDataFrame([("JavaScript",), ("Rust",), ("COBOL",), (None,)], "l string").select(cohorts.language_group(F.col("l")).alias("g"))
    assert [r["g"] for r in label.collect()] == ["JavaScript/TypeScript", "Rust", "Other", "Other"]


def test_sums_below_need_no_single_sort(spark):
    rng = np.random.default_rng(3)
    at = rng.permutation(5000)[:2000].astype(float)
    df = spark.createDataFrame([(float(a), int(a) % 7) for a in at], "v double, n int")
    out = reshape.sum_below(df, "v", "n", "below", ranges=16)
    total = {a: s for a, s in zip(sorted(at), np.concatenate([[0], np.cumsum([int(a) % 7 for a in sorted(at)])]), strict=False)}
    assert {r["v"]: r["below"] for r in out.collect()} == total
    assert reshape.sum_below(df.limit(0), "v", "n", "below").count() == 0
    ranks = panels.average_ranks(spark.createDataFrame([(x,) for x in (3.0, 1.0, 3.0, 2.0)], "v double"), "v")
    assert sorted((r["v"], r["rank"]) for r in ranks.collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]


def test_coverage_is_exact_with_frequent_shingles(spark):
    units = [("a%02d" % i, "one two three four five" + (" six" if i % 2 else "")) for i in range(40)]
    a = similarity.shingles(spark.createDataFrame(units, "u string, t string"), "u", "t")
    b = similarity.shingles(spark.createDataFrame([("b", "zero one two three four five")], "u string, t string"), "u", "t")
    got = {r["unit_a"]: (r["shared"], r["n_a"], r["n_b"], r["coverage"]) for r in similarity.shared_coverage(a, b).collect()}
    assert got == {u: ((1, 2, 2, 0.5) if int(u[1:]) % 2 else (1, 1, 2, 2 / 3)) for u, _ in units}
    assert similarity.shared_coverage(a, b, common=10).count() == 0


def test_checks_and_guards(spark):
    p = spark.createDataFrame([("a", "2025-01", "treatment", 1, 0, 1.0), ("a", "2025-01", "treatment", 1, 1, None), ("b", "2025-02", "control", None, 0, 0.0)], "repo_name string, time string, dataset_source string, time_to_event int, post_event int, v double")
    got = {r["check"]: r["value"] for r in qc.qc_long(p, qc.input_checks(p, 3, "x", ["v"], ["post_event", "absent"], ["v"])).collect()}
    assert got["panel_label"] == "x" and got["row_count_preserved"] == "1" and got["v_missing"] == "1" and got["v_zero_count"] == "1" and got["v_finite"] == "2" and "absent_sum" not in got
    merged = {r["check"]: r["value"] for r in qc.qc_long(p, qc.merge_checks(p, 4, ["v"], [], commit="v")).collect()}
    assert merged["duplicate_rows"] == "1" and merged["row_count_preserved"] == "0" and merged["missing_v"] == "1"
    with pytest.raises(ValueError, match="repeat"):
        quality.assert_keys(p, ["repo_name", "time"])
    with pytest.raises(ValueError, match="negative"):
        quality.assert_keys(p.withColumn("n", F.lit(-1)).limit(1), ["repo_name"], ["n"])
    counts = spark.createDataFrame([("a", "treatment", "2025-01", "X", 2)], "repo_name string, dataset_source string, month string, category string, warning_count long")
    seen = counts.select("repo_name", "dataset_source", "month")
    rows = p.where("post_event = 0").withColumn("event", F.lit(None).cast("string"))
    with pytest.raises(quality.NotBothSides):
        quality.category_did(rows, counts, seen, "X")
    assert quality.category_did(rows, counts, seen, "X", treatment_only=True).count() == 2


def test_expressions(spark):
    one = spark.range(1)
    size = lambda n: one.select(values.bytes_text(F.lit(n)).alias("x")).first()["x"]
    assert [size(n) for n in (0, 1023, 1024, 1536, 5 * 1024**2, 3 * 1024**4)] == ["0 bytes", "1023 bytes", "1.00 KB", "1.50 KB", "5.00 MB", "3072.00 GB"]
    r = one.select(values.prefix(F.lit(" 2025-01-31")).alias("a"), values.prefix(F.lit("nan")).alias("b"), periods.event_in_range(F.lit("2025-1"), 202407, 202503).alias("c"), periods.event_in_range(F.lit("2025-01"), 202407, 202503).alias("d"), periods.within(F.lit(None).cast("date"), "2024-01-01", "2025-01-01").alias("e")).first()
    assert tuple(r) == ("2025-01", None, False, True, False)
    assert one.select(periods.without_zone(F.timestamp_seconds(F.lit(0)))).dtypes[0][1] == "timestamp_ntz"


def test_upsert_takes_up_after_a_crash(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    tables.upsert(old, path, "k")
    (tmp_path / "t").rename(tmp_path / "t.old")  # as if the process had ended between the two renames
    tables.upsert(spark.createDataFrame([(2, "c")], "k int, v string"), path, "k")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c")] and not (tmp_path / "t.old").exists()


def test_landed_pages(spark):
    node = {"advisory": {"ghsaId": "G1", "summary": 'a "b"'}, "package": {"name": "p"}, "vulnerableVersionRange": "< 1"}
    pages = [json.dumps({"securityVulnerabilities": {"edges": [{"node": node}, {"node": {}}]}}), "{}", "not json", None]
    got = tables.landed_advisories(spark.createDataFrame([(x,) for x in pages], "body string")).collect()
    assert sorted(map(tuple, got), key=repr) == [("G1", "p", "< 1", 'a "b"'), (None, None, None, None)]
    size, price = tables.estimated_cost(spark.range(1000))
    assert size > 0 and price == size / 1024**4 * 5.0


def test_imputation_equals_dense_least_squares(spark):
    """Effects and errors on an unbalanced panel with a covariate, against dummies for every unit and period."""
    rng = np.random.default_rng(5)
    rows = [(u, t, 8 if u % 3 == 0 else 11 if u % 3 == 1 else None, float(rng.normal() + u / 5 + t / 4), float(rng.normal())) for u in range(18) for t in range(1, 15) if rng.random() > 0.15]
    df = spark.createDataFrame(rows, "u int, t int, g int, y double, x double")
    on = np.array([g is not None and t >= g for _, t, g, _, _ in rows])
    y, x = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    design = np.stack([np.array([r[0] == u for r in rows]) for u in range(18)] + [np.array([r[1] == t for r in rows]) for t in range(2, 15)] + [x], 1).astype(float)
    beta = np.linalg.pinv(design[~on]) @ y[~on]
    effect = (y - design @ beta)[on]
    # The estimate is a weighted sum of outcomes; residuals of treated rows from their cell's mean.
    pull = design[on].mean(0) @ np.linalg.pinv(design[~on])
    weight = np.zeros(len(rows))
    weight[on], weight[~on] = 1 / on.sum(), -pull
    rest = y - design @ beta
    cells = {}
    for i in np.flatnonzero(on):
        cells.setdefault((rows[i][2], rows[i][1]), []).append(rest[i])
    eps = np.array([rest[i] - np.mean(cells[rows[i][2], rows[i][1]]) if on[i] else rest[i] for i in range(len(rows))])
    by_unit = np.array([(weight * eps)[[r[0] == u for r in rows]].sum() for u in range(18)])
    got = did.imputation_static(df, "y", "u", "t", F.col("t") >= F.col("g"), "g", ["x"]).first()
    assert got["n"] == on.sum() and abs(got["estimate"] - effect.mean()) < 1e-8
    assert abs(got["std_error"] - (by_unit**2).sum() ** 0.5) < 1e-8
    table = did.event_time_table(df.withColumn("rel", F.col("t") - F.col("g")), "y", "u", "t", F.col("t") >= F.col("g"), "g", "rel", k=3).collect()
    assert [r["time"] for r in table] == [-3, -2, 0, 1, 2, 3]


def test_gmm_with_an_endogenous_regressor(spark):
    """Collapsed instruments against the same sums of dense blocks."""
    rng = np.random.default_rng(2)
    rows = []
    for u in range(60):
        a, y, w = rng.normal(), rng.normal(), rng.normal()
        for t in range(8):
            w = 0.4 * w + rng.normal() + 0.3 * a
            y = 0.4 * y + 0.8 * w + a + rng.normal() * 0.3
            if rng.random() > 0.03:
                rows.append((u, t, float(y), float(w)))
    g = panels.difference_gmm(spark.createDataFrame(rows, "u int, t int, y double, w double").repartition(5), "y", [], "u", "t", (2, 3), "twoways", ["w"], collapse=True)
    held = {(u, t): (y, w) for u, t, y, w in rows}
    zs, xs, ds, us, ts = [], [], [], [], []
    for u in range(60):
        for t in range(2, 8):
            if all((u, t - k) in held for k in range(3)):
                level = [held[u, t - k][c] if (u, t - k) in held else 0.0 for c in (0, 1) for k in (2, 3)]
                extra = [1.0, *[float(t == s) for s in range(3, 8)]]
                zs.append(level + extra)
                xs.append([held[u, t - 1][0] - held[u, t - 2][0], held[u, t][1] - held[u, t - 1][1], *extra])
                ds.append(held[u, t][0] - held[u, t - 1][0])
                us.append(u)
                ts.append(t)
    z, x, d, us, ts = (np.array(v) for v in (zs, xs, ds, us, ts))
    h = 2.0 * np.eye(len(d)) - ((us[:, None] == us) & (abs(ts[:, None] - ts) == 1))
    same = us[:, None] == us
    fit = lambda w: np.linalg.pinv(x.T @ z @ w @ z.T @ x) @ x.T @ z @ w @ z.T @ d
    e = d - x @ fit(np.linalg.pinv(z.T @ h @ z))
    beta = fit(np.linalg.pinv(z.T @ (np.outer(e, e) * same) @ z))
    assert g.names == ["lag_y", "w"] and g.n == len(d) and np.allclose(g.beta, beta[:2], atol=1e-6)
    models = panels.gmm_models()
    assert len(models) == 8 and sum(m.collapse for m in models.values()) == 4
