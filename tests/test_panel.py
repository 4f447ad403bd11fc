"""Fixtures of a few rows, each holding a trap."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelkiln.functions import periods, values
from panelkiln.operators import cohorts, events, joins, matching, panel, quality, reshape


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_padding_zero_and_carry_stay_within_units(spark):
    df = spark.createDataFrame([("A", "2024-01", 3, 10), ("A", "2024-02", 1, 20), ("A", "2024-05", 2, 30), ("B", "2024-03", 7, 5)], "repo_name string, month string, commits int, total int")
    out = panel.pad_periods(df, ["repo_name"], "month", zero=["commits"], fill=["total"])
    assert rows(out, "repo_name", "month", "commits", "total") == [("A", "2024-01", 3, 10), ("A", "2024-02", 1, 20), ("A", "2024-03", 0, 20), ("A", "2024-04", 0, 20), ("A", "2024-05", 2, 30), ("B", "2024-03", 7, 5)]
    again = panel.pad_periods(out, ["repo_name"], "month", zero=["commits"], fill=["total"])
    assert rows(again, "repo_name", "month", "commits", "total") == rows(out, "repo_name", "month", "commits", "total")


def test_window_makes_no_months_before_the_first(spark):
    df = spark.createDataFrame([("A", "2023-11", 3, True), ("A", "2024-02", 1, None), ("B", "2024-03", 7, None)], "repo_name string, month string, commits int, cursor boolean")
    out = panel.complete_window(df, "2024-01", "2024-03", zero=["commits"])
    assert rows(out, "repo_name", "month", "commits", "cursor") == [("A", "2024-01", 0, False), ("A", "2024-02", 1, False), ("A", "2024-03", 0, False), ("B", "2024-03", 7, False)]


def test_flag_is_not_carried_across_units(spark):
    df = spark.createDataFrame([("A", "2024-01", True), ("B", "2024-01", None), ("B", "2024-02", True), ("B", "2024-03", None)], "repo_name string, month string, cursor boolean")
    out = panel.carry_flag(df, "cursor", ["repo_name"], "month")
    assert rows(out, "repo_name", "month", "cursor") == [("A", "2024-01", True), ("B", "2024-01", False), ("B", "2024-02", True), ("B", "2024-03", True)]


def test_weeks_step_by_mondays_over_the_turn_of_the_year(spark):
    df = spark.createDataFrame([("A", "2022-W50"), ("A", "2023-W02")], "repo_name string, month string")
    out = panel.week_grid(df, ["repo_name"], "month", periods.week(F.col("_day")))
    assert [r[1] for r in rows(out, "repo_name", "month")] == ["2022-W50", "2022-W51", "2022-W52", "2023-W01", "2023-W02"]
    days = spark.range(1500).select(F.date_add(F.lit(dt.date(2021, 1, 1)), F.col("id").cast("int")).alias("d"))
    for d, w in days.select("d", periods.week(F.col("d"))).collect():
        assert w == d.strftime("%Y-W%W")


def test_months(spark):
    one = spark.createDataFrame([("2025-01", "202412", "2024-12-31", "202412.0", "nan", "202413")], "a string, b string, c string, d string, e string, f string")
    got = one.select(periods.month_diff(F.col("a"), F.col("b")), *[periods.normal_month(F.col(c)) for c in "abcdef"], periods.add_months_yyyymm(F.lit(202411), 3), periods.month_id(F.lit("2024-13")), periods.months_between_inclusive(F.lit("2024-11"), F.lit("2025-02"))).first()
    assert tuple(got) == (1, "2025-01", "2024-12", "2024-12", "2024-12", None, None, 202502, None, ["2024-11", "2024-12", "2025-01", "2025-02"])


@pytest.mark.parametrize("endpoints", ["cumulative", "exact"])
def test_lead_lag_edges(spark, endpoints):
    df = spark.createDataFrame([(x,) for x in (-8, -6, -1, 0, 6, 9, None)], "tte int")
    out = df.select("tte", *[c.alias(n) for n, c in panel.lead_lag(F.col("tte"), 6, endpoints).items()])
    hot = {r["tte"]: [c for c in out.columns[1:] if r[c] == 1] for r in out.collect()}
    far = endpoints == "cumulative"
    assert hot == {-8: ["lead_6"] if far else [], -6: ["lead_6"], -1: ["lead_1"], 0: ["lag_0"], 6: ["lag_6"], 9: ["lag_6"] if far else [], None: []}


def test_absorbing_and_switching(spark):
    ts = spark.createDataFrame([("A", "2024-12", False), ("A", "2025-01", True), ("A", "2025-02", None)], "repo_name string, month string, cursor boolean")
    ev = spark.createDataFrame([("A", "2025-01")], "repo_name string, event string")
    a = panel.treatment_panel(ts, ev)
    assert rows(a, "time", "time_to_event", "post_event", "lag_1") == [("2024-12", -1, 0, 0), ("2025-01", 0, 1, 0), ("2025-02", 1, 1, 1)]
    s = panel.treatment_panel(ts, ev, mode="switching")
    assert rows(s, "time", "post_event", "lag_1") == [("2024-12", 0, 0), ("2025-01", 1, 0), ("2025-02", 0, 0)]
    hot = a.select(sum((F.col(c) for c in a.columns if c.startswith(("lead_", "lag_"))), F.lit(0))).collect()
    assert all(r[0] == 1 for r in hot)


def test_buckets_without_events_have_null_age_and_shared_users_count_once(spark):
    ev = spark.createDataFrame([("WatchEvent", dt.datetime(2023, 1, 5), "r", "x"), ("ForkEvent", dt.datetime(2023, 2, 5), "r", "x"), ("WatchEvent", dt.datetime(2023, 11, 5), "r", "y")], "type string, created_at timestamp, repo string, actor string")
    repos = spark.createDataFrame([("r",), ("none",)], "repo string")
    out = {(r["repo"], r["bucket"]): r for r in events.bucket_features(repos, ev, periods.month_id(F.lit("2024-01"))).collect()}
    assert len(out) == 14
    assert out["r", 7]["users_involved"] == 1 and out["r", 7]["n_stars"] == 1 and out["r", 2]["n_stars"] == 1
    assert all(out["none", b]["age_days"] is None and out["none", b]["total_events"] == 0 for b in range(1, 8))


def test_asof_is_strict_where_it_says(spark):
    a = spark.createDataFrame([("p", "2024-01-01"), ("p", "2024-01-01"), ("p", "2024-02-01")], "project string, day string")
    assert rows(joins.previous(a, "project", "day"), "day", "previous") == [("2024-01-01", None), ("2024-02-01", "2024-01-01")]
    left = spark.createDataFrame([("p", 5), ("p", 1), ("q", 5)], "k string, t int")
    right = spark.createDataFrame([("p", 5, "x"), ("p", 2, "w"), ("p", 7, "z")], "k string, u int, v string")
    assert rows(joins.asof_backward(left, right, "k", "t", "u", ["v"]), "k", "t", "v") == [("p", 1, None), ("p", 5, "x"), ("q", 5, None)]
    assert rows(joins.asof_forward(left, right, "k", "t", "u", "n"), "k", "t", "n") == [("p", 1, 2), ("p", 5, 5), ("q", 5, None)]


def test_one_to_one(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 5), (1, 6)], "k int, w int")
    with pytest.raises(joins.NotOneToOne):
        joins.one_to_one(a, b, ["k"])
    assert joins.one_to_one(a, b.where("w = 5"), ["k"]).count() == 2


def test_nearest_breaks_ties_by_name_and_reuses(spark):
    t = spark.createDataFrame([("g", "t1", 0.5), ("g", "t2", 0.5)], "p string, repo_name string, score double")
    c = spark.createDataFrame([("g", n, s) for n, s in (("b", 0.4), ("a", 0.6), ("c", 0.6), ("d", 0.9), ("e", 0.1), ("f", 0.6))] + [("h", "z", 0.5)], "p string, repo_name string, score double")
    out = matching.nearest(t, c, ["p"], k=3)
    for unit in ("t1", "t2"):
        got = [r["control"] for r in out.where(F.col("treatment") == unit).orderBy("match_rank").collect()]
        dist = sorted([(abs(s - 0.5), n) for n, s in (("b", 0.4), ("a", 0.6), ("c", 0.6), ("d", 0.9), ("e", 0.1), ("f", 0.6))])
        assert got == [n for _, n in dist[:3]]


def test_switches(spark):
    df = spark.createDataFrame([("A", m, f) for m, f in (("1", False), ("2", True), ("3", True), ("4", False), ("5", True))] + [("B", "1", True)], "repo_name string, month string, cursor boolean")
    assert rows(panel.switches(df, ["repo_name"], "month", "cursor"), "repo_name", "month") == [("A", "2"), ("A", "5"), ("B", "1")]


def test_quality_is_not_imputed(spark):
    base = "repo_name string, time string, dataset_source string, scan_commit string, bugs_raw double, vulnerabilities_raw double, code_smells_raw double, technical_debt_raw double, ncloc_raw double, duplicated_lines_density_raw double, comment_lines_density_raw double, cognitive_complexity_raw double"
    df = spark.createDataFrame([("a", "2024-01", "treatment", "s", 0.0, 0.0, 0.0, 0.0, None, None, None, None), ("b", "2024-01", "control", "s", 1.0, 1.0, 2.0, 0.0, 0.0, 1.0, 1.0, 5.0), ("c", "2024-01", "control", None, None, None, None, None, None, None, None, None)], base)
    out = {r["repo_name"]: r for r in quality.quality_outcomes(df).collect()}
    assert out["a"]["sourceless"] == 1 and out["a"]["code_complexity"] is None and out["a"]["static_analysis_warnings"] == 0
    assert out["b"]["warnings_per_kloc"] is None and out["b"]["static_analysis_warnings"] == 4
    assert out["c"]["static_analysis_warnings"] is None and out["c"]["has_scan"] == 0
    old = {r["repo_name"]: r for r in quality.quality_outcomes_v1(df).collect()}
    assert old["a"]["code_complexity"] == 0 and old["c"]["code_complexity"] is None


def test_pairs_and_coverage(spark):
    p = spark.createDataFrame([("t", "a", 1), ("t", "b", 2), ("t", "c", 3), ("u", "a", 1)], "treatment_repo string, control_repo string, match_rank int")
    ev = spark.createDataFrame([("a", "2025-09"), ("b", "2025-08")], "repo_name string, event string")
    kept = cohorts.drop_leaky(p, ev, "2025-08")
    assert rows(kept, "treatment_repo", "control_repo") == [("t", "a"), ("t", "c"), ("u", "a")]
    assert rows(cohorts.pair_coverage(p, kept.where("treatment_repo = 't'")), "treatment_repo", "num_controls_before", "num_final_controls") == [("t", 3, 2), ("u", 1, 0)]
    assert cohorts.with_exactly(p, 3).count() == 3


def test_values(spark):
    one = spark.createDataFrame([("nan", " TRUE", "Ada B <ada.b@x.org>", "rel_−3", 0.0, None)], "a string, b string, c string, d string, p double, q double")
    got = one.select(values.missing_to_null(F.col("a")), values.to_bool(F.col("b")), values.author_keys(F.col("c")), values.trailing_integer(F.col("d")), values.stars(F.col("p")), values.stars(F.col("q")), values.normal_p(F.lit(1.959964)), values.clip(F.col("q"), low=0.0), values.equals_loosely(F.lit("3.0"), "3")).first()
    assert got[:6] == (None, True, ["ada.b", "adab", "ada"], -3, "***", "") and abs(got[6] - 0.05) < 1e-6 and got[7] is None and got[8]


def test_order_of_input_does_not_matter(spark):
    data = [("A", i % 3, i) for i in range(12)]
    a = reshape.keep_one(spark.createDataFrame(data, "k string, g int, o int"), ["k", "g"], [F.desc("o")])
    b = reshape.keep_one(spark.createDataFrame(data[::-1], "k string, g int, o int").repartition(3), ["k", "g"], [F.desc("o")])
    assert rows(a, "k", "g", "o") == rows(b, "k", "g", "o")


def test_deterministic_samples(spark):
    df = spark.range(100).select((F.col("id") % 20).alias("u"), "id")
    assert reshape.sample_units(df, "u", 5).select("u").distinct().count() == 5
    assert rows(reshape.sample_units(df, "u", 5), "id") == rows(reshape.sample_units(df.repartition(7), "u", 5), "id")
    assert all(r[1] <= 3 for r in reshape.cap_groups(df, ["u"], "id", 3).groupBy("u").count().collect())
