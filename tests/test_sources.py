import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelkiln.functions import semver
from panelkiln.operators import dependency, effects, qc
from panelkiln.sources import tables
from panelkiln.streaming import activity


def test_csv_upsert_resume_manifest(spark, tmp_path):
    a = spark.createDataFrame([("r1", 1, "ok"), ("r2", 2, "failed")], "repo string, n int, status string")
    tables.write(a, f"{tmp_path}/a", "csv")
    back = tables.read_csv(spark, f"{tmp_path}/a", "repo string, n int, status string", ["repo", "n"])
    assert sorted(map(tuple, back.collect())) == [("r1", 1), ("r2", 2)]
    assert [r["repo"] for r in tables.pending(a.select("repo"), a, ["repo"]).collect()] == ["r2"]
    path = f"{tmp_path}/u"
    tables.upsert(a, path, "repo")
    tables.upsert(spark.createDataFrame([("r2", 5, "ok"), ("r3", 6, "ok")], a.schema), path, "repo")
    assert sorted(map(tuple, spark.read.parquet(path).select("repo", "n").collect())) == [("r1", 1), ("r2", 5), ("r3", 6)]
    both = tables.read_manifest(spark, {"main": f"{tmp_path}/a", "none": f"{tmp_path}/missing"}, "repo string, n int, status string")
    assert sorted((r["panel"], r["repo"]) for r in both.collect() if r["repo"] is None or r["panel"] == "main") == [("main", "r1"), ("main", "r2"), ("none", None)]
    tables.write_list(a, "repo", f"{tmp_path}/l")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/l").collect()] == ["r1", "r2"]
    with pytest.raises(tables.TooLarge):
        tables.capped(spark.range(10**6), 10)


def test_partition_bounds_prune(spark, tmp_path):
    spark.range(100).withColumn("ym", F.concat(F.lit("20240"), (F.col("id") % 5 + 1).cast("string"))).write.partitionBy("ym").parquet(f"{tmp_path}/e")
    df = tables.read_events(spark, f"{tmp_path}/e", "202402", "202403")
    assert df.count() == 40
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ym" in plan


@pytest.mark.parametrize(
    ("version", "spec", "yes"),
    [
        ("1.2.3", "^1.2.0", True), ("2.0.0", "^1.2.0", False), ("0.2.5", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False),
        ("1.5.0", "1.x", True), ("2.0.0", "1.x", False), ("1.5.0", ">=1.0.0 <2.0.0", True), ("1.5.0", ">= 1.0.0, < 1.5.0", False), ("1.5.0", "1.2 - 1.6", True), ("3.0.0", "<1.0.0 || >=3", True),
        ("1.0.0", "*", True), ("1.0.0-beta", ">=1.0.0", False), ("bad", "*", False),
    ],
)
def test_versions(version, spec, yes):
    assert semver.satisfies(version, spec) is yes


def test_dependency_health(spark):
    m = spark.createDataFrame([("r", dt.datetime(2024, 6, 1), '{"dependencies": {"p": "^1.0.0"}, "devDependencies": {"q": "9.x"}}')], "repo_name string, committed_at timestamp, manifest string")
    rel = spark.createDataFrame([("p", "1.0.0", dt.datetime(2024, 1, 1)), ("p", "1.10.0", dt.datetime(2024, 2, 1)), ("p", "2.0.0", dt.datetime(2024, 3, 2)), ("p", "1.99.0", dt.datetime(2025, 1, 1)), ("q", "1.0.0", dt.datetime(2024, 1, 1))], "package string, version string, released_at timestamp")
    adv = spark.createDataFrame([("p", "<1.11.0", dt.datetime(2024, 5, 1))], "package string, range string, published_at timestamp")
    out = dependency.health(dependency.vulnerable(dependency.resolve(dependency.dependencies(m), rel), adv)).first()
    assert (out["dependencies"], out["resolved"], out["vulnerable"], out["mean_lag_days"]) == (2, 1, 1, 30.0)


def test_effect_table_and_markdown(spark):
    r = spark.createDataFrame([("warn_x", "treat", 0.1, 0.04, None, None, None, "b"), ("size", "treat", 0.0, 0.0, None, None, None, "a")], "outcome string, term string, estimate double, std_error double, conf_low double, conf_high double, p_value double, panel string")
    t = effects.effect_table(r, panels=["b", "a"]).collect()
    assert [x["panel"] for x in t] == ["b", "a"] and t[0]["formatted"] == "10.5%* [2.2%, 19.5%]" and t[0]["ci_excludes_zero"] and t[1]["p_value"] is None
    assert effects.markdown(spark.createDataFrame([("a|b", None)], "x string, y string")) == "| x | y |\n| --- | --- |\n| a\\|b |  |\n"


def test_coverage_and_composition(spark):
    df = spark.createDataFrame([("t", 1.0, None), ("t", None, 2.0), ("c", 3.0, 4.0)], "s string, a double, b double")
    got = {(r["s"], r["metric"]): (r["nonmissing"], r["missing"]) for r in qc.coverage(df, ["s"], ["a", "b"]).collect()}
    assert got == {("t", "a"): (1, 1), ("t", "b"): (1, 1), ("c", "a"): (1, 0), ("c", "b"): (1, 0)}
    parts = {(r["scope"], r["part"]): r["share"] for r in qc.composition(df, ["a", "b"], "s").collect()}
    assert parts["all", "a"] == 0.4 and abs(parts["t", "b"] - 2 / 3) < 1e-12


def test_stream_counts_match_batch(spark, tmp_path):
    ev = spark.createDataFrame([("WatchEvent", dt.datetime(2024, 1, d, h), "r", "x") for d in (1, 2, 9) for h in (1, 5)], "type string, created_at timestamp, repo string, actor string")
    ev.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/in")
    activity.into_table(activity.event_counts(stream), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    out = {r["period_start"].day: r["n_stars"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert out == {1: 2, 2: 2}


def test_exact_stream_equals_batch_over_a_restart(spark, tmp_path):
    """Repeated rows, users in several windows, rows without a user, late rows and a restart between two files."""
    kinds = ["WatchEvent", "ForkEvent", "IssuesEvent"]
    row = lambda d, h, i: (kinds[i % 3], dt.datetime(2024, 1, d, h), f"r{i % 2}", None if i % 11 == 0 else f"u{i % 4}")
    first = [row(d, h, i) for d in (1, 2, 3) for h in (1, 5) for i in range(13)] * 2
    # Late but within the watermark, and later windows that close the first ones.
    second = [row(2, 7, i) for i in range(5)] + [row(d, 3, i) for d in (4, 12) for i in range(7)]
    ddl = "type string, created_at timestamp, repo string, actor string"
    a, b = spark.createDataFrame(first, ddl), spark.createDataFrame(second, ddl)
    for part in (a, b):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(a.schema).parquet(f"{tmp_path}/in")
        activity.into_table(activity.exact_counts(stream), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = {(r["repo"], r["period_start"]): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    rows = a.unionByName(b).withColumn("day", F.date_trunc("day", "created_at"))
    want = rows.groupBy("repo", "day").agg(F.count_distinct("actor").alias("users"), F.count("*").alias("n"), F.count_if(F.col("type") == "WatchEvent").alias("stars")).collect()
    closed = {(r["repo"], r["day"]): (r["users"], r["n"], r["stars"]) for r in want if r["day"].day < 9}
    assert {k: (r["users_involved"], r["total_events"], r["n_stars"]) for k, r in got.items()} == closed and len(closed) == 8
