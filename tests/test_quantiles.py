import numpy as np
from pyspark.sql import functions as F

from panelkiln.operators import matching, qc, quantiles


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(v), None if i % 9 == 0 else float(i % 5)) for i, (g, v) in enumerate(zip(rng.choice(["a", "b"], 500), rng.normal(size=500) * 10.0 ** rng.integers(-200, 200, 500), strict=True))]
    rows += [(None, -0.0, 1.0), (None, 0.0, None), (None, 5.0, None), ("only null", None, None), ("inf", float("inf"), 2.0), ("inf", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {(r["g"], r["column"], r["p"]): r["value"] for r in quantiles.quantiles(df, ["x", "y"], ps, ["g"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for name, at in (("x", 1), ("y", 2)):
            v = [r[at] for r in rows if r[0] == g and r[at] is not None]
            if v and g != "inf":
                want |= {(g, name, p): float(np.quantile(v, p)) for p in ps}
    assert {k for k in got if k[0] != "inf"} == set(want)
    assert all(abs(got[k] - v) <= 1e-9 * max(1.0, abs(v)) for k, v in want.items())
    assert got["inf", "x", 0.0] == 1.0 and got["inf", "x", 1.0] == float("inf")
    whole = {r["p"]: r["value"] for r in quantiles.quantiles(df.where("g = 'a'"), ["x"], ps).collect()}
    assert all(whole[p] == got["a", "x", p] for p in ps)
    assert quantiles.quantiles(df.limit(0), ["x"], [0.5]).collect() == []
    assert "percentile" not in qc.describe(df, ["x"])._jdf.queryExecution().executedPlan().toString()


def test_tables_keep_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 4.0, None), (None, 2.0, 3.0)], "g string, x double, z double")
    rows = {(r["g"], r["column"]): r for r in qc.describe(df, ["x", "z"], ["g"]).collect()}
    assert rows["a", "z"]["n"] == 0 and rows["a", "z"]["median"] is None and rows["a", "x"]["q25"] == 1.75 and rows[None, "z"]["median"] == 3.0
    out = {r["feature"]: r for r in matching.balance_table(df.withColumn("t", F.col("g").isNotNull().cast("int")), "t", ["x", "z"]).collect()}
    assert out["x"]["median_t"] == 2.5 and out["x"]["median_c"] == 2.0 and out["z"]["median_t"] is None
