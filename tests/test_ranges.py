"""Ranks, neighbours and versions without a group in one task, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from panelkiln.functions import semver
from panelkiln.operators import dependency, matching, reshape


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_places_of_texts_and_numbers(spark, ranges):
    rng = random.Random(2)
    keys = {(rng.choice(["", "a", "ab", "b", "é", None]), rng.choice([None, -1.5, 0.0, 2.0, float("inf")]), i) for i in range(400)}
    df = spark.createDataFrame(sorted(keys, key=lambda k: k[2]), "a string, b double, c int").repartition(4)
    got = [r["n"] for r in reshape.place_in_order(df, ["a", "b", "c"], "n", ranges).orderBy("a", "b", "c").collect()]
    assert got == list(range(1, len(keys) + 1))
    assert reshape.place_in_order(df.limit(0), ["a", "b", "c"], "n", ranges).collect() == []
    plan = reshape.dense_ids(df, "c", "id")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_nearest_in_one_large_group(spark, ranges):
    """One group on a line cut into ranges, with places that many controls share: as all pairs say."""
    rng = random.Random(ranges)
    controls = [("g", f"c{i}", rng.choice([0.25, 0.5, round(rng.random(), 2)])) for i in range(300)] + [("h", "c1", 0.5), ("h", "x", 0.75)]
    treated = [("g", f"t{i}", round(rng.random(), 2)) for i in range(60)] + [("g", "c7", controls[7][2]), ("h", "t", 0.5), ("none", "t", 0.5)]
    make = lambda rows: spark.createDataFrame(rows, "seg string, repo_name string, score double").repartition(3)
    got = {(r["seg"], r["treatment"], r["match_rank"]): (r["control"], round(r["distance"], 9)) for r in matching.nearest(make(treated), make(controls), ["seg"], ranges=ranges).collect()}
    want = {}
    for g, t, s in treated:
        near = sorted((abs(s - x), c) for h, c, x in controls if h == g and c != t)[:3]
        want |= {(g, t, i + 1): (c, round(x, 9)) for i, (x, c) in enumerate(near)}
    assert got == want
    # Pooled: no grouping column at all.
    pooled = matching.nearest(make(treated), make(controls), [], ranges=ranges).where("treatment = 't0'").orderBy("match_rank").collect()
    s = next(x for _, t, x in treated if t == "t0")
    assert [r["control"] for r in pooled] == [c for _, c in sorted((abs(s - x), c) for _, c, x in controls if c != "t0")[:3]]


VERSIONS = [f"{a}.{b}.{c}{p}" for a in range(3) for b in range(3) for c in (0, 3) for p in ("", "-alpha", "-alpha-1", "-rc.2", "-rc.10")]
SPECS = ["^1.2.0", "~1.2", ">=1.0.0 <2.0.0", "1.x", "*", "1.2.3", "<1.2.0 || >=2.1.0", "^0.2.1", ">1.1", ">=1.2.3 >1.2.3 <=2.0", "1.0.0 - 1.3.0", "=1.1.0", "bad", "<=1.2", "^1.2.0-alpha", "latest", "<2.0.0 <=2.0.0"]


def test_intervals_hold_what_a_range_holds():
    keys = [(semver.parse(v), semver.sort_key(semver.parse(v))) for v in VERSIONS]
    assert sorted(keys) == sorted(keys, key=lambda k: k[1])
    for spec in SPECS:
        for v, (_, s) in zip(VERSIONS, keys, strict=True):
            inside = any((a is None or s > a or (ai and s == a)) and (b is None or s < b or (bi and s == b)) for a, ai, b, bi in semver.intervals(spec))
            assert inside == semver.satisfies(v, spec), (v, spec)


def test_resolution_equals_a_search_of_all_releases(spark):
    rng = random.Random(6)
    releases = [(p, v, 86400 * rng.randrange(300)) for p in "ab" for v in VERSIONS + ["junk"] if rng.random() < 0.6]
    deps = [(f"r{i}", 86400 * rng.randrange(300), rng.choice("abz"), rng.choice(SPECS)) for i in range(200)]
    stamp = lambda rows, ddl, c: spark.createDataFrame(rows, ddl).withColumn(c, F.timestamp_seconds(c))
    got = dependency.resolve(stamp(deps, "repo_name string, committed_at long, package string, spec string", "committed_at"), stamp(releases, "package string, version string, released_at long", "released_at"))
    held = {r["repo_name"]: (r["version"], r["newest"], r["lag_days"]) for r in got.collect()}
    assert len(held) == len(deps)
    for name, at, package, spec in deps:
        known = {v: t for p, v, t in releases if p == package and t <= at and semver.parse(v)}
        newest, version = semver.best(known, "*"), semver.best(known, spec)
        assert held[name] == (version, newest, max(0, (known[newest] - known[version]) // 86400) if version else None)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan


def test_propensity_by_period_equals_separate_fits(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = []
    for p in (3, 4, 7):
        for i in range(150):
            x, z = rng.normal(), 5.0 + 3 * rng.normal()
            rows.append((p, f"u{i}", int(rng.random() < 1 / (1 + np.exp(-(p - 4) * x - 0.2 * z + 1))), float(x), float(z), 1.0))
    rows += [(9, "a", 1, 0.0, 1.0, 1.0), (9, "b", 1, 1.0, 1.0, 1.0), (3, "hole", 0, None, 1.0, 1.0), (None, "none", 1, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "period int, repo string, treated int, x double, z double, flat double").repartition(4)
    got = {(r["period"], r["repo"]): r["score"] for r in matching.propensity_by(df, ["x", "z", "flat"], "period").collect()}
    assert len(got) == len(rows) and got[9, "a"] is None and got[3, "hole"] is None and got[None, "none"] is None
    for p in (3, 4, 7):
        mine = [r for r in rows if r[0] == p and r[3] is not None]
        f = np.array([r[3:] for r in mine])
        sd = f.std(0)
        x = np.column_stack([np.ones(len(f)), (f - f.mean(0)) / np.where(sd > 0, sd, 1)])
        y, b, penalty = np.array([r[2] for r in mine], float), np.zeros(4), np.diag([0.0, 1, 1, 1])
        for _ in range(50):
            q = 1 / (1 + np.exp(-x @ b))
            b = b + np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + penalty, x.T @ (y - q) - penalty @ b)
        want = 1 / (1 + np.exp(-x @ b))
        assert np.allclose([got[p, r[1]] for r in mine], want, atol=1e-7)
        alone = {r["repo"]: r["score"] for r in matching.propensity(df.where((F.col("period") == p) & F.col("x").isNotNull()), ["x", "z", "flat"]).collect()}
        assert max(abs(alone[r[1]] - got[p, r[1]]) for r in mine) < 1e-3
    found, _ = matching.match_by_period(df, ["x", "z", "flat"], "period", unit="repo")
    near = [r for r in found.collect() if r["period"] == 7]
    t = near[0]["treatment"]
    controls = sorted((abs(got[7, t] - got[7, r[1]]), r[1]) for r in rows if r[0] == 7 and r[2] == 0)[:3]
    assert sorted((r["match_rank"], r["control"]) for r in near if r["treatment"] == t) == [(i + 1, c) for i, (_, c) in enumerate(controls)]


def test_clone_cascade_equals_all_pairs(spark):
    from panelkiln.operators import similarity

    rng = random.Random(9)
    base = [set(rng.sample(range(400), rng.randrange(1, 40))) for _ in range(25)]
    sets = {i: s | {1000, 1001} for i, s in enumerate(base)}  # two shingles that all have
    for i in range(40):
        s = set(base[i % 25])
        drop = set(rng.sample(sorted(s), min(len(s), rng.randrange(0, 12))))
        sets[100 + i] = (s - drop) | set(rng.sample(range(400, 500), rng.randrange(0, 6))) | {1000, 1001}
    df = spark.createDataFrame([(u, x) for u, s in sets.items() for x in s], "unit int, shingle long").repartition(3)
    for least in (0.3, 0.5, 0.8, 1.0):
        pairs, stages = similarity.clone_cascade(df, least)
        got = {(r["unit_a"], r["unit_b"]): (r["shared"], round(r["coverage"], 9)) for r in pairs.collect()}
        firsts = {frozenset(s): min(u for u, t in sets.items() if t == s) for s in map(frozenset, sets.values())}
        units = sorted(firsts.values())
        want = {(a, b): (len(sets[a] & sets[b]), round(2 * len(sets[a] & sets[b]) / (len(sets[a]) + len(sets[b])), 9)) for a in units for b in units if a < b and 2 * len(sets[a] & sets[b]) >= least * (len(sets[a]) + len(sets[b]))}
        assert got == want
        n = {r["stage"]: r["pairs"] for r in stages.collect()}
        assert n["clones"] == len(want) and n["clones"] <= n["size"] <= n["prefix"]
    # Hot shingles alone bring no pair together at a high coverage.
    assert n["prefix"] < len(units) * (len(units) - 1) / 20


def test_propensity_steps_read_distinct_rows(spark, monkeypatch):
    """Equal rows are one with a number in every Newton step; scores are those of all rows one by one."""
    import numpy as np
    from pyspark.sql.classic.dataframe import DataFrame

    rows = [(1, f"u{i}-{k}", int(i % 5 < 2 or i == 7), float(i % 8), float(i % 3)) for i in range(40) for k in range(5 + i % 4)]
    df = spark.createDataFrame(rows, "period int, repo string, treated int, x double, z double").repartition(4)
    seen, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, *a, **k: seen.append(self.count()) or plain(self, *a, **k))
    got = {r["repo"]: r["score"] for r in matching.propensity_by(df, ["x", "z"], "period").collect()}
    assert set(seen) == {len({(r[2], r[3], r[4]) for r in rows})} and max(seen) < len(rows) / 5
    f = np.array([r[3:] for r in rows])
    x, y, b = np.column_stack([np.ones(len(f)), (f - f.mean(0)) / f.std(0)]), np.array([r[2] for r in rows], float), np.zeros(3)
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag([0.0, 1, 1]), x.T @ (y - q) - np.diag([0.0, 1, 1]) @ b)
    assert np.allclose([got[r[1]] for r in rows], 1 / (1 + np.exp(-x @ b)), atol=1e-9)


def test_clone_cascade_moves_no_row_per_pair_and_shingle(spark):
    """Candidates meet whole sets as lists."""
    from panelkiln.operators import similarity

    df = spark.createDataFrame([(u, x) for u in range(6) for x in range(u % 3, 20)], "unit int, shingle long")
    with_side = spark.createDataFrame([(u, u % 2) for u in range(6)], "unit int, side int")
    pairs, _ = similarity.clone_cascade(df, 0.5, with_side)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(unit_b#\d+, shingle#", plan)
    # Units 0 to 2 stand for their copies; only 0 and 2 are on one side.
    assert [(r["unit_a"], r["unit_b"], r["n_a"], r["n_b"], r["shared"]) for r in pairs.collect()] == [(0, 2, 20, 18, 18)]


def test_clone_pairs_keeps_copies_and_sides(spark, tmp_path):
    """A text whose copy in another language comes first is compared in its own one; copies are linked with their first text."""
    from panelkiln.plans import catalog, more

    words = [f"w{i}" for i in range(24)]
    text, near = " ".join(words), " ".join(words[:20])
    rows = [(1, text, "en"), (2, text.upper(), "de"), (3, near, "de"), (4, near + "  ", "de"), (5, text, "en"), (6, "a b", "de"), (7, text, None), (8, text, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, more.clone_pairs(spark, str(tmp_path)).collect()))
    assert got == [(1, 5, 20, 20, 20, 1.0), (2, 3, 20, 16, 16, 0.888889), (3, 4, 16, 16, 16, 1.0)]

    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.sql(catalog.ORACLES["clone_pairs"]).fetchall()) == got
