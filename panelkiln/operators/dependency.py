"""Dependencies of repos: what a manifest asks for, what resolves, how far behind and how vulnerable it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkiln.functions.semver import spec_intervals, version_key, version_satisfies

FIELDS = ("dependencies", "devDependencies")


def dependencies(manifests: DataFrame) -> DataFrame:
    """(repo_name, committed_at, package, spec) from package manifests as JSON text."""
    schema = ", ".join(f"{f} map<string,string>" for f in FIELDS)
    parsed = manifests.withColumn("_j", F.from_json("manifest", schema))
    both = F.map_concat(*[F.coalesce(F.col(f"_j.{f}"), F.create_map().cast("map<string,string>")) for f in FIELDS[:1]])
    dev = F.map_filter(F.coalesce(F.col(f"_j.{FIELDS[1]}"), F.create_map().cast("map<string,string>")), lambda k, v: ~F.coalesce(F.map_contains_key(F.coalesce(F.col(f"_j.{FIELDS[0]}"), F.create_map().cast("map<string,string>")), k), F.lit(False)))
    return parsed.select("repo_name", "committed_at", F.explode(F.map_concat(both, dev)).alias("package", "spec"))


def _changes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the releases that were the newest of all so far when they came out, in order of time: no more than it has releases."""
    so_far = Window.partitionBy(*keys).orderBy("released_at", "_k").rowsBetween(Window.unboundedPreceding, -1)
    new = rows.withColumn("_max", F.max("_k").over(so_far)).where("_max IS NULL OR _k > _max")
    return new.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("released_at", "_k", "version"))).alias("_changes"))


def _by(changes: str, when: str) -> Column:
    """The last change up to a time."""
    past = F.filter(changes, lambda c: c["released_at"] <= F.col(when))
    return F.try_element_at(past, F.lit(-1))


def resolve(deps: DataFrame, releases: DataFrame) -> DataFrame:
    """The newest release within the range at the commit, the newest of all by then, and the days between them.

    releases: (package, version, released_at). A range that nothing meets has NULL. A range is compiled once, to intervals
    of sort keys, and meets its package's releases once, however many dependencies ask for it: what is joined to them
    is one row per (package, spec), the releases that were its newest in turn.
    """
    keys = releases.select("version").distinct().withColumn("_k", version_key(F.col("version"))).where("_k IS NOT NULL")
    known = releases.join(keys, "version").select("package", "version", "released_at", "_k")
    asked = deps.select("package", "spec").distinct()
    ranges = asked.select("spec").distinct().withColumn("_in", F.explode(spec_intervals(F.col("spec"))))
    above = F.col("_in.low").isNull() | (F.col("_k") > F.col("_in.low")) | (F.col("_in.low_in") & (F.col("_k") == F.col("_in.low")))
    below = F.col("_in.high").isNull() | (F.col("_k") < F.col("_in.high")) | (F.col("_in.high_in") & (F.col("_k") == F.col("_in.high")))
    met = asked.join(ranges, "spec").join(known, "package").where(above & below).select("package", "spec", "version", "released_at", "_k").distinct()
    within = _changes(met, ["package", "spec"]).withColumnRenamed("_changes", "_within")
    every = _changes(known.join(asked.select("package").distinct(), "package", "left_semi"), ["package"]).withColumnRenamed("_changes", "_every")
    out = deps.join(within, ["package", "spec"], "left").join(every, "package", "left").withColumns({"_v": _by("_within", "committed_at"), "_n": _by("_every", "committed_at")})
    out = out.withColumns({"newest": F.col("_n.version"), "newest_at": F.col("_n.released_at"), "version": F.col("_v.version"), "version_at": F.col("_v.released_at")})
    # greatest() skips NULL, so an unresolved range is kept apart.
    lag = F.when(F.col("version").isNotNull(), F.greatest(F.date_diff("newest_at", "version_at"), F.lit(0)))
    return out.withColumn("lag_days", lag).drop("_within", "_every", "_v", "_n")


def vulnerable(resolved: DataFrame, advisories: DataFrame) -> DataFrame:
    """Adds ``vulnerable``: whether an advisory published by the commit covers the version. advisories: (package, range, published_at)."""
    a = advisories.withColumnRenamed("range", "_range")
    hit = resolved.select("repo_name", "committed_at", "package", "version").join(a, "package").where("published_at <= committed_at AND version IS NOT NULL")
    keys = ["repo_name", "committed_at", "package"]
    bad = hit.withColumn("_hit", version_satisfies(F.col("version"), F.col("_range"))).where("_hit").select(*keys).distinct().withColumn("vulnerable", F.lit(1))
    return resolved.join(bad, keys, "left").withColumn("vulnerable", F.coalesce("vulnerable", F.lit(0)))


def health(checked: DataFrame) -> DataFrame:
    return checked.groupBy("repo_name", "committed_at").agg(F.count("*").alias("dependencies"), F.count("version").alias("resolved"), F.sum("vulnerable").alias("vulnerable"), F.avg("lag_days").alias("mean_lag_days"))
