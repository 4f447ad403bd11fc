"""Checks and descriptive tables: one wide aggregate, then a long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkiln.functions.values import missing_to_null
from panelkiln.operators.quantiles import quantiles


def qc_long(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, value): all checks of a table in one pass."""
    one = df.agg(*[c.cast("string").alias(n) for n, c in checks.items()])
    return one.unpivot([], list(checks), "check", "value")


def panel_checks() -> dict[str, Column]:
    source = F.col("dataset_source")
    return {
        "rows": F.count("*"),
        "repos": F.count_distinct("repo_name"),
        "treated_rows": F.count_if(source == "treatment"),
        "control_rows": F.count_if(source == "control"),
        "post_rows": F.count_if(F.col("post_event") == 1),
        "control_post_event_sum": F.coalesce(F.sum(F.when(source == "control", F.col("post_event"))), F.lit(0)),
        "post_event_mismatch_rows": F.count_if((source == "treatment") & (F.col("post_event") != (F.col("time_to_event") >= 0).cast("int"))),
        "first_month": F.min("time"),
        "last_month": F.max("time"),
    }


def _sides() -> dict[str, Column]:
    source = F.col("dataset_source")
    of = lambda s: F.count_distinct(F.when(source == s, F.col("repo_name")))
    return {
        "repos": F.count_distinct("repo_name"), "min_time": F.min("time"), "max_time": F.max("time"),
        "treatment_rows": F.count_if(source == "treatment"), "control_rows": F.count_if(source == "control"), "treatment_repos": of("treatment"), "control_repos": of("control"),
    }


def _filled(columns: Sequence[str]) -> dict[str, Column]:
    return {f"{c}_{n}": f for c in columns for n, f in (("nonmissing", F.count(c)), ("missing", F.count("*") - F.count(c)))}


def _flags(columns: Sequence[str]) -> dict[str, Column]:
    return {f"{c}_sum": F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in columns}


def merge_checks(merged: DataFrame, panel_rows: int, metrics: Sequence[str], flags: Sequence[str], commit: str = "scan_commit") -> dict[str, Column]:
    """Of a panel merged with scans: rows kept, sides, repeated keys, what is known of each metric, sums of flags."""
    keys = F.count_distinct("repo_name", "time", "dataset_source")
    head = {"input_panel_rows": F.lit(panel_rows), "merged_rows": F.count("*"), "row_count_preserved": (F.count("*") == panel_rows).cast("int")}
    have = [c for c in metrics if c in merged.columns]
    return head | _sides() | {"duplicate_rows": F.count("*") - keys, f"missing_{commit}": F.count("*") - F.count(commit)} | _filled(have) | _flags([c for c in flags if c in merged.columns])


def input_checks(df: DataFrame, input_rows: int, label: str, outcomes: Sequence[str], flags: Sequence[str], logs: Sequence[str] = ()) -> dict[str, Column]:
    """Of a table that goes into an estimator: rows, sides, readiness, events, and each outcome's missing, zeros, mean, median."""
    source, post = F.col("dataset_source"), F.col("post_event")
    on = lambda s, c: F.when(source == s, c)
    head = {"panel_label": F.lit(label), "input_rows": F.lit(input_rows), "output_rows": F.count("*"), "row_count_preserved": (F.count("*") == input_rows).cast("int")}
    events = {f"{s}_time_to_event_nonmissing": F.count(on(s, F.col("time_to_event"))) for s in ("treatment", "control")}
    sums = {"post_event_sum": post} | {f"{s}_post_event_sum": on(s, post) for s in ("control", "treatment")}
    out = head | _sides() | events | {k: F.coalesce(F.sum(c), F.lit(0)).cast("long") for k, c in sums.items()} | _flags([c for c in flags if c in df.columns])
    for c in outcomes:
        x = F.col(c).cast("double")
        out |= _filled([c]) | {f"{c}_zero_count": F.count_if(x == 0), f"{c}_mean": F.round(F.avg(x), 6), f"{c}_median": F.round(F.percentile(x, 0.5), 6)}
    return out | {f"{c}_{n}": f for c in logs for n, f in (("nonmissing", F.count(c)), ("finite", F.count_if(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")))))}


def wide_checks(long: DataFrame, by: str, checks: Sequence[str]) -> DataFrame:
    return long.groupBy(by).agg(*[F.first(F.when(F.col("check") == c, F.col("value")), ignorenulls=True).alias(c) for c in checks])


def coverage(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Rows with, without and in all, and the percentage, of each metric."""
    one = df.groupBy(*by).agg(F.count("*").alias("total"), *[F.count(c).alias(c) for c in metrics])
    long = one.unpivot([*by, "total"], list(metrics), "metric", "nonmissing")
    return long.select(*by, "metric", "nonmissing", (F.col("total") - F.col("nonmissing")).alias("missing"), "total", (F.col("nonmissing") / F.col("total") * 100).alias("coverage_pct"))


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """n, missing, zeros, mean, sd (n - 1), min, quartiles and max (interpolated) of each column."""
    stats = {
        "n": lambda c: F.count(c),
        "missing": lambda c: F.count("*") - F.count(c),
        "zero_count": lambda c: F.count_if(c == 0).cast("long"),
        "mean": F.avg,
        "sd": F.stddev_samp,
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
    }
    one = df.groupBy(*by).agg(*[f(F.col(c)).alias(f"{c}|{s}") for c in columns for s, f in stats.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{s}`").alias(s) for s in stats]) for c in columns])).alias("r")
    cuts = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    # A row per group and column on either side.
    found = quantiles(df, columns, list(cuts.values()), by)
    wide = found.groupBy(*[F.col(c).alias(f"_{c}") for c in by], F.col("column").alias("_column")).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for n, p in cuts.items()])
    same = F.col("column") == F.col("_column")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    order = ["n", "missing", "zero_count", "mean", "sd", "min", *cuts, "max"]
    return one.select(*by, rows).select(*by, "r.*").join(wide, same, "left").select(*by, "column", *order)


def composition(df: DataFrame, parts: Sequence[str], by: str) -> DataFrame:
    """Each part's sum and share, overall and by source: one pass with grouping sets."""
    one = df.groupingSets([[F.col(by)], []], F.col(by)).agg(*[F.sum(c).alias(c) for c in parts], F.grouping(by).alias("_all"))
    named = one.withColumn("scope", F.when(F.col("_all") == 1, "all").otherwise(F.col(by)))
    long = named.unpivot(["scope"], list(parts), "part", "total")
    return long.withColumn("share", F.try_divide("total", F.sum("total").over(Window.partitionBy("scope"))))


def shares(df: DataFrame, by: Sequence[str], count: str = "n", order: Sequence[str] = ()) -> DataFrame:
    """Share of the group's total and the cumulative percentage from the largest down."""
    w = Window.partitionBy(*by)
    run = w.orderBy(F.desc(count), *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.col(count) / F.sum(count).over(w)
    return df.withColumn("share", share).withColumn("cumulative_pct", F.sum(count).over(run) / F.sum(count).over(w) * 100)


def value_counts(df: DataFrame, column: str, missing: str = "(missing)") -> DataFrame:
    return df.groupBy(F.coalesce(missing_to_null(F.col(column)), F.lit(missing)).alias(column)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def panel_summary(panel: DataFrame) -> DataFrame:
    return panel.groupBy("dataset_source").agg(F.count_distinct("repo_name").alias("repos"), F.count("*").alias("rows"), F.count_if(F.col("post_event") == 1).cast("long").alias("post_rows"))


def estimation_summary(df: DataFrame, outcomes: Sequence[str], by: str = "dataset_source") -> DataFrame:
    """Mean and share of zeros of each outcome."""
    one = df.groupBy(by).agg(*[x for c in outcomes for x in (F.avg(c).alias(f"{c}|mean"), F.avg(F.when(F.col(c) == 0, 1.0).when(F.col(c).isNotNull(), 0.0)).alias(f"{c}|zero_share"))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("outcome"), F.col(f"`{c}|mean`").alias("mean"), F.col(f"`{c}|zero_share`").alias("zero_share")) for c in outcomes])).alias("r")
    return one.select(by, rows).select(by, "r.*")


def event_time_counts(panel: DataFrame, rel: str = "time_to_event") -> DataFrame:
    return panel.where(F.col(rel).isNotNull()).groupBy(rel).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, columns: Sequence[str], complete: bool = True) -> DataFrame:
    """Of each pair; complete: over the rows where all columns are known, else where the pair is."""
    base = df.dropna(subset=list(columns)) if complete else df
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = base.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("correlation")) for a, b in pairs])).alias("r")
    return one.select(rows).select("r.*")


def mean_of_means(df: DataFrame, value: str, cell: Sequence[str], unit: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Sums by cell, means by unit, then mean, median, sd and n by group."""
    cells = df.groupBy(*cell).agg(F.sum(value).alias("_v"))
    units = cells.groupBy(*unit).agg(F.avg("_v").alias("_v"))
    one = units.groupBy(*by).agg(F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"), F.count("*").alias("n"))
    middle = quantiles(units, ["_v"], [0.5], by).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("value").alias("median"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return one.join(middle, same, "left").select(*by, "mean", "median", "sd", "n")


def pre_post(df: DataFrame, value: str, rel: str, by: Sequence[str] = ()) -> DataFrame:
    """Means before and from the event on, their difference and the change in percent."""
    pre, post = (F.avg(F.when(c, F.col(value))) for c in (F.col(rel) < 0, F.col(rel) >= 0))
    out = df.groupBy(*by).agg(pre.alias("mean_pre"), post.alias("mean_post"))
    gain = F.col("mean_post") - F.col("mean_pre")
    return out.withColumn("difference", gain).withColumn("change_pct", F.try_divide(gain, F.nullif("mean_pre", F.lit(0.0))) * 100)
