"""Outcome metrics: merging scans into panels, derived outcomes, readiness, categories, introduced issues."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkiln.functions.periods import month_diff, month_id, normal_month
from panelkiln.functions.values import log1p_guarded, per_kloc
from panelkiln.operators.joins import one_to_one, previous
from panelkiln.operators.panel import cohort
from panelkiln.operators.reshape import dense_ids, keep_one, union_all
from panelkiln.schemas import require_columns

KEYS = ("repo_name", "time", "dataset_source")
ISSUES = ("bugs", "vulnerabilities", "code_smells", "technical_debt")
SIZES = ("ncloc", "duplicated_lines_density", "comment_lines_density", "cognitive_complexity")
OUTCOMES = ("static_analysis_warnings", "duplicate_line_density", "code_complexity")
RATES = ("warnings_per_kloc", "complexity_per_kloc", "code_smells_per_kloc")
LOGGED = (*OUTCOMES, *RATES, "commits", "lines_added", "lines_removed", "contributors")


def both(cs: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, cs)


def merge_quality(panel: DataFrame, treated: DataFrame, control: DataFrame) -> DataFrame:
    """The panel with the scans' metrics as ``_raw``: one to one, every panel row once, nothing imputed."""
    tagged = [df.withColumn("dataset_source", F.lit(s)) for df, s in ((treated, "treatment"), (control, "control"))]
    scans = union_all(tagged).withColumnRenamed("month", "time")
    scans = keep_one(scans, KEYS, [F.col("latest_commit").desc_nulls_last(), *[F.col(c) for c in (*ISSUES, *SIZES)]])
    raw = scans.select(*KEYS, F.col("latest_commit").alias("scan_commit"), *[F.col(c).alias(f"{c}_raw") for c in (*ISSUES, *SIZES)])
    return one_to_one(panel, raw, KEYS)


def quality_outcomes(merged: DataFrame) -> DataFrame:
    """Warnings (NULL if any part is), rates only where there is code, and seven flags."""
    have = {c: F.col(f"{c}_raw") for c in (*ISSUES, *SIZES)}
    warnings = have["bugs"] + have["vulnerabilities"] + have["code_smells"]
    out = merged.withColumns(have).withColumns({"static_analysis_warnings": warnings, "duplicate_line_density": have["duplicated_lines_density"], "code_complexity": have["cognitive_complexity"]})
    n = F.col("ncloc")
    rates = {"warnings_per_kloc": per_kloc(F.col("static_analysis_warnings"), n), "complexity_per_kloc": per_kloc(F.col("code_complexity"), n), "code_smells_per_kloc": per_kloc(F.col("code_smells"), n)}
    some, every = F.coalesce(*have.values()).isNotNull(), both([c.isNotNull() for c in have.values()])
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return out.withColumns(rates).withColumns({
        "has_scan": flag(F.col("scan_commit").isNotNull()), "has_any_metric": flag(some), "has_all_metrics": flag(every), "has_size": flag(n.isNotNull()),
        "positive_size": flag(n > 0), "missing_outcome": flag(F.col("static_analysis_warnings").isNull() | F.col("code_complexity").isNull() | F.col("duplicate_line_density").isNull()),
        "sourceless": flag(sourceless()),
    })


def sourceless() -> Column:
    """A commit without source: all sizes NULL and all issue counts 0."""
    return both([F.col(c).isNull() for c in SIZES] + [F.col(c) == 0 for c in ISSUES])


def quality_outcomes_v1(merged: DataFrame) -> DataFrame:
    """As quality_outcomes, but sizes of sourceless commits count as 0."""
    zero = F.coalesce(both([F.col(f"{c}_raw").isNull() for c in SIZES] + [F.col(f"{c}_raw") == 0 for c in ISSUES]), F.lit(False))
    return quality_outcomes(merged.withColumns({f"{c}_raw": F.when(zero, 0.0).otherwise(F.col(f"{c}_raw")) for c in SIZES}))


def readiness(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Duplicate flag (all but the first of a key) and four readiness flags."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in OUTCOMES], F.col("commits"))
    out = df.withColumn("did_duplicate_key", (F.row_number().over(w) > 1).cast("int"))
    keyed = both([F.col(c).isNotNull() for c in keys]) & (F.col("did_duplicate_key") == 0) & F.col("dataset_source").isin("treatment", "control")
    core = keyed & both([F.col(c).isNotNull() for c in OUTCOMES])
    rate = keyed & both([F.col(c).isNotNull() for c in RATES])
    base = keyed & F.col("post_event").isNotNull() & F.col("is_treatment").isNotNull()
    flags = {"ready_core": core, "ready_rate": rate, "ready_base": base, "ready_did": core & base}
    return out.withColumns({f"analysis_{k}": F.coalesce(v, F.lit(False)).cast("int") for k, v in flags.items()})


def did_input(df: DataFrame, strict: bool = False) -> dict[str, DataFrame]:
    """full, complete and missing. Numbers are coerced, logs guarded; strict fails on any missing outcome."""
    require_columns(df, [*KEYS, *OUTCOMES])
    numeric = [c for c in LOGGED if c in df.columns]
    out = df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in numeric})
    out = readiness(out.withColumns({f"log_{c}": log1p_guarded(F.col(c)) for c in numeric}))
    missing = out.where("analysis_ready_did = 0")
    if strict and missing.take(1):
        raise ValueError("outcomes are missing")
    return {"full": out, "complete": out.where("analysis_ready_did = 1"), "missing": missing}


def assert_keys(df: DataFrame, keys: Sequence[str], not_negative: Sequence[str] = ()) -> DataFrame:
    """Raises if keys repeat or counts are negative: one aggregate over the keys, one over the counts."""
    if df.groupBy(*keys).count().where("count > 1").take(1):
        raise ValueError(f"keys repeat: {', '.join(keys)}")
    if not_negative:
        low = df.agg(*[F.min(c).alias(c) for c in not_negative]).first()
        bad = [c for c in not_negative if low[c] is not None and low[c] < 0]
        if bad:
            raise ValueError(f"negative: {', '.join(bad)}")
    return df


def category_counts(issues: DataFrame) -> DataFrame:
    """Warnings by repo, source, month and category: the best count that the columns allow."""
    if "warning_count" in issues.columns:
        n = F.sum("warning_count")
    elif "count" in issues.columns:
        n = F.sum("count")
    elif "issue_key" in issues.columns:
        n = F.count_distinct("issue_key")
    else:
        n = F.count("*")
    months = issues.withColumn("month", normal_month(F.col("month"))).where("month IS NOT NULL")
    return months.groupBy("repo_name", "dataset_source", "month", F.coalesce("category", F.lit("Other")).alias("category")).agg(n.cast("long").alias("warning_count"))


def observed(issues: DataFrame) -> DataFrame:
    return issues.select("repo_name", "dataset_source", normal_month(F.col("month")).alias("month")).where("month IS NOT NULL").distinct()


def category_did_input(panel: DataFrame, counts: DataFrame, coverage: DataFrame, category: str) -> DataFrame:
    """The panel with one category's count: zero where the month was observed without it, NULL where it wasn't."""
    on = ["repo_name", "dataset_source", "time"]
    c = counts.where(F.col("category") == category).select("repo_name", "dataset_source", F.col("month").alias("time"), "warning_count")
    seen = coverage.select("repo_name", "dataset_source", F.col("month").alias("time"), F.lit(1).alias("_seen"))
    out = panel.join(c, on, "left").join(seen, on, "left")
    out = out.withColumn("warning_count", F.when(F.col("_seen") == 1, F.coalesce("warning_count", F.lit(0)))).drop("_seen")
    return out.withColumn("log_warning_count", log1p_guarded(F.col("warning_count")))


class NotBothSides(ValueError):
    pass


def category_did(panel: DataFrame, counts: DataFrame, coverage: DataFrame, category: str, treatment_only: bool = False, after: int = 202407, to: int = 202503) -> DataFrame:
    """category_did_input ready for an estimator: the cohorts of (after, to] and units without event, with ids.

    Fails where no treated unit was observed, and where no control was unless ``treatment_only`` (then for diagnosis
    alone). Adds time_id and event_id (12 y + m, 0 without event), repo_id (1, 2, ... by name) and log columns.
    """
    out = category_did_input(panel, counts, coverage, category)
    seen = out.where("warning_count IS NOT NULL").agg(*[F.count_if(F.col("dataset_source") == s).alias(s) for s in ("treatment", "control")]).first()
    if not seen["treatment"] or not (seen["control"] or treatment_only):
        raise NotBothSides("the warnings cover no treated or no control units")
    event = F.regexp_replace("event", "-", "").try_cast("int")
    out = out.where(cohort(event, after, to)).withColumns({"time_id": month_id(F.col("time")), "event_id": F.coalesce(month_id(F.col("event")), F.lit(0))}).where("time_id IS NOT NULL")
    logs = {n: log1p_guarded(F.col(c).cast("double")) for c, n in (("contributors", "contributors_log"), ("ncloc", "log_ncloc")) if c in out.columns}
    return dense_ids(out, "repo_name", "repo_id").withColumns({**logs, "analysis_ready": F.col("dataset_source").isin("treatment", "control").cast("int")})


def introduced_issues(issues: DataFrame, analyses: DataFrame, event: str = "event_month", k: int = 6) -> DataFrame:
    """Issues created in (previous analysis, this analysis] with the month relative to the event, -k to k.

    analyses: (project, analysis_date, month, event_month). issues: (project, issue_key, creation_date, category).
    """
    before = analyses.join(previous(analyses, "project", "analysis_date", "previous_analysis_date"), ["project", "analysis_date"])
    rel = month_diff(F.col("month"), F.col(event))
    ranges = before.withColumn("relative_period", rel).where(rel.between(-k, k))
    # The equi-join on the project is narrowed by the range in the join itself.
    hit = (F.col("i.creation_date") <= F.col("a.analysis_date")) & (F.col("a.previous_analysis_date").isNull() | (F.col("i.creation_date") > F.col("a.previous_analysis_date")))
    out = ranges.alias("a").join(issues.alias("i"), (F.col("a.project") == F.col("i.project")) & hit)
    return out.select("a.project", "a.month", "a.analysis_date", "a.previous_analysis_date", F.col("a.previous_analysis_date").isNotNull().cast("int").alias("range_has_previous_analysis"), "a.relative_period", "i.issue_key", "i.creation_date", F.coalesce("i.category", F.lit("Other")).alias("category"))


def with_definitions(warnings: DataFrame, definitions: DataFrame) -> DataFrame:
    """The category of each warning's rule; rules without one are "Unmapped"."""
    return warnings.join(definitions.select("rule", "category"), "rule", "left").withColumn("category", F.coalesce("category", F.lit("Unmapped")))


def classify(warnings: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """taxonomy: (rule, category), loaded as data."""
    return warnings.join(taxonomy, "rule", "left").withColumn("category", F.coalesce("category", F.lit("Other")))
