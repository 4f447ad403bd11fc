"""Choosing units: event windows, pairs, leaks, adopters, settings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkiln.functions.periods import month_diff
from panelkiln.functions.values import author_keys, clip, ratio_or_zero
from panelkiln.operators.joins import author_match
from panelkiln.operators.reshape import place_in_order, ranked_long


def event_windows(panel: DataFrame, unit: str = "repo_name", time: str = "month", event: str = "event") -> DataFrame:
    """Per unit: months before, in and after the event month, and the balanced window, the lesser of both sides."""
    rel = month_diff(F.col(time), F.col(event))
    rows = panel.select(unit, time, event).distinct()
    out = rows.groupBy(unit).agg(
        F.min(event).alias("event_month"), F.min(time).alias("panel_first_month"), F.max(time).alias("panel_latest_month"), F.count_distinct(time).alias("panel_month_count"),
        F.min(rel).alias("min_relative_month"), F.max(rel).alias("max_relative_month"),
        F.count_if(rel < 0).cast("long").alias("pre_panel_months"), F.count_if(rel == 0).cast("long").alias("event_months"), F.count_if(rel > 0).cast("long").alias("post_panel_months"),
    )
    return out.withColumn("balanced_window", F.least("pre_panel_months", "post_panel_months"))


#: Sort keys of the rankings, each descending; keys that a table lacks are left out, ties go by name.
RANKINGS = {
    "balanced": ("balanced_window", "total_pre_post", "cursor_commit_rows", "cursor_file_rows", "ts_rows_with_latest_commit", "panel_month_count"),
    "high_contributor": ("share", "cursor_commit_rows", "balanced_window", "total_pre_post", "ts_rows_with_latest_commit"),
    "longest": ("panel_month_count", "balanced_window"),
}


def eligible(windows: DataFrame, before: int = 6, after: int = 6, least_share: float | None = None, evidence: bool = False) -> DataFrame:
    """Units with enough months on both sides and an event month; with the total of both sides.

    least_share: of the column ``share``. evidence: commits or files of the tool are required.
    """
    ok = windows.where((F.col("pre_panel_months") >= before) & (F.col("post_panel_months") >= after) & (F.col("event_months") >= 1))
    if evidence:
        ok = ok.where("cursor_commit_rows > 0 OR cursor_file_rows > 0")
    if least_share is not None:
        ok = ok.where(F.col("share") >= least_share)
    return ok.withColumn("total_pre_post", F.col("pre_panel_months") + F.col("post_panel_months"))


def contributor_share(units: DataFrame, commits: str = "cursor_commit_rows", total: str = "repo_commits") -> DataFrame:
    """Adds ``share``: the tool's commits of all, 1 at most, 0 where there are none or nothing is known."""
    return units.withColumn("share", clip(ratio_or_zero(F.coalesce(commits, F.lit(0)), F.coalesce(total, F.lit(0))).cast("double"), high=1.0))


def balanced(windows: DataFrame, before: int = 6, after: int = 6, rank: str = "balanced", unit: str = "repo_name", least_share: float | None = None, evidence: bool = False) -> DataFrame:
    """Eligible units, ranked by one of RANKINGS."""
    ok = eligible(windows, before, after, least_share, evidence)
    # From the greatest on, unknown values last.
    down = {f"_o{i}": F.coalesce(-F.col(c).cast("double"), F.lit(float("inf"))) for i, c in enumerate(c for c in RANKINGS[rank] if c in ok.columns)}
    return place_in_order(ok.withColumns(down), [*down, unit], "rank").withColumn("rank", F.col("rank").cast("int")).drop(*down)


def window_counts(windows: DataFrame, ks: Sequence[int] = range(3, 10)) -> DataFrame:
    """How many units have a balanced window of k months, for each k; one pass."""
    one = windows.agg(*[F.count_if(F.col("balanced_window") >= k).cast("long").alias(f"k{k}") for k in ks])
    return one.unpivot([], [f"k{k}" for k in ks], "window", "units")


def pairs_long(matches: DataFrame, columns: Sequence[str] = ("matched_control_1", "matched_control_2", "matched_control_3")) -> DataFrame:
    return ranked_long(matches.withColumnRenamed("repo_name", "treatment_repo"), ["treatment_repo"], columns, "match_rank", "control_repo")


def flag_overlap(pairs: DataFrame, treated: DataFrame, adopters: DataFrame) -> DataFrame:
    """Whether a control is itself treated, or an adopter of any kind. Both: (repo_name)."""

    def has(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("repo_name").alias("control_repo")).distinct().withColumn(name, F.lit(1))

    out = pairs.join(has(treated, "_t"), "control_repo", "left").join(has(adopters, "_a"), "control_repo", "left")
    return out.withColumns({"overlap_treatment": F.coalesce("_t", F.lit(0)), "overlap_adopter": F.coalesce("_a", F.lit(0))}).drop("_t", "_a")


def clean_pairs(pairs: DataFrame, treated: DataFrame, adopters: DataFrame) -> dict[str, DataFrame]:
    """kept, dropped, coverage and summary."""
    flagged = flag_overlap(pairs, treated, adopters)
    bad = (F.col("overlap_treatment") == 1) | (F.col("overlap_adopter") == 1)
    kept = flagged.where(~bad)
    summary = flagged.agg(F.count("*").alias("pairs"), F.count_if(~bad).cast("long").alias("kept_pairs"), F.count_distinct("control_repo").alias("controls"), F.count_distinct(F.when(~bad, F.col("control_repo"))).alias("kept_controls"))
    return {"kept": kept, "dropped": flagged.where(bad), "coverage": pair_coverage(pairs, kept), "summary": summary}


def pair_coverage(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct controls of each treatment before and after a filter, and how many went."""
    n = lambda df, name: df.groupBy("treatment_repo").agg(F.count_distinct("control_repo").alias(name))
    out = n(before, "num_controls_before").join(n(after, "num_final_controls"), "treatment_repo", "left")
    final = F.coalesce("num_final_controls", F.lit(0))
    return out.select("treatment_repo", "num_controls_before", final.alias("num_final_controls"), (F.col("num_controls_before") - final).alias("num_dropped_controls"))


def drop_leaky(pairs: DataFrame, evidence: DataFrame, end: str) -> DataFrame:
    """Pairs whose control shows no evidence up to ``end``. evidence: (repo_name, event as YYYY-MM)."""
    leaky = evidence.where(F.col("event") <= end).select(F.col("repo_name").alias("control_repo")).distinct()
    return pairs.join(leaky, "control_repo", "left_anti")


def with_exactly(pairs: DataFrame, n: int = 3) -> DataFrame:
    """Pairs of the treatments that have n distinct controls left."""
    full = pairs.groupBy("treatment_repo").agg(F.count_distinct("control_repo").alias("_n")).where(F.col("_n") == n)
    return pairs.join(full, "treatment_repo", "left_semi")


def adoption_check(windows: DataFrame, adoption: DataFrame) -> DataFrame:
    """Months between the panel's event and the detected adoption, and a status."""
    out = windows.select("repo_name", "event_month").join(adoption.select("repo_name", "adoption_month"), "repo_name", "left")
    diff = month_diff(F.col("adoption_month"), F.col("event_month"))
    status = F.when(F.col("event_month").isNull(), "missing_event_month").when(F.col("adoption_month").isNull(), "missing_adoption_month").when(diff == 0, "matched").otherwise("mismatched")
    return out.withColumns({"month_difference": diff, "status": status})


def sample_options(checked: DataFrame) -> dict[str, DataFrame]:
    """exact, within one month, and all that have both months."""
    d = F.col("month_difference")
    return {"exact": checked.where(d == 0), "within_1_month": checked.where(F.abs(d) <= 1), "diagnostic": checked.where(d.isNotNull())}


def usable(clones: DataFrame, statuses: Sequence[str] = ("cloned", "exists", "updated")) -> DataFrame:
    return clones.where(F.lower(F.trim("status")).isin(*statuses))


def adopter_metrics(repos: DataFrame, commits: DataFrame, evidence: DataFrame, least_stars: int = 10) -> DataFrame:
    """Per repo with enough stars: evidence commits, their first time, and the share of commits by adopters in percent.

    An adopter is an author of an evidence commit of that repo.
    """
    base = repos.where(F.col("repo_stars") >= least_stars).select("repo_name", "repo_stars")
    adopters = evidence.select("repo_name", "author").distinct().withColumn("_by", F.lit(1))
    share = commits.join(adopters, ["repo_name", "author"], "left").groupBy("repo_name").agg(F.count("*").alias("commits"), F.count("_by").alias("adopter_commits"))
    found = evidence.groupBy("repo_name").agg(F.count("*").alias("evidence_commits"), F.count_distinct("author").alias("adopters"), F.min("committed_at").alias("first_evidence"))
    out = base.join(found, "repo_name", "left").join(share, "repo_name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("repo_name", "repo_stars", zero("evidence_commits"), zero("adopters"), "first_evidence", zero("commits"), zero("adopter_commits"), (ratio_or_zero(F.col("adopter_commits"), F.col("commits")) * 100).alias("adopter_pct"))


def pushes_share(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per repo the share of pushes by actors that match an evidence author by any key."""
    pushes = events.where("type = 'PushEvent'")
    mine = author_match(pushes, evidence).groupBy("repo_name").agg(F.count("*").alias("adopter_pushes"))
    total = pushes.groupBy("repo_name").agg(F.count("*").alias("pushes"))
    out = total.join(mine, "repo_name", "left").withColumn("adopter_pushes", F.coalesce("adopter_pushes", F.lit(0)))
    return out.withColumn("share", F.col("adopter_pushes") / F.col("pushes"))


def known_authors(evidence: DataFrame) -> DataFrame:
    """(repo_name, keys): all keys of a repo's authors, sorted."""
    return evidence.select("repo_name", F.explode(author_keys(F.col("author"))).alias("k")).groupBy("repo_name").agg(F.array_sort(F.collect_set("k")).alias("keys"))


def confidence(panel: DataFrame, config: DataFrame, agents: DataFrame) -> DataFrame:
    """high_confidence and other_agents.

    high_confidence: NULL for controls and before the event, true in its month, later true in months
    with a change of the configuration. config: (repo_name, months array). agents: (repo_name, tools array).
    """
    out = panel.join(config.select("repo_name", F.col("months").alias("_months")), "repo_name", "left").join(agents.select("repo_name", F.col("tools").alias("_tools")), "repo_name", "left")
    changed = F.coalesce(F.array_contains("_months", F.col("time")), F.lit(False))
    high = F.when(F.col("event").isNull() | (F.col("time") < F.col("event")), F.lit(None).cast("boolean")).when(F.col("time") == F.col("event"), True).otherwise(changed)
    others = F.coalesce(F.size(F.array_remove("_tools", "cursor")) > 0, F.lit(False))
    return out.withColumns({"high_confidence": high, "other_agents": others}).drop("_months", "_tools")


def config_months(changes: DataFrame) -> DataFrame:
    """All months in which a repo's configuration changed, from lists of them. changes: (repo_name, months array)."""
    return changes.groupBy("repo_name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("months")))).alias("months"))


@dataclass(frozen=True)
class Setting:
    """rows: the condition binds all rows, controls too. Otherwise it picks treated units (those with a row that
    meets it, with all their rows) and the controls that were matched to them."""

    condition: str
    rows: bool = False


def settings(until: str = "2025-06", before: str = "2024-11", since: str = "2024-12", default: str = "2025-02", busy: int = 10) -> dict[str, Setting]:
    """The robustness settings by name. The panel has commits, time, event, high_confidence, other_agents,
    adopter_pct and language_group; months as YYYY-MM."""
    unit_any = "coalesce(max(coalesce(other_agents, false)) OVER (PARTITION BY repo_name), false)"
    languages = {name: Setting(f"language_group = '{label}'") for name, label in (("javascript", "JavaScript/TypeScript"), ("python", "Python"), ("go", "Go"), ("rust", "Rust"))}
    return {
        "all": Setting("true", True),
        "adopters_80": Setting("coalesce(adopter_pct, 0) >= 80"),
        "active": Setting("commits > 0", True),
        "very_active": Setting(f"commits >= {busy}", True),
        "truncated": Setting(f"time <= '{until}'", True),
        "config_changes": Setting("high_confidence IS NULL OR high_confidence", True),
        "low_confidence": Setting("high_confidence IS NULL OR NOT high_confidence", True),
        "with_others": Setting(f"{unit_any}"),
        "only_one": Setting(f"NOT {unit_any}"),
        "before_release": Setting(f"event <= '{before}'"),
        "after_release": Setting(f"event >= '{since}'"),
        "made_default": Setting(f"event >= '{default}'"),
    } | languages


def language_group(c: Column) -> Column:
    """Five groups; the first holds two languages, the last all others and NULL."""
    return F.when(c.isin("JavaScript", "TypeScript"), "JavaScript/TypeScript").when(c.isin("Python", "Go", "Rust"), c).otherwise("Other")


def apply_setting(panel: DataFrame, pairs: DataFrame, setting: Setting) -> DataFrame:
    if setting.rows:
        return panel.where(setting.condition)
    mark = "_meets"
    units = panel.where("is_treatment = 1").withColumn(mark, F.expr(setting.condition)).where(mark).select("repo_name").distinct()
    treated = panel.where("is_treatment = 1").join(units, "repo_name", "left_semi")
    controls = pairs.join(units.withColumnRenamed("repo_name", "treatment_repo"), "treatment_repo", "left_semi").select(F.col("control_repo").alias("repo_name")).distinct()
    return treated.unionByName(panel.where("is_treatment = 0").join(controls, "repo_name", "left_semi"))


def setting_labels(panel: DataFrame, pairs: DataFrame, chosen: dict[str, Setting]) -> DataFrame:
    """The panel with ``settings``, the list of the settings that each row is in: what ``apply_setting`` picks for each, at once."""
    named = lambda marks: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in marks.items()]))
    units = {n: s for n, s in chosen.items() if not s.rows}
    marks = {n: f"_m{i}" for i, n in enumerate(units)}
    treated = panel.where("is_treatment = 1").select("repo_name", *[F.expr(s.condition).alias(marks[n]) for n, s in units.items()])
    mine = treated.groupBy("repo_name").agg(*[F.bool_or(c).alias(c) for c in marks.values()]).select("repo_name", named({n: F.col(c) for n, c in marks.items()}).alias("_own"))
    # As many names as there are settings.
    met = pairs.join(mine.withColumnRenamed("repo_name", "treatment_repo"), "treatment_repo").select(F.col("control_repo").alias("repo_name"), F.explode("_own").alias("_n"))
    theirs = met.groupBy("repo_name").agg(F.collect_set("_n").alias("_own"))
    both = mine.withColumn("is_treatment", F.lit(1)).unionByName(theirs.withColumn("is_treatment", F.lit(0)))
    whole = named({n: F.expr(s.condition) for n, s in chosen.items() if s.rows})
    out = panel.join(both, ["repo_name", "is_treatment"], "left")
    return out.withColumn("settings", F.concat(whole, F.coalesce("_own", F.array().cast("array<string>")))).drop("_own")


def setting_counts(panel: DataFrame, *by: str) -> DataFrame:
    return panel.groupBy(*by).agg(F.count_distinct(F.when(F.col("is_treatment") == 1, F.col("repo_name"))).alias("treated"), F.count_distinct(F.when(F.col("is_treatment") == 0, F.col("repo_name"))).alias("controls"), F.count("*").alias("n"), F.count_if(F.col("post_event") == 1).cast("long").alias("post_rows"))
