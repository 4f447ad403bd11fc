"""Activity logs to features: conditional counts by type and calendar bucket.

Events are (type, created_at, repo, actor). Type names are those of the public
event archive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkiln.functions.periods import age_days, month, month_id

#: Metric and the event types it counts.
METRICS = {
    "n_stars": ("WatchEvent",),
    "n_forks": ("ForkEvent",),
    "n_releases": ("ReleaseEvent",),
    "n_pulls": ("PullRequestEvent",),
    "n_issues": ("IssuesEvent", "IssueEvent"),
    "n_comments": ("IssueCommentEvent", "PullRequestReviewCommentEvent"),
}


def counts(kind: str = "type", metrics: dict[str, Sequence[str]] | None = None) -> list[Column]:
    return [F.count_if(F.col(kind).isin(*types)).cast("long").alias(name) for name, types in (metrics or METRICS).items()]


def seen_by(repos: DataFrame, events: DataFrame) -> DataFrame:
    """The events of listed repos, in order of repo and time."""
    return events.join(repos.select("repo").distinct(), "repo", "left_semi")


def type_histogram(events: DataFrame, kind: str = "type") -> DataFrame:
    return events.groupBy(kind).agg(F.count("*").alias("n")).orderBy(F.desc("n"), kind)


def event_metrics(events: DataFrame, period: Column) -> DataFrame:
    """Per repo and period: stars, issues, comments, and days since the repo's first event."""
    first = events.groupBy("repo").agg(F.min("created_at").alias("_first"))
    by = events.groupBy("repo", period.alias("period")).agg(
        F.count_if(F.col("type") == "WatchEvent").cast("long").alias("stars"),
        F.count_if(F.col("type").isin(*METRICS["n_issues"])).cast("long").alias("issues"),
        F.count_if(F.col("type").isin(*METRICS["n_comments"])).cast("long").alias("issue_comments"),
        F.min("created_at").alias("_begin"),
    )
    return by.join(first, "repo").select("repo", "period", "stars", "issues", "issue_comments", age_days(F.col("_begin"), F.col("_first")).alias("age"))


def merge_event_metrics(ts: DataFrame, metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join; counts become 0 where there is no row, ages are 0 at least."""
    out = ts.join(metrics, list(keys), "left")
    for c in ("stars", "issues", "issue_comments"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)).cast("long"))
    return out.withColumn("age", F.greatest(F.coalesce("age", F.lit(0)), F.lit(0)).cast("long"))


def active(events: DataFrame, target: str, least_stars: int = 10) -> DataFrame:
    """Repos with an event in the target month and enough star events ever."""
    starred = events.where("type = 'WatchEvent'").groupBy("repo").agg(F.count("*").alias("stars_ever")).where(F.col("stars_ever") >= least_stars)
    return starred.join(events.where(month(F.col("created_at")) == target), "repo", "left_semi")


def bucketed(events: DataFrame, target: Column) -> DataFrame:
    """Adds ``bucket``: 1 to 6 for that many months before the target month, 7 for all earlier ones; others drop out."""
    back = target - month_id(month(F.col("created_at")))
    return events.withColumn("bucket", F.when(back.between(1, 6), back).when(back > 6, 7)).where("bucket IS NOT NULL")


def bucket_features(repos: DataFrame, events: DataFrame, target: Column) -> DataFrame:
    """Seven rows a repo: activity in each of six months and in all months before, zero where there was none.

    repos: (repo, and what ``target`` - a month id - needs). Each event falls into one
    bucket, so one grouping does it all; distinct users are counted per bucket.
    """
    mine = events.join(repos, "repo")
    felt = bucketed(mine, target).groupBy("repo", "bucket").agg(F.count_distinct("actor").alias("users_involved"), *counts(), F.count("*").alias("total_events"))
    # The first event counts even in the target month, but none after it.
    first = mine.where(month_id(month(F.col("created_at"))) <= target).groupBy("repo").agg(F.min("created_at").alias("_first"))
    grid = repos.select("repo", target.alias("_target")).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(1), F.lit(7))))
    names = ["users_involved", *METRICS, "total_events"]
    out = grid.join(felt, ["repo", "bucket"], "left").join(first, "repo", "left")
    # Buckets end with their month; the last one with the seventh month back.
    end = F.last_day(F.make_date(F.floor((F.col("_target") - F.col("bucket") - 1) / 12).cast("int"), (F.pmod(F.col("_target") - F.col("bucket") - 1, F.lit(12)) + 1).cast("int"), F.lit(1)))
    return out.select("repo", "bucket", F.when(F.col("bucket") == 7, "sum").otherwise("within").alias("period_type"), age_days(end, F.col("_first")).cast("long").alias("age_days"), *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])


def control_candidates(events: DataFrame, target: str, least_stars: int = 10) -> DataFrame:
    """Features of the active repos before the target month (``YYYY-MM``)."""
    return bucket_features(active(events, target, least_stars).select("repo"), events, month_id(F.lit(target)))


def treatment_features(events: DataFrame, adoption: DataFrame) -> DataFrame:
    """The same buckets before each repo's own adoption month. adoption: (repo, adoption_month)."""
    return bucket_features(adoption.select("repo", "adoption_month"), events, month_id(F.col("adoption_month")))


def features_before(events: DataFrame, adoption: DataFrame) -> DataFrame:
    """One row a repo: everything before its adoption month."""
    mine = adoption.select("repo", "adoption_month").join(events, "repo", "left")
    before = month(F.col("created_at")) < F.col("adoption_month")
    picked = [F.count_if(F.col("type").isin(*types) & before).cast("long").alias(n) for n, types in METRICS.items()]
    first = F.min(F.when(before, F.col("created_at")))
    start = F.to_date(F.concat("adoption_month", F.lit("-01")))
    out = mine.groupBy("repo", "adoption_month").agg(F.count_distinct(F.when(before, F.col("actor"))).alias("users_involved"), *picked, F.count_if(before).cast("long").alias("total_events"), first.alias("_first"))
    return out.withColumn("age_days", age_days(start, F.col("_first")).cast("long")).drop("_first")


def period_units(adoption: DataFrame) -> DataFrame:
    """(repo, period, treated): each adopting repo in its adoption month, and each other repo in every month that has adoptions.

    adoption: (repo, adoption_month), NULL for a repo without. Months are ids; they are as many as the calendar has.
    """
    when = adoption.select("repo", month_id(F.col("adoption_month")).alias("period"))
    months = sorted(r[0] for r in when.where("period IS NOT NULL").select("period").distinct().collect())
    every = F.explode(F.array(*[F.lit(m) for m in months]).cast("array<int>")).alias("period")
    mine = when.where("period IS NOT NULL").select("repo", F.col("period").cast("int").alias("period"), F.lit(1).alias("treated"))
    return mine.unionByName(when.where("period IS NULL").select("repo", every, F.lit(0).alias("treated")))


def lag_features(events: DataFrame, units: DataFrame, lags: int = 3, metrics: Sequence[str] = ("n_stars", "n_pulls")) -> DataFrame:
    """Activity of each unit (repo, period, treated) in each of ``lags`` months before its period, and in all earlier ones.

    Events are counted by month once, whatever the number of periods that look back at them.
    """
    by = events.groupBy("repo", month_id(month(F.col("created_at"))).alias("_t")).agg(*[F.count_if(F.col("type").isin(*METRICS[m])).alias(m) for m in metrics], F.count("*").alias("total_events"))
    back = F.col("period") - F.col("_t")
    picks = [F.coalesce(F.sum(F.when(back == b if b <= lags else back > lags, F.col(m))), F.lit(0)).cast("long").alias(f"{m}_{f'm{b}' if b <= lags else 'sum'}") for m in (*metrics, "total_events") for b in range(1, lags + 2)]
    return units.join(by, "repo", "left").groupBy("repo", "period", "treated").agg(*picks)


def wide_features(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """A column for each metric and bucket, named by the offset: n_stars_m1 to n_stars_m6 and n_stars_sum."""
    picks = [F.coalesce(F.max(F.when(F.col("bucket") == b, F.col(n))), F.lit(0)).alias(f"{n}_{'sum' if b == 7 else f'm{b}'}") for n in names for b in range(1, 8)]
    return features.groupBy("repo").agg(F.max(F.when(F.col("bucket") == 1, F.col("age_days"))).alias("age_days"), *picks)


def commit_series(commits: DataFrame, period: Column, by: Sequence[str] = ("repo_name",)) -> DataFrame:
    """Per unit and period: commits, lines, authors and the last commit. by: add the author for the contributors' form."""
    when = F.struct("committed_at", "sha")
    return commits.groupBy(*by, period.alias("month")).agg(
        F.max_by("sha", when).alias("latest_commit"), F.count("*").alias("commits"), F.sum("added").alias("lines_added"), F.sum("removed").alias("lines_removed"), F.count_distinct("author").alias("contributors")
    )
