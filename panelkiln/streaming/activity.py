"""Activity metrics over streams: the same columns as the batch operators, by calendar month or window.

State is bounded by the watermark; late events beyond it are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkiln.operators.events import METRICS, counts


def event_counts(events: DataFrame, late: str = "2 days", window: str = "1 day", extra: dict[str, Column] | None = None) -> DataFrame:
    """Counts by repo and window. Distinct users are approximate, by a sketch; ``exact_counts`` has a state a user."""
    more = [c.alias(n) for n, c in (extra or {}).items()]
    by = events.withWatermark("created_at", late).groupBy("repo", F.window("created_at", window))
    out = by.agg(*counts(), F.count("*").alias("total_events"), F.approx_count_distinct("actor").alias("users_involved"), *more)
    return out.select("repo", F.col("window.start").alias("period_start"), *METRICS, "total_events", "users_involved", *(extra or {}))


def exact_counts(events: DataFrame, late: str = "2 days", window: str = "1 day") -> DataFrame:
    """As ``event_counts``, with distinct users exact: the stream's finished windows equal the batch operators' rows.

    Two chained stateful steps: each user's events by repo and window, then users and sums by repo and window. State is a row
    a user, repo and open window, which the watermark bounds; both steps are partial sums before the shuffle, and no user list
    is ever held. Events without a user count, but not as a user.
    """
    by = events.withWatermark("created_at", late).groupBy("repo", F.window("created_at", window), "actor").agg(*counts(), F.count("*").alias("total_events"))
    again = by.groupBy("repo", F.window(F.window_time("window"), window).alias("w"))
    out = again.agg(*[F.sum(m).alias(m) for m in (*METRICS, "total_events")], F.count("actor").alias("users_involved"))
    return out.select("repo", F.col("w.start").alias("period_start"), *METRICS, "total_events", "users_involved")


def commit_counts(commits: DataFrame, late: str = "2 days", window: str = "1 day") -> DataFrame:
    by = commits.withWatermark("committed_at", late).groupBy("repo_name", F.window("committed_at", window))
    out = by.agg(F.count("*").alias("commits"), F.sum("added").alias("lines_added"), F.sum("removed").alias("lines_removed"), F.max_by("sha", F.struct("committed_at", "sha")).alias("latest_commit"))
    return out.select("repo_name", F.col("window.start").alias("period_start"), "commits", "lines_added", "lines_removed", "latest_commit")


def into_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts a query that appends finished windows to a Parquet table and ends when the input is read."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
