"""The registered queries: each an operator on the driver's tables, most with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.estimators import did, linear
from panelkiln.estimators import panel as panels
from panelkiln.functions import periods, values
from panelkiln.operators import cohorts, events, joins, matching, panel, qc, quality, reshape, scan, similarity
from panelkiln.plans.bindings import END, START, TARGET, adoption, commits, ctes, daily_events, load, monthly_events, pairs, panel_rows, scans, series
from panelkiln.sources.tables import query as parameterised

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(*columns: str):
    return {c: F.round(c, 6) + F.lit(0.0) for c in columns}


# Events


@query("SELECT CASE event_type WHEN 'view' THEN 'WatchEvent' WHEN 'click' THEN 'ForkEvent' WHEN 'signup' THEN 'PullRequestEvent' WHEN 'purchase' THEN 'ReleaseEvent' WHEN 'error' THEN 'IssuesEvent' END AS type, count(*) AS n FROM events GROUP BY 1")
def type_histogram(spark, d):
    return events.type_histogram(daily_events(spark, d))


@query(ctes("ev") + """SELECT repo, count_if(type = 'WatchEvent')::BIGINT AS n_stars, count_if(type = 'ForkEvent')::BIGINT AS n_forks, count_if(type = 'ReleaseEvent')::BIGINT AS n_releases,
  count_if(type = 'PullRequestEvent')::BIGINT AS n_pulls, count_if(type IN ('IssuesEvent', 'IssueEvent'))::BIGINT AS n_issues, 0::BIGINT AS n_comments, count(*) AS total_events, count(DISTINCT actor) AS users_involved FROM ev GROUP BY 1""")
def event_type_metrics(spark, d):
    return daily_events(spark, d).groupBy("repo").agg(*events.counts(), F.count("*").alias("total_events"), F.count_distinct("actor").alias("users_involved"))


@query(ctes("oe") + """, f AS (SELECT repo, min(created_at) AS first FROM oe GROUP BY 1)
SELECT repo, strftime(created_at, '%Y-%m') AS period, count_if(type = 'WatchEvent')::BIGINT AS stars, count_if(type = 'IssuesEvent')::BIGINT AS issues, count_if(type = 'IssueCommentEvent')::BIGINT AS issue_comments,
  date_diff('day', any_value(first), min(created_at))::INT AS age FROM oe JOIN f USING (repo) GROUP BY 1, 2""")
def monthly_event_metrics(spark, d):
    return events.event_metrics(monthly_events(spark, d), periods.month(F.col("created_at")))


@query(ctes("oe", "ts") + """, f AS (SELECT repo, min(created_at) AS first FROM oe GROUP BY 1),
m AS (SELECT repo, strftime(created_at, '%Y-%m') AS period, count_if(type = 'WatchEvent')::BIGINT AS stars, count_if(type = 'IssuesEvent')::BIGINT AS issues, count_if(type = 'IssueCommentEvent')::BIGINT AS issue_comments,
  date_diff('day', any_value(first), min(created_at)) AS age FROM oe JOIN f USING (repo) GROUP BY 1, 2)
SELECT repo_name, month, commits, coalesce(stars, 0) AS stars, coalesce(issues, 0) AS issues, coalesce(issue_comments, 0) AS issue_comments, greatest(coalesce(age, 0), 0)::BIGINT AS age
FROM ts LEFT JOIN m ON repo = repo_name AND period = month""")
def merged_event_metrics(spark, d):
    m = events.event_metrics(monthly_events(spark, d), periods.month(F.col("created_at"))).withColumnsRenamed({"repo": "repo_name", "period": "month"})
    return events.merge_event_metrics(series(spark, d), m, ["repo_name", "month"]).select("repo_name", "month", "commits", "stars", "issues", "issue_comments", "age")


@query(ctes("ev") + "SELECT repo, strftime(min(created_at), '%Y-%m-%d') AS first_day, strftime(max(created_at), '%Y-%m-%d') AS last_day, count(*) AS n FROM ev GROUP BY 1")
def first_last_seen(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return daily_events(spark, d).groupBy("repo").agg(day(F.min("created_at")).alias("first_day"), day(F.max("created_at")).alias("last_day"), F.count("*").alias("n"))


@query(ctes("oe") + f"""SELECT repo, count(*) AS stars_ever FROM oe WHERE type = 'WatchEvent' AND repo IN (SELECT repo FROM oe WHERE strftime(created_at, '%Y-%m') = '{TARGET}') GROUP BY 1 HAVING count(*) >= 2""")
def active_candidates_having(spark, d):
    return events.active(monthly_events(spark, d), TARGET, 2)


_BUCKETS = """
g AS (SELECT repo, t, unnest([1, 2, 3, 4, 5, 6, 7]) AS bucket FROM u),
b AS (SELECT oe.*, CASE WHEN t - mid BETWEEN 1 AND 6 THEN t - mid WHEN t - mid > 6 THEN 7 END AS bucket, mid, t FROM (SELECT *, year(created_at) * 12 + month(created_at) AS mid FROM oe) oe JOIN u USING (repo)),
f AS (SELECT repo, min(created_at) AS first FROM b WHERE mid <= t GROUP BY 1),
m AS (SELECT repo, bucket, count(DISTINCT actor) AS users_involved, count_if(type = 'WatchEvent') AS n_stars, count_if(type = 'ForkEvent') AS n_forks, 0 AS n_releases, count_if(type = 'PullRequestEvent') AS n_pulls,
  count_if(type = 'IssuesEvent') AS n_issues, count_if(type = 'IssueCommentEvent') AS n_comments, count(*) AS total_events FROM b WHERE bucket IS NOT NULL GROUP BY 1, 2)
SELECT repo, bucket::INT AS bucket, CASE WHEN bucket = 7 THEN 'sum' ELSE 'within' END AS period_type,
  CASE WHEN first IS NOT NULL THEN greatest(0, date_diff('day', first, last_day(make_date(((t - bucket - 1) // 12)::INT, ((t - bucket - 1) % 12 + 1)::INT, 1)))) END::BIGINT AS age_days,
  coalesce(users_involved, 0)::BIGINT AS users_involved, coalesce(n_stars, 0)::BIGINT AS n_stars, coalesce(n_forks, 0)::BIGINT AS n_forks, coalesce(n_releases, 0)::BIGINT AS n_releases, coalesce(n_pulls, 0)::BIGINT AS n_pulls,
  coalesce(n_issues, 0)::BIGINT AS n_issues, coalesce(n_comments, 0)::BIGINT AS n_comments, coalesce(total_events, 0)::BIGINT AS total_events
FROM g LEFT JOIN m USING (repo, bucket) LEFT JOIN f USING (repo)"""


@query(ctes("oe") + f""", u AS (SELECT repo, 1998 * 12 + 6 AS t FROM oe WHERE type = 'WatchEvent' AND repo IN (SELECT repo FROM oe WHERE strftime(created_at, '%Y-%m') = '{TARGET}') GROUP BY 1 HAVING count(*) >= 2),""" + _BUCKETS)
def bucketed_control_features(spark, d):
    return events.control_candidates(monthly_events(spark, d), TARGET, 2)


@query(ctes("oe", "ad") + ", u AS (SELECT repo_name AS repo, substr(event, 1, 4)::INT * 12 + substr(event, 6, 2)::INT AS t FROM ad WHERE event IS NOT NULL)," + _BUCKETS)
def bucketed_treatment_features(spark, d):
    a = adoption(spark, d).where("event IS NOT NULL").select(F.col("repo_name").alias("repo"), F.col("event").alias("adoption_month"))
    return events.treatment_features(monthly_events(spark, d), a)


@query(ctes("oe", "ad") + """, a AS (SELECT repo_name AS repo, event AS adoption_month FROM ad WHERE event IS NOT NULL),
j AS (SELECT a.repo, adoption_month, type, actor, created_at, strftime(created_at, '%Y-%m') < adoption_month AS b FROM a LEFT JOIN oe ON a.repo = oe.repo)
SELECT repo, adoption_month, count(DISTINCT CASE WHEN b THEN actor END) AS users_involved, count_if(b AND type = 'WatchEvent')::BIGINT AS n_stars, count_if(b AND type = 'ForkEvent')::BIGINT AS n_forks, 0::BIGINT AS n_releases,
  count_if(b AND type = 'PullRequestEvent')::BIGINT AS n_pulls, count_if(b AND type = 'IssuesEvent')::BIGINT AS n_issues, count_if(b AND type = 'IssueCommentEvent')::BIGINT AS n_comments, count_if(b)::BIGINT AS total_events,
  CASE WHEN min(CASE WHEN b THEN created_at END) IS NOT NULL THEN greatest(0, date_diff('day', min(CASE WHEN b THEN created_at END), (adoption_month || '-01')::TIMESTAMP)) END::BIGINT AS age_days FROM j GROUP BY 1, 2""")
def pre_adoption_features(spark, d):
    a = adoption(spark, d).where("event IS NOT NULL").select(F.col("repo_name").alias("repo"), F.col("event").alias("adoption_month"))
    return events.features_before(monthly_events(spark, d), a)


@query(ctes("oe") + f""", p AS (SELECT '1998-05' AS period, 'within' AS period_type, 1998 * 12 + 5 AS ym, NULL::INT AS start UNION ALL SELECT 'before', 'sum', NULL, 1998 * 12 + 1),
r AS (SELECT DISTINCT repo FROM oe)
SELECT r.repo, period, count(e.actor) AS n FROM r CROSS JOIN p LEFT JOIN (SELECT repo, actor, year(created_at) * 12 + month(created_at) AS ym FROM oe) e
  ON e.repo = r.repo AND ((period_type = 'within' AND e.ym = p.ym) OR (period_type = 'sum' AND e.ym < p.start)) GROUP BY 1, 2""")
def theta_period_join(spark, d):
    e = monthly_events(spark, d).select("repo", "actor", periods.month_id(periods.month(F.col("created_at"))).alias("ym"))
    p = spark.createDataFrame([("1998-05", "within", 1998 * 12 + 5, None), ("before", "sum", None, 1998 * 12 + 1)], "period string, period_type string, ym int, start int")
    return joins.theta_periods(e, e, p).groupBy("repo", "period").agg(F.count("actor").alias("n"))


@query("SELECT o_custkey AS repo, o_orderkey AS id FROM orders WHERE list_contains(['1-URGENT', '2-HIGH'], o_orderpriority) AND o_totalprice >= 100000.0")
def parameterised_sql(spark, d):
    return parameterised(spark, "SELECT o_custkey AS repo, o_orderkey AS id FROM o WHERE array_contains(:kinds, o_orderpriority) AND o_totalprice >= :least", o=load(spark, d, "orders"), kinds=["1-URGENT", "2-HIGH"], least=100000.0)


# Series and padding


@query(ctes("ts") + "SELECT repo_name, month, latest_commit, commits, lines_added, lines_removed, contributors FROM ts")
def monthly_timeseries(spark, d):
    return events.commit_series(commits(spark, d), periods.month(F.col("committed_at")))


@query(ctes("co") + "SELECT repo_name, author, strftime(committed_at, '%Y-%m') AS month, arg_max(sha, {'a': committed_at, 'b': sha}) AS latest_commit, count(*) AS commits, sum(added)::BIGINT AS lines_added, sum(removed)::BIGINT AS lines_removed FROM co GROUP BY 1, 2, 3")
def contributor_timeseries(spark, d):
    return events.commit_series(commits(spark, d), periods.month(F.col("committed_at")), ("repo_name", "author")).drop("contributors")


_GRID = """g AS (SELECT repo_name, printf('%04d-%02d', (i - 1) // 12, (i - 1) % 12 + 1) AS month, i FROM (SELECT repo_name, unnest(range(a, b + 1)) AS i FROM (
  SELECT repo_name, min(substr(month, 1, 4)::INT * 12 + substr(month, 6, 2)::INT) AS a, max(substr(month, 1, 4)::INT * 12 + substr(month, 6, 2)::INT) AS b FROM ts GROUP BY 1)))"""


@query(ctes("ts") + f", {_GRID} SELECT repo_name, month, coalesce(commits, 0) AS commits, coalesce(lines_added, 0) AS lines_added FROM g LEFT JOIN ts USING (repo_name, month)")
def pad_periods_zero(spark, d):
    return panel.pad_periods(series(spark, d).select("repo_name", "month", "commits", "lines_added"), ["repo_name"], "month", zero=["commits", "lines_added"])


@query(ctes("ts") + f""", {_GRID}, j AS (SELECT g.repo_name, g.month, contributors, lines_removed, row_number() OVER (PARTITION BY g.repo_name ORDER BY g.month) - 1 AS k FROM g LEFT JOIN ts USING (repo_name, month))
SELECT repo_name, month, last_value(contributors IGNORE NULLS) OVER (PARTITION BY repo_name ORDER BY month) AS contributors, (first_value(lines_removed) OVER (PARTITION BY repo_name ORDER BY month) + 30 * k)::BIGINT AS lines_removed FROM j""")
def pad_periods_ffill(spark, d):
    return panel.pad_periods(series(spark, d).select("repo_name", "month", "contributors", "lines_removed"), ["repo_name"], "month", fill=["contributors"], age="lines_removed")


@query(ctes("ts") + f""", {_GRID.replace("max(substr(month, 1, 4)::INT * 12 + substr(month, 6, 2)::INT) AS b", "1998 * 12 + 12 AS b").replace("SELECT repo_name, min(substr(month, 1, 4)::INT * 12 + substr(month, 6, 2)::INT) AS a", "SELECT repo_name, greatest(1996 * 12 + 1, min(substr(month, 1, 4)::INT * 12 + substr(month, 6, 2)::INT)) AS a")}
SELECT repo_name, month, coalesce(commits, 0) AS commits, coalesce(cursor, false) AS cursor FROM g LEFT JOIN ts USING (repo_name, month)""")
def complete_window(spark, d):
    return panel.complete_window(series(spark, d).select("repo_name", "month", "commits", "cursor"), START, END, zero=["commits"])


@query(ctes("ad") + "SELECT repo_name, event FROM ad")
def adoption_first(spark, d):
    return adoption(spark, d)


@query(ctes("co") + """SELECT repo_name, commit_hash, strftime(t, '%Y-%m') AS adoption_month FROM (SELECT repo_name, 'h' || sha AS commit_hash, committed_at AS t, row_number() OVER (PARTITION BY repo_name ORDER BY committed_at, 'h' || sha) AS k FROM co WHERE evidence) WHERE k = 1""")
def first_evidence_row(spark, d):
    e = commits(spark, d).where("evidence").select("repo_name", F.concat(F.lit("h"), F.col("sha").cast("string")).alias("commit_hash"), F.lit("unknown").alias("authored_at"), F.date_format("committed_at", "yyyy-MM-dd HH:mm:ss").alias("committed_at"))
    return panel.adoption_dates(e).select("repo_name", "commit_hash", "adoption_month")


@query(ctes("ts") + "SELECT repo_name, month FROM (SELECT *, lag(cursor) OVER (PARTITION BY repo_name ORDER BY month) AS p FROM ts) WHERE cursor AND NOT coalesce(p, false)")
def switch_months(spark, d):
    return panel.switches(series(spark, d), ["repo_name"], "month", "cursor")


def _coding(k: int = 6, far: bool = True, on: str = "true") -> str:
    flag = lambda c: f"coalesce({c}, false)::INT"
    lead = [f"{flag(f'tte {"<=" if far and j == k else "="} -{j}')} AS lead_{j}" for j in range(k, 0, -1)]
    lag = [f"CASE WHEN {on} THEN {flag(f'tte {">=" if far and j == k else "="} {j}')} ELSE 0 END AS lag_{j}" for j in range(k + 1)]
    return ", ".join(lead + lag)


_HEAD = "repo_name, month AS time, 'treatment' AS dataset_source, 1 AS ever_treated, event, commits, tte AS time_to_event"


def _coded(df: DataFrame, more=("is_treatment_dynamic",)) -> DataFrame:
    return df.select("repo_name", "time", "dataset_source", "ever_treated", "event", "commits", "time_to_event", "post_event", *more, *[f"lead_{j}" for j in range(6, 0, -1)], *[f"lag_{j}" for j in range(7)])


@query(ctes("pr") + f", t AS (SELECT *, mid - eid AS tte FROM pr WHERE event IS NOT NULL) SELECT {_HEAD}, (tte >= 0)::INT AS post_event, coalesce(cursor, false)::INT AS is_treatment_dynamic, {_coding()} FROM t")
def absorbing_panel(spark, d):
    ts = series(spark, d).where(F.col("month").between(START, END))
    return _coded(panel.treatment_panel(ts, adoption(spark, d)))


@query(ctes("pr") + f", t AS (SELECT *, mid - eid AS tte FROM pr WHERE event IS NOT NULL) SELECT {_HEAD}, CASE WHEN cursor THEN (tte >= 0)::INT ELSE 0 END AS post_event, {_coding(far=False, on='cursor')} FROM t")
def switching_panel(spark, d):
    ts = series(spark, d).where(F.col("month").between(START, END))
    return _coded(panel.treatment_panel(ts, adoption(spark, d), mode="switching", endpoints="exact"), ())


_FLAG = ctes("ts", "ad") + f""", g AS (SELECT repo_name, unnest(range(greatest({1996 * 12 + 1}, a), {1998 * 12 + 12 + 1})) AS i FROM (SELECT repo_name, min(substr(month, 1, 4)::INT * 12 + substr(month, 6, 2)::INT) AS a FROM ts GROUP BY 1)),
f AS (SELECT repo_name, printf('%04d-%02d', (i - 1) // 12, (i - 1) % 12 + 1) AS month, i AS mid FROM g),
t AS (SELECT f.repo_name, f.month, event, coalesce(commits, 0) AS commits, coalesce(cursor, false) AS cursor, (mid - (substr(event, 1, 4)::INT * 12 + substr(event, 6, 2)::INT))::INT AS tte
  FROM f LEFT JOIN ts USING (repo_name, month) JOIN ad ON ad.repo_name = f.repo_name WHERE event IS NOT NULL)
SELECT {_HEAD}, (tte >= 0)::INT AS post_event, cursor::INT AS is_treatment_dynamic, {_coding()} FROM t"""


@query(_FLAG)
def lead_lag_panel(spark, d):
    ts = series(spark, d).select("repo_name", "month", "commits", "cursor")
    return _coded(panel.treatment_panel(panel.complete_window(ts, START, END, zero=["commits"]), adoption(spark, d)))


@query(ctes("ts", "pa") + f""", v AS (SELECT control_repo AS repo_name, string_agg(DISTINCT treatment_repo::VARCHAR, '; ' ORDER BY treatment_repo::VARCHAR) AS matched_treatment_repos, string_agg(DISTINCT match_rank::VARCHAR, '; ' ORDER BY match_rank::VARCHAR) AS match_ranks,
  string_agg(DISTINCT matched_period::VARCHAR, '; ' ORDER BY matched_period::VARCHAR) AS matched_periods FROM pa GROUP BY 1)
SELECT repo_name, month AS time, commits, matched_treatment_repos, match_ranks, matched_periods, 0 AS post_event, 0 AS lag_0, 1 AS matched_as_control FROM ts JOIN v USING (repo_name)""")
def control_panel_provenance(spark, d):
    return panel.control_panel(series(spark, d), pairs(spark, d)).select("repo_name", "time", "commits", "matched_treatment_repos", "match_ranks", "matched_periods", "post_event", "lag_0", "matched_as_control")


def assembled(spark: SparkSession, d: str) -> DataFrame:
    t = panel.treatment_panel(series(spark, d), adoption(spark, d))
    return panel.assemble(t, panel.control_panel(series(spark, d).join(adoption(spark, d).where("event IS NULL"), "repo_name", "left_semi"), pairs(spark, d)), START, END)


_ASSEMBLED = ctes("ts", "ad", "pa") + f""", p AS (SELECT repo_name, month AS time, 'treatment' AS dataset_source, event, commits, lines_added, contributors, latest_commit, 1 AS is_treatment,
    substr(month, 1, 4)::INT * 12 + substr(month, 6, 2)::INT - (substr(event, 1, 4)::INT * 12 + substr(event, 6, 2)::INT) AS tte FROM ts JOIN ad USING (repo_name) WHERE event IS NOT NULL AND month BETWEEN '{START}' AND '{END}'
  UNION ALL SELECT repo_name, month, 'control', NULL, commits, lines_added, contributors, latest_commit, 0, NULL FROM ts WHERE repo_name IN (SELECT control_repo FROM pa) AND repo_name IN (SELECT repo_name FROM ad WHERE event IS NULL) AND month BETWEEN '{START}' AND '{END}'),
q AS (SELECT *, CASE WHEN dataset_source = 'control' THEN 0 ELSE (tte >= 0)::INT END AS post_event FROM p)
"""


@query(_ASSEMBLED + "SELECT repo_name, time, dataset_source, event, commits, lines_added, is_treatment, tte AS time_to_event, post_event FROM q")
def assembled_panel(spark, d):
    return assembled(spark, d).select("repo_name", "time", "dataset_source", "event", "commits", "lines_added", "is_treatment", "time_to_event", "post_event")


@query(ctes("ad", "pa") + f"SELECT DISTINCT repo_name, event, CASE WHEN event > '{END}' THEN 'after' WHEN event < '{START}' THEN 'before' ELSE 'within' END AS leak FROM ad JOIN pa ON control_repo = repo_name WHERE event IS NOT NULL")
def control_leakage(spark, d):
    controls = pairs(spark, d).select(F.col("control_repo").alias("repo_name"))
    return panel.leakage(controls, adoption(spark, d), START, END)


_WINDOWS = """w AS (SELECT repo_name, min(event) AS event_month, min(month) AS panel_first_month, max(month) AS panel_latest_month, count(DISTINCT month) AS panel_month_count, min(mid - eid) AS min_relative_month, max(mid - eid) AS max_relative_month,
  count_if(mid < eid)::BIGINT AS pre_panel_months, count_if(mid = eid)::BIGINT AS event_months, count_if(mid > eid)::BIGINT AS post_panel_months, least(count_if(mid < eid), count_if(mid > eid))::BIGINT AS balanced_window FROM pr WHERE event IS NOT NULL GROUP BY 1)"""


@query(ctes("pr") + f", {_WINDOWS} SELECT * FROM w")
def event_window_summary(spark, d):
    return cohorts.event_windows(panel_rows(spark, d).where("event IS NOT NULL"))


@query(ctes("pr") + f", {_WINDOWS} SELECT repo_name, balanced_window, row_number() OVER (ORDER BY balanced_window DESC, panel_month_count DESC, repo_name)::INT AS rank FROM w WHERE pre_panel_months >= 2 AND post_panel_months >= 2 AND event_months >= 1")
def balanced_rank(spark, d):
    return cohorts.balanced(cohorts.event_windows(panel_rows(spark, d).where("event IS NOT NULL")), 2, 2).select("repo_name", "balanced_window", "rank")


@query(ctes("pr") + f", {_WINDOWS} SELECT 'k' || k AS window, (SELECT count(*) FROM w WHERE balanced_window >= k) AS units FROM (SELECT unnest([3, 4, 5, 6, 7, 8, 9]) AS k)")
def balanced_window_counts(spark, d):
    return cohorts.window_counts(cohorts.event_windows(panel_rows(spark, d).where("event IS NOT NULL")))


@query(ctes("pr") + f""", {_WINDOWS} SELECT w.repo_name, event_month, ad.event AS adoption_month, 0 AS month_difference, 'matched' AS status FROM w JOIN ad USING (repo_name)""")
def adoption_check(spark, d):
    w = cohorts.event_windows(panel_rows(spark, d).where("event IS NOT NULL"))
    return cohorts.adoption_check(w, adoption(spark, d).withColumnRenamed("event", "adoption_month"))


# Pairs


@query(ctes("pa") + "SELECT treatment_repo, match_rank, control_repo::VARCHAR AS control_repo FROM pa")
def pairs_unpivot(spark, d):
    wide = matching.matched_wide(pairs(spark, d).select(F.col("treatment_repo").alias("treatment"), F.col("control_repo").cast("string").alias("control"), "match_rank"))
    return cohorts.pairs_long(wide.withColumnRenamed("treatment", "repo_name"))


@query("""WITH x AS (SELECT t.c_mktsegment AS segment, t.c_custkey AS treatment, c.c_custkey AS control, abs(c.c_acctbal - t.c_acctbal) AS distance FROM customer t JOIN customer c ON t.c_mktsegment = c.c_mktsegment WHERE t.c_custkey % 3 = 0 AND c.c_custkey % 3 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY segment, treatment ORDER BY distance, control)::INT AS match_rank FROM x) SELECT segment, treatment, control, match_rank, round(distance, 6) AS distance FROM r WHERE match_rank <= 3""")
def knn_match_1to3(spark, d):
    c = load(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("repo_name"), F.col("c_acctbal").alias("score"))
    return matching.nearest(c.where("repo_name % 3 = 0"), c.where("repo_name % 3 != 0"), ["segment"]).withColumns(r6("distance"))


@query(ctes("pa") + """, k AS (SELECT * FROM pa WHERE control_repo % 4 <> 0) SELECT treatment_repo, count(DISTINCT pa.control_repo) AS num_controls_before, coalesce(any_value(n), 0) AS num_final_controls, count(DISTINCT pa.control_repo) - coalesce(any_value(n), 0) AS num_dropped_controls
FROM pa LEFT JOIN (SELECT treatment_repo, count(DISTINCT control_repo) AS n FROM k GROUP BY 1) USING (treatment_repo) GROUP BY 1""")
def pair_coverage(spark, d):
    p = pairs(spark, d)
    return cohorts.pair_coverage(p, p.where("control_repo % 4 != 0"))


@query(ctes("pa", "ad") + f""", k AS (SELECT * FROM pa WHERE control_repo NOT IN (SELECT repo_name FROM ad WHERE event <= '{END}')) SELECT treatment_repo, match_rank, control_repo FROM k WHERE treatment_repo IN (SELECT treatment_repo FROM k GROUP BY 1 HAVING count(DISTINCT control_repo) = 3)""")
def strict_1to3(spark, d):
    return cohorts.with_exactly(cohorts.drop_leaky(pairs(spark, d), adoption(spark, d), END)).select("treatment_repo", "match_rank", "control_repo")


@query(ctes("pa", "ad") + """SELECT treatment_repo, control_repo, (control_repo IN (SELECT treatment_repo FROM pa))::INT AS overlap_treatment, (control_repo IN (SELECT repo_name FROM ad WHERE event IS NOT NULL))::INT AS overlap_adopter FROM pa""")
def anti_overlap(spark, d):
    p = pairs(spark, d)
    treated = p.select(F.col("treatment_repo").alias("repo_name"))
    return cohorts.flag_overlap(p, treated, adoption(spark, d).where("event IS NOT NULL")).select("treatment_repo", "control_repo", "overlap_treatment", "overlap_adopter")


@query(ctes("pa", "ad") + """, f AS (SELECT *, control_repo IN (SELECT treatment_repo FROM pa) OR control_repo IN (SELECT repo_name FROM ad WHERE event IS NOT NULL) AS bad FROM pa)
SELECT count(*) AS pairs, count_if(NOT bad)::BIGINT AS kept_pairs, count(DISTINCT control_repo) AS controls, count(DISTINCT CASE WHEN NOT bad THEN control_repo END) AS kept_controls FROM f""")
def clean_pairs_summary(spark, d):
    p = pairs(spark, d)
    return cohorts.clean_pairs(p, p.select(F.col("treatment_repo").alias("repo_name")), adoption(spark, d).where("event IS NOT NULL"))["summary"]


# As-of


@query("SELECT o_custkey AS project, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), '%Y-%m-%d') AS previous FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders)")
def asof_previous(spark, d):
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return joins.previous(o, "project", "day")


@query(ctes("co") + """, m AS (SELECT repo_name, unnest(['1996-03-31', '1997-06-30', '1998-12-31'])::DATE AS day FROM (SELECT DISTINCT repo_name FROM co))
SELECT repo_name, strftime(day, '%Y-%m-%d') AS day, (SELECT arg_max(sha, {'a': committed_at, 'b': sha}) FROM co WHERE co.repo_name = m.repo_name AND co.committed_at::DATE <= m.day) AS sha FROM m""")
def asof_month_end(spark, d):
    c = commits(spark, d).select("repo_name", F.to_date("committed_at").alias("committed"), "sha")
    days = F.explode(F.array(*[F.to_date(F.lit(x)) for x in ("1996-03-31", "1997-06-30", "1998-12-31")])).alias("day")
    left = c.select("repo_name").distinct().select("repo_name", days)
    return joins.asof_backward(left, c, "repo_name", "day", "committed", ["sha"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(ctes("ts") + """SELECT repo_name, '1997-02' AS wanted, min(CASE WHEN month >= '1997-02' THEN month END) AS found FROM ts GROUP BY 1""")
def asof_next(spark, d):
    ts = series(spark, d).select("repo_name", "month")
    left = ts.select("repo_name").distinct().withColumn("wanted", F.lit("1997-02"))
    return joins.asof_forward(left, ts, "repo_name", "wanted", "month", "found")


# Quality


def merged(spark: SparkSession, d: str) -> DataFrame:
    s = scans(spark, d)
    return quality.merge_quality(assembled(spark, d), s.where("repo_name % 3 = 0"), s.where("repo_name % 3 != 0 AND repo_name % 10 != 1"))


_MERGED = _ASSEMBLED.rstrip() + ",\n" + ctes("sc").removeprefix("WITH ").rstrip() + """,
mq AS (SELECT q.*, sc.latest_commit AS scan_commit, bugs, vulnerabilities, code_smells, technical_debt, ncloc, duplicated_lines_density, comment_lines_density, cognitive_complexity
  FROM q LEFT JOIN sc ON sc.repo_name = q.repo_name AND sc.month = q.time AND ((q.dataset_source = 'treatment' AND sc.repo_name % 3 = 0) OR (q.dataset_source = 'control' AND sc.repo_name % 3 <> 0 AND sc.repo_name % 10 <> 1)))
"""


@query(_MERGED + "SELECT repo_name, time, dataset_source, scan_commit, bugs AS bugs_raw, ncloc AS ncloc_raw FROM mq")
def merge_quality_left_1to1(spark, d):
    return merged(spark, d).select("repo_name", "time", "dataset_source", "scan_commit", "bugs_raw", "ncloc_raw")


_RATES = """o AS (SELECT *, bugs + vulnerabilities + code_smells AS w FROM mq)"""


@query(_MERGED + f""", {_RATES} SELECT repo_name, time, dataset_source, w AS static_analysis_warnings, round(CASE WHEN ncloc > 0 THEN w / ncloc * 1000 END, 6) AS warnings_per_kloc, round(CASE WHEN ncloc > 0 THEN cognitive_complexity / ncloc * 1000 END, 6) AS complexity_per_kloc,
  (scan_commit IS NOT NULL)::INT AS has_scan, (bugs IS NOT NULL AND ncloc IS NOT NULL)::INT AS has_all_metrics, coalesce(ncloc > 0, false)::INT AS positive_size, (w IS NULL OR cognitive_complexity IS NULL OR duplicated_lines_density IS NULL)::INT AS missing_outcome FROM o""")
def quality_rates(spark, d):
    return quality.quality_outcomes(merged(spark, d)).withColumns(r6("warnings_per_kloc", "complexity_per_kloc")).select("repo_name", "time", "dataset_source", "static_analysis_warnings", "warnings_per_kloc", "complexity_per_kloc", "has_scan", "has_all_metrics", "positive_size", "missing_outcome")


@query(_MERGED + f""", {_RATES} SELECT repo_name, time, dataset_source, 0 AS did_duplicate_key, (w IS NOT NULL AND cognitive_complexity IS NOT NULL AND duplicated_lines_density IS NOT NULL)::INT AS analysis_ready_core,
  coalesce(ncloc > 0 AND w IS NOT NULL AND cognitive_complexity IS NOT NULL, false)::INT AS analysis_ready_rate, 1 AS analysis_ready_base, round(CASE WHEN w >= 0 THEN ln(1 + w) END, 6) AS log_static_analysis_warnings FROM o""")
def readiness_flags(spark, d):
    full = quality.did_input(quality.quality_outcomes(merged(spark, d)))["full"]
    return full.select("repo_name", "time", "dataset_source", "did_duplicate_key", "analysis_ready_core", "analysis_ready_rate", "analysis_ready_base", F.round("log_static_analysis_warnings", 6).alias("log_static_analysis_warnings"))


@query(_ASSEMBLED + """, a AS (SELECT count(*)::VARCHAR AS rows, count(DISTINCT repo_name)::VARCHAR AS repos, count_if(dataset_source = 'treatment')::VARCHAR AS treated_rows, count_if(dataset_source = 'control')::VARCHAR AS control_rows, count_if(post_event = 1)::VARCHAR AS post_rows,
  coalesce(sum(CASE WHEN dataset_source = 'control' THEN post_event END), 0)::VARCHAR AS control_post_event_sum, '0' AS post_event_mismatch_rows, min(time) AS first_month, max(time) AS last_month FROM q) UNPIVOT a ON COLUMNS(*) INTO NAME "check" VALUE value""".replace(") UNPIVOT", ") SELECT * FROM (UNPIVOT").rstrip() + ")")
def qc_long(spark, d):
    return qc.qc_long(assembled(spark, d), qc.panel_checks())


@query("""WITH j AS (SELECT source, quality, toxic, nullif(n_chars % 5, 0) AS lead FROM documents LEFT JOIN labels USING (doc_id)), m AS (
SELECT source, 'quality' AS metric, count(quality) AS nonmissing, count(*) AS total FROM j GROUP BY 1 UNION ALL SELECT source, 'toxic', count(toxic), count(*) FROM j GROUP BY 1 UNION ALL SELECT source, 'lead', count(lead), count(*) FROM j GROUP BY 1)
SELECT source, metric, nonmissing, total - nonmissing AS missing, total, round(nonmissing / total * 100, 6) AS coverage_pct FROM m""")
def coverage_long(spark, d):
    j = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left").withColumn("lead", F.nullif(F.col("n_chars") % 5, F.lit(0)))
    return qc.coverage(j, ["source"], ["quality", "toxic", "lead"]).withColumns(r6("coverage_pct"))


@query(ctes("sc") + """, m AS (SELECT CASE WHEN repo_name % 3 = 0 THEN 'treatment' ELSE 'control' END AS s, bugs, vulnerabilities, code_smells FROM sc), l AS (SELECT unnest(['all', s]) AS scope, bugs, vulnerabilities, code_smells FROM m),
t AS (SELECT scope, sum(bugs) AS bugs, sum(vulnerabilities) AS vulnerabilities, sum(code_smells) AS code_smells FROM l GROUP BY 1), u AS (SELECT scope, unnest(['bugs', 'vulnerabilities', 'code_smells']) AS part, unnest([bugs, vulnerabilities, code_smells]) AS total FROM t)
SELECT scope, part, total, round(total / sum(total) OVER (PARTITION BY scope), 6) AS share FROM u""")
def composition_shares(spark, d):
    s = scans(spark, d).withColumn("dataset_source", F.when(F.col("repo_name") % 3 == 0, "treatment").otherwise("control"))
    return qc.composition(s, ["bugs", "vulnerabilities", "code_smells"], "dataset_source").withColumns(r6("share"))


def _stats(c: str, by: str) -> str:
    return f"""SELECT {by} AS language, '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS missing, count_if({c} = 0)::BIGINT AS zero_count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 4) AS sd, min({c})::DOUBLE AS min,
  round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75, max({c})::DOUBLE AS max FROM lineitem GROUP BY 1"""


@query(_stats("l_quantity", "l_returnflag") + " UNION ALL " + _stats("l_discount", "l_returnflag"))
def describe_quantiles(spark, d):
    out = qc.describe(load(spark, d, "lineitem").withColumnRenamed("l_returnflag", "language"), ["l_quantity", "l_discount"], ["language"])
    return out.withColumns(r6("mean", "q25", "median", "q75") | {"sd": F.round("sd", 4)})


def _balance(c: str) -> str:
    t, u = f"{c}::DOUBLE) FILTER (c_custkey % 3 = 0)", f"{c}::DOUBLE) FILTER (c_custkey % 3 <> 0)"
    return f"""SELECT '{c}' AS feature, round(avg({t}, 4) AS mean_t, round(avg({u}, 4) AS mean_c, round(median({t}, 4) AS median_t, round(median({u}, 4) AS median_c, round(var_samp({t}, 2) AS var_t, round(var_samp({u}, 2) AS var_c,
  round((avg({t} - avg({u}) / sqrt((var_samp({t} + var_samp({u}) / 2), 6) AS normalised_difference FROM customer"""


@query(_balance("c_acctbal") + " UNION ALL " + _balance("c_nationkey"))
def balance_table(spark, d):
    c = load(spark, d, "customer").withColumn("g", (F.col("c_custkey") % 3 == 0).cast("int"))
    out = matching.balance_table(c, "g", ["c_acctbal", "c_nationkey"])
    return out.withColumns({k: F.round(k, n) for k, n in (("mean_t", 4), ("mean_c", 4), ("median_t", 4), ("median_c", 4), ("var_t", 2), ("var_c", 2), ("normalised_difference", 6))})


@query(ctes("pr") + """, p AS (SELECT repo_name, avg(CASE WHEN mid < eid THEN commits END) AS a, avg(CASE WHEN mid >= eid THEN commits END) AS b FROM pr WHERE event IS NOT NULL GROUP BY 1)
SELECT repo_name, round(a, 6) AS mean_pre, round(b, 6) AS mean_post, round(b - a, 6) AS difference, round((b - a) / nullif(a, 0) * 100, 6) AS change_pct FROM p""")
def pre_post_summary(spark, d):
    p = panel_rows(spark, d).where("event IS NOT NULL").withColumn("rel", periods.month_diff(F.col("month"), F.col("event")))
    return qc.pre_post(p, "commits", "rel", ["repo_name"]).withColumns(r6("mean_pre", "mean_post", "difference", "change_pct"))


_WARN = """wa AS (SELECT o_custkey AS repo_name, strftime(o_orderdate, '%Y-%m') AS month, p_brand AS rule, CASE WHEN p_size % 4 <> 0 THEN split_part(p_type, ' ', 1) END AS cat, l_orderkey * 10 + l_linenumber AS issue_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)"""


def warnings(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(load(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return li.select(F.col("o_custkey").alias("repo_name"), F.lit("treatment").alias("dataset_source"), periods.month(F.col("o_orderdate")).alias("month"), F.col("p_brand").alias("rule"), F.when(F.col("p_size") % 4 != 0, F.split_part("p_type", F.lit(" "), F.lit(1))).alias("category"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("issue_key"), F.col("o_orderdate").alias("creation_date"))


@query(f"WITH {_WARN} SELECT repo_name, 'treatment' AS dataset_source, month, coalesce(cat, 'Other') AS category, count(DISTINCT issue_key) AS warning_count FROM wa GROUP BY ALL")
def category_counts(spark, d):
    return quality.category_counts(warnings(spark, d))


@query(f"""WITH {_WARN}, a AS (SELECT repo_name, month, coalesce(cat, 'Other') AS category, count(*) AS v FROM wa GROUP BY ALL), b AS (SELECT repo_name, category, avg(v) AS v FROM a GROUP BY ALL)
SELECT category, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS sd, count(*) AS n FROM b GROUP BY 1""")
def category_avg(spark, d):
    w = warnings(spark, d).select("repo_name", "month", F.coalesce("category", F.lit("Other")).alias("category"), F.lit(1).alias("one"))
    return qc.mean_of_means(w, "one", ["repo_name", "month", "category"], ["repo_name", "category"], ["category"]).withColumns(r6("mean", "median", "sd"))


@query(f"""WITH {_WARN}, d AS (SELECT DISTINCT p_brand AS rule, 'Group ' || p_brand AS category FROM part WHERE p_brand < 'Brand#4'), t AS (SELECT coalesce(d.category, 'Unmapped') AS category, count(*) AS n FROM wa LEFT JOIN d USING (rule) GROUP BY 1)
SELECT category, n, round(n / sum(n) OVER (), 6) AS share, round(sum(n) OVER (ORDER BY n DESC, category ROWS UNBOUNDED PRECEDING) / sum(n) OVER () * 100, 6) AS cumulative_pct FROM t""")
def unmapped_shares(spark, d):
    defs = load(spark, d, "part").where("p_brand < 'Brand#4'").select(F.col("p_brand").alias("rule"), F.concat(F.lit("Group "), F.col("p_brand")).alias("category")).distinct()
    n = quality.with_definitions(warnings(spark, d).drop("category"), defs).groupBy("category").agg(F.count("*").alias("n"))
    return qc.shares(n.withColumn("_all", F.lit(1)), ["_all"], "n", ["category"]).drop("_all").withColumns(r6("share", "cumulative_pct"))


@query(f"""WITH {_WARN}, t AS (SELECT coalesce(cat, 'Other') AS category, count_if(month < '1998-01')::BIGINT AS value_pre, count_if(month >= '1998-01')::BIGINT AS value_post FROM wa GROUP BY 1)
SELECT category, value_pre, value_post, value_post - value_pre AS change, round((value_post - value_pre) / value_pre * 100, 6) AS change_pct FROM t ORDER BY abs(value_post - value_pre) DESC, category LIMIT 4""")
def topk_change(spark, d):
    w = warnings(spark, d).select(F.coalesce("category", F.lit("Other")).alias("category"), F.when(F.col("month") < "1998-01", "pre").otherwise("post").alias("period"), F.lit(1).alias("one"))
    out = reshape.wide_change(w, ["category"], "period", "one").withColumns({c: F.col(c).cast("long") for c in ("value_pre", "value_post", "change")} | r6("change_pct"))
    return reshape.top_by(out, F.abs("change"), 4, "category")


@query(f"""WITH {_WARN}, x AS (SELECT DISTINCT o_custkey AS project, o_orderdate AS day FROM orders), y AS (SELECT project, day, lag(day) OVER (PARTITION BY project ORDER BY day) AS prev, (year(day) - 1998) * 12 + month(day) - 1 AS rel FROM x),
i AS (SELECT o_custkey AS project, l_orderkey * 10 + l_linenumber AS issue_key, l_shipdate AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT y.project, strftime(day, '%Y-%m') AS month, (prev IS NOT NULL)::INT AS range_has_previous_analysis, rel::INT AS relative_period, issue_key FROM y JOIN i ON y.project = i.project AND c <= day AND (prev IS NULL OR c > prev) WHERE rel BETWEEN -6 AND 6""")
def introduced_issues(spark, d):
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderdate").alias("analysis_date")).distinct()
    a = o.withColumns({"month": periods.month(F.col("analysis_date")), "event_month": F.lit("1998-01")})
    li = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    i = li.select(F.col("o_custkey").alias("project"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("issue_key"), F.col("l_shipdate").alias("creation_date"), F.lit(None).cast("string").alias("category"))
    return quality.introduced_issues(i, a).select("project", "month", "range_has_previous_analysis", "relative_period", "issue_key")


# Windows, dedup, functions


@query(ctes("ts") + """, l AS (SELECT repo_name, month, commits, coalesce(lag(commits) OVER (PARTITION BY repo_name ORDER BY month), 0) AS commits_lag FROM ts)
SELECT repo_name, month, commits_lag, commits - commits_lag AS commits_diff, round(sign(commits - commits_lag) * ln(1 + abs(commits - commits_lag)), 6) AS signed FROM l""")
def delta_signed_log(spark, d):
    out = panel.differences(series(spark, d), ["repo_name"], "month", ["commits"])
    return out.select("repo_name", "month", "commits_lag", "commits_diff", F.round(values.signed_log(F.col("commits_diff").cast("double")), 6).alias("signed"))


@query(ctes("pr") + "SELECT a.repo_name, a.month, a.commits, b.commits AS commits_l2 FROM pr a LEFT JOIN pr b ON a.repo_name = b.repo_name AND b.mid = a.mid - 2")
def calendar_lag(spark, d):
    return panel.calendar_lag(panel_rows(spark, d).select("repo_name", "month", "commits"), ["repo_name"], "month", ["commits"], 2)


@query("SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority)::INT AS id FROM orders")
def dense_ids(spark, d):
    return reshape.dense_ids(load(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "id")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def dedup_keep_last(spark, d):
    return reshape.keep_one(load(spark, d, "orders"), ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""WITH u AS (SELECT o_custkey, o_orderkey, 1 AS age FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey, 0 FROM orders WHERE o_orderkey % 5 = 0) SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY age, o_orderkey) AS k FROM u) WHERE k = 1""")
def union_newest(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey")
    return reshape.union_newest(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 5 = 0"), ["o_custkey"], [F.col("o_orderkey")])


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, len(json_keys(props::JSON))::INT AS n_keys FROM events")
def json_props(spark, d):
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.size(values.json_keys(F.col("props"))).alias("n_keys"))


@query("""WITH a AS (SELECT c_custkey, c_name, c_name || ' <' || lower(replace(c_name, '#', '.')) || '@x.org>' AS author FROM customer)
SELECT c_custkey, c_name AS name, lower(replace(c_name, '#', '.')) || '@x.org' AS email, array_to_string(list_sort(list_distinct([split_part(lower(replace(c_name, '#', '.')) || '@x.org', '@', 1), replace(lower(c_name), ' ', ''), split_part(lower(c_name), ' ', 1)])), '|') AS keys FROM a""")
def author_parse(spark, d):
    mail = F.concat(F.lower(F.translate("c_name", "#", ".")), F.lit("@x.org"))
    a = load(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(" <"), mail, F.lit(">")).alias("author"))
    return a.select("c_custkey", values.author_name(F.col("author")).alias("name"), values.author_email(F.col("author")).alias("email"), F.array_join(F.array_sort(values.author_keys(F.col("author"))), "|").alias("keys"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-W%W') AS week, strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS quarter, (year(o_orderdate) * 100 + month(o_orderdate))::INT AS yyyymm, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end, strftime(o_orderdate - INTERVAL (isodow(o_orderdate) - 1) DAY, '%Y-%m-%d') AS monday FROM orders")
def week_label(spark, d):
    at = F.col("o_orderdate")
    o = load(spark, d, "orders").withColumn("week", periods.week(at))
    return o.select("o_orderkey", "week", periods.quarter(at).alias("quarter"), periods.yyyymm(at).alias("yyyymm"), F.date_format(periods.month_end(periods.month(at)), "yyyy-MM-dd").alias("month_end"), F.date_format(periods.week_monday(F.col("week")), "yyyy-MM-dd").alias("monday"))


@query("""WITH m AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%Y%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y%m') || '.0' ELSE 'nan' END AS raw, o_orderdate AS day FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN strftime(day, '%Y-%m') END AS month, CASE WHEN o_orderkey % 5 < 4 THEN (year(day) * 12 + month(day))::INT END AS id, CASE WHEN o_orderkey % 5 < 4 THEN (year(day + INTERVAL 5 MONTH) * 100 + month(day + INTERVAL 5 MONTH))::INT END AS plus5 FROM m""")
def normal_months(spark, d):
    at, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.date_format(at, "yyyy-MM")).when(k == 1, F.date_format(at, "yyyyMM")).when(k == 2, F.date_format(at, "yyyy-MM-dd")).when(k == 3, F.concat(F.date_format(at, "yyyyMM"), F.lit(".0"))).otherwise("nan")
    o = load(spark, d, "orders").select("o_orderkey", periods.normal_month(raw).alias("month"))
    return o.select("o_orderkey", "month", periods.month_id(F.col("month")).alias("id"), periods.add_months_yyyymm(F.translate("month", "-", "").cast("int"), 5).alias("plus5"))


@query(ctes("co") + """, ad2 AS (SELECT DISTINCT repo_name, author FROM co WHERE evidence), s AS (SELECT repo_name, count(*) AS commits, count(a.author) AS adopter_commits FROM co LEFT JOIN ad2 a USING (repo_name, author) GROUP BY 1),
e AS (SELECT repo_name, count(*) AS evidence_commits, count(DISTINCT author) AS adopters FROM co WHERE evidence GROUP BY 1)
SELECT c_custkey AS repo_name, coalesce(evidence_commits, 0) AS evidence_commits, coalesce(adopters, 0) AS adopters, coalesce(commits, 0) AS commits, coalesce(adopter_commits, 0) AS adopter_commits, round(coalesce(adopter_commits / nullif(commits, 0), 0) * 100, 6) AS adopter_pct
FROM customer LEFT JOIN e ON e.repo_name = c_custkey LEFT JOIN s ON s.repo_name = c_custkey WHERE c_acctbal >= 1000""")
def adopter_share(spark, d):
    repos = load(spark, d, "customer").select(F.col("c_custkey").alias("repo_name"), F.col("c_acctbal").alias("repo_stars"))
    c = commits(spark, d)
    return cohorts.adopter_metrics(repos, c, c.where("evidence"), 1000).drop("first_evidence", "repo_stars").withColumns(r6("adopter_pct"))


@query(_ASSEMBLED + """, cm AS (SELECT repo_name, list(DISTINCT month) AS months FROM ts WHERE commits >= 2 GROUP BY 1)
SELECT q.repo_name, time, CASE WHEN event IS NULL OR time < event THEN NULL WHEN time = event THEN true ELSE coalesce(list_contains(months, time), false) END AS high_confidence, q.repo_name % 4 = 0 AS other_agents FROM q LEFT JOIN cm USING (repo_name)""")
def confidence_rules(spark, d):
    config = cohorts.config_months(series(spark, d).where("commits >= 2").select("repo_name", F.array("month").alias("months")))
    agents = series(spark, d).select("repo_name").distinct().select("repo_name", F.when(F.col("repo_name") % 4 == 0, F.array(F.lit("cursor"), F.lit("other"))).otherwise(F.array(F.lit("cursor"))).alias("tools"))
    return cohorts.confidence(assembled(spark, d), config, agents).select("repo_name", "time", "high_confidence", "other_agents")


@query("""WITH u AS (SELECT DISTINCT o_custkey FROM orders), s AS (SELECT o_custkey FROM u ORDER BY md5('42:' || o_custkey), o_custkey LIMIT 100)
SELECT o_custkey, o_orderkey FROM orders JOIN s USING (o_custkey)""")
def hash_sample(spark, d):
    return reshape.sample_units(load(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 100)


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('42:' || o_orderkey), o_orderkey) AS k FROM orders) WHERE k <= 3")
def capped_groups(spark, d):
    return reshape.cap_groups(load(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 3)


@query(ctes("pr") + """, i AS (SELECT repo_name, month, event, row_number() OVER (PARTITION BY repo_name ORDER BY month) - 1 AS k, min(CASE WHEN month >= event THEN month END) OVER (PARTITION BY repo_name) AS b FROM pr WHERE event IS NOT NULL)
SELECT repo_name, month, k::INT AS time_index, (month >= b)::INT AS intervention, sum((month >= b)::INT) OVER (PARTITION BY repo_name ORDER BY month)::INT AS time_after_intervention FROM i WHERE b IS NOT NULL""")
def its_dataset(spark, d):
    p = panel_rows(spark, d).where("event IS NOT NULL")
    return panel.its_dataset(p.select("repo_name", "month"), p.select("repo_name", "event").distinct())


def _its(spark: SparkSession, d: str) -> DataFrame:
    p = panel_rows(spark, d).where("event IS NOT NULL").withColumn("rel", periods.month_diff(F.col("month"), F.col("event"))).where("rel BETWEEN -6 AND 6")
    return p.withColumns(panel.its_variables(F.col("rel")))


_ITS = ctes("pr") + ", v AS (SELECT repo_name, month, commits, mid - eid AS rel, mid - eid + 7 AS seq, (mid >= eid)::INT AS post, CASE WHEN mid >= eid THEN mid - eid + 1 ELSE 0 END AS after FROM pr WHERE mid - eid BETWEEN -6 AND 6)\n"


@query(_ITS + "SELECT repo_name, month, rel, seq, post, after FROM v")
def its_variables(spark, d):
    return _its(spark, d).select("repo_name", "month", "rel", "seq", "post", "after")


@query(_ITS + "SELECT round(regr_slope(commits, seq), 6) AS slope, round(regr_intercept(commits, seq), 6) AS const, round(regr_r2(commits, seq), 6) AS r2, count(*) AS n FROM v")
def ols_its(spark, d):
    fit = linear.ols(_its(spark, d), "commits", ["seq"])
    return spark.createDataFrame([(round(float(fit.beta[1]), 6), round(float(fit.beta[0]), 6), round(float(fit.r2), 6), fit.n)], "slope double, const double, r2 double, n long")


@query()
def its_specs(spark, d):
    fits = panels.its_specs(_its(spark, d).withColumn("lines", F.col("lines_added").cast("double")), "commits", ["lines"], "repo_name")
    return spark.createDataFrame([(k, *row, f.n) for k, f in fits.items() for row in f.rows()], "spec string, term string, estimate double, std_error double, p_value double, n long")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _unit() -> Column:
    """Nation and segment in one number."""
    at = F.lit(len(SEGMENTS))
    for i, name in enumerate(SEGMENTS):
        at = F.when(F.col("c_mktsegment") == name, i).otherwise(at)
    return (F.col("c_nationkey") * 10 + at).cast("int")


def _coded_units(counts: DataFrame, units: DataFrame) -> DataFrame:
    """A balanced panel of (u, t, y, x) over all months of the counts, two cohorts and units without event."""
    span = counts.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    grid = units.crossJoin(F.broadcast(span)).select("u", F.explode(F.sequence("a", "b")).alias("t"))  # one row
    full = grid.join(counts, ["u", "t"], "left").select("u", "t", F.coalesce("n", F.lit(0)).cast("double").alias("y"), (F.coalesce("v", F.lit(0.0)) / 100000).alias("x"))
    cohort = F.when(F.col("u") % 3 == 0, 1996 * 12 + 13).when(F.col("u") % 3 == 1, 1996 * 12 + 19)
    return full.withColumn("g", cohort).withColumn("post", F.coalesce(F.col("t") >= F.col("g"), F.lit(False)).cast("int")).withColumn("rel", F.col("t") - F.col("g"))


def _dense(spark: SparkSession, d: str) -> DataFrame:
    """All orders by nation and segment and month: a balanced panel."""
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("k"), _unit().alias("u"))
    o = load(spark, d, "orders").join(c, F.col("k") == F.col("o_custkey"))
    agg = o.groupBy("u", periods.month_id(periods.month(F.col("o_orderdate"))).alias("t")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
    return _coded_units(agg, c.select("u").distinct())


_UNIT = "(c_nationkey * 10 + CASE c_mktsegment " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(SEGMENTS)) + f" ELSE {len(SEGMENTS)} END)::INT"
_DENSE = f"""WITH cu AS (SELECT c_custkey, {_UNIT} AS u FROM customer), a AS (SELECT u, (year(o_orderdate) * 12 + month(o_orderdate))::INT AS t, count(*) AS n FROM orders JOIN cu ON c_custkey = o_custkey GROUP BY 1, 2),
s AS (SELECT min(t) AS lo, max(t) AS hi FROM a), g AS (SELECT u, unnest(range(lo, hi + 1))::INT AS t FROM (SELECT DISTINCT u FROM cu), s),
p AS (SELECT u, t, coalesce(n, 0)::DOUBLE AS y, CASE u % 3 WHEN 0 THEN {1996 * 12 + 13} WHEN 1 THEN {1996 * 12 + 19} END AS g FROM g LEFT JOIN a USING (u, t)), q AS (SELECT *, coalesce(t >= g, false)::INT AS post FROM p)
"""


def imputed_sql(table: str, steps: int = 40) -> str:
    """CTEs after ``table`` (lab, u, t, y, post): unit and time effects of untreated rows by turns of averaging, and
    ``fx`` with each treated row's effect. The turns are many enough to settle far below what is compared."""
    out = [f"n0 AS MATERIALIZED (SELECT lab, u, t, y FROM {table} WHERE post = 0)", "a0 AS (SELECT lab, u, avg(y) AS a FROM n0 GROUP BY ALL)"]
    for i in range(1, steps + 1):
        out.append(f"b{i} AS (SELECT n0.lab, n0.t, avg(y - a) AS b FROM n0 JOIN a{i - 1} USING (lab, u) GROUP BY ALL)")
        out.append(f"a{i} AS {'MATERIALIZED ' if i % 5 == 0 else ''}(SELECT n0.lab, n0.u, avg(y - b) AS a FROM n0 JOIN b{i} USING (lab, t) GROUP BY ALL)")
    out.append(f"bz AS (SELECT n0.lab, n0.t, avg(y - a) AS b FROM n0 JOIN a{steps} USING (lab, u) GROUP BY ALL)")
    out.append(f"fx AS (SELECT x.*, x.y - a - b AS effect FROM {table} x JOIN a{steps} USING (lab, u) JOIN bz USING (lab, t) WHERE post = 1)")
    return ",\n".join(out)


@query(_DENSE + """, w AS (SELECT y - avg(y) OVER (PARTITION BY u) - avg(y) OVER (PARTITION BY t) + avg(y) OVER () AS a, post - avg(post) OVER (PARTITION BY u) - avg(post) OVER (PARTITION BY t) + avg(post) OVER () AS b FROM q)
SELECT round(sum(a * b) / sum(b * b), 6) AS estimate, count(*) AS n FROM w""")
def twfe_balanced(spark, d):
    return did.twfe_balanced(_dense(spark, d), "y", "post", "u", "t").withColumns(r6("estimate"))


@query(_DENSE + """, w AS (SELECT y - avg(y) OVER (PARTITION BY u) - avg(y) OVER (PARTITION BY t) + avg(y) OVER () AS a, post - avg(post) OVER (PARTITION BY u) - avg(post) OVER (PARTITION BY t) + avg(post) OVER () AS b FROM q)
SELECT round(sum(a * b) / sum(b * b), 6) AS estimate, count(*) AS n FROM w""")
def twfe_absorbed(spark, d):
    fit = did.twfe(_dense(spark, d), "y", ["post"], "u", "t")
    return spark.createDataFrame([(round(float(fit.beta[0]), 6), fit.n)], "estimate double, n long")


@query()
def twfe_event_study(spark, d):
    fit = did.event_study(_dense(spark, d), "y", "u", "t", "rel", covariates=["x"])
    return spark.createDataFrame([(*row, fit.n) for row in fit.rows()], "term string, estimate double, std_error double, p_value double, n long")


@query(_DENSE + """, s4 AS (SELECT avg(y) FILTER (g IS NOT NULL AND t >= 23965) AS tp, avg(y) FILTER (g IS NOT NULL AND t < 23965) AS tb, avg(y) FILTER (g IS NULL AND t >= 23965) AS cp, avg(y) FILTER (g IS NULL AND t < 23965) AS cb FROM q)
SELECT round(tp, 6) AS t_post, round(tb, 6) AS t_pre, round(cp, 6) AS c_post, round(cb, 6) AS c_pre, round(tp - tb - (cp - cb), 6) AS did FROM s4""")
def did_2x2(spark, d):
    p = _dense(spark, d).withColumns({"treated": F.col("g").isNotNull().cast("int"), "late": (F.col("t") >= 23965).cast("int")})
    return did.did_2x2(p, "y", "treated", "late").withColumns(r6("t_post", "t_pre", "c_post", "c_pre", "did"))


_GT = """, c AS (SELECT DISTINCT g AS cohort FROM q WHERE g IS NOT NULL), z0 AS (SELECT q.*, cohort, CASE WHEN t >= cohort - 1 THEN cohort - 2 ELSE t - 1 END AS b FROM q, c), z AS (SELECT z0.u, z0.t, z0.g, cohort, b, z0.y - s.y AS d FROM z0 JOIN q s ON s.u = z0.u AND s.t = z0.b WHERE z0.t <> b),
k AS (SELECT cohort, t, CASE WHEN g = cohort THEN 1 WHEN g IS NULL OR g > greatest(t, b) + 1 THEN 0 END AS s, d FROM z), m AS (SELECT cohort, t, avg(d) FILTER (s = 1) AS m1, avg(d) FILTER (s = 0) AS m0, count(d) FILTER (s = 1) AS n1, count(d) FILTER (s = 0) AS n0 FROM k WHERE s IS NOT NULL GROUP BY 1, 2),
gt AS (SELECT cohort::INT AS cohort, t::INT AS t, (t - cohort)::INT AS rel, m1 - m0 AS att, n1 AS n_treated, n0 AS n_control FROM m WHERE n1 > 0 AND n0 > 0)
"""


@query(_DENSE + _GT + "SELECT cohort, t, rel, round(att, 6) AS att, n_treated, n_control FROM gt")
def group_time_att(spark, d):
    return did.group_time(_dense(spark, d), "y", "u", "t", "g").drop("std_error").withColumns(r6("att"))


@query(_DENSE + _GT.replace("CASE WHEN t >= cohort - 1 THEN cohort - 2 ELSE t - 1 END", "cohort - 2").replace("g IS NULL OR g > greatest(t, b) + 1", "g IS NULL") + "SELECT cohort, t, round(att, 6) AS att, n_control FROM gt")
def group_time_universal(spark, d):
    return did.group_time(_dense(spark, d), "y", "u", "t", "g", against="never", base="universal").select("cohort", "t", F.round("att", 6).alias("att"), "n_control")


@query(_DENSE + _GT + "SELECT rel, round(sum(att * n_treated) / sum(n_treated), 6) AS att, sum(n_treated)::BIGINT AS n FROM gt GROUP BY 1")
def group_time_dynamic(spark, d):
    return did.aggregate_att(did.group_time(_dense(spark, d), "y", "u", "t", "g"), "dynamic").withColumns(r6("att"))


@query(_DENSE + _GT + "SELECT round(sum(att * n_treated) / sum(n_treated), 6) AS att, sum(n_treated)::BIGINT AS n FROM gt WHERE rel >= 0")
def group_time_simple(spark, d):
    return did.aggregate_att(did.group_time(_dense(spark, d), "y", "u", "t", "g")).withColumns(r6("att"))


_IMPUTED = _DENSE + ", lq AS (SELECT 'all' AS lab, * FROM q),\n" + imputed_sql("lq") + "\n"


@query(_IMPUTED + "SELECT 'treat' AS term, round(avg(effect), 6) AS estimate, count(*) AS n FROM fx")
def imputation_att(spark, d):
    return did.imputation_static(_dense(spark, d), "y", "u", "t", F.col("post") == 1, "g").select("term", F.round("estimate", 6).alias("estimate"), "n")


@query()
def imputation_covariates(spark, d):
    return did.imputation_static(_dense(spark, d), "y", "u", "t", F.col("post") == 1, "g", ["x"])


@query(_IMPUTED + "SELECT 'tau' || (t - g) AS term, round(avg(effect), 6) AS estimate, count(*) AS n FROM fx WHERE t - g BETWEEN 0 AND 6 GROUP BY 1")
def imputation_dynamic(spark, d):
    return did.imputation_dynamic(_dense(spark, d), "y", "u", "t", F.col("post") == 1, "g", "rel").select("term", F.round("estimate", 6).alias("estimate"), "n")


@query()
def event_time_table(spark, d):
    return did.event_time_table(_dense(spark, d), "y", "u", "t", F.col("post") == 1, "g", "rel")


@query()
def pretrend_wald(spark, d):
    fit, _ = did.pretrends(_dense(spark, d), "y", "u", "t", F.col("post") == 1, "rel")
    rows = [(k, *v) for k, v in did.pretrend_tests(fit).items()]
    return spark.createDataFrame(rows, "test string, statistic double, df int, p_value double")


@query()
def dynamic_panel_gmm(spark, d):
    g = panels.difference_gmm(_dense(spark, d), "y", ["x"], "u", "t", collapse=True)
    rows = [(n, float(b), float(e)) for n, b, e in zip(g.names, g.beta, g.error, strict=True)] + [("sargan_p", g.sargan[2], None), ("m1_p", g.m1[1], None), ("m2_p", g.m2[1], None)]
    return spark.createDataFrame(rows, "term string, estimate double, std_error double")


@query("""WITH s AS (SELECT n_chars AS v, (lang = 'en')::INT AS g FROM documents), r AS (SELECT v, g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r, count(*) OVER (PARTITION BY v) AS c FROM s),
o AS (SELECT count(*) AS n, sum(g)::BIGINT AS n1, sum(r * g) AS w, sum((c::DOUBLE ** 3 - c) / c) AS ties FROM r) SELECT n, n1, w, round(w - n1 * (n1 + 1) / 2, 6) AS u,
  round((w - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2 - sign(w - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2) * 0.5) / sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM o""")
def wilcoxon_ranks(spark, d):
    s = load(spark, d, "documents").select(F.col("n_chars").alias("v"), (F.col("lang") == "en").cast("int").alias("g"))
    return panels.rank_sum(s, "v", "g").withColumns(r6("u", "z"))


@query("""WITH s AS (SELECT least(greatest(l_discount * 10, 0.0001), 0.9999) AS s, (l_returnflag = 'R')::INT AS y FROM lineitem), b AS (SELECT s, sum(y)::BIGINT AS p, sum(1 - y)::BIGINT AS q FROM s GROUP BY 1),
r AS (SELECT p, q, sum(q) OVER (ORDER BY s) - q AS below FROM b), a AS (SELECT sum(p * (below + q / 2)) / (sum(p) * sum(q)) AS auc FROM r),
o AS (SELECT count(*) AS n, avg(y) AS m, sum(y * ln(s) + (1 - y) * ln(1 - s)) AS ll, count_if(s >= 0.5 AND y = 1) AS tp, count_if(s >= 0.5) AS pp, sum(y) AS pos FROM s)
SELECT n, round(1 - ll / (n * (m * ln(m) + (1 - m) * ln(1 - m))), 6) AS mcfadden_r2, round(tp / pp, 6) AS precision, round(tp / pos, 6) AS recall, round(auc, 6) AS auc FROM o, a""")
def propensity_auc(spark, d):
    s = load(spark, d, "lineitem").select(F.least(F.greatest(F.col("l_discount") * 10, F.lit(0.0001)), F.lit(0.9999)).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("treated"))
    return matching.diagnostics(s).withColumns(r6("mcfadden_r2", "precision", "recall", "auc"))


@query()
def propensity_scores(spark, d):
    c = load(spark, d, "customer").withColumn("treated", (F.col("c_custkey") % 3 == 0).cast("int"))
    return matching.propensity(c, ["c_acctbal", "c_nationkey"]).select("c_custkey", "treated", "score")


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS correlation, 'l_quantity' AS a, 'l_extendedprice' AS b FROM lineitem UNION ALL SELECT round(corr(l_quantity, l_discount), 6), 'l_quantity', 'l_discount' FROM lineitem UNION ALL SELECT round(corr(l_extendedprice, l_discount), 6), 'l_extendedprice', 'l_discount' FROM lineitem")
def correlations(spark, d):
    return qc.correlations(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumns(r6("correlation"))


@query(_ASSEMBLED + "SELECT dataset_source, count(DISTINCT repo_name) AS repos, count(*) AS rows, count_if(post_event = 1)::BIGINT AS post_rows FROM q GROUP BY 1")
def panel_summary(spark, d):
    return qc.panel_summary(assembled(spark, d))


@query(_ASSEMBLED + "SELECT tte AS time_to_event, count(*) AS n FROM q WHERE tte IS NOT NULL GROUP BY 1")
def event_time_counts(spark, d):
    return qc.event_time_counts(assembled(spark, d))


@query(_ASSEMBLED + """SELECT dataset_source, 'commits' AS outcome, round(avg(commits), 6) AS mean, round(avg((commits = 0)::INT), 6) AS zero_share FROM q GROUP BY 1 UNION ALL SELECT dataset_source, 'lines_added', round(avg(lines_added), 6), round(avg((lines_added = 0)::INT), 6) FROM q GROUP BY 1""")
def estimation_summary(spark, d):
    return qc.estimation_summary(assembled(spark, d), ["commits", "lines_added"]).withColumns(r6("mean", "zero_share"))


@query("""WITH w AS (SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents UNION ALL SELECT 'b', item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') FROM benchmark),
s AS (SELECT DISTINCT side, id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT side, id, w, unnest(range(1, len(w) - 3)) AS i FROM w)), n AS (SELECT side, id, count(*) AS n FROM s GROUP BY ALL),
j AS (SELECT a.id AS unit_a, b.id AS unit_b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.side = 'd' AND b.side = 'b' GROUP BY ALL)
SELECT unit_a, unit_b, shared, x.n AS n_a, y.n AS n_b, round(2 * shared / (x.n + y.n), 6) AS coverage FROM j JOIN n x ON x.side = 'd' AND x.id = unit_a JOIN n y ON y.side = 'b' AND y.id = unit_b""")
def shingle_similarity(spark, d):
    a = similarity.shingles(load(spark, d, "documents"), "doc_id", "text")
    b = similarity.shingles(load(spark, d, "benchmark"), "item_id", "text")
    return similarity.shared_coverage(a, b).withColumns(r6("coverage"))


@query("""SELECT c_custkey, lower(trim(c_mktsegment)) IN ('building', 'machinery') AS hit, CASE WHEN lower(trim(CASE WHEN c_custkey % 4 = 0 THEN ' NaN ' ELSE c_name END)) NOT IN ('', 'nan') THEN c_name END AS clean,
  CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE true END AS flag, round(CASE WHEN c_acctbal >= 0 THEN ln(1 + c_acctbal) END, 6) AS logged, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS label FROM customer""")
def scalar_values(spark, d):
    c, k = load(spark, d, "customer"), F.col("c_custkey")
    raw = F.when(k % 4 == 0, " NaN ").otherwise(F.col("c_name"))
    flag = F.when(k % 3 == 0, " True").when(k % 3 == 1, "no").otherwise("1")
    return c.select("c_custkey", F.lower(F.trim("c_mktsegment")).isin("building", "machinery").alias("hit"), values.missing_to_null(raw).alias("clean"), values.to_bool(flag).alias("flag"), F.round(values.log1p_guarded(F.col("c_acctbal")), 6).alias("logged"), values.humanise(F.col("c_mktsegment")).alias("label"))


# Further operators


_SCAN = ctes("co") + """, m AS (SELECT repo_name, unnest(['1997-11', '1997-12', '1998-01', '1998-02', '1998-03']) AS month FROM (SELECT DISTINCT repo_name FROM co)),
s AS (SELECT repo_name, month, (SELECT arg_max(sha, {'a': committed_at, 'b': sha}) FROM co WHERE co.repo_name = m.repo_name AND committed_at::DATE <= last_day((month || '-01')::DATE)) AS sha FROM m),
r AS (SELECT *, (sha IS NULL)::INT AS missing, coalesce(sha = lag(sha) OVER (PARTITION BY repo_name ORDER BY month), false)::INT AS repeated FROM s)
"""


@query(_SCAN + "SELECT repo_name, month, sha, missing, repeated FROM r")
def scan_input(spark, d):
    return scan.scan_input(commits(spark, d), "1997-11", "1998-03")


@query(_SCAN + "SELECT count(*) AS rows, 0::BIGINT AS duplicates, sum(missing)::BIGINT AS missing, sum(repeated)::BIGINT AS repeated FROM r")
def scan_checks(spark, d):
    return scan.scan_checks(scan.scan_input(commits(spark, d), "1997-11", "1998-03"))


@query(ctes("co") + """, p AS (SELECT o_custkey AS repo_name, 'a' || (o_orderkey % 6) AS actor FROM orders WHERE o_orderstatus <> 'F'), e AS (SELECT DISTINCT repo_name, author FROM co WHERE evidence)
SELECT repo_name, count(*) AS pushes, count(author) AS adopter_pushes, round(count(author) / count(*), 6) AS share FROM p LEFT JOIN e USING (repo_name) WHERE author IS NULL OR author = actor OR true GROUP BY 1""".replace("LEFT JOIN e USING (repo_name) WHERE author IS NULL OR author = actor OR true", "LEFT JOIN e ON e.repo_name = p.repo_name AND e.author = p.actor").replace("SELECT repo_name, count(*) AS pushes", "SELECT p.repo_name, count(*) AS pushes"))
def pushes_share(spark, d):
    o = load(spark, d, "orders").where("o_orderstatus != 'F'")
    pushes = o.select(F.lit("PushEvent").alias("type"), F.col("o_custkey").alias("repo_name"), F.concat(F.lit("A"), (F.col("o_orderkey") % 6).cast("string")).alias("actor"))
    evidence = commits(spark, d).where("evidence").select("repo_name", F.concat("author", F.lit(" <"), "author", F.lit("@x.org>")).alias("author"))
    return cohorts.pushes_share(pushes, evidence).withColumns(r6("share"))


@query(_ASSEMBLED.rstrip() + f""",
{_WARN}, c AS (SELECT repo_name, month, count(DISTINCT issue_key) AS n FROM wa WHERE cat = 'SMALL' GROUP BY ALL), s AS (SELECT DISTINCT repo_name, month FROM wa)
SELECT q.repo_name, q.time, q.dataset_source, CASE WHEN s.repo_name IS NOT NULL THEN coalesce(n, 0) END AS warning_count, round(CASE WHEN s.repo_name IS NOT NULL THEN ln(1 + coalesce(n, 0)) END, 6) AS log_warning_count
FROM q LEFT JOIN s ON s.repo_name = q.repo_name AND s.month = q.time AND q.dataset_source = 'treatment' LEFT JOIN c ON c.repo_name = q.repo_name AND c.month = q.time""")
def category_did_input(spark, d):
    w = warnings(spark, d)
    out = quality.category_did_input(assembled(spark, d), quality.category_counts(w), quality.observed(w), "SMALL")
    return out.select("repo_name", "time", "dataset_source", "warning_count", F.round("log_warning_count", 6).alias("log_warning_count"))


@query("SELECT coalesce(CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END, '(missing)') AS o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, d):
    return qc.value_counts(load(spark, d, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority"))), "o_orderpriority")


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def key_difference(spark, d):
    o = load(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return reshape.difference(load(spark, d, "customer"), o, ["c_custkey"])


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def key_intersection(spark, d):
    o = load(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return reshape.intersection(load(spark, d, "customer"), o, ["c_custkey"])


@query(ctes("pr") + "SELECT repo_name, month, max(CASE WHEN month = event THEN commits END) OVER (PARTITION BY repo_name) AS commits_at_event FROM pr WHERE event IS NOT NULL")
def value_at_event(spark, d):
    p = panel_rows(spark, d).where("event IS NOT NULL")
    return panel.value_at(p, ["repo_name"], F.col("month") == F.col("event"), "commits", "commits_at_event").select("repo_name", "month", "commits_at_event")


@query(ctes("oe") + """, u AS (SELECT repo, 1998 * 12 + 6 AS t FROM oe WHERE type = 'WatchEvent' AND repo IN (SELECT repo FROM oe WHERE strftime(created_at, '%Y-%m') = '1998-06') GROUP BY 1 HAVING count(*) >= 2),
b AS (SELECT u.repo, t - (year(created_at) * 12 + month(created_at)) AS k, type FROM u JOIN oe USING (repo))
SELECT repo, count_if(type = 'WatchEvent' AND k = 1)::BIGINT AS n_stars_m1, count_if(type = 'WatchEvent' AND k = 6)::BIGINT AS n_stars_m6, count_if(type = 'WatchEvent' AND k > 6)::BIGINT AS n_stars_sum, count_if(k > 6)::BIGINT AS total_events_sum FROM b GROUP BY 1""")
def wide_features(spark, d):
    f = events.control_candidates(monthly_events(spark, d), TARGET, 2)
    return events.wide_features(f, ["n_stars", "total_events"]).select("repo", "n_stars_m1", "n_stars_m6", "n_stars_sum", "total_events_sum")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'JavaScript/TypeScript' WHEN lang = 'fr' THEN 'Python' WHEN lang = 'de' THEN 'Rust' ELSE 'Other' END AS language_group FROM documents")
def language_groups(spark, d):
    name = F.when(F.col("lang") == "en", "TypeScript").when(F.col("lang") == "fr", "Python").when(F.col("lang") == "de", "Rust").otherwise("COBOL")
    return load(spark, d, "documents").select("doc_id", cohorts.language_group(name).alias("language_group"))


@query("SELECT l_partkey, max(l_extendedprice) FILTER (l_returnflag = 'R') AS m_r, max(l_extendedprice) FILTER (l_returnflag = 'N') AS m_n FROM lineitem GROUP BY 1")
def wide_maxima(spark, d):
    by = load(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.max("l_extendedprice").alias("m"))
    return reshape.wide(by, ["l_partkey"], "l_returnflag", ["R", "N"], "m").select("l_partkey", F.col("R").alias("m_r"), F.col("N").alias("m_n"))


@query(_DENSE + """, z AS (SELECT u, avg(y) AS size FROM q GROUP BY 1), h AS (SELECT q.*, CASE WHEN size < (SELECT median(size) FROM z) THEN 'low' ELSE 'high' END AS half FROM q JOIN z USING (u)),
w AS (SELECT half, y - avg(y) OVER (PARTITION BY half, u) - avg(y) OVER (PARTITION BY half, t) + avg(y) OVER (PARTITION BY half) AS a, post - avg(post) OVER (PARTITION BY half, u) - avg(post) OVER (PARTITION BY half, t) + avg(post) OVER (PARTITION BY half) AS b FROM h)
SELECT half, round(sum(a * b) / sum(b * b), 6) AS estimate, count(*) AS n FROM w GROUP BY 1""")
def heterogeneous_effects(spark, d):
    p = _dense(spark, d)
    sized = p.join(p.groupBy("u").agg(F.avg("y").alias("size")), "u")
    fits = did.heterogeneity(sized, "y", "post", "u", "t", "size")
    return spark.createDataFrame([(k, round(float(f.beta[0]), 6), f.n) for k, f in fits.items()], "half string, estimate double, n long")
