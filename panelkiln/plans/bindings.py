"""The domain's tables on top of the driver's: activity logs, commits, monthly series, scans, pairs.

Each has a DataFrame form and, for the oracles, the same as SQL common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.functions.periods import month
from panelkiln.operators.panel import first_adoption

#: Months of the panels.
START, END = "1996-01", "1998-12"
TARGET = "1998-06"


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _case(column: str, names: dict[str, str]):
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


EVENT_TYPES = {"view": "WatchEvent", "click": "ForkEvent", "signup": "PullRequestEvent", "purchase": "ReleaseEvent", "error": "IssuesEvent"}
ORDER_TYPES = {"1-URGENT": "WatchEvent", "2-HIGH": "ForkEvent", "3-MEDIUM": "PullRequestEvent", "4-NOT SPECIFIED": "IssuesEvent", "5-LOW": "IssueCommentEvent"}


def daily_events(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return e.select(_case("event_type", EVENT_TYPES).alias("type"), F.col("ts").alias("created_at"), F.col("user_id").alias("repo"), (F.col("event_id") % 37).alias("actor"))


def monthly_events(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return o.select(_case("o_orderpriority", ORDER_TYPES).alias("type"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("repo"), (F.col("o_orderkey") % 7).alias("actor"))


def commits(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("added"), F.sum("l_linenumber").alias("removed"))
    o = load(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(F.col("o_custkey").alias("repo_name"), F.col("o_orderkey").alias("sha"), F.concat(F.lit("a"), (F.col("o_orderkey") % 5).cast("string")).alias("author"), F.col("o_orderdate").alias("committed_at"), "added", "removed", (F.col("o_orderpriority") == "1-URGENT").alias("evidence"))


def series(spark: SparkSession, d: str) -> DataFrame:
    """Monthly series with the tool's flag."""
    return commits(spark, d).groupBy("repo_name", month(F.col("committed_at")).alias("month")).agg(
        F.max_by("sha", F.struct("committed_at", "sha")).alias("latest_commit"), F.count("*").alias("commits"), F.sum("added").alias("lines_added"), F.sum("removed").alias("lines_removed"), F.count_distinct("author").alias("contributors"), F.bool_or("evidence").alias("cursor")
    )


def adoption(spark: SparkSession, d: str) -> DataFrame:
    """(repo_name, event): every third unit adopts; others have NULL."""
    return first_adoption(series(spark, d)).select("repo_name", F.when(F.col("repo_name") % 3 == 0, F.col("event")).alias("event"))


def panel_rows(spark: SparkSession, d: str) -> DataFrame:
    """The series in the window with each unit's event."""
    return series(spark, d).join(adoption(spark, d), "repo_name").where(F.col("month").between(START, END))


def scans(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    flag = lambda f: F.count_if(F.col("l_returnflag") == f).cast("double")
    base = li.groupBy(F.col("o_custkey").alias("repo_name"), month(F.col("o_orderdate")).alias("month")).agg(
        F.max("o_orderkey").cast("string").alias("latest_commit"), flag("R").alias("bugs"), flag("A").alias("vulnerabilities"), flag("N").alias("code_smells"), F.sum("l_linenumber").cast("double").alias("technical_debt"),
        F.sum("l_quantity").alias("_q"), F.count("*").alias("_n"),
    )
    some = F.col("_q") % 7 != 0
    sizes = {"ncloc": F.when(some, F.col("_q") * 10), "duplicated_lines_density": F.when(some, F.col("_q") % 13), "comment_lines_density": F.when(some, F.col("_q") % 11), "cognitive_complexity": F.when(some, F.col("_n") * 3.0)}
    return base.withColumns(sizes).drop("_q", "_n")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each treated unit (a multiple of 3) with up to three controls."""
    c = load(spark, d, "customer").where(F.col("c_custkey") % 3 == 0).select(F.col("c_custkey").alias("treatment_repo"), F.col("c_acctbal").alias("s"))
    n = load(spark, d, "customer").agg(F.max("c_custkey").alias("n"))
    rank = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("match_rank")
    out = c.crossJoin(F.broadcast(n)).select("treatment_repo", rank, "n")  # one row
    control = (F.col("treatment_repo") * 7 + F.col("match_rank") * 5) % (F.col("n") + 1)
    return out.select("treatment_repo", "match_rank", control.cast("long").alias("control_repo"), (F.lit(199800) + F.col("match_rank")).alias("matched_period")).where("control_repo > 0 AND control_repo != treatment_repo")


def _sql_case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


SQL = {
    "ev": f"ev AS (SELECT {_sql_case('event_type', EVENT_TYPES)} AS type, ts AS created_at, user_id AS repo, event_id % 37 AS actor FROM events)",
    "oe": f"oe AS (SELECT {_sql_case('o_orderpriority', ORDER_TYPES)} AS type, o_orderdate AS created_at, o_custkey AS repo, o_orderkey % 7 AS actor FROM orders)",
    "co": """co AS (SELECT o_custkey AS repo_name, o_orderkey AS sha, 'a' || (o_orderkey % 5) AS author, o_orderdate AS committed_at, added, removed, o_orderpriority = '1-URGENT' AS evidence
      FROM orders JOIN (SELECT l_orderkey, sum(l_quantity)::BIGINT AS added, sum(l_linenumber)::BIGINT AS removed FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)""",
    "ts": """ts AS (SELECT repo_name, strftime(committed_at, '%Y-%m') AS month, arg_max(sha, {'a': committed_at, 'b': sha}) AS latest_commit, count(*) AS commits, sum(added)::BIGINT AS lines_added,
      sum(removed)::BIGINT AS lines_removed, count(DISTINCT author) AS contributors, bool_or(evidence) AS cursor FROM co GROUP BY 1, 2)""",
    "ad": "ad AS (SELECT repo_name, CASE WHEN repo_name % 3 = 0 THEN min(CASE WHEN cursor THEN month END) END AS event FROM ts GROUP BY 1)",
    "pr": f"pr AS (SELECT ts.*, event, substr(month, 1, 4)::INT * 12 + substr(month, 6, 2)::INT AS mid, substr(event, 1, 4)::INT * 12 + substr(event, 6, 2)::INT AS eid FROM ts JOIN ad USING (repo_name) WHERE month BETWEEN '{START}' AND '{END}')",
    "sc": """sb AS (SELECT o_custkey AS repo_name, strftime(o_orderdate, '%Y-%m') AS month, max(o_orderkey)::VARCHAR AS latest_commit, count_if(l_returnflag = 'R')::DOUBLE AS bugs,
      count_if(l_returnflag = 'A')::DOUBLE AS vulnerabilities, count_if(l_returnflag = 'N')::DOUBLE AS code_smells, sum(l_linenumber)::DOUBLE AS technical_debt, sum(l_quantity) AS q, count(*) AS n
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
    sc AS (SELECT repo_name, month, latest_commit, bugs, vulnerabilities, code_smells, technical_debt, CASE WHEN q % 7 <> 0 THEN q * 10 END AS ncloc, CASE WHEN q % 7 <> 0 THEN q % 13 END AS duplicated_lines_density,
      CASE WHEN q % 7 <> 0 THEN q % 11 END AS comment_lines_density, CASE WHEN q % 7 <> 0 THEN n * 3.0::DOUBLE END AS cognitive_complexity FROM sb)""",
    "pa": """pa AS (SELECT * FROM (SELECT c_custkey AS treatment_repo, k::INT AS match_rank, ((c_custkey * 7 + k * 5) % (n + 1))::BIGINT AS control_repo, (199800 + k)::INT AS matched_period
      FROM customer, (SELECT max(c_custkey) AS n FROM customer), (SELECT unnest([1, 2, 3]) AS k) WHERE c_custkey % 3 = 0) WHERE control_repo > 0 AND control_repo <> treatment_repo)""",
}
_NEEDS = {"ts": ("co",), "ad": ("ts",), "pr": ("ad",)}


def ctes(*names: str) -> str:
    """WITH and the expressions of the named tables, and of those they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, ()):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(SQL[n] for n in order) + "\n"
