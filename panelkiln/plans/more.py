"""Further registered queries: selections, lookups, checks, result tables, settings and grids, with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln import schemas
from panelkiln.estimators import batched, did
from panelkiln.estimators import panel as panels
from panelkiln.functions import periods, values
from panelkiln.operators import cohorts, dependency, effects, events, joins, matching, panel, qc, quality, reshape, similarity
from panelkiln.plans import catalog
from panelkiln.plans.bindings import END, adoption, commits, ctes, load, monthly_events, pairs, panel_rows, scans, series
from panelkiln.plans.catalog import _ASSEMBLED, _DENSE, _MERGED, _UNIT, _WARN, _WINDOWS, _coded_units, _dense, _unit, assembled, imputed_sql, merged, query, r6, warnings
from panelkiln.sources import tables

_BEFORE = set(catalog.QUERIES)

# Selections


@query(ctes("oe") + "SELECT type, strftime(created_at, '%Y-%m-%d') AS day, repo, actor FROM oe WHERE repo IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def events_seen_by(spark, d):
    listed = load(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("repo"))
    found = events.seen_by(listed, monthly_events(spark, d))
    return found.select("type", F.date_format("created_at", "yyyy-MM-dd").alias("day"), "repo", "actor").orderBy("repo", "day")


_PATH = "p_name || CASE p_size % 6 WHEN 0 THEN '/.cursor/rules/a.mdc' WHEN 1 THEN '/src/.cursorrules' WHEN 2 THEN '/.cursorrules.bak' WHEN 3 THEN '/.cursorignore' WHEN 4 THEN '/x.cursor/y' ELSE '/src/main.py' END"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """Changed paths of commits: a line's part names a path."""
    tail = F.lit("/src/main.py")
    for k, t in enumerate(("/.cursor/rules/a.mdc", "/src/.cursorrules", "/.cursorrules.bak", "/.cursorignore", "/x.cursor/y")):
        tail = F.when(F.col("p_size") % 6 == k, t).otherwise(tail)
    li = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.select(F.col("l_orderkey").alias("sha"), F.concat("p_name", tail).alias("path"))


@query(f"SELECT l_orderkey AS sha, l_linenumber AS n, p_size % 6 IN (0, 1, 3) AS tool, starts_with({_PATH}, 'red') AS red, contains({_PATH}, '.cursor') AS like_tool FROM lineitem JOIN part ON p_partkey = l_partkey")
def tool_paths(spark, d):
    li = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("sha"), F.col("l_linenumber").alias("n"), "p_name", "p_size")
    ends = F.element_at(F.array(*[F.lit(x) for x in ("/.cursor/rules/a.mdc", "/src/.cursorrules", "/.cursorrules.bak", "/.cursorignore", "/x.cursor/y", "/src/main.py")]), (F.col("p_size") % 6 + 1).cast("int"))
    path = F.concat("p_name", ends)
    return li.select("sha", "n", values.is_tool_path(path).alias("tool"), path.startswith("red").alias("red"), path.contains(".cursor").alias("like_tool"))


@query(ctes("co") + """, h AS (SELECT DISTINCT l_orderkey AS sha FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size % 6 IN (0, 1, 3))
SELECT repo_name, count(*) AS evidence_commits, strftime(min(committed_at), '%Y-%m') AS adoption_month, arg_min(sha, {'a': committed_at, 'b': sha})::VARCHAR AS commit_hash FROM co JOIN h USING (sha) GROUP BY 1""")
def evidence_by_path(spark, d):
    """Commits whose changed paths hold a tool's file, and each repo's first."""
    touched = _paths(spark, d).where(values.is_tool_path(F.col("path"))).select("sha").distinct()
    found = commits(spark, d).join(touched, "sha", "left_semi")
    n = found.groupBy("repo_name").agg(F.count("*").alias("evidence_commits"))
    text = found.select("repo_name", F.col("sha").cast("string").alias("commit_hash"), F.lit("?").alias("authored_at"), F.date_format("committed_at", "yyyy-MM-dd HH:mm:ss").alias("committed_at"), "sha")
    first = panel.adoption_dates(text.withColumn("commit_hash", F.format_string("%020d", "sha")))
    return n.join(first, "repo_name").select("repo_name", "evidence_commits", "adoption_month", F.col("sha").cast("string").alias("commit_hash"))


@query(ctes("ad") + "SELECT repo_name, event FROM ad WHERE event IS NULL OR (replace(event, '-', '')::INT > 199603 AND replace(event, '-', '')::INT <= 199712)")
def cohort_filter(spark, d):
    a = adoption(spark, d)
    return a.where(panel.cohort(F.translate("event", "-", "").cast("int"), 199603, 199712)).select("repo_name", "event")


@query(ctes("ad") + ", t AS (SELECT repo_name, CASE WHEN repo_name % 5 = 0 THEN event || '-01' ELSE event END AS event FROM ad WHERE event IS NOT NULL) SELECT repo_name, event FROM t WHERE length(event) = 7 AND event > '1996-03' AND event <= '1997-12'")
def event_range(spark, d):
    a = adoption(spark, d).where("event IS NOT NULL").withColumn("event", F.when(F.col("repo_name") % 5 == 0, F.concat("event", F.lit("-01"))).otherwise(F.col("event")))
    return a.where(periods.event_in_range(F.col("event"), 199603, 199712)).select("repo_name", "event")


@query("SELECT o_orderkey, o_orderdate >= '1996-01-01' AND o_orderdate < '1998-04-01' AS inside, strftime(o_orderdate, '%Y-%m') >= '1996-01' AND strftime(o_orderdate, '%Y-%m') < '1998-04' AS inside_text FROM orders")
def adoption_window(spark, d):
    at = F.when(F.col("o_orderkey") >= 0, F.col("o_orderdate"))
    return load(spark, d, "orders").select("o_orderkey", periods.within(at, "1996-01-01", "1998-04-01").alias("inside"), periods.within(periods.month(at), "1996-01", "1998-04").alias("inside_text"))


def _checked(spark: SparkSession, d: str) -> DataFrame:
    w = cohorts.event_windows(panel_rows(spark, d).where("event IS NOT NULL"))
    moved = F.when(F.col("repo_name") % 2 == 0, F.col("event")).when(F.col("repo_name") % 5 == 0, F.lit(None)).otherwise(periods.month_of_id(periods.month_id(F.col("event")) + (F.col("repo_name") % 4 - 2).cast("int")))
    return cohorts.adoption_check(w, adoption(spark, d).select("repo_name", moved.alias("adoption_month")))


_CHECKED = ctes("pr") + f""", {_WINDOWS}, m AS (SELECT repo_name, event_month, CASE WHEN repo_name % 2 = 0 THEN 0 WHEN repo_name % 5 = 0 THEN NULL ELSE (repo_name % 4 - 2)::INT END AS month_difference FROM w)
"""


@query(_CHECKED + "SELECT repo_name, event_month, month_difference, CASE WHEN month_difference IS NULL THEN 'missing_adoption_month' WHEN month_difference = 0 THEN 'matched' ELSE 'mismatched' END AS status FROM m")
def adoption_shifts(spark, d):
    return _checked(spark, d).select("repo_name", "event_month", "month_difference", "status")


@query(_CHECKED + "SELECT unnest(['exact', 'within_1_month', 'diagnostic']) AS option, unnest([count_if(month_difference = 0), count_if(abs(month_difference) <= 1), count(month_difference)])::BIGINT AS units FROM m")
def sample_options(spark, d):
    parts = [df.agg(F.count("*").alias("units")).select(F.lit(k).alias("option"), "units") for k, df in cohorts.sample_options(_checked(spark, d)).items()]
    return reshape.union_all(parts)


@query("SELECT c_custkey, c_nationkey = 7 AS as_number, c_mktsegment = 'BUILDING' AS as_text FROM customer")
def loose_equality(spark, d):
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_nationkey", F.lit(".0"))).otherwise(F.col("c_nationkey").cast("string"))
    return load(spark, d, "customer").select("c_custkey", values.equals_loosely(text, "7").alias("as_number"), values.equals_loosely(F.col("c_mktsegment"), " building ").alias("as_text"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'F')")
def usable_clones(spark, d):
    o = load(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "O", " Cloned").when(F.col("o_orderstatus") == "F", "EXISTS ").otherwise("failed"))
    return cohorts.usable(o).select("o_orderkey", "o_orderstatus")


@query("SELECT count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber)) AS keys, min(l_quantity) AS least FROM lineitem")
def asserted_keys(spark, d):
    """Passes as no key repeats and no count is negative; the tests have the other outcomes."""
    li = load(spark, d, "lineitem")
    numbered = li.withColumn("id", F.monotonically_increasing_id())
    quality.assert_keys(numbered, ["id"], ["l_quantity"])
    return li.agg(F.count("*").alias("rows"), F.count_distinct("l_orderkey", "l_linenumber").alias("keys"), F.min("l_quantity").alias("least"))


# Columns


@query(ctes("ts") + "SELECT repo_name, month, commits, round(commits / 2, 6) AS half, commits * 3 AS triple, lines_added FROM ts")
def inserted_columns(spark, d):
    out = schemas.insert_after(series(spark, d).select("repo_name", "month", "commits", "lines_added"), "commits", {"half": F.round(F.col("commits") / 2, 6), "triple": F.col("commits") * 3})
    if out.columns != ["repo_name", "month", "commits", "half", "triple", "lines_added"]:
        raise AssertionError(out.columns)
    return out


@query(ctes("ts") + "SELECT repo_name, month, commits AS n, lines_added::DOUBLE AS effort, NULL::DOUBLE AS stars FROM ts")
def first_available(spark, d):
    ts = series(spark, d).select("repo_name", "month", F.col("commits").alias("n"), F.col("lines_added").cast("double").alias("added"))
    out = schemas.with_alias(ts, "effort", ["lines", "added", "n"])
    return schemas.with_alias(out, "stars", ["stargazers"], "double").drop("added")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 10 THEN l_quantity END AS a, CASE WHEN l_linenumber > 2 THEN l_discount END AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN a IS NOT NULL THEN greatest(a, 20) END AS low, CASE WHEN a IS NOT NULL THEN least(greatest(a, 20), 40) END AS held, a IS NULL OR b IS NULL AS some_missing, a IS NULL AND b IS NULL AS all_missing FROM v""")
def clipped_and_missing(spark, d):
    a, b = F.when(F.col("l_quantity") >= 10, F.col("l_quantity")), F.when(F.col("l_linenumber") > 2, F.col("l_discount"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", values.clip(a, 20.0).alias("low"), values.clip(a, 20.0, 40.0).alias("held"), values.any_null(a, b).alias("some_missing"), values.all_null(a, b).alias("all_missing"))


@query("""WITH s AS (SELECT c_custkey, c_custkey % 7 * 100 AS a, c_custkey % 5 * 100 AS b, c_custkey % 3 * 100 AS c FROM customer)
SELECT c_custkey, CASE greatest(a, b, c) WHEN a THEN 'Go' WHEN b THEN 'Python' ELSE 'Rust' END AS language, a + b + c AS total FROM s""")
def packed_languages(spark, d):
    k = F.col("c_custkey")
    text = F.concat(F.lit("Rust: "), (k % 3 * 100).cast("string"), F.lit("; Go: "), (k % 7 * 100).cast("string"), F.lit("; Python: "), (k % 5 * 100).cast("string"))
    m = values.packed_map(text)
    return load(spark, d, "customer").select("c_custkey", values.largest_key(m).alias("language"), F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda t, x: t + x).alias("total"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m') END AS month, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS wall,
  CASE WHEN b < 1024 THEN b || ' bytes' WHEN b < 1024 ** 2 THEN printf('%.2f KB', b / 1024) WHEN b < 1024 ** 3 THEN printf('%.2f MB', b / 1024 ** 2) ELSE printf('%.2f GB', b / 1024 ** 3) END AS size,
  (year(o_orderdate - INTERVAL 13 MONTH) * 100 + month(o_orderdate - INTERVAL 13 MONTH))::INT AS back FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 1000 WHEN 1 THEN o_orderkey * 512 WHEN 2 THEN o_orderkey * 1048576 ELSE (o_orderkey + 1) * 1073741824 END AS b FROM orders)""")
def labels_of_values(spark, d):
    """Month prefixes, wall clock without zone, byte sizes, months back."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    raw = F.when(k % 4 == 0, " nan ").otherwise(F.date_format(at, " yyyy-MM-dd"))
    size = F.when(k % 4 == 0, k % 1000).when(k % 4 == 1, k * 512).when(k % 4 == 2, k * 1048576).otherwise((k + 1) * 1073741824)
    return load(spark, d, "orders").select("o_orderkey", values.prefix(raw).alias("month"), F.date_format(periods.without_zone(at), "yyyy-MM-dd HH:mm").alias("wall"), values.bytes_text(size).alias("size"), periods.add_months_yyyymm(periods.yyyymm(at), -13).alias("back"))


@query("SELECT l_orderkey, l_linenumber, round(date_diff('day', o_orderdate::DATE, l_shipdate::DATE) / 7)::INT AS weeks FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def week_differences(spark, d):
    li = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.select("l_orderkey", "l_linenumber", periods.week_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("weeks"))


@query("SELECT o_orderkey, ('0x' || substr(md5('3:' || o_orderkey), 1, 8))::BIGINT % 10 AS bucket FROM orders WHERE ('0x' || substr(md5('3:' || o_orderkey), 1, 8))::BIGINT % 10 < 4")
def hash_share(spark, d):
    o = load(spark, d, "orders").select("o_orderkey")
    return reshape.sample_share(o, "o_orderkey", 4, 10, 3).withColumn("bucket", values.hash_bucket(F.col("o_orderkey"), 10, 3))


# Joins


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def enriched(spark, d):
    dim = load(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return joins.enrich(load(spark, d, "orders").select("o_orderkey", "o_custkey"), joins.dimension(dim), "o_custkey")


@query(ctes("ts") + "SELECT DISTINCT repo_name, month, commits FROM ts JOIN (SELECT repo_name, max(month) AS month FROM ts GROUP BY 1) USING (repo_name, month)")
def latest_period(spark, d):
    return joins.latest(series(spark, d).select("repo_name", "month", "commits"), ["repo_name"], "month")


@query("""WITH v AS (SELECT o_custkey AS project, strftime(o_orderdate, '%Y-%m') AS m, max(o_orderdate) AS at, arg_max(o_orderkey, o_orderdate) AS version FROM (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) GROUP BY 1, 2),
w AS (SELECT c_custkey AS project, unnest(['1996-05', '1997-10', '1999-12']) AS m FROM customer) SELECT w.project, replace(w.m, '-', '') AS wanted, version FROM w LEFT JOIN v USING (project, m)""")
def versions_by_month(spark, d):
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("project"), F.col("o_orderdate").alias("at")).agg(F.max("o_orderkey").alias("version"))
    held = o.withColumn("label", periods.month(F.col("at")))
    asked = load(spark, d, "customer").select(F.col("c_custkey").alias("project"), F.explode(F.array(*[F.lit(x) for x in ("199605", "199710", "199912")])).alias("label"))
    found = joins.version_match(asked, held, "project", periods.normal_month(F.col("label")), "version", "at")
    return found.select("project", F.col("label").alias("wanted"), "version")


@query(ctes("sc") + """, t AS (SELECT repo_name, month, bugs, ncloc FROM sc WHERE repo_name % 2 = 0), n AS (SELECT repo_name, month, bugs + 1 AS bugs, CASE WHEN repo_name % 4 = 0 THEN NULL ELSE ncloc END AS ncloc FROM sc)
SELECT t.repo_name, t.month, t.bugs, n.bugs AS bugs_new, coalesce(n.ncloc, t.ncloc) AS ncloc FROM t LEFT JOIN n USING (repo_name, month)""")
def suffixed_and_combined(spark, d):
    s = scans(spark, d).select("repo_name", "month", "bugs", "ncloc")
    new = s.withColumns({"bugs": F.col("bugs") + 1, "ncloc": F.when(F.col("repo_name") % 4 != 0, F.col("ncloc"))})
    both = joins.suffixed(s.where("repo_name % 2 = 0"), new, ["repo_name", "month"], "_new")
    return joins.combine_first(both.withColumnsRenamed({"ncloc": "ncloc_old", "ncloc_new": "ncloc"}), "ncloc", "ncloc_old")


@query(ctes("co") + "SELECT repo_name, array_to_string(list_sort(list(DISTINCT lower(author))), '|') AS keys FROM co WHERE evidence GROUP BY 1")
def known_authors(spark, d):
    e = commits(spark, d).where("evidence").select("repo_name", F.concat(F.initcap("author"), F.lit(" <"), "author", F.lit("@x.org>")).alias("author"))
    return cohorts.known_authors(e).select("repo_name", F.array_join("keys", "|").alias("keys"))


@query("""WITH x AS (SELECT c_nationkey AS p, t.c_custkey AS treatment, c.c_custkey AS control, abs(c.c_acctbal - t.c_acctbal) AS distance FROM customer t JOIN customer c USING (c_nationkey) WHERE t.c_custkey % 2 = 0 AND c.c_custkey <> t.c_custkey),
r AS (SELECT *, row_number() OVER (PARTITION BY p, treatment ORDER BY distance, control)::INT AS match_rank FROM x) SELECT p, treatment, control, match_rank, round(distance, 6) AS distance FROM r WHERE match_rank <= 3""")
def knn_overlapping(spark, d):
    """Treated units are among the controls of others, never of themselves."""
    c = load(spark, d, "customer").select(F.col("c_nationkey").alias("p"), F.col("c_custkey").alias("repo_name"), F.col("c_acctbal").alias("score"))
    return matching.nearest(c.where("repo_name % 2 = 0"), c, ["p"]).withColumns(r6("distance"))


@query("""WITH c AS (SELECT hash AS class, side FROM (SELECT md5(text) AS hash, 'd' AS side FROM documents WHERE text IS NOT NULL UNION ALL SELECT md5(text), 'b' FROM benchmark)),
n AS (SELECT class, count(DISTINCT side) AS n FROM c GROUP BY 1) SELECT count(*) AS classes, count_if(n > 1)::BIGINT AS mixed, count_if(n > 1) / count(*) AS mixed_ratio FROM n""")
def mixed_classes(spark, d):
    side = lambda name, s: load(spark, d, name).where("text IS NOT NULL").select(F.md5("text").alias("class"), F.lit(s).alias("side"))
    return similarity.mixed_ratio(side("documents", "d").unionByName(side("benchmark", "b")))


@query(f"""WITH {_WARN}, t AS (SELECT 'Brand#' || k AS rule, CASE WHEN k % 2 = 0 THEN 'Naming' ELSE 'Errors' END AS category FROM (SELECT unnest(range(1, 11)) AS k))
SELECT coalesce(category, 'Other') AS category, count(*) AS n FROM wa LEFT JOIN t USING (rule) GROUP BY 1""")
def classified(spark, d):
    taxonomy = spark.range(1, 11).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("rule"), F.when(F.col("id") % 2 == 0, "Naming").otherwise("Errors").alias("category"))
    return quality.classify(warnings(spark, d).drop("category"), taxonomy).groupBy("category").agg(F.count("*").alias("n"))


@query("""SELECT 'GHSA-' || c_custkey AS advisory, 'pkg' || c_custkey % 20 AS package, '< 1.' || c_nationkey AS "range", c_name AS summary FROM customer""")
def landed_advisories(spark, d):
    """Pages of an interface's answer as landed, of a hundred items or so each."""
    c = load(spark, d, "customer")
    node = F.struct(F.struct(F.concat(F.lit("GHSA-"), F.col("c_custkey")).alias("ghsaId"), F.col("c_name").alias("summary")).alias("advisory"), F.struct(F.concat(F.lit("pkg"), F.col("c_custkey") % 20).alias("name")).alias("package"), F.concat(F.lit("< 1."), F.col("c_nationkey")).alias("vulnerableVersionRange"))
    edges = c.groupBy(F.floor(F.col("c_custkey") / 100).alias("page")).agg(F.collect_list(F.struct(node.alias("node"))).alias("edges"))
    pages = edges.select(F.to_json(F.struct(F.struct("edges", F.struct(F.lit(False).alias("hasNextPage")).alias("pageInfo")).alias("securityVulnerabilities"))).alias("body"))
    return tables.landed_advisories(pages)


# Ranks and order


@query(ctes("pr", "ts") + f""", {_WINDOWS}, e AS (SELECT repo_name, count(*) AS repo_commits, count_if(evidence) AS cursor_commit_rows FROM co GROUP BY 1), f AS (SELECT repo_name, count(latest_commit) AS ts_rows FROM ts GROUP BY 1),
a AS (SELECT w.*, pre_panel_months + post_panel_months AS total, repo_commits, cursor_commit_rows AS ccr, ts_rows, least(cursor_commit_rows / repo_commits, 1.0) AS share FROM w JOIN e USING (repo_name) JOIN f USING (repo_name) WHERE pre_panel_months >= 1 AND post_panel_months >= 1 AND event_months >= 1)
SELECT repo_name, round(share, 6) AS share, row_number() OVER (ORDER BY share DESC, ccr DESC, balanced_window DESC, total DESC, ts_rows DESC, repo_name)::INT AS by_share,
  row_number() OVER (ORDER BY balanced_window DESC, total DESC, ccr DESC, ts_rows DESC, panel_month_count DESC, repo_name)::INT AS by_window FROM a""")
def ranking_strategies(spark, d):
    w = cohorts.event_windows(panel_rows(spark, d).where("event IS NOT NULL"))
    found = commits(spark, d).groupBy("repo_name").agg(F.count("*").alias("repo_commits"), F.count_if("evidence").alias("cursor_commit_rows"))
    months = series(spark, d).groupBy("repo_name").agg(F.count("latest_commit").alias("ts_rows_with_latest_commit"))
    units = cohorts.contributor_share(w.join(found, "repo_name").join(months, "repo_name"))
    rank = lambda how, name: cohorts.balanced(units, 1, 1, how).withColumnRenamed("rank", name)
    return rank("high_contributor", "by_share").select("repo_name", F.round("share", 6).alias("share"), "by_share").join(rank("balanced", "by_window").select("repo_name", "by_window"), "repo_name")


@query("""WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'n/a' ELSE (c_custkey * 7 % 13)::VARCHAR END AS label FROM customer), k AS (SELECT DISTINCT label FROM r ORDER BY label LIMIT 5)
SELECT c_custkey, label FROM r WHERE label IN (SELECT label FROM k) ORDER BY try_cast(label AS DOUBLE) NULLS LAST, c_custkey""")
def numeric_order_capped(spark, d):
    k = F.col("c_custkey")
    c = load(spark, d, "customer").select("c_custkey", F.when(k % 10 == 0, "n/a").otherwise((k * 7 % 13).cast("string")).alias("label"))
    return reshape.by_number(reshape.capped(c, "label", 5), "label", "c_custkey")


# Quality and checks


@query(_MERGED + """, z AS (SELECT *, ncloc IS NULL AND duplicated_lines_density IS NULL AND comment_lines_density IS NULL AND cognitive_complexity IS NULL AND bugs = 0 AND vulnerabilities = 0 AND code_smells = 0 AND technical_debt = 0 AS none FROM (SELECT * REPLACE (CASE WHEN repo_name % 2 = 0 THEN 0 ELSE bugs END AS bugs, CASE WHEN repo_name % 2 = 0 THEN 0 ELSE vulnerabilities END AS vulnerabilities, CASE WHEN repo_name % 2 = 0 THEN 0 ELSE code_smells END AS code_smells, CASE WHEN repo_name % 2 = 0 THEN 0 ELSE technical_debt END AS technical_debt) FROM mq WHERE scan_commit IS NOT NULL))
SELECT repo_name, time, dataset_source, CASE WHEN none THEN 0 ELSE ncloc END AS ncloc, CASE WHEN none THEN 0 ELSE cognitive_complexity END AS code_complexity FROM z""")
def quality_v1(spark, d):
    m = merged(spark, d).where("scan_commit IS NOT NULL")
    even = m.withColumns({f"{c}_raw": F.when(F.col("repo_name") % 2 == 0, 0.0).otherwise(F.col(f"{c}_raw")) for c in quality.ISSUES})
    return quality.quality_outcomes_v1(even).select("repo_name", "time", "dataset_source", "ncloc", "code_complexity")


def _long_sql(table: str, entries: dict[str, str]) -> str:
    names, items = ", ".join(f"'{k}'" for k in entries), ", ".join(f"({v})::VARCHAR" for v in entries.values())
    return f'SELECT unnest([{names}]) AS "check", unnest([{items}]) AS value FROM {table}'


def _side_checks() -> dict[str, str]:
    of = lambda s: f"count(DISTINCT CASE WHEN dataset_source = '{s}' THEN repo_name END)"
    return {"repos": "count(DISTINCT repo_name)", "min_time": "min(time)", "max_time": "max(time)", "treatment_rows": "count_if(dataset_source = 'treatment')", "control_rows": "count_if(dataset_source = 'control')", "treatment_repos": of("treatment"), "control_repos": of("control")}


def _fill_checks(columns: dict[str, str]) -> dict[str, str]:
    return {f"{n}_{s}": e for n, c in columns.items() for s, e in (("nonmissing", f"count({c})"), ("missing", f"count(*) - count({c})"))}


@query(_MERGED + _long_sql("mq", {"input_panel_rows": "(SELECT count(*) FROM q)", "merged_rows": "count(*)", "row_count_preserved": "(count(*) = (SELECT count(*) FROM q))::INT"} | _side_checks() | {"duplicate_rows": "count(*) - count(DISTINCT (repo_name, time, dataset_source))", "missing_scan_commit": "count(*) - count(scan_commit)"}
        | _fill_checks({"bugs_raw": "bugs", "ncloc_raw": "ncloc", "static_analysis_warnings": "bugs + vulnerabilities + code_smells", "warnings_per_kloc": "CASE WHEN ncloc > 0 THEN bugs + vulnerabilities + code_smells END"}) | {"has_scan_sum": "count(scan_commit)", "positive_size_sum": "count_if(ncloc > 0)"}))
def qc_merge(spark, d):
    out = quality.quality_outcomes(merged(spark, d))
    checks = qc.merge_checks(out, assembled(spark, d).count(), ["bugs_raw", "ncloc_raw", "static_analysis_warnings", "warnings_per_kloc"], ["has_scan", "positive_size"])
    return qc.qc_long(out, checks)


def _input_checks(label: str, outcomes: dict[str, str], flags: dict[str, str], logs: dict[str, str], rows: str) -> dict[str, str]:
    on = lambda s, c: f"coalesce(sum(CASE WHEN dataset_source = '{s}' THEN {c} END), 0)::BIGINT"
    out = {"panel_label": f"'{label}'", "input_rows": rows, "output_rows": "count(*)", "row_count_preserved": "1"} | _side_checks()
    out |= {f"{s}_time_to_event_nonmissing": f"count(CASE WHEN dataset_source = '{s}' THEN tte END)" for s in ("treatment", "control")}
    out |= {"post_event_sum": "sum(post_event)::BIGINT", "control_post_event_sum": on("control", "post_event"), "treatment_post_event_sum": on("treatment", "post_event")}
    out |= {f"{n}_sum": f"coalesce(sum({c}), 0)::BIGINT" for n, c in flags.items()}
    for n, c in outcomes.items():
        out |= _fill_checks({n: c}) | {f"{n}_zero_count": f"count_if(({c}) = 0)", f"{n}_mean": f"round(avg({c}), 6)", f"{n}_median": f"round(median({c}), 6)"}
    return out | {f"{n}_{s}": f"count({c})" for n, c in logs.items() for s in ("nonmissing", "finite")}


def _rounded(df: DataFrame) -> DataFrame:
    """Numbers as text alike in every engine."""
    number = F.col("value").try_cast("double")
    return df.withColumn("value", F.when(number.isNotNull(), F.format_number(number, 4)).otherwise(F.col("value")))


def _rounded_sql(sql: str) -> str:
    return sql.replace('SELECT unnest([', 'SELECT "check", CASE WHEN try_cast(value AS DOUBLE) IS NOT NULL THEN format(\'{:,.4f}\', value::DOUBLE) ELSE value END AS value FROM (SELECT unnest([', 1) + ")"


@query(_MERGED + ", o AS (SELECT *, bugs + vulnerabilities + code_smells AS w FROM mq) " + _rounded_sql(_long_sql("o", _input_checks("main", {"static_analysis_warnings": "w::DOUBLE", "code_complexity": "cognitive_complexity::DOUBLE"}, {"has_scan": "(scan_commit IS NOT NULL)::INT", "analysis_ready_core": "(w IS NOT NULL AND cognitive_complexity IS NOT NULL AND duplicated_lines_density IS NOT NULL)::INT"}, {"log_static_analysis_warnings": "w"}, "(SELECT count(*) FROM q)"))))
def qc_quality_input(spark, d):
    full = quality.did_input(quality.quality_outcomes(merged(spark, d)))["full"]
    return _rounded(qc.qc_long(full, qc.input_checks(full, assembled(spark, d).count(), "main", ["static_analysis_warnings", "code_complexity"], ["has_scan", "analysis_ready_core"], ["log_static_analysis_warnings"])))


@query(_ASSEMBLED + _rounded_sql(_long_sql("q", _input_checks("velocity", {"commits": "commits::DOUBLE", "lines_added": "lines_added::DOUBLE"}, {}, {}, "count(*)"))))
def qc_velocity_input(spark, d):
    p = assembled(spark, d)
    return _rounded(qc.qc_long(p, qc.input_checks(p, p.count(), "velocity", ["commits", "lines_added"], [])))


@query(_ASSEMBLED + """, w AS (SELECT 'treatment' AS panel, count(*)::VARCHAR AS "rows", max(time) AS last_month FROM q WHERE dataset_source = 'treatment' UNION ALL SELECT 'control', count(*)::VARCHAR, max(time) FROM q WHERE dataset_source = 'control') SELECT * FROM w""")
def qc_wide(spark, d):
    p, checks = assembled(spark, d), qc.panel_checks()
    parts = [qc.qc_long(p.where(F.col("dataset_source") == s), checks).withColumn("panel", F.lit(s)) for s in ("treatment", "control")]
    return qc.wide_checks(reshape.union_all(parts), "panel", ["rows", "last_month"])


@query("SELECT covariate, n = 0 AS used FROM (SELECT count_if(l_quantity IS NULL) AS complete, count_if(NOT l_linenumber > 1 OR l_discount IS NULL) AS holes, count(*) AS absent FROM lineitem) UNPIVOT (n FOR covariate IN (complete, holes, absent))")
def optional_covariates(spark, d):
    li = load(spark, d, "lineitem").select(F.col("l_quantity").alias("complete"), F.when(F.col("l_linenumber") > 1, F.col("l_discount")).alias("holes"))
    names = ["complete", "holes", "absent"]
    used = did.optional_covariates(li, names)
    return spark.createDataFrame([(n, n in used) for n in names], "covariate string, used boolean")


# Result tables


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Estimates by nation as outcome and by region as panel: sizes, errors and ages of the customers' balances."""
    c = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    one = c.groupBy(F.concat(F.lit("R"), F.col("n_regionkey")).alias("panel"), F.concat(F.lit("out_"), F.col("c_nationkey") % 5).alias("outcome")).agg(
        (F.avg("c_acctbal") / 10000).alias("estimate"), (F.stddev_samp("c_acctbal") / F.sqrt(F.count("*")) / 10000).alias("std_error"))
    return one.withColumns({"conf_low": F.lit(None).cast("double"), "conf_high": F.lit(None).cast("double"), "p_value": (F.col("std_error") * 2)})


_RESULTS = """WITH r AS (SELECT 'R' || n_regionkey AS panel, 'out_' || c_nationkey % 5 AS outcome, avg(c_acctbal) / 10000 AS e, stddev_samp(c_acctbal) / sqrt(count(*)) / 10000 AS s FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2),
t AS (SELECT *, e - 1.96 * s AS lo, e + 1.96 * s AS hi, 2 * s AS p FROM r), f AS (SELECT *, (exp(e) - 1) * 100 AS pct, (exp(lo) - 1) * 100 AS lo_pct, (exp(hi) - 1) * 100 AS hi_pct, CASE WHEN p IS NULL THEN '' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars, coalesce(lo > 0 OR hi < 0, false) AS sig FROM t)
"""


@query(_RESULTS + "SELECT panel, outcome, round(pct, 6) AS estimate_pct, round(lo_pct, 6) AS conf_low_pct, round(hi_pct, 6) AS conf_high_pct, stars, sig AS ci_excludes_zero, 'Out ' || right(outcome, 1) AS outcome_label FROM f")
def effects_table(spark, d):
    t = effects.effect_table(_results(spark, d), panels=["R0", "R1"])
    return t.select("panel", "outcome", "estimate_pct", "conf_low_pct", "conf_high_pct", "stars", "ci_excludes_zero", "outcome_label").withColumns(r6("estimate_pct", "conf_low_pct", "conf_high_pct"))


@query(_RESULTS + ", z AS (SELECT *, round(pct, 3) AS v FROM f) SELECT panel, " + ", ".join(f"max(v) FILTER (outcome = 'out_{k}') AS estimate_pct_out_{k}, max(stars) FILTER (outcome = 'out_{k}') AS stars_out_{k}" for k in (0, 3)) + " FROM z GROUP BY 1")
def effects_by_panel(spark, d):
    t = effects.effect_table(_results(spark, d)).withColumn("estimate_pct", F.round("estimate_pct", 3) + F.lit(0.0))
    return effects.effects_wide(t, ["estimate_pct", "stars"], ["out_0", "out_3"])


@query(_RESULTS + ", p AS (SELECT unnest(['out_0', 'out_1', 'out_9']) AS outcome, unnest([10.0, 60.5, 1.0]) AS published_pct) SELECT panel, outcome, round(pct - published_pct, 6) AS difference_pp FROM f JOIN p USING (outcome)")
def published_differences(spark, d):
    published = spark.createDataFrame([("out_0", 10.0), ("out_1", 60.5), ("out_9", 1.0)], "outcome string, published_pct double")
    return effects.compare_published(effects.effect_table(_results(spark, d)), published).select("panel", "outcome", "difference_pp").withColumns(r6("difference_pp"))


@query("""WITH r AS (SELECT n_regionkey % 2 AS o, c_nationkey - 12 AS time, avg(c_acctbal) - 4500 AS e, stddev_samp(c_acctbal) / sqrt(count(*)) AS s FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2), t AS (SELECT *, coalesce(e - 1.96 * s > 0 OR e + 1.96 * s < 0, false) AS sig FROM r)
SELECT 'out_' || o AS outcome, count_if(time < 0)::BIGINT AS pre_terms, count_if(time < 0 AND sig)::BIGINT AS pre_significant, count_if(time >= 0)::BIGINT AS post_terms, count_if(time >= 0 AND sig)::BIGINT AS post_significant FROM t GROUP BY 1""")
def pretrend_counts(spark, d):
    c = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    term = F.concat(F.lit("tau"), F.regexp_replace((F.col("c_nationkey") - 12).cast("string"), "-", "−"))
    one = c.groupBy(F.concat(F.lit("out_"), F.col("n_regionkey") % 2).alias("outcome"), term.alias("term")).agg((F.avg("c_acctbal") - 4500).alias("estimate"), (F.stddev_samp("c_acctbal") / F.sqrt(F.count("*"))).alias("std_error"))
    dynamic = effects.normalise_dynamic(one.withColumns({n: F.lit(None).cast("double") for n in ("conf_low", "conf_high", "p_value")}))
    return effects.pretrend_summary(dynamic)


# Clones


@query("""WITH w AS (SELECT doc_id AS id, lang, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT id, lang, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, lang, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
c AS (SELECT id, lang, md5(array_to_string(list(g ORDER BY g), '|')) AS class, count(*) AS n FROM s GROUP BY id, lang), f AS (SELECT lang, class, min(id) AS id, min(n) AS n FROM c GROUP BY 1, 2),
r AS (SELECT s.id, s.lang, s.g, f.n FROM s JOIN f USING (id, lang)), j AS (SELECT a.id AS unit_a, b.id AS unit_b, a.n AS n_a, b.n AS n_b, count(*) AS shared FROM r a JOIN r b ON a.g = b.g AND a.lang = b.lang AND a.id < b.id GROUP BY ALL),
p AS (SELECT * FROM j UNION ALL SELECT f.id, c.id, f.n, c.n, f.n FROM c JOIN f USING (lang, class) WHERE f.id < c.id)
SELECT unit_a, unit_b, n_a, n_b, shared, round(2 * shared / (n_a + n_b), 6) AS coverage FROM p WHERE 2 * shared / (n_a + n_b) >= 0.5""")
def clone_pairs(spark, d):
    """Texts of one language that share half of their five-word shingles or more: pairs of the first texts of equal sets, and each such set's other texts with its first."""
    docs = load(spark, d, "documents")
    sets, langs = similarity.shingles(docs, "doc_id", "text"), docs.select(F.col("doc_id").alias("unit"), F.col("lang").alias("side"))
    found, _ = similarity.clone_cascade(sets, 0.5, langs, by_side=True)
    return found.unionByName(similarity.clone_copies(sets, langs)).withColumns(r6("coverage"))


# Matching by period

_LAGS = ", ".join(f"coalesce(sum({m}) FILTER ({'period - t = ' + str(b) if b <= 3 else 'period - t > 3'}), 0)::BIGINT AS {n}_{'m' + str(b) if b <= 3 else 'sum'}" for m, n in (("s", "n_stars"), ("p", "n_pulls"), ("n", "total_events")) for b in range(1, 5))


def _period_features(spark: SparkSession, d: str) -> DataFrame:
    units = events.period_units(adoption(spark, d).select(F.col("repo_name").alias("repo"), F.col("event").alias("adoption_month")))
    return events.lag_features(monthly_events(spark, d), units)


@query(ctes("oe", "ad") + f""", a AS (SELECT repo_name AS repo, substr(event, 1, 4)::INT * 12 + substr(event, 6, 2)::INT AS period FROM ad),
un AS (SELECT repo, period, 1 AS treated FROM a WHERE period IS NOT NULL UNION ALL SELECT a.repo, m.period, 0 FROM a, (SELECT DISTINCT period FROM a WHERE period IS NOT NULL) m WHERE a.period IS NULL),
mo AS (SELECT repo, (year(created_at) * 12 + month(created_at))::INT AS t, count(*) AS n, count_if(type = 'WatchEvent') AS s, count_if(type = 'PullRequestEvent') AS p FROM oe GROUP BY 1, 2)
SELECT un.repo, period, treated, {_LAGS} FROM un LEFT JOIN mo ON mo.repo = un.repo GROUP BY un.repo, period, treated""")
def period_features(spark, d):
    """Activity before each period of the units that adopt in it and of those that never do."""
    return _period_features(spark, d)


@query()
def matched_by_period(spark, d):
    """From features to pairs: a propensity fit for each adoption month, and three nearest controls of the same month."""
    names = [f"{m}_{s}" for m in ("n_stars", "n_pulls", "total_events") for s in ("m1", "m2", "m3", "sum")]
    found, _ = matching.match_by_period(_period_features(spark, d), names, "period", unit="repo")
    return found.select("period", "treatment", "control", "match_rank", F.round("distance", 6).alias("distance"))


# Settings and grids

_MONTHS = dict(until="1999-06", before="1997-01", since="1997-02", default="1997-07", busy=3)


def _settings_panel(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = _dense(spark, d).withColumnRenamed("u", "repo_name")
    k, t, g = F.col("repo_name"), F.col("t"), F.col("g")
    language = F.element_at(F.array(*[F.lit(x) for x in ("JavaScript", "Python", "Go", "Rust", "COBOL")]), (k % 5 + 1).cast("int"))
    p = p.withColumns({
        "time": periods.month_of_id(t), "event": F.when(g.isNotNull(), periods.month_of_id(g)), "commits": F.col("y"), "is_treatment": g.isNotNull().cast("int"), "post_event": F.col("post"),
        "high_confidence": F.when(g.isNull() | (t < g), F.lit(None).cast("boolean")).when(t == g, True).otherwise(t % 3 == 0),
        "other_agents": k % 4 == 0, "adopter_pct": k * 37 % 101, "language_group": cohorts.language_group(language),
    })
    units = p.groupBy("repo_name").agg(F.max("is_treatment").alias("tr"))
    # A row per unit; ranks by name on each side.
    ranked = lambda tr: reshape.dense_ids(units.where(F.col("tr") == tr).select("repo_name"), "repo_name", "r").withColumn("r", F.col("r") - 1)
    controls = ranked(0)
    n = controls.count()
    wanted = ranked(1).select(F.col("repo_name").alias("treatment_repo"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: (F.col("r") * 7 + i * 5) % n)).alias("r"))
    return p, wanted.join(controls.withColumnRenamed("repo_name", "control_repo"), "r").select("treatment_repo", "control_repo")


_SETTINGS = _DENSE + """, sp AS MATERIALIZED (SELECT u, t, y, post, g IS NOT NULL AS tr, CASE WHEN g IS NOT NULL THEN g END AS g, CASE WHEN g IS NULL OR t < g THEN NULL WHEN t = g THEN true ELSE t % 3 = 0 END AS hc, u % 4 = 0 AS oth, u * 37 % 101 AS pct, CASE u % 5 WHEN 0 THEN 'javascript' WHEN 1 THEN 'python' WHEN 2 THEN 'go' WHEN 3 THEN 'rust' END AS lang FROM q),
ur AS (SELECT u, tr, row_number() OVER (PARTITION BY tr ORDER BY u) - 1 AS r, count(*) OVER (PARTITION BY tr) AS n FROM (SELECT DISTINCT u, tr FROM sp)),
mp AS (SELECT DISTINCT a.u AS treatment, b.u AS control FROM ur a, (SELECT unnest([1, 2, 3]) AS k), ur b WHERE a.tr AND NOT b.tr AND b.r = (a.r * 7 + k * 5) % b.n),
rs AS (SELECT 'all' AS lab, * FROM sp UNION ALL SELECT 'active', * FROM sp WHERE y > 0 UNION ALL SELECT 'very_active', * FROM sp WHERE y >= 3 UNION ALL SELECT 'truncated', * FROM sp WHERE t <= 1999 * 12 + 6
  UNION ALL SELECT 'config_changes', * FROM sp WHERE coalesce(hc, true) UNION ALL SELECT 'low_confidence', * FROM sp WHERE NOT coalesce(hc, false)),
us AS (SELECT DISTINCT lab, u FROM (SELECT 'adopters_80' AS lab, u FROM sp WHERE tr AND pct >= 80 UNION ALL SELECT 'with_others', u FROM sp WHERE tr AND oth UNION ALL SELECT 'only_one', u FROM sp WHERE tr AND NOT oth UNION ALL SELECT 'before_release', u FROM sp WHERE tr AND g <= 1997 * 12 + 1
  UNION ALL SELECT 'after_release', u FROM sp WHERE tr AND g >= 1997 * 12 + 2 UNION ALL SELECT 'made_default', u FROM sp WHERE tr AND g >= 1997 * 12 + 7 UNION ALL SELECT lang, u FROM sp WHERE tr AND lang IS NOT NULL)),
un AS (SELECT lab, sp.* FROM us JOIN sp USING (u) UNION ALL SELECT lab, sp.* FROM (SELECT DISTINCT lab, control AS u FROM us JOIN mp ON treatment = us.u) JOIN sp USING (u)),
st AS MATERIALIZED (SELECT lab, u, t, y, post, tr, g FROM rs UNION ALL SELECT lab, u, t, y, post, tr, g FROM un)
"""


@query(_SETTINGS + "SELECT lab AS panel, count(DISTINCT CASE WHEN tr THEN u END) AS treated, count(DISTINCT CASE WHEN NOT tr THEN u END) AS controls, count(*) AS n, count_if(post = 1)::BIGINT AS post_rows FROM st GROUP BY 1")
def settings_statistics(spark, d):
    labelled = cohorts.setting_labels(*_settings_panel(spark, d), cohorts.settings(**_MONTHS))
    return cohorts.setting_counts(labelled.withColumn("panel", F.explode("settings")), "panel")


@query(_SETTINGS + ",\n" + imputed_sql("st") + "\nSELECT lab AS panel, round(avg(effect), 6) AS estimate, count(*) AS n FROM fx GROUP BY 1")
def settings_grid(spark, d):
    """The effect under each robustness setting."""
    labelled = cohorts.setting_labels(*_settings_panel(spark, d), cohorts.settings(**_MONTHS))
    found = did.imputation_table(labelled, "y", "repo_name", "t", F.col("post") == 1, "g", "settings")
    return found.where("n > 0").select(F.col("label").alias("panel"), F.round("estimate", 6).alias("estimate"), "n")


_ID = "(substr({0}, 1, 4)::INT * 12 + substr({0}, 6, 2)::INT)"
_FOUR = _ASSEMBLED.rstrip() + f""",
kp AS (SELECT * FROM pa WHERE control_repo NOT IN (SELECT repo_name FROM ad WHERE event <= '{END}')), sk AS (SELECT * FROM kp WHERE treatment_repo IN (SELECT treatment_repo FROM kp GROUP BY 1 HAVING count(DISTINCT control_repo) = 3)),
b0 AS (SELECT 'main' AS cut, repo_name AS u, {_ID.format('time')} AS t, {_ID.format('event')} AS g, commits::DOUBLE AS y FROM q), b1 AS (SELECT * FROM b0 UNION ALL SELECT 'strict', u, t, g, y FROM b0 WHERE (g IS NOT NULL AND u IN (SELECT treatment_repo FROM sk)) OR (g IS NULL AND u IN (SELECT control_repo FROM sk))),
gr AS (SELECT cut, u, any_value(g) AS g, unnest(range(min(t), {1998 * 12 + 12 + 1}))::INT AS t FROM b1 GROUP BY 1, 2), b2 AS (SELECT cut || '_unbalanced' AS lab, u, t, g, y FROM b1 UNION ALL SELECT cut || '_completed', gr.u, gr.t, gr.g, coalesce(y, 0) FROM gr LEFT JOIN b1 USING (cut, u, t)),
c AS (SELECT DISTINCT lab, g AS cohort FROM b2 WHERE g IS NOT NULL), z0 AS (SELECT b2.*, cohort, CASE WHEN t >= cohort - 1 THEN cohort - 2 ELSE t - 1 END AS b FROM b2 JOIN c USING (lab)), z AS (SELECT z0.lab, z0.u, z0.t, z0.g, cohort, b, z0.y - s.y AS d FROM z0 JOIN b2 s ON s.lab = z0.lab AND s.u = z0.u AND s.t = z0.b WHERE z0.t <> b),
k AS (SELECT lab, cohort, t, CASE WHEN g = cohort THEN 1 WHEN g IS NULL OR g > greatest(t, b) + 1 THEN 0 END AS s, d FROM z), m AS (SELECT lab, cohort, t, avg(d) FILTER (s = 1) AS m1, avg(d) FILTER (s = 0) AS m0, count(d) FILTER (s = 1) AS n1, count(d) FILTER (s = 0) AS n0 FROM k WHERE s IS NOT NULL GROUP BY 1, 2, 3),
e AS (SELECT lab, sum((m1 - m0) * n1) / sum(n1) AS att, sum(n1)::BIGINT AS n FROM m WHERE n1 > 0 AND n0 > 0 AND t >= cohort GROUP BY 1), r AS (SELECT lab, count(*) AS rows, count(DISTINCT u) AS units FROM b2 GROUP BY 1)
SELECT lab AS panel, rows, units, round(att, 6) AS att, n FROM r LEFT JOIN e USING (lab)"""


def _four(spark: SparkSession, d: str, *outcomes: str) -> DataFrame:
    """Main and strict one-to-three samples, as they are and with all months filled in: rows of four panels, from one reading."""
    base = assembled(spark, d).select("repo_name", F.col("time").alias("month"), "event", "is_treatment", *outcomes)
    strict = cohorts.with_exactly(cohorts.drop_leaky(pairs(spark, d), adoption(spark, d), END))
    units = strict.select(F.col("treatment_repo").alias("repo_name"), F.lit(1).alias("is_treatment")).unionByName(strict.select(F.col("control_repo").alias("repo_name"), F.lit(0).alias("is_treatment"))).distinct()
    held = F.collect_list(F.struct("month", *outcomes)).alias("rows")
    # A unit's months, at most a calendar, and those that its completed panel adds.
    one = base.join(units.withColumn("strict", F.lit(True)), ["repo_name", "is_treatment"], "left").groupBy("repo_name").agg(F.max("event").alias("event"), F.bool_or("strict").alias("strict"), held)
    have = F.transform("rows", lambda r: r["month"])
    every = F.transform(F.sequence(F.to_date(F.concat(F.array_min(have), F.lit("-01"))), F.lit(f"{END}-01").cast("date"), F.expr("interval 1 month")), lambda m: F.date_format(m, "yyyy-MM"))
    blank = F.transform(F.array_except(every, have), lambda m: F.struct(m.alias("month"), *[F.lit(0).cast(base.schema[c].dataType).alias(c) for c in outcomes], F.lit(False).alias("seen")))
    seen = F.transform("rows", lambda r: F.struct(r["month"].alias("month"), *[r[c].alias(c) for c in outcomes], F.lit(True).alias("seen")))
    rows = one.select("repo_name", "event", "strict", F.explode(F.concat(seen, blank)).alias("r")).select("repo_name", "event", "strict", "r.month", *[f"r.{c}" for c in outcomes], "r.seen")
    named = {"main_unbalanced": F.col("seen"), "main_completed": F.lit(True), "strict_unbalanced": F.col("seen") & F.col("strict"), "strict_completed": F.col("strict")}
    panels_ = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))
    return rows.withColumns({"panels": panels_, "t": periods.month_id(F.col("month")), "g": periods.month_id(F.col("event"))})


@query(_FOUR)
def four_panels(spark, d):
    """The group-time effect in one number, for each of the four panels."""
    rows = _four(spark, d, "commits")
    units = batched.gather(rows, "commits", "repo_name", "t", "g", label="panels")
    try:
        found, sizes = batched.group_time(units), units.sizes().collect()  # a row per panel
    finally:
        units.release()
    n = lambda g: int(sum(n for (c, t), n, m in zip(g.cells, g.treated, g.control, strict=True) if t >= c and m))
    att = {name: (round(float(g.estimate[0]), 6), n(g)) for name, g in found.items() if g.names[:1] == ["simple"]}
    return spark.createDataFrame([(r["label"], r["rows"], r["units"], *att.get(r["label"], (None, None))) for r in sizes], "panel string, rows long, units long, att double, n long")


_OUTCOMES = ("commits", "lines_added", "contributors", "commit_size", "load")
_GRID = _FOUR[: _FOUR.index("b0 AS (")] + f"""h0 AS (SELECT 'main' AS cut, repo_name AS u, {_ID.format('time')} AS t, {_ID.format('event')} AS g, commits, lines_added, contributors FROM q),
h1 AS (SELECT * FROM h0 UNION ALL SELECT 'strict', u, t, g, commits, lines_added, contributors FROM h0 WHERE (g IS NOT NULL AND u IN (SELECT treatment_repo FROM sk)) OR (g IS NULL AND u IN (SELECT control_repo FROM sk))),
gr AS (SELECT cut, u, any_value(g) AS g, unnest(range(min(t), {1998 * 12 + 12 + 1}))::INT AS t FROM h1 GROUP BY 1, 2),
h2 AS (SELECT cut || '_unbalanced' AS pan, u, t, g, commits AS c, lines_added AS l, contributors AS w FROM h1 UNION ALL SELECT cut || '_completed', gr.u, gr.t, gr.g, coalesce(commits, 0), coalesce(lines_added, 0), coalesce(contributors, 0) FROM gr LEFT JOIN h1 USING (cut, u, t)),
h3 AS (SELECT pan, u, t, g, unnest({list(_OUTCOMES)}) AS outcome, unnest([c, l, w, CASE WHEN c > 0 THEN l / c ELSE 0 END, CASE WHEN w > 0 THEN c / w ELSE 0 END]::DOUBLE[]) AS v FROM h2),
h4 AS (SELECT pan || '|' || outcome AS lab, u, t, g, ln(1 + v) AS y, coalesce(t >= g, false)::INT AS post FROM h3),
{imputed_sql('h4', 120)},
tm AS (SELECT lab, 'treat' AS term, effect FROM fx UNION ALL SELECT lab, 'tau' || (t - g), effect FROM fx WHERE t - g BETWEEN 0 AND 6)
SELECT split_part(lab, '|', 1) AS panel, split_part(lab, '|', 2) AS outcome, term, round(avg(effect), 5) AS estimate, count(*) AS n FROM tm GROUP BY ALL"""


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    """The four panels' rows once for each of five logged outcomes; labels are panel and outcome."""
    rows = _four(spark, d, "commits", "lines_added", "contributors")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    rows = rows.withColumns({"commit_size": share("lines_added", "commits"), "load": share("commits", "contributors")})
    y = F.explode(F.array(*[F.struct(F.lit(c).alias("outcome"), values.log1p_guarded(F.col(c).cast("double")).alias("y")) for c in _OUTCOMES])).alias("o")
    long = rows.select("repo_name", "t", "g", "panels", y).select("repo_name", "t", "g", "panels", "o.*")
    return long.withColumns({"labels": F.transform("panels", lambda p: F.concat_ws("|", p, "outcome")), "post": F.coalesce(F.col("t") >= F.col("g"), F.lit(False)), "rel": F.col("t") - F.col("g")})


@query(_GRID)
def outcome_grid(spark, d):
    """Static effects and effects by month since adoption, of five outcomes on four panels, as one table."""
    found = did.imputation_table(_outcomes(spark, d), "y", "repo_name", "t", F.col("post"), "g", "labels", "rel", range(7))
    name = F.split("label", r"\|")
    return found.where("n > 0").select(name[0].alias("panel"), name[1].alias("outcome"), "term", F.round("estimate", 5).alias("estimate"), "n")


@query()
def group_time_robust(spark, d):
    """Group-time effects with a covariate, doubly robust: in one number and by time since treatment, with errors and bands."""
    return did.group_time_table(_dense(spark, d), "y", "u", "t", "g", covariates=["x"], weigh="cohort", draws=199).drop("label")


@query(_DENSE + """, c AS (SELECT DISTINCT g AS cohort FROM q WHERE g IS NOT NULL), z0 AS (SELECT q.*, cohort, CASE WHEN t >= cohort - 1 THEN cohort - 2 ELSE t - 1 END AS b FROM q, c), z AS (SELECT z0.u, z0.t, z0.g, cohort, b, z0.y - s.y AS d FROM z0 JOIN q s ON s.u = z0.u AND s.t = z0.b WHERE z0.t <> b),
k AS (SELECT *, CASE WHEN g = cohort THEN 1 WHEN g IS NULL OR g > greatest(t, b) + 1 THEN 0 END AS s FROM z), m AS (SELECT cohort, t, avg(d) FILTER (s = 1) AS m1, avg(d) FILTER (s = 0) AS m0, count(d) FILTER (s = 1) AS n1, count(d) FILTER (s = 0) AS n0 FROM k WHERE s IS NOT NULL GROUP BY 1, 2 HAVING count(d) FILTER (s = 1) > 0 AND count(d) FILTER (s = 0) > 0),
ag AS (SELECT CASE WHEN e.i = 0 THEN 'simple' ELSE 'rel_' || (t - cohort) END AS term, * FROM m, (SELECT unnest([0, 1]) AS i) e WHERE e.i = 1 OR t >= cohort), w AS (SELECT term, sum((m1 - m0) * n1) / sum(n1) AS est, sum(n1) AS total FROM ag GROUP BY 1),
psi AS (SELECT term, k.u, sum(CASE WHEN k.s = 1 THEN (k.d - m1) / n1 ELSE -(k.d - m0) / n0 END * n1 / total + CASE WHEN k.s = 1 THEN (m1 - m0 - est) / total ELSE 0 END) AS v FROM ag JOIN w USING (term) JOIN k ON k.cohort = ag.cohort AND k.t = ag.t AND k.s IS NOT NULL GROUP BY 1, 2)
SELECT term, round(any_value(est), 6) AS estimate, round(sqrt(sum(v * v)), 6) AS std_error FROM psi JOIN w USING (term) GROUP BY 1""")
def group_time_errors(spark, d):
    """Aggregates of group-time effects with the errors of their influence functions."""
    found = did.group_time_table(_dense(spark, d), "y", "u", "t", "g")
    return found.select("term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"))


@query()
def lead_tests(spark, d):
    """Joint tests of the leads of three methods with three covariances."""
    return did.lead_table(_dense(spark, d), "y", "u", "t", "g", F.col("post") == 1, "rel", covariates=["x"]).drop("label")


_CATEGORIES = ("SMALL", "LARGE", "PROMO")


@query(f"""WITH cu AS (SELECT c_custkey, {_UNIT} AS u FROM customer), w AS (SELECT u, (year(o_orderdate) * 12 + month(o_orderdate))::INT AS t, split_part(p_type, ' ', 1) AS lab, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN cu ON c_custkey = o_custkey GROUP BY 1, 2, 3),
sx AS (SELECT min(t) AS lo, max(t) AS hi FROM w), g AS (SELECT lab, u, unnest(range(lo, hi + 1))::INT AS t FROM (SELECT DISTINCT u FROM cu), sx, (SELECT unnest({list(_CATEGORIES)}) AS lab)),
p AS (SELECT lab, u, t, ln(1 + coalesce(n, 0)) AS y, CASE u % 3 WHEN 0 THEN {1996 * 12 + 13} WHEN 1 THEN {1996 * 12 + 19} END AS g FROM g LEFT JOIN w USING (lab, u, t)), lq AS (SELECT *, coalesce(t >= g, false)::INT AS post FROM p),
{imputed_sql('lq')}
SELECT lab AS panel, round(avg(effect), 6) AS estimate, count(*) AS n FROM fx GROUP BY 1""")
def category_effects(spark, d):
    """The effect on the logged warnings of each category."""
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("k"), _unit().alias("u"))
    li = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(load(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).join(c, F.col("k") == F.col("o_custkey"))
    t = periods.month_id(periods.month(F.col("o_orderdate")))
    # All categories share the calendar of all warnings.
    by = li.groupBy("u", t.alias("t")).agg(*[F.count_if(F.split_part("p_type", F.lit(" "), F.lit(1)) == x).alias(x) for x in _CATEGORIES], F.count("*").alias("n"), F.lit(0.0).alias("v"))
    base = _coded_units(by, c.select("u").distinct())
    counts = base.join(by.select("u", "t", *_CATEGORIES), ["u", "t"], "left")
    y = F.explode(F.array(*[F.struct(F.lit(x).alias("panel"), values.log1p_guarded(F.coalesce(x, F.lit(0)).cast("double")).alias("y")) for x in _CATEGORIES])).alias("o")
    rows = counts.select("u", "t", "g", "post", y).select("u", "t", "g", "post", "o.*")
    found = did.imputation_table(rows, "y", "u", "t", F.col("post") == 1, "g", "panel")
    return found.select(F.col("label").alias("panel"), F.round("estimate", 6).alias("estimate"), "n")


@query(_ASSEMBLED.rstrip() + f""",
{_WARN}, k AS (SELECT repo_name, month, count(DISTINCT issue_key) AS n FROM wa WHERE cat = 'SMALL' GROUP BY ALL), s AS (SELECT DISTINCT repo_name, month FROM wa),
x AS (SELECT q.*, CASE WHEN s.repo_name IS NOT NULL AND dataset_source = 'treatment' THEN coalesce(n, 0) END AS wc FROM q LEFT JOIN s ON s.repo_name = q.repo_name AND s.month = q.time LEFT JOIN k ON k.repo_name = q.repo_name AND k.month = q.time),
y AS (SELECT * FROM x WHERE event IS NULL OR (replace(event, '-', '')::INT > 199606 AND replace(event, '-', '')::INT <= 199806))
SELECT repo_name, time, wc AS warning_count, {_ID.format('time')} AS time_id, coalesce({_ID.format('event')}, 0) AS event_id, dense_rank() OVER (ORDER BY repo_name)::INT AS repo_id, round(ln(1 + contributors), 6) AS contributors_log, 1 AS analysis_ready FROM y""")
def category_did(spark, d):
    w = warnings(spark, d)
    out = quality.category_did(assembled(spark, d), quality.category_counts(w), quality.observed(w), "SMALL", treatment_only=True, after=199606, to=199806)
    return out.select("repo_name", "time", "warning_count", "time_id", "event_id", "repo_id", F.round("contributors_log", 6).alias("contributors_log"), "analysis_ready")


@query("""WITH rel AS (SELECT 'pkg' || p_partkey % 20 AS package, p_size % 3 AS a, p_size % 7 AS b, p_partkey % 11 AS c, min(p_partkey) AS k FROM part GROUP BY 1, 2, 3, 4),
dep AS (SELECT c_custkey, 'pkg' || c_custkey % 20 AS package, c_custkey % 5 AS m FROM customer), nw AS (SELECT package, arg_max(k, a * 10000 + b * 100 + c) AS newest_k FROM rel GROUP BY 1),
v AS (SELECT c_custkey, dep.package, max(b * 100 + c) AS bc, arg_max(k, b * 100 + c) AS k FROM dep JOIN rel ON rel.package = dep.package AND a = 1 AND b >= m GROUP BY 1, 2),
h AS (SELECT dep.c_custkey, v.k IS NOT NULL AS ok, CASE WHEN v.k IS NOT NULL THEN greatest(0, date_diff('day', to_timestamp(1600000000 + v.k * 3600)::TIMESTAMP::DATE, to_timestamp(1600000000 + newest_k * 3600)::TIMESTAMP::DATE)) END AS lag,
  coalesce(v.k IS NOT NULL AND ((dep.package = 'pkg1' AND bc < 400) OR (dep.package = 'pkg2' AND bc < 200)), false) AS bad FROM dep LEFT JOIN v USING (c_custkey, package) LEFT JOIN nw USING (package))
SELECT c_custkey::VARCHAR AS repo_name, 1::BIGINT AS dependencies, ok::BIGINT AS resolved, bad::BIGINT AS vulnerable, lag::DOUBLE AS mean_lag_days FROM h""")
def dependency_health(spark, d):
    p = load(spark, d, "part")
    named = p.select(F.concat(F.lit("pkg"), (F.col("p_partkey") % 20).cast("string")).alias("package"), F.concat_ws(".", (F.col("p_size") % 3).cast("string"), (F.col("p_size") % 7).cast("string"), (F.col("p_partkey") % 11).cast("string")).alias("version"), "p_partkey")
    releases = named.groupBy("package", "version").agg(F.timestamp_seconds(F.lit(1_600_000_000) + F.min("p_partkey") * 3600).alias("released_at"))
    spec = F.concat(F.lit("^1."), (F.col("c_custkey") % 5).cast("string"), F.lit(".0"))
    name = F.concat(F.lit("pkg"), (F.col("c_custkey") % 20).cast("string"))
    manifests = load(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("repo_name"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("committed_at"), F.to_json(F.struct(F.create_map(name, spec).alias("dependencies"))).alias("manifest"))
    advisories = spark.createDataFrame([("pkg1", "<1.4.0"), ("pkg2", ">=1.0.0 <1.2.0 || 2.x")], "package string, range string").withColumn("published_at", F.timestamp_seconds(F.lit(1_650_000_000)))
    return dependency.health(dependency.vulnerable(dependency.resolve(dependency.dependencies(manifests), releases), advisories)).drop("committed_at")


@query()
def dynamic_panel_models(spark, d):
    """Eight models of velocity and debt: a row per model and term."""
    p = _dense(spark, d).withColumns({"lines_added": F.col("x"), "commits": F.col("y"), "cognitive_complexity": F.sqrt(F.abs(F.sin(F.col("u") * 7 + F.col("t"))) + F.col("y")), "static_analysis_warnings": F.col("y") * F.abs(F.cos(F.col("u") + F.col("t") * 3)), "post_event": F.col("post").cast("double")})
    fits = panels.fit_models(p, panels.gmm_models(exogenous=()), "u", "t")
    rows = [(name, n, float(b), float(e), float(e2), g.n, g.m1[1], g.m2[1]) for name, g in fits.items() for n, b, e, e2 in zip(g.names, g.beta, g.error, g.plain_error, strict=True)]
    return spark.createDataFrame(rows, "model string, term string, estimate double, std_error double, plain_error double, n long, m1_p double, m2_p double")


NAMES = [n for n in catalog.QUERIES if n not in _BEFORE]
