"""Schemas of the domain's landed tables, and plan-time guards. Guards read column names only, never data."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPO_EVENTS = "type string, created_at timestamp, repo string, actor string"
COMMITS = "repo_name string, sha string, author string, committed_at timestamp, added int, removed int"
EVIDENCE_COMMITS = "repo_name string, commit_hash string, author string, authored_at string, committer string, committed_at string, message string, paths string"
TS_REPOS = "repo_name string, month string, latest_commit string, cursor boolean, commits long, lines_added long, lines_removed long, contributors long"
PAIRS = "treatment_repo string, matched_period string, treatment_propensity_score double, match_rank int, control_repo string"
SCANNED = "repo_name string, month string, latest_commit string, ncloc double, bugs double, vulnerabilities double, code_smells double, duplicated_lines_density double, comment_lines_density double, cognitive_complexity double, technical_debt double"
DEFINITIONS = "rule string, type string, severity string, effort string, example_message string, category string"
QC = "check string, value string"


class MissingColumns(ValueError):
    pass


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"{what} lacks {', '.join(missing)}")
    return df


def first_available(df: DataFrame, candidates: Iterable[str], kind: str | None = None) -> Column:
    """The first of the candidate columns that the table has; NULL if it has none."""
    for c in candidates:
        if c in df.columns:
            return F.col(c)
    out = F.lit(None)
    return out.cast(kind) if kind else out


def with_alias(df: DataFrame, target: str, candidates: Iterable[str], kind: str | None = None) -> DataFrame:
    """Adds ``target`` from the first candidate that there is, unless the table has it."""
    return df if target in df.columns else df.withColumn(target, first_available(df, candidates, kind))


def insert_after(df: DataFrame, after: str, columns: dict[str, Column]) -> DataFrame:
    """Derived columns placed behind a given one."""
    order: list[Column] = []
    for c in df.columns:
        if c not in columns:
            order.append(F.col(c))
        if c == after:
            order += [e.alias(n) for n, e in columns.items()]
    return df.select(*order)


def columns_first(df: DataFrame, first: Iterable[str]) -> DataFrame:
    head = [c for c in first if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head])
