"""Joins with invariants, as-of joins and fuzzy key joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkiln.functions.values import author_keys

#: Rows up to which a dimension is broadcast; it is counted first.
DIMENSION = 100_000


class NotOneToOne(ValueError):
    pass


def dimension(df: DataFrame, most: int = DIMENSION) -> DataFrame:
    """The table with a broadcast hint if it has ``most`` rows or fewer (one bounded count); else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def enrich(df: DataFrame, dim: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(dim, on, "left")


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """``value`` of the dimension, the default where it has no row or a NULL."""
    return df.join(dim.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join after a check that neither side repeats a key: one job over the keys of both that stops at a repeat."""
    sides = [duplicate_keys(df.select(*keys), keys).select(F.lit(side).alias("side")) for side, df in (("left", left), ("right", right))]
    if bad := sides[0].union(sides[1]).take(1):
        raise NotOneToOne(f"the {bad[0]['side']} side repeats keys ({', '.join(keys)})")
    return left.join(right, list(keys), "left")


def suffixed(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    """Left join; columns that both have get the suffix on the right."""
    clash = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in keys}
    return left.join(right.withColumnsRenamed(clash), list(keys), "left")


def combine_first(df: DataFrame, target: str, *others: str) -> DataFrame:
    have = [F.col(c) for c in (target, *others) if c in df.columns]
    return df.withColumn(target, F.coalesce(*have)).drop(*[c for c in others if c in df.columns])


def previous(df: DataFrame, by: str, at: str, name: str = "previous") -> DataFrame:
    """Per distinct (by, at): the latest earlier value of ``at``; equal ones don't count."""
    return df.select(by, at).distinct().withColumn(name, F.lag(at).over(Window.partitionBy(by).orderBy(at)))


def asof_backward(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, take: Sequence[str], tie: str | None = None) -> DataFrame:
    """Each left row with ``take`` of the last right row of its group that is not later; NULL if there is none.

    One union and one window, so nothing is joined by range; of right rows at one time the greatest ``tie`` counts.
    """
    held = F.struct(*take)
    tie = tie or take[0]
    a = left.select(F.col(by).alias("_by"), F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(held.alias("x")).schema["x"].dataType).alias("_right"))
    b = right.select(F.col(by).alias("_by"), F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), held.alias("_right"))
    w = Window.partitionBy("_by").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = a.unionByName(b).withColumn("_found", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    return found.select("_left.*", *[F.col(f"_found.{c}").alias(c) for c in take])


def asof_forward(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, name: str) -> DataFrame:
    """Each left row with the first value of ``right_at`` in its group that is not earlier."""
    low = left.groupBy(by, left_at).agg(F.count("*").alias("_n"))
    a = low.select(by, F.col(left_at).alias("_at"), F.lit(1).alias("_side"))
    b = right.select(by, F.col(right_at).alias("_at"), F.lit(0).alias("_side")).distinct()
    w = Window.partitionBy(by).orderBy(F.desc("_at"), F.asc("_side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    next_ = a.unionByName(b).withColumn(name, F.last(F.when(F.col("_side") == 0, F.col("_at")), ignorenulls=True).over(w)).where("_side = 1")
    return left.join(next_.select(by, F.col("_at").alias(left_at), name), [by, left_at], "left")


def latest(df: DataFrame, by: Sequence[str], period: str) -> DataFrame:
    """Distinct rows of each group's last period: one aggregate and a join on it."""
    last = df.groupBy(*by).agg(F.max(period).alias(period))
    return df.join(last, [*by, period], "left_semi").distinct()


def version_match(wanted: DataFrame, versions: DataFrame, by: str, key: Column, value: str, newest: str) -> DataFrame:
    """Wanted rows with the value of the version of equal normalised key, the newest of several."""
    best = versions.withColumn("_key", key).groupBy(by, "_key").agg(F.max_by(value, newest).alias(value))
    return wanted.withColumn("_key", key).join(best, [by, "_key"], "left").drop("_key")


def author_match(events: DataFrame, authors: DataFrame, repo: str = "repo_name", actor: str = "actor", author: str = "author") -> DataFrame:
    """The events whose actor is one of the repo's authors, met by any of an author's keys."""
    keys = authors.select(repo, F.explode(author_keys(F.col(author))).alias("_key")).distinct()
    return events.withColumn("_key", F.lower(F.trim(actor))).join(keys, [repo, "_key"], "left_semi").drop("_key")


def theta_periods(repos: DataFrame, events: DataFrame, periods: DataFrame, on: str = "repo") -> DataFrame:
    """Repos x periods, with the events of the period (within) or before its start (sum): an equi-join with a residual.

    periods: (period, period_type, ym, start). A parameter table, counted before it is broadcast.
    """
    grid = repos.select(on).distinct().crossJoin(dimension(periods, 1000))
    e, g = events.alias("e"), grid.alias("g")
    hit = ((F.col("g.period_type") == "within") & (F.col("e.ym") == F.col("g.ym"))) | ((F.col("g.period_type") == "sum") & (F.col("e.ym") < F.col("g.start")))
    return g.join(e, (F.col(f"g.{on}") == F.col(f"e.{on}")) & hit, "left").select("g.*", *[F.col(f"e.{c}").alias(c) for c in events.columns if c not in (on, "ym")])
