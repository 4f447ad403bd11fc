"""What a scanner has to look at: the commit of each unit at each month's end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkiln.functions.periods import month_end, months_between_inclusive
from panelkiln.operators.joins import asof_backward


def scan_input(commits: DataFrame, start: str, end: str, unit: str = "repo_name") -> DataFrame:
    """(unit, month, sha, missing, repeated): the last commit up to each month's end.

    missing: there is none yet. repeated: it is that of the month before, so one scan serves both.
    """
    months = F.explode(months_between_inclusive(F.lit(start), F.lit(end))).alias("month")
    grid = commits.select(unit).distinct().select(unit, months).withColumn("_end", month_end(F.col("month")))
    days = commits.select(unit, F.to_date("committed_at").alias("_day"), "sha")
    out = asof_backward(grid, days, unit, "_end", "_day", ["sha"]).drop("_end")
    before = F.lag("sha").over(Window.partitionBy(unit).orderBy("month"))
    return out.withColumns({"missing": F.col("sha").isNull().cast("int"), "repeated": F.coalesce(F.col("sha") == before, F.lit(False)).cast("int")})


def scan_checks(scan: DataFrame, unit: str = "repo_name") -> DataFrame:
    """Rows, repeated keys, missing and repeated commits, in one pass over key counts."""
    by = scan.groupBy(unit, "month").agg(F.count("*").alias("_n"), F.max("missing").alias("_m"), F.max("repeated").alias("_r"))
    return by.agg(F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("duplicates"), F.sum("_m").alias("missing"), F.sum("_r").alias("repeated"))
