"""Calendar padding, adoption and treatment coding of unit-by-month panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkiln.functions.periods import month_diff, month_id, months_between_inclusive, week_monday
from panelkiln.operators.joins import asof_forward
from panelkiln.operators.reshape import keep_one, union_all

EVENT_COLUMNS = ("repo_name", "time", "dataset_source", "ever_treated", "is_treatment", "is_treatment_dynamic", "event", "post_event", "time_to_event")


def up_to_now(by: Sequence[str], time: str):
    return Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def month_grid(df: DataFrame, keys: Sequence[str], time: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Every month of each unit, from its first (not before ``start``) to its last (or ``end``)."""
    span = df.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    first = F.greatest(F.col("_a"), F.lit(start)) if start else F.col("_a")
    last = F.lit(end) if end else F.col("_b")
    return span.select(*keys, F.explode(months_between_inclusive(first, last)).alias(time))


def week_grid(df: DataFrame, keys: Sequence[str], time: str, label: Column) -> DataFrame:
    """Every week of each unit, stepping by Mondays, the last included. label: of the column ``_day``."""
    days = df.groupBy(*keys).agg(F.min(week_monday(F.col(time))).alias("_a"), F.max(week_monday(F.col(time))).alias("_b"))
    steps = F.explode(F.sequence("_a", "_b", F.expr("interval 7 days"))).alias("_day")
    return days.select(*keys, steps).select(*keys, label.alias(time)).distinct()


def pad_periods(df: DataFrame, keys: Sequence[str], time: str, zero: Sequence[str] = (), fill: Sequence[str] = (), age: str | None = None, step_days: int = 30, grid: DataFrame | None = None) -> DataFrame:
    """Missing periods between a unit's first and last: counts 0, cumulative columns carried forward within the unit.

    ``age`` is rebuilt as the first age and ``step_days`` a period.
    """
    out = (grid if grid is not None else month_grid(df, keys, time)).join(df, [*keys, time], "left")
    w = up_to_now(keys, time)
    new = {c: F.coalesce(c, F.lit(0)) for c in zero} | {c: F.last(c, ignorenulls=True).over(w) for c in fill}
    if age:
        new[age] = F.first(age, ignorenulls=True).over(w) + step_days * (F.row_number().over(Window.partitionBy(*keys).orderBy(time)) - 1)
    return out.withColumns(new)


def complete_window(df: DataFrame, start: str, end: str, keys: Sequence[str] = ("repo_name",), time: str = "month", zero: Sequence[str] = (), false: Sequence[str] = ("cursor",)) -> DataFrame:
    """All months from the unit's first or ``start``, the later, to ``end``; those outside drop out."""
    out = month_grid(df, keys, time, start, end).join(df, [*keys, time], "left")
    new = {c: F.coalesce(c, F.lit(0)) for c in zero} | {c: F.coalesce(c, F.lit(False)) for c in false if c in df.columns}
    return out.withColumns(new)


def carry_flag(df: DataFrame, flag: str, keys: Sequence[str], time: str) -> DataFrame:
    """The last known flag of the unit itself; false before the first."""
    return df.withColumn(flag, F.coalesce(F.last(flag, ignorenulls=True).over(up_to_now(keys, time)), F.lit(False)))


def first_adoption(ts: DataFrame, keys: Sequence[str] = ("repo_name",), time: str = "month", flag: str = "cursor") -> DataFrame:
    """(unit, event): the first period with the flag; NULL for units without one."""
    return ts.groupBy(*keys).agg(F.min(F.when(F.col(flag), F.col(time))).alias("event"))


def adoption_dates(commits: DataFrame) -> DataFrame:
    """The earliest evidence commit of each repo: authored time, else committed time; ties by hash."""
    at = F.coalesce(F.try_to_timestamp("authored_at"), F.try_to_timestamp("committed_at"))
    first = keep_one(commits.withColumn("adopted_at", at).where("adopted_at IS NOT NULL"), ["repo_name"], [F.col("adopted_at"), F.col("commit_hash")])
    return first.withColumns({"adoption_date": F.to_date("adopted_at"), "adoption_month": F.date_format("adopted_at", "yyyy-MM")})


def switches(df: DataFrame, keys: Sequence[str], time: str, flag: str) -> DataFrame:
    """The periods in which a unit turns from false (or nothing) to true."""
    before = F.coalesce(F.lag(flag).over(Window.partitionBy(*keys).orderBy(time)), F.lit(False))
    return df.withColumn("_on", F.col(flag) & ~before).where("_on").select(*keys, time)


def lead_lag(tte: Column, k: int = 6, endpoints: str = "cumulative") -> dict[str, Column]:
    """lead_k..lead_1 and lag_0..lag_k of the time to event; NULL times give zeros.

    endpoints: cumulative puts all that lies beyond into the outermost, exact leaves it out.
    """
    flag = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")
    far = endpoints == "cumulative"
    out = {f"lead_{j}": flag(tte <= -j if far and j == k else tte == -j) for j in range(k, 0, -1)}
    return out | {f"lag_{j}": flag(tte >= j if far and j == k else tte == j) for j in range(k + 1)}


def treatment_panel(ts: DataFrame, events: DataFrame, mode: str = "absorbing", k: int = 6, endpoints: str = "cumulative") -> DataFrame:
    """Treated units' rows with their event coding. events: (repo_name, event as YYYY-MM).

    absorbing: once treated, always treated. switching: post_event and lags are zero in periods without the flag.
    """
    base = ts.join(events.where("event IS NOT NULL"), "repo_name").withColumnRenamed("month", "time")
    tte = month_diff(F.col("time"), F.col("event"))
    coded = base.withColumn("time_to_event", tte).withColumn("post_event", (F.col("time_to_event") >= 0).cast("int"))
    coded = coded.withColumns(lead_lag(F.col("time_to_event"), k, endpoints))
    on = F.coalesce("cursor", F.lit(False))
    if mode == "switching":
        coded = coded.withColumns({c: F.when(on, F.col(c)).otherwise(0) for c in ["post_event", *[f"lag_{j}" for j in range(k + 1)]]})
    return coded.withColumns({"dataset_source": F.lit("treatment"), "ever_treated": F.lit(1), "is_treatment": F.lit(1), "is_treatment_dynamic": on.cast("int")})


def provenance(pairs: DataFrame) -> DataFrame:
    """Per control the sorted distinct treatments, ranks and periods it was matched for, joined by "; "."""
    text = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "; ")
    return pairs.groupBy(F.col("control_repo").alias("repo_name")).agg(text("treatment_repo").alias("matched_treatment_repos"), text("match_rank").alias("match_ranks"), text("matched_period").alias("matched_periods"))


def control_panel(ts: DataFrame, pairs: DataFrame, k: int = 6) -> DataFrame:
    """Matched controls' rows: no event, zeros for its coding, and where they were matched."""
    zeros = [*[f"lead_{j}" for j in range(k, 0, -1)], *[f"lag_{j}" for j in range(k + 1)]]
    coding = {c: F.lit(0) for c in ("post_event", *zeros, "ever_treated", "is_treatment", "is_treatment_dynamic")}
    nulls = {"event": F.lit(None).cast("string"), "time_to_event": F.lit(None).cast("int")}
    return ts.withColumnRenamed("month", "time").join(provenance(pairs), "repo_name").withColumns(coding | nulls | {"dataset_source": F.lit("control"), "matched_as_control": F.lit(1)})


def leakage(control: DataFrame, evidence: DataFrame, start: str, end: str) -> DataFrame:
    """Controls with evidence of their own: whether within the window or after it. evidence: (repo_name, event)."""
    hit = control.select("repo_name").distinct().join(evidence.where("event IS NOT NULL"), "repo_name")
    return hit.select("repo_name", "event", F.when(F.col("event") > end, "after").when(F.col("event") < start, "before").otherwise("within").alias("leak"))


def assemble(treated: DataFrame, control: DataFrame, start: str, end: str) -> DataFrame:
    both = union_all([treated, control]).where(F.col("time").between(start, end))
    head = [c for c in EVENT_COLUMNS if c in both.columns]
    return both.select(*head, *[c for c in both.columns if c not in head])


def its_dataset(ts: DataFrame, adoption: DataFrame, by: Sequence[str] = ("repo_name",), time: str = "month") -> DataFrame:
    """Interrupted time series: index from 0, 1 from the adoption period on, periods since.

    An adoption in a period without a row counts from the next period that has one.
    """
    key = by[0]
    found = asof_forward(adoption.where("event IS NOT NULL"), ts.select(key, time), key, "event", time, "begin").where("begin IS NOT NULL")
    w = Window.partitionBy(*by).orderBy(time)
    out = ts.join(found.select(key, "begin"), key).withColumn("time_index", F.row_number().over(w) - 1)
    on = F.col(time) >= F.col("begin")
    out = out.withColumn("intervention", on.cast("int"))
    since = F.sum("intervention").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn("time_after_intervention", since.cast("int")).drop("begin")


def its_variables(rel: Column, k: int = 6) -> dict[str, Column]:
    """seq, post and time after, of a relative month from -k on."""
    return {"seq": rel + k + 1, "post": (rel >= 0).cast("int"), "after": F.when(rel >= 0, rel + 1).otherwise(0)}


def cohort(event: Column, after: int = 202407, to: int = 202503) -> Column:
    """Never treated (0 or NULL), or first treated within (after, to], YYYYMM."""
    e = F.coalesce(event, F.lit(0))
    return (e == 0) | ((e > after) & (e <= to))


def differences(df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], default: int | None = 0) -> DataFrame:
    """Row lags and first differences within the unit."""
    w = Window.partitionBy(*keys).orderBy(time)
    lagged = df.withColumns({f"{c}_lag": F.lag(c, 1, default).over(w) for c in columns})
    return lagged.withColumns({f"{c}_diff": F.col(c) - F.col(f"{c}_lag") for c in columns})


def calendar_lag(df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], k: int) -> DataFrame:
    """The value k months earlier by the calendar, NULL where that month has no row."""
    earlier = df.select(*keys, (month_id(F.col(time)) + k).alias("_t"), *[F.col(c).alias(f"{c}_l{k}") for c in columns])
    return df.withColumn("_t", month_id(F.col(time))).join(earlier, [*keys, "_t"], "left").drop("_t")


def value_at(df: DataFrame, keys: Sequence[str], cond: Column, value: str, name: str) -> DataFrame:
    """The value in the row where the condition holds, in all rows of the unit."""
    return df.withColumn(name, F.max(F.when(cond, F.col(value))).over(Window.partitionBy(*keys)))
