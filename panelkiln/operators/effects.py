"""Result tables of estimators: normalising, formatting, summaries. They have a row per outcome and term."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkiln.functions.values import excludes_zero, humanise, normal_p, percent, stars, trailing_integer
from panelkiln.operators.reshape import by_lookup, wide

Z95 = 1.96


def normalise_static(results: DataFrame) -> DataFrame:
    """Confidence limits and p from estimate and error where they are missing."""
    z = F.col("estimate") / F.nullif("std_error", F.lit(0.0))
    return results.withColumns({
        "conf_low": F.coalesce("conf_low", F.col("estimate") - Z95 * F.col("std_error")),
        "conf_high": F.coalesce("conf_high", F.col("estimate") + Z95 * F.col("std_error")),
        "p_value": F.coalesce("p_value", normal_p(z)),
    })


def normalise_dynamic(results: DataFrame, term: str = "term") -> DataFrame:
    """Adds ``time``, the signed number at the term's end, and whether the interval leaves zero out."""
    out = normalise_static(results).withColumn("time", trailing_integer(F.col(term)))
    return out.withColumn("significant", excludes_zero(F.col("conf_low"), F.col("conf_high")))


def effect_table(results: DataFrame, legend: str = "three", outcomes: Sequence[str] = (), panels: Sequence[str] = ()) -> DataFrame:
    """Percent changes, stars, interval flag and a formatted estimate; sorted by panel and outcome."""
    out = normalise_static(results)
    low, high = F.col("conf_low"), F.col("conf_high")
    out = out.withColumns({"estimate_pct": percent(F.col("estimate")), "conf_low_pct": percent(low), "conf_high_pct": percent(high), "stars": stars(F.col("p_value"), legend), "ci_excludes_zero": excludes_zero(low, high), "outcome_label": humanise(F.col("outcome"))})
    text = F.format_string("%.1f%%%s [%.1f%%, %.1f%%]", "estimate_pct", "stars", "conf_low_pct", "conf_high_pct")
    out = out.withColumn("formatted", F.when(F.col("estimate").isNotNull(), text))
    return by_lookup(out, "panel", panels, "outcome") if panels else out


def effects_wide(table: DataFrame, metrics: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """A row per panel with ``metric_outcome`` columns."""
    out = None
    for m in metrics:
        part = wide(table, ["panel"], "outcome", outcomes, m)
        part = part.select("panel", *[F.col(o).alias(f"{m}_{o}") for o in outcomes])
        out = part if out is None else out.join(part, "panel")
    return out


def pretrend_summary(dynamic: DataFrame) -> DataFrame:
    """Per outcome the number of terms before and from the event on, and of significant ones."""
    before, sig = F.col("time") < 0, F.col("significant")
    n = lambda c: F.count_if(c).cast("long")
    return dynamic.groupBy("outcome").agg(n(before).alias("pre_terms"), n(before & sig).alias("pre_significant"), n(~before).alias("post_terms"), n(~before & sig).alias("post_significant"))


def compare_published(table: DataFrame, published: DataFrame) -> DataFrame:
    """The difference in percentage points from published percent effects: (outcome, published_pct)."""
    return table.join(published, "outcome").withColumn("difference_pp", F.col("estimate_pct") - F.col("published_pct"))


def markdown(df: DataFrame) -> str:
    """A Markdown table of a small result, pipes escaped."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    head = f"| {' | '.join(map(cell, df.columns))} |\n|{' --- |' * len(df.columns)}\n"
    return head + "".join(f"| {' | '.join(map(cell, row))} |\n" for row in df.toLocalIterator())


def p_or_missing(c: Column) -> Column:
    return F.when(c.isNotNull(), F.when(c < 0.001, "<0.001").otherwise(F.format_string("%.3f", c))).otherwise("")
