"""Exact quantiles in four passes, in the memory of a histogram.

A double's bits, read as a whole number with the sign turned the right way, sort as
the doubles do. Each pass counts the next DIGIT bits of the values that share the
bits found so far, for all groups, columns and ranks together, and keeps the digit
that holds the rank; after four passes all 64 bits are known. What is shuffled and
held is counts by digit, never values, so one group may have all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGIT = 16
#: Ranks up to which a pass looks its bits up in a broadcast table.
FEW = 100_000


@F.pandas_udf(T.LongType())
def ordered_bits(v: pd.Series) -> pd.Series:
    """Whole numbers that sort as the doubles do; -0.0 is 0.0, NaN is above all."""
    b = (v.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(b ^ (b >> 63 & np.int64(0x7FFFFFFFFFFFFFFF)))


@F.pandas_udf(T.DoubleType())
def from_bits(k: pd.Series) -> pd.Series:
    b = k.to_numpy(np.int64)
    return pd.Series((b ^ (b >> 63 & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64))


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(*by, column, p, value): each column's quantiles in each group, interpolated between neighbours; NULLs don't count.

    A group without values has no row. Groups may be NULL.
    """
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns])).alias("_e")
    values = df.select(*by, group.alias("_g"), each).where("_e._v IS NOT NULL").select(*by, "_g", F.col("_e._c").alias("_c"), ordered_bits("_e._v").alias("_k"))
    digit = lambda i: F.shiftright("_k", 48) if i == 0 else F.shiftright("_k", 48 - DIGIT * i).bitwiseAND((1 << DIGIT) - 1)
    keys = ["_g", "_c", "_known"]

    def cumulated(counts: DataFrame) -> DataFrame:
        upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_d"))
        return counts.withColumn("_upto", upto).withColumn("_below", F.col("_upto") - F.col("_n"))

    first = values.groupBy(*by, "_g", "_c", digit(0).alias("_d")).agg(F.count("*").alias("_n")).withColumn("_known", F.lit(0).cast("long"))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    at = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), ((F.col("_all") - 1) * float(p)).alias("h")) for p in probabilities])).alias("_p")
    found = cumulated(first).withColumn("_all", total).select("*", at).select("*", F.col("_p.p").alias("p"), F.col("_p.h").alias("_h"))
    found = found.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))))
    hit = (F.col("_below") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto"))
    ranks = found.where(hit).select(*by, "_g", "_c", "p", "_h", F.col("_rank").alias("_at"), F.col("_d").cast("long").alias("_known"), (F.col("_rank") - F.col("_below")).alias("_rank"))
    most = FEW // (2 * len(columns) * len(probabilities))
    few = not by or df.select(group.alias("_g")).distinct().limit(most + 1).count() <= most
    want = ["p", "_h", "_at", "_rank"]
    for i in (1, 2, 3):
        # What is asked of the same bits, two ranks a quantile at most, goes with them, so that each pass follows the one before.
        known = ranks.groupBy(*by, *keys).agg(F.collect_list(F.struct(*want)).alias("_want")).select(*keys, F.struct(*by, "_want").alias("_w"))
        rest = values.select("_g", "_c", F.shiftright("_k", 64 - DIGIT * i).alias("_known"), digit(i).alias("_d"))
        rest = rest.join(F.broadcast(known) if few else known, keys)
        counts = cumulated(rest.groupBy(*keys, "_d").agg(F.count("*").alias("_n"), F.first("_w").alias("_w")))
        asked = counts.select("*", *[f"_w.{c}" for c in by], F.explode("_w._want").alias("_q")).select("*", *[f"_q.{c}" for c in want]).where(hit)
        ranks = asked.select(*by, "_g", "_c", "p", "_h", "_at", F.shiftleft("_known", DIGIT).bitwiseOR(F.col("_d").cast("long")).alias("_known"), (F.col("_rank") - F.col("_below")).alias("_rank"))
    weight = 1 - F.abs(F.col("_h") - F.col("_at"))
    value = F.sum(F.when(weight > 0, weight * from_bits("_known")).otherwise(0.0))
    return ranks.groupBy(*by, F.col("_c").alias("column"), "p").agg(value.alias("value"))
