"""Propensity scores, nearest neighbours and balance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkiln.operators.quantiles import quantiles
from panelkiln.operators.reshape import key_range, sum_below


def _first_names(rows: DataFrame, keys: Sequence[str], name: str, k: int, parts: int = 16) -> DataFrame:
    """The first k names at each place; a place that many share is cut by hash first."""
    salt = F.pmod(F.xxhash64(name), F.lit(parts))
    top = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, *by).orderBy(name))).where(F.col("_n") <= k).drop("_n")
    return top(top(rows.withColumn("_salt", salt), "_salt")).drop("_salt")


def nearest(treated: DataFrame, controls: DataFrame, within: Sequence[str], score: str = "score", unit: str = "repo_name", k: int = 3, ranges: int = 64) -> DataFrame:
    """The k controls nearest in score within the same group: (unit, control, rank, distance); ties by name.

    A control may serve several units; a unit is never its own control. Candidates are the k + 1 distinct scores on
    either side: of controls with one score only the first k + 1 by name count - one more than are wanted, as the unit
    itself may be among them. Pairs are never enumerated, and no task sorts a whole group: both sides' scores, a place
    each, are cut into ranges of (group, score). A range finds its neighbours in one sorted pass; the k + 1 outermost
    places of each range of a group that is cut, a bounded table, serve the ranges beside it.
    """
    want, k = k, k + 1
    c = controls.select(*within, F.col(unit).alias("_c"), F.col(score).cast("double").alias("_s"))
    place = _first_names(c, [*within, "_s"], "_c", k).groupBy(*within, "_s").agg(F.array_sort(F.collect_list("_c")).alias("_names"))
    t = treated.select(*within, F.col(unit).alias("_t"), F.col(score).cast("double").alias("_s"))
    asked = t.select(*within, "_s").distinct()
    kind = dict(place.dtypes)["_names"]
    none = F.lit(None).cast(f"struct<_s:double,_names:{kind}>")
    line = place.select(*within, "_s", F.lit(False).alias("_ask"), F.struct("_s", "_names").alias("_p")).unionByName(asked.select(*within, "_s", F.lit(True).alias("_ask"), none.alias("_p")))
    line = line.withColumn("_r", key_range(line.select(*within, "_s"), [*within, "_s"], ranges))
    # Running lists of the last k places: a row of the line sees at most k of them, whatever the range's size.
    inside = Window.partitionBy("_r", *within)
    down, up = inside.orderBy(F.asc("_s"), F.asc("_ask")), inside.orderBy(F.desc("_s"), F.asc("_ask"))
    edges = line
    for name, w in (("_below", down), ("_above", up)):
        here = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        line = line.withColumn("_i", F.sum(F.when(F.col("_p").isNotNull(), 1).otherwise(0)).over(here))
        ranked = [F.last(F.when(F.col("_p").isNotNull() & (F.col("_i") % k == j), F.col("_p")), ignorenulls=True).over(here) for j in range(k)]
        line = line.withColumn(name, F.array_compact(F.array(*ranked)))
    # Groups that are cut are fewer than ranges, and have k places on either side of each.
    cut = edges.groupBy(*within).agg(F.count_distinct("_r").alias("_n")).where("_n > 1")
    held = edges.where(F.col("_p").isNotNull()).join(F.broadcast(cut.drop("_n")), list(within), "left_semi") if within else edges.where(F.col("_p").isNotNull())
    outer = [F.row_number().over(inside.orderBy(d("_s"))) <= k for d in (F.asc, F.desc)]
    held = held.withColumns({"_lo": outer[0], "_hi": outer[1]}).where("_lo OR _hi")
    carried = held.groupBy(*within).agg(F.array_sort(F.collect_list(F.struct("_s", F.col("_p._names").alias("_names"), "_r"))).alias("_edges"))
    asks = line.where("_ask").select(*within, "_s", "_r", "_below", "_above")
    asks = asks.join(F.broadcast(carried), list(within), "left") if within else asks.crossJoin(F.broadcast(carried))  # one row
    plain = lambda e: F.transform(e, lambda p: F.struct(p["_s"].alias("_s"), p["_names"].alias("_names")))
    some = lambda e: F.coalesce(e, F.array().cast(f"array<struct<_s:double,_names:{kind},_r:int>>"))
    before = F.filter(some(F.col("_edges")), lambda e: e["_r"] < F.col("_r"))
    after = F.filter(some(F.col("_edges")), lambda e: e["_r"] > F.col("_r"))
    far = F.concat(plain(F.slice(F.reverse(before), 1, k)), plain(F.slice(after, 1, k)))
    found = asks.select(*within, "_s", F.array_distinct(F.concat("_below", "_above", far)).alias("_places"))
    near = t.join(found, [*within, "_s"]).select(*within, "_t", F.col("_s").alias("_score"), F.explode("_places").alias("_p"))
    each = near.select(*within, "_t", F.abs(F.col("_p._s") - F.col("_score")).alias("distance"), F.explode("_p._names").alias("control")).where(~F.col("control").eqNullSafe(F.col("_t")))
    rank = F.row_number().over(Window.partitionBy(*within, "_t").orderBy("distance", "control"))
    return each.withColumn("match_rank", rank).where(F.col("match_rank") <= want).select(*within, F.col("_t").alias("treatment"), "control", "match_rank", "distance")


def matched_wide(pairs: DataFrame, k: int = 3) -> DataFrame:
    """One row per treatment with matched_control_1 to k."""
    return pairs.groupBy("treatment").agg(*[F.max(F.when(F.col("match_rank") == i, F.col("control"))).alias(f"matched_control_{i}") for i in range(1, k + 1)])


def standardised(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(x - mean) / population sd, 0 for constants; the moments come from one aggregate."""
    row = df.agg(*[f(c).alias(f"{c}{s}") for c in features for f, s in ((F.avg, "_m"), (F.stddev_pop, "_s"))]).first()
    unit = lambda c: (F.col(c) - F.lit(float(row[f"{c}_m"] or 0))) / F.lit(float(row[f"{c}_s"] or 0) or 1.0)
    return df.withColumns({c: unit(c) for c in features})


def propensity(df: DataFrame, features: Sequence[str], label: str = "treated", c: float = 1.0) -> DataFrame:
    """Adds ``score``: L2-regularised logistic regression on standardised features (inverse strength ``c``)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    scaled = standardised(df, features)
    ready = VectorAssembler(inputCols=list(features), outputCol="_x").transform(scaled.withColumn("_y", F.col(label).cast("double")))
    n = ready.count()
    model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1 / (c * max(1, n)), standardization=False, maxIter=200, tol=1e-9, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_l")
    scored = model.fit(ready).transform(ready).withColumn("score", vector_to_array("_p")[1])
    return scored.drop("_x", "_y", "_p", "_r", "_l")


def propensity_by(df: DataFrame, features: Sequence[str], by: str, label: str = "treated", c: float = 1.0, steps: int = 40) -> DataFrame:
    """Adds ``score``: a regularised logistic regression for each value of ``by``, all of them fitted at once.

    As ``propensity`` does for one: features are standardised within the group, and half the squared slopes over ``c`` are
    added to the negative log likelihood. A Newton step is one pass over the distinct rows and their numbers: each task adds up weighted products by group, a row per
    (group, entry) leaves it, and the driver solves a system of features + 1 for each group; groups are periods, as many as
    the calendar has. A group without both labels, or a row without a feature, has no score.
    """
    k = len(features) + 1
    # A row per period.
    moments = df.dropna(subset=[by, label, *features]).groupBy(by).agg(F.avg(F.col(label).cast("double")).alias("_y"), *[f(F.col(x).cast("double")).alias(f"{x}{s}") for x in features for f, s in ((F.avg, "_m"), (F.stddev_pop, "_s"))]).collect()
    at = {r[by]: (np.array([r[f"{x}_m"] for x in features]), np.array([r[f"{x}_s"] or 1.0 for x in features])) for r in moments if 0 < r["_y"] < 1}
    beta = {g: np.zeros(k) for g in at}
    # Rows that agree in period, label and features are one row with their number: each Newton step reads these.
    rows = df.select(F.col(by).alias("g"), F.col(label).cast("double").alias("y"), *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(features)]).dropna()
    rows = rows.groupBy(*rows.columns).agg(F.count("*").cast("double").alias("n")).persist()
    kind = df.select(by).schema[0].dataType

    def groups(batch: pa.RecordBatch) -> Iterator[tuple]:
        g, v = np.array(batch.column(0).to_pylist(), object), np.stack([x.to_numpy(zero_copy_only=False) for x in batch.columns[1:]], 1)
        for name in set(g.tolist()):
            if name in at:
                mine = v[g == name]
                mean, spread = at[name]
                yield name, mine[:, 0], mine[:, -1], np.concatenate([np.ones((len(mine), 1)), (mine[:, 1:-1] - mean) / spread], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        key = pa.null()
        for batch in batches:
            key = batch.schema.field(0).type
            for name, y, n, x in groups(batch):
                p = 1 / (1 + np.exp(-np.clip(x @ beta[name], -500, 500)))
                v = np.concatenate([((x * (n * p * (1 - p))[:, None]).T @ x).ravel(), x.T @ (n * (y - p))])
                total[name] = total.get(name, 0) + v
        for name, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(v), key), pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], names=["g", "at", "v"])

    penalty = np.diag([0.0, *[1 / c] * (k - 1)])
    try:
        for _ in range(steps if at else 0):
            sums = {g: np.zeros(k * k + k) for g in at}
            for g, i, v in rows.mapInArrow(run, f"g {kind.simpleString()}, at int, v double").groupBy("g", "at").agg(F.sum("v")).collect():
                sums[g][i] = v
            moved = 0.0
            for g, v in sums.items():
                step = np.linalg.solve(v[: k * k].reshape(k, k) + penalty + 1e-12 * np.eye(k), v[k * k :] - penalty @ beta[g])
                beta[g] = beta[g] + step
                moved = max(moved, float(np.abs(step).max()))
            if moved < 1e-10:
                break
    finally:
        rows.unpersist()
    fits = [(g, float(b[0]), *[float(x) for x in b[1:] / at[g][1]], *[float(x) for x in at[g][0]]) for g, b in beta.items()]
    names = [*[f"_b{i}" for i in range(k)], *[f"_c{i}" for i in range(1, k)]]
    schema = T.StructType([T.StructField("_g", kind), *[T.StructField(n, T.DoubleType()) for n in names]])
    table = F.broadcast(df.sparkSession.createDataFrame(fits, schema))  # a row per period
    index = F.col("_b0") + sum(((F.col(x).cast("double") - F.col(f"_c{i}")) * F.col(f"_b{i}") for i, x in enumerate(features, 1)), F.lit(0.0))
    return df.join(table, F.col(by) == F.col("_g"), "left").withColumn("score", 1 / (1 + F.exp(-index))).drop("_g", *names)


def match_by_period(df: DataFrame, features: Sequence[str], by: str, within: Sequence[str] = (), label: str = "treated", unit: str = "repo_name", k: int = 3) -> tuple[DataFrame, DataFrame]:
    """(pairs, scored): scores of each period's own fit, and for each treated unit the k nearest controls of its period and group."""
    scored = propensity_by(df, features, by, label)
    known = scored.where("score IS NOT NULL")
    return nearest(known.where(F.col(label) == 1), known.where(F.col(label) == 0), [by, *within], "score", unit, k), scored


def diagnostics(scored: DataFrame, label: str = "treated", score: str = "score", cut: float = 0.5) -> DataFrame:
    """AUC by average ranks, McFadden's R2, precision and recall: sums over score groups, so ties weigh half.

    Scores are grouped first; the running sum is over distinct scores, in ranges of them.
    """
    y = F.col(label)
    by = scored.groupBy(F.col(score).alias("_s")).agg(F.sum(y).alias("_pos"), F.sum(1 - y).alias("_neg"))
    ranked = sum_below(by, "_s", "_neg", "_below")
    auc = ranked.agg((F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2)) / (F.sum("_pos") * F.sum("_neg"))).alias("auc"))
    p, s = F.greatest(F.least(F.col(score), F.lit(1 - 1e-10)), F.lit(1e-10)), F.col(score) >= cut
    base = scored.agg(F.avg(y).alias("_m"), F.count("*").alias("n"), F.sum(y * F.log(p) + (1 - y) * F.log(1 - p)).alias("_ll"), F.count_if(s & (y == 1)).alias("_tp"), F.count_if(s).alias("_pp"), F.sum(y).alias("_p"))
    null = F.col("n") * (F.col("_m") * F.log("_m") + (1 - F.col("_m")) * F.log(1 - F.col("_m")))
    return base.select("n", (1 - F.col("_ll") / null).alias("mcfadden_r2"), F.try_divide("_tp", "_pp").alias("precision"), F.try_divide("_tp", "_p").alias("recall")).crossJoin(auc)  # one row each


def balance_table(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """Mean, median and variance of each feature by group (1 and 0), and the normalised difference of means."""
    picks: list[Column] = []
    for c in features:
        for g, s in ((1, "t"), (0, "c")):
            x = F.when(F.col(group) == g, F.col(c).cast("double"))
            picks += [F.avg(x).alias(f"{c}|mean_{s}"), F.var_samp(x).alias(f"{c}|var_{s}")]
    one = df.agg(*picks)
    stats = ("mean_t", "mean_c", "var_t", "var_c")
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"`{c}|{s}`").alias(s) for s in stats]) for c in features])).alias("r")
    medians = quantiles(df.where(F.col(group).isin(0, 1)), features, [0.5], [group])
    # A row per feature.
    medians = medians.groupBy(F.col("column").alias("feature")).agg(*[F.max(F.when(F.col(group) == g, F.col("value"))).alias(f"median_{s}") for g, s in ((1, "t"), (0, "c"))])
    out = one.select(rows).select("r.*").join(medians, "feature", "left").select("feature", "mean_t", "mean_c", "median_t", "median_c", "var_t", "var_c")
    return out.withColumn("normalised_difference", (F.col("mean_t") - F.col("mean_c")) / F.sqrt((F.col("var_t") + F.col("var_c")) / 2))


def same_language(df: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.lower(c) == F.lower(columns[0]) for c in columns[1:]], F.lit(True))
