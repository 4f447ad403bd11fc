"""Deduplication, set operations, wide and long forms, top-k and deterministic samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkiln.functions.values import hash_bucket, hash_text


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an explicit order; only the first row of each is kept while a partition is read."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n).drop("_nth")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """By name; columns that a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_newest(old: DataFrame, new: DataFrame, keys: Sequence[str], tie: Sequence[Column]) -> DataFrame:
    """One row per key, of the new table where it has one."""
    both = union_all([old.withColumn("_age", F.lit(1)), new.withColumn("_age", F.lit(0))])
    return keep_one(both, keys, [F.col("_age"), *tie]).drop("_age")


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_anti")


def intersection(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_semi")


def ranked_long(df: DataFrame, keep: Sequence[str], columns: Sequence[str], rank: str, value: str) -> DataFrame:
    """A row per filled column; the rank counts from one."""
    items = F.posexplode(F.array(*columns))
    return df.select(*keep, items.alias("_i", value)).where(F.col(value).isNotNull() & (F.trim(value) != "")).select(*keep, (F.col("_i") + 1).cast("int").alias(rank), value)


def long(df: DataFrame, keep: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(keep), list(columns), name, value)


def wide(df: DataFrame, keep: Sequence[str], column: str, values: Sequence[str], value: str, how: str = "first") -> DataFrame:
    """A column per stated value; stating them saves a job and fixes the schema."""
    pick = {"first": lambda c: F.first(c, ignorenulls=True), "sum": F.sum, "max": F.max}[how]
    return df.groupBy(*keep).agg(*[pick(F.when(F.col(column) == v, F.col(value))).alias(str(v)) for v in values])


def wide_change(df: DataFrame, keep: Sequence[str], period: str, value: str, before: str = "pre", after: str = "post") -> DataFrame:
    """Sums before and after, their difference and the change in percent (NULL from zero)."""
    out = df.groupBy(*keep).agg(*[F.sum(F.when(F.col(period) == p, F.col(value)).otherwise(0)).alias(n) for p, n in ((before, "value_pre"), (after, "value_post"))])
    gain = F.col("value_post") - F.col("value_pre")
    return out.withColumn("change", gain).withColumn("change_pct", F.when(F.col("value_pre") != 0, gain / F.col("value_pre") * 100))


def top_by(df: DataFrame, by: Column, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(n)


def sample_units(df: DataFrame, unit: str, n: int, seed: int = 42) -> DataFrame:
    """All rows of the n units with the smallest seeded hash."""
    units = df.select(unit).distinct().orderBy(hash_text(F.col(unit), seed), unit).limit(n)
    return df.join(units, unit, "left_semi")


def sample_share(df: DataFrame, unit: str, keep: int, of: int, seed: int = 0) -> DataFrame:
    return df.where(hash_bucket(F.col(unit), of, seed) < keep)


def cap_groups(df: DataFrame, keys: Sequence[str], ident: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows a group, by seeded hash."""
    return first_rows(df, keys, [hash_text(F.col(ident), seed), F.col(ident)], n)


def key_range(df: DataFrame, keys: Sequence[str], ranges: int = 64, seen: int = 64) -> Column:
    """The number of a row's range, from 0, in the order of keys of any types, texts too; equal keys share a range.

    The cuts are every ``seen``-th of the ``ranges`` x ``seen`` rows with the smallest hashes, which are all that the driver
    gets; the same rows give the same cuts.
    """
    some = df.select(*keys).orderBy(F.xxhash64(*keys), *keys).limit(ranges * seen)
    held = some.orderBy(*keys).collect()
    cuts = list(dict.fromkeys(tuple(r) for r in held[seen // 2 :: max(1, len(held) // ranges)]))
    types = {f.name: f.dataType for f in df.select(*keys).schema}
    key = lambda values: F.struct(*[v.cast(types[k]).alias(k) for k, v in zip(keys, values, strict=True)])
    at = key([F.col(k) for k in keys])
    return F.size(F.filter(F.array(*[key([F.lit(v) for v in c]) for c in cuts]), lambda c: c <= at)) if cuts else F.lit(0)


def place_in_order(df: DataFrame, keys: Sequence[str], name: str, ranges: int = 64) -> DataFrame:
    """Adds each row's place, from 1, in the order of its keys, which no two rows share. A range's rows are sorted together, never all."""
    placed = df.withColumn("_range", key_range(df, keys, ranges))
    # A row a range.
    sizes = sorted((r["_range"], r["n"]) for r in placed.groupBy("_range").agg(F.count("*").alias("n")).collect())
    starts, total = {}, 0
    for k, n in sizes:
        starts[k] = total
        total += n
    before = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("_range")) if starts else F.lit(0)
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return placed.withColumn(name, before + inside).drop("_range")


def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """1, 2, ... in order of the names."""
    ids = place_in_order(df.select(column).distinct(), [column], name).withColumn(name, F.col(name).cast("int"))
    return df.join(ids, column)


def by_number(df: DataFrame, column: str, *then: str) -> DataFrame:
    """Sorted by a text column read as a number; what is no number comes last."""
    return df.orderBy(F.col(column).cast("string").try_cast("double").asc_nulls_last(), *then)


def capped(df: DataFrame, column: str, most: int = 0) -> DataFrame:
    """The rows of the first ``most`` values of a column by name; all of them where ``most`` is 0."""
    if most <= 0:
        return df
    return df.join(df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most), column, "left_semi")


def sum_below(df: DataFrame, at: str, amount: str, name: str, ranges: int = 64) -> DataFrame:
    """Adds the sum of ``amount`` over all rows with a smaller ``at``; ``at`` is a number and distinct.

    The values are cut into ranges at approximate quantiles (a job over the column, ``ranges`` numbers to the driver);
    sums of ranges are added up over one row each, and only a range's own rows are sorted together.
    """
    cuts = df.agg(F.percentile_approx(at, [k / ranges for k in range(1, ranges)]).alias("q")).first()["q"] or []
    of = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col(at))) if cuts else F.lit(0)
    placed = df.withColumn("_range", of)
    sums = placed.groupBy("_range").agg(F.sum(amount).alias("_sum"))
    before = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))  # a row a range
    within = F.sum(amount).over(Window.partitionBy("_range").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(amount)
    return placed.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + within).drop("_range", "_before")


def by_lookup(df: DataFrame, column: str, order: Sequence[str], *then: str) -> DataFrame:
    """Sorted by a stated order of values; others come last."""
    key = reduce(lambda acc, iv: F.when(F.col(column) == iv[1], iv[0]).otherwise(acc), reversed(list(enumerate(order))), F.lit(len(order)))
    return df.orderBy(key, *then)
