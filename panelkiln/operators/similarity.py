"""Similarity of units by shared shingles: coverage and class mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shingles(docs: DataFrame, unit: str, text: str, words: int = 5) -> DataFrame:
    """(unit, shingle): distinct 64-bit hashes of runs of lower-case words."""
    ws = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    n = F.size("_w") - words + 1
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice("_w", i, words), " ")))
    return docs.select(F.col(unit).alias("unit"), ws.alias("_w")).select("unit", F.explode(F.array_distinct(runs)).alias("shingle"))


def _marks(df: DataFrame) -> DataFrame:
    """(unit, class): units with equal sets are one class, told apart by two hash sums and the size."""
    h = [F.bit_xor(F.xxhash64("shingle")), F.bit_xor(F.xxhash64("shingle", F.lit(1))), F.count("*")]
    return df.groupBy("unit").agg(F.struct(*[x.alias(f"h{i}") for i, x in enumerate(h)]).alias("class"))


def _classes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unit, class) and (class, shingle)."""
    marks = _marks(df)
    heads = marks.groupBy("class").agg(F.min("unit").alias("unit"))
    return marks, df.join(heads, "unit").select("class", "shingle")


def shared_coverage(a: DataFrame, b: DataFrame, common: int | None = None) -> DataFrame:
    """Of each pair of units with common shingles: 2 shared / (n_a + n_b).

    Exact: units of a side with equal sets are compared once, as a class, and adaptive execution splits hot shingles.
    With ``common`` (an approximation) shingles that more units of a side have don't count as shared, only in sizes.
    """

    def rare(sets: DataFrame, units: DataFrame) -> DataFrame:
        return sets if common is None else sets.join(units.groupBy("shingle").count().where(F.col("count") > common), "shingle", "left_anti")

    (marks_a, sets_a), (marks_b, sets_b) = _classes(a), _classes(b)
    x, y = rare(sets_a, a).withColumnRenamed("class", "class_a"), rare(sets_b, b).withColumnRenamed("class", "class_b")
    both = x.join(y, "shingle").groupBy("class_a", "class_b").agg(F.count("*").alias("shared"))
    name = lambda df, s: df.select(F.col("unit").alias(f"unit_{s}"), F.col("class").alias(f"class_{s}"), F.col("class.h2").alias(f"n_{s}"))
    out = both.join(name(marks_a, "a"), "class_a").join(name(marks_b, "b"), "class_b")
    return out.select("unit_a", "unit_b", "shared", "n_a", "n_b", (2 * F.col("shared") / (F.col("n_a") + F.col("n_b"))).alias("coverage"))


def clone_copies(sets: DataFrame, within: DataFrame) -> DataFrame:
    """(unit_a, unit_b, n_a, n_b, shared, coverage): each unit after the first one of its side and set, paired with that first one."""
    units = _marks(sets).join(within.select("unit", "side"), "unit")
    heads = units.groupBy("side", "class").agg(F.min("unit").alias("unit_a"))
    n = F.col("class.h2")
    again = units.join(heads, ["side", "class"]).where("unit_a < unit")
    return again.select("unit_a", F.col("unit").alias("unit_b"), n.alias("n_a"), n.alias("n_b"), n.alias("shared"), F.lit(1.0).alias("coverage"))


def clone_cascade(sets: DataFrame, least: float, within: DataFrame | None = None, by_side: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pairs, stages): all pairs of units with a coverage of ``least`` or more, found in stages of growing cost.

    sets: (unit, shingle). Units with equal sets are one class, named by its first unit; pairs are of these names, with
    unit_a before unit_b. within: (unit, side), units compared only with those of the same side. by_side: equal sets are a
    class on each side that has them, and ``clone_copies`` gives the members; without it a class stands on its first unit's
    side only, and is not compared on the sides of its other units.
    A pair at ``least`` shares at least p = least n / (2 - least) of a class's n shingles; put in order of rarity over all
    classes, the first n - p + 1 of both then have one in common. Stages: classes that meet there (prefix), those
    whose sizes allow the coverage (size), and those that have it once their whole sets are compared (clones). Frequent
    shingles stand last, so they are in no prefix of a set that has rarer ones, and are never joined with each other.
    """
    if by_side:
        units = _marks(sets).join(within.select("unit", "side"), "unit")
        first = units.groupBy("side", "class").agg(F.min("unit").alias("unit")).select("unit", F.col("class.h2").alias("n"), "side")
    else:
        first = _marks(sets).groupBy("class").agg(F.min("unit").alias("unit")).select("unit", F.col("class.h2").alias("n"))
        first = first.withColumn("side", F.lit(0)) if within is None else first.join(within.select("unit", "side"), "unit")
    # The one join that moves all shingles: sizes and sides come with the first units.
    named = sets.join(first, "unit").select("unit", "side", "n", "shingle")
    often = named.groupBy("shingle").agg(F.count("*").alias("_often"))
    share = F.ceil(F.lit(least) * F.col("n") / F.lit(2 - least) - 1e-9)
    place = F.row_number().over(Window.partitionBy("unit").orderBy("_often", "shingle"))
    head = named.join(often, "shingle").withColumn("_place", place).where(F.col("_place") <= F.col("n") - share + 1).select("unit", "side", "n", "shingle")
    a, b = (head.select(F.col("unit").alias(f"unit_{x}"), F.col("n").alias(f"n_{x}"), "side", "shingle") for x in "ab")
    meet = a.join(b, ["side", "shingle"]).where("unit_a < unit_b").select("unit_a", "unit_b", "n_a", "n_b")
    met = meet.distinct()
    # Sizes that don't allow the coverage go before anything is grouped.
    fit = meet.where(2 * F.least("n_a", "n_b") >= F.lit(least) * (F.col("n_a") + F.col("n_b")) - 1e-9).distinct()
    # A set travels as one list, and no pair as a row for each shingle.
    whole = named.groupBy("unit").agg(F.collect_list("shingle").alias("held"))
    of = lambda x: whole.select(F.col("unit").alias(f"unit_{x}"), F.col("held").alias(f"held_{x}"))
    shared = F.size(F.array_intersect("held_a", "held_b")).cast("long")
    both = fit.join(of("a"), "unit_a").join(of("b"), "unit_b").select("unit_a", "unit_b", "n_a", "n_b", shared.alias("shared"))
    pairs = both.withColumn("coverage", 2 * F.col("shared") / (F.col("n_a") + F.col("n_b"))).where(F.col("coverage") >= least - 1e-12)
    count = lambda df, name: df.agg(F.lit(name).alias("stage"), F.count("*").alias("pairs"))
    return pairs, count(met, "prefix").unionByName(count(fit, "size")).unionByName(count(pairs, "clones"))


def mixed_ratio(classes: DataFrame) -> DataFrame:
    """Share of clone classes with members on both sides. classes: (class, side)."""
    by = classes.groupBy("class").agg(F.count_distinct("side").alias("_n"))
    return by.agg(F.count("*").alias("classes"), F.count_if(F.col("_n") > 1).cast("long").alias("mixed")).withColumn("mixed_ratio", F.try_divide("mixed", "classes"))
