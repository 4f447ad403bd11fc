"""Connected components by alternating large-star and small-star steps, on DataFrames alone.

Each round is a minimum per node and a join back, written to the shared folder,
so lineage stays short and a lost executor costs one round at most. Neighbours
are never gathered: a hub's edges are joined with its minimum, which adaptive
execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.llm.common import no_broadcast, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them. Edges come as u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes with a link, the component being its least node.

    links: (u, v) of one orderable type; loops, repeats and either order are allowed.
    """
    with no_broadcast(links.sparkSession):
        return _settle(links, rounds)


def _settle(links: DataFrame, rounds: int) -> DataFrame:
    edges = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "cc")
    state = None
    for _ in range(rounds):
        edges = written(_small_star(_large_star(edges)), "cc")
        row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v") % 1000003).alias("s")).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
