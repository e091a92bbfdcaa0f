"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Every step is a join and an aggregation over the edges; nothing is collected. The edges are
written to the shared folder after each round, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node of its component.

    Edges with a null end and loops are left out; repeated edges count once.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    now = written(now, "edges")
    digest = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = digest(now)
    while before[0]:
        now = written(_small_star(_large_star(now)), "edges")
        after = digest(now)
        if after == before:
            break
        before = after
    tops = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
