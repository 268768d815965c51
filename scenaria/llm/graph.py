"""Connected components of an undirected graph by alternating large-star and small-star steps.

Both sides of a step's join are shuffled by the vertex anyway. The merge hints keep Spark from broadcasting a side that
turns out small: each broadcast is a job more and goes through the driver's memory, and an operator has many such steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a vertex to the least vertex around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    return both.filter("b > a").join(least.hint("merge"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins a vertex and its smaller neighbours to the least of them; edges come as a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least.hint("merge"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(vertex, component) for every vertex of an edge, the component named by its least vertex.

    Ends when the edges are stars around the least vertices: each vertex then has one edge, and no
    centre has an edge of its own. Steps are joins and map-side combined minima; a hot vertex is one
    key of a join that Spark can split.
    """
    state = scratch.save(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    seen = state.select(mark.alias("m")).first().m
    while seen.n:
        # Saved in between: each step reads its edges several times, and a plan of both would hold the first one's each time.
        large = scratch.save(_large_star(state), "large-star")
        state = scratch.save(_small_star(large), "edges")
        scratch.drop(large)
        now = state.select(mark.alias("m")).first().m
        if now == seen:
            break
        seen = now
    return state.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(
        state.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    )
