"""Connected components of an edge table by alternating large-star and small-star rounds, all in joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sightline.llm.common import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(moved).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each vertex that is not the least of its component. ``edges`` has the long columns a and b.

    Self-loops, repeated edges and rows with a null end change nothing; without edges the result is empty.
    """
    ends = edges.dropna(subset=["a", "b"]).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v")
    now = materialize(ends.distinct(), "components")
    state = _state(now)
    while True:
        now = materialize(_small_star(_large_star(now)), "components")
        last, state = state, _state(now)
        if state == last:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
