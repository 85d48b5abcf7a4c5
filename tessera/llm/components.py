"""Connected components by alternating large-star and small-star steps.

Each step joins edges with the least neighbour of a node, a partially aggregated minimum, so the centre
of a large group costs one row there; both sides of every join are written tables, which lets Spark
split a key that holds many rows. Edges turn into stars around each component's least node in a
number of rounds that grows with the logarithm of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) to (node, label): each node that has a smaller node in its component, and the least one."""
    now = scratch.save(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "least")
        large = scratch.save(both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least2 = scratch.save(large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), "least")
        joined = large.join(least2, F.col("u") == F.col("w"))
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        new = scratch.save(small, "edges")
        scratch.drop(now, least, large, least2)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
