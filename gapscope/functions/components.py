"""Connected components of an edge table by alternating large- and small-star steps.

Each step is two shuffles of the (shrinking) edge table with map-side minima, so a
node with very many neighbours costs one partial row per task; the number of
steps grows with the logarithm of the longest chain, and the loop runs until
nothing changes.  Every step's edges are written to the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscope.session import reliable_checkpoint


def _to_minimum(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Point every neighbour of a node (or the larger ones) at the least of its neighbourhood.

    ``edges`` are directed (u, v): v is a neighbour of u.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = edges.join(least, "u")
    if larger_only:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    smaller = linked.where("v < u")
    return smaller.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        smaller.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = reliable_checkpoint) -> DataFrame:
    """(node, root) for every node of an edge, root the least node of its component.

    ``edges`` has two columns of one orderable type; direction, repetitions, loops
    and nulls (dropped) do not matter.  The root itself is not listed.  ``keep``
    writes a step's edges to shared storage and returns them without lineage.
    """
    a, b = edges.columns
    now = keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} <> {b}").distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both, larger_only=True).where("u <> v").distinct()
        now = keep(_to_minimum(large, larger_only=False).where("u <> v").distinct())
        # stars: every node has one parent and no parent has a parent
        split = now.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
        deep = now.select(F.col("v").alias("u")).join(now.select("u"), "u", "left_semi")
        if split.unionByName(deep).isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
