"""Strongly connected components of a directed edge table by forward and backward reachability.

Every part (at first: what the caller gives, such as undirected components) gets one
pivot, the node with most neighbours on its scarcer side.  What the pivot reaches and
what reaches it are found together, for all parts at once, by frontiers joined with the
edges; both sets' intersection is the pivot's component.  A component never crosses the
sets, so each of the three rests becomes a part of its own for the next round.  Nodes
without an edge in or out are dropped first.  Frontiers and edges are written to the
shared checkpoint folder; nothing but "is it empty" reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscope.session import reliable_checkpoint


def _reached(moves: DataFrame, start: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(part, node, way) reachable from ``start`` by ``moves`` (part, node, way, to), itself included."""
    seen = front = keep(start)
    while True:
        front = keep(front.join(moves, ["part", "node", "way"]).select("part", F.col("to").alias("node"), "way").distinct()
                     .join(seen, ["part", "node", "way"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def strong_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = reliable_checkpoint) -> DataFrame:
    """(node, block) of every node in a component of two nodes or more; block is the component's least node.

    ``edges``: (part, u, v), an edge from u to v, parts as strings; both ends of an edge lie in its part.
    Repetitions and loops do not matter.
    """
    live = keep(edges.select("part", "u", "v").where("u <> v").distinct())
    found = live.select(F.col("u").alias("node"), F.col("u").alias("pivot")).where("false")
    while True:
        ends = (live.select("part", F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in"))
                .unionByName(live.select("part", F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
                .groupBy("part", "node").agg(F.least(F.sum("out"), F.sum("in")).alias("both")).where("both > 0"))
        ends = keep(ends)
        if ends.isEmpty():
            blocks = found.groupBy("pivot").agg(F.min("node").alias("block"), F.count(F.lit(1)).alias("n")).where("n > 1")
            return found.join(blocks, "pivot").select("node", "block")
        pivots = ends.groupBy("part").agg(F.max_by("node", F.struct("both", "node")).alias("node"))
        moves = live.select("part", F.col("u").alias("node"), F.lit("f").alias("way"), F.col("v").alias("to")).unionByName(
            live.select("part", F.col("v").alias("node"), F.lit("b").alias("way"), F.col("u").alias("to")))
        start = pivots.select("part", "node", F.explode(F.array(F.lit("f"), F.lit("b"))).alias("way"))
        sides = _reached(moves, start, keep).groupBy("part", "node").agg(F.concat_ws("", F.sort_array(F.collect_set("way"))).alias("side"))
        sides = keep(sides)
        met = sides.where("side = 'bf'").join(pivots.select("part", F.col("node").alias("pivot")), "part")
        found = keep(found.unionByName(met.select("node", "pivot")))
        at = ends.select("part", "node").join(sides, ["part", "node"], "left").fillna("", ["side"])
        of = lambda end: at.select("part", F.col("node").alias(end), F.col("side").alias(f"{end}_side"))
        live = keep(live.join(of("u"), ["part", "u"]).join(of("v"), ["part", "v"]).where("u_side = v_side and u_side <> 'bf'")
                    .select(F.concat("part", F.lit("/"), "u_side").alias("part"), "u", "v"))
