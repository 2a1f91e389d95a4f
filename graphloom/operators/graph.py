"""Traversals of the edge table: a loop of joins, one for each hop.

Each hop reads the edges once, so they are best handed over as a stored table;
they need not be distinct. Only the nodes reached are shuffled and stored, as long
as a frontier is small enough to be sent to every task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config as C
from ..plans.lineage import cut

#: A frontier of up to so many nodes is sent to every task. Of a larger one each task hashes its part, and the edges stream past it.
SENT = 500_000


def _hop(steps: DataFrame, frontier: DataFrame, size: int, seen: DataFrame) -> DataFrame:
    """(node): what the steps (node, next) lead to from the frontier's ``size`` nodes, without those seen."""
    here = F.broadcast(frontier) if size <= SENT else frontier.hint("shuffle_hash")
    new = steps.join(here, "node", "left_semi").select(F.col("next").alias("node")).distinct()
    return new.join(seen, "node", "left_anti")


def _steps(edges: DataFrame, node: str, next_: str) -> DataFrame:
    return edges.select(F.col(node).alias("node"), F.col(next_).alias("next"))


def impact(edges: DataFrame, start: DataFrame, max_hops: int = 3) -> DataFrame:
    """(node, hop): what reaches ``start`` (one column, node) against the edges (src, dst), at its first hop."""
    hops = min(max(1, max_hops), C.MAX_HOPS)
    back = _steps(edges, "dst", "src")
    seen = frontier = cut(start.select("node").distinct())
    out = None
    for hop in range(1, hops + 1):
        size = frontier.count()
        if hop > 1 and not size:
            break
        frontier = _hop(back, frontier, size, seen)
        if hop < hops:
            frontier = cut(frontier)
            seen = seen.unionByName(frontier)
        found = frontier.withColumn("hop", F.lit(hop))
        out = found if out is None else out.unionByName(found)
    return out


def _meeting(edges: DataFrame, source: DataFrame, target: DataFrame, hops: int) -> int | None:
    """Length of the shortest path of at most ``hops``, from both ends: each time the end with the fewer nodes takes a step.

    After i steps of one end and j of the other a path of i + j edges has a node in
    both frontiers, and if no shorter one was found, so has no other.
    """
    ends = [(_steps(edges, "src", "dst"), source, 1, source), (_steps(edges, "dst", "src"), target, 1, target)]
    for hop in range(1, hops + 1):
        (steps, frontier, size, seen), other = sorted(ends, key=lambda x: x[2])
        frontier = cut(_hop(steps, frontier, size, seen))
        size = frontier.count()
        if not size:
            return None
        small, large = (frontier, other[1]) if size <= other[2] else (other[1], frontier)
        small = F.broadcast(small) if min(size, other[2]) <= SENT else small
        if not large.join(small, "node", "left_semi").isEmpty():
            return hop
        ends = [(steps, frontier, size, seen.unionByName(frontier)), other]
    return None


def path_length(edges: DataFrame, source, target, max_hops: int = 6) -> DataFrame:
    """One row (directed, hops) of the shortest path; undirected where no directed one exists; hops null if none."""
    spark, schema = edges.sparkSession, "directed boolean, hops int"
    if source == target:
        return spark.createDataFrame([(True, 0)], schema)
    one_way = edges.select("src", "dst")
    both = one_way.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    start, end = (spark.createDataFrame([(x,)], "node " + dict(edges.dtypes)["src"]) for x in (source, target))
    for directed, table in ((True, one_way), (False, both)):
        hops = _meeting(table, start, end, min(max(1, max_hops), C.MAX_HOPS))
        if hops is not None:
            return spark.createDataFrame([(directed, hops)], schema)
    return spark.createDataFrame([(False, None)], schema)
