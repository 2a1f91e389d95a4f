"""Connected components of a link table, by repeated min-label contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import shared_dir


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node that each linked node reaches.

    ``links`` has long columns a, b. Alternates large-star and small-star, so
    the rounds grow with the logarithm of a component's diameter. Every round
    groups by node with map-side partial minima, and is cut by ``checkpoint()``.
    A node with a very large number of links is never gathered: both stars are a
    minimum per node joined back on the links.
    """
    shared_dir(links.sparkSession)
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    for _ in range(max_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: larger neighbours of u link to the least of u's closed neighbourhood
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small star: u and its smaller neighbours link to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .filter("u != v").distinct().checkpoint()
        )
        same = small.count() == edges.count() and small.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = small
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
