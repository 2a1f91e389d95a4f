"""Traversals: results against brute force, and rows shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom import bindings
from graphloom.operators import graph

from .test_link import shuffled


def levels(edges, start):
    """{node: hop} from ``start`` along the edges."""
    out, frontier, hop = {start: 0}, {start}, 0
    while frontier:
        hop += 1
        frontier = {b for a, b in edges if a in frontier} - out.keys()
        out |= dict.fromkeys(frontier, hop)
    return out


@pytest.mark.parametrize("sent", [500_000, 0])
def test_hops_are_those_of_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(graph, "SENT", sent)
    r = random.Random(3)
    pairs = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(75)]
    edges = spark.createDataFrame(pairs + pairs[:20], "src string, dst string")
    edges = graph.cut(edges)
    for node in ("n1", "n2"):
        want = levels([(b, a) for a, b in pairs], node)
        got = graph.impact(edges, spark.createDataFrame([(node,)], "node string"), 4).collect()
        assert {x.node: x.hop for x in got} == {n: h for n, h in want.items() if 0 < h <= 4} and len(got) == len({x.node for x in got})
    for a, b, most in [("n1", "n2", 6), ("n2", "n9", 6), ("n5", "n40", 6), ("n7", "n33", 3), ("n7", "none", 6)] if sent else [("n1", "n2", 6)]:
        one, two = levels(pairs, a).get(b, 99), levels(pairs + [(y, x) for x, y in pairs], a).get(b, 99)
        want = (True, one) if one <= most else (False, two if two <= most else None)
        assert tuple(graph.path_length(edges, a, b, most).first()) == want


@pytest.mark.parametrize("name", ["impact_hops", "shortest_path"])
def test_only_nodes_reached_are_shuffled(spark, tmp_path, name):
    n = 4000  # parts of one supplier each, far from s1 and s2, which meet in part 1
    far = spark.range(n).select((F.col("id") + 10).alias("l_partkey"), (F.col("id") * 2 + 10).alias("l_suppkey"))
    near = spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "l_partkey long, l_suppkey long")
    far.union(near).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = shuffled(spark)
    rows = [tuple(x) for x in bindings.queries()[name](spark, str(tmp_path)).collect()]
    assert rows == ([("p1", 1)] if name == "impact_hops" else [(False, 2)])
    assert shuffled(spark) - before < 500
