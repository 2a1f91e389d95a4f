"""The query tools over a stored graph: tables in, tables out.

repos (name, summary, domain, kind, ...), edges (from, to, kind, key, name, detail,
evidence, match), unresolved and generic (repo, kind, key, ...), external_nodes
(id, label, kind, hosts), external_edges (as edges; ``to`` is a node's id),
shared (name, repos map).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..plans.lineage import cut

EDGE_FIELDS = ("from", "to", "kind", "key", "name", "detail", "evidence", "match")


def _of(column: str, value: str | None) -> Column:
    """Equality with a filter that may be left out."""
    return F.lit(True) if not value else F.col(column) == value


def edge_view(rows: DataFrame, *more: str) -> Column:
    """JSON of a row's edge fields, without those that are null or empty."""
    fields = [c for c in (*EDGE_FIELDS, *more) if c in rows.columns]
    return F.to_json(F.struct(*(F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields)))


def external_view(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """External edges with the label of their node; the id where it has none."""
    labels = nodes.select(F.col("id").alias("to"), F.nullif("label", F.lit("")).alias("label"))
    return edges.join(labels, "to", "left").withColumn("label", F.coalesce("label", "to")).select(*edges.columns, "label")


def list_repos(repos: DataFrame, domain: str | None = None, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the repositories of a domain and kind by name, one row (count, domains)); domains are those of all repositories."""
    chosen = repos.filter(_of("domain", domain) & _of("kind", kind))
    domains = repos.agg(F.array_sort(F.collect_set("domain")).alias("domains"))
    return chosen.orderBy("name"), chosen.agg(F.count("*").alias("count")).crossJoin(F.broadcast(domains))


def dependents(edges: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """Edges that lead to a repository."""
    return edges.filter((F.col("to") == name) & _of("kind", kind)).orderBy("from", "kind", "key")


def dependencies(edges: DataFrame, unresolved: DataFrame, external: DataFrame, generic: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """(section, kind, key, target): all that a repository leads to; sections internal, external, unresolved, generic."""
    mine = _of("kind", kind)
    parts = [
        edges.filter((F.col("from") == name) & mine).select(F.lit("internal").alias("section"), "kind", "key", F.col("to").alias("target")),
        external.filter((F.col("from") == name) & mine).select(F.lit("external"), "kind", "key", "to"),
        unresolved.filter((F.col("repo") == name) & mine).select(F.lit("unresolved"), "kind", "key", F.lit(None).cast("string")),
        generic.filter((F.col("repo") == name) & mine).select(F.lit("generic"), "kind", "key", F.lit(None).cast("string")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def get_repo(repos: DataFrame, edges: DataFrame, unresolved: DataFrame, external: DataFrame, generic: DataFrame, shared: DataFrame) -> DataFrame:
    """Every repository with its sections: out, in, unresolved, external, generic, shared (arrays of JSON), each one aggregate and one join."""

    def section(rows: DataFrame, by: str, name: str) -> DataFrame:
        view = edge_view(rows, "repo") if name != "shared" else F.col("item")
        return rows.groupBy(F.col(by).alias("name")).agg(F.array_sort(F.collect_list(view)).alias(name))

    stores = shared.select(F.explode(F.map_keys("repos")).alias("repo"), F.to_json(F.struct("name", "repos")).alias("item"))
    out = repos
    for rows, by, name in (
        (edges, "from", "out"), (edges, "to", "in"), (unresolved, "repo", "unresolved"), (external, "from", "external"), (generic, "repo", "generic"), (stores, "repo", "shared"),
    ):
        out = out.join(section(rows, by, name), "name", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def external_dependencies(nodes: DataFrame, external: DataFrame, name: str | None = None) -> DataFrame:
    """(id, label, kind, consumers): who leads to each external node; with a name, the nodes of that repository alone."""
    used = external.filter(_of("from", name)).groupBy(F.col("to").alias("id")).agg(F.array_sort(F.collect_set("from")).alias("consumers"))
    how = "left" if name is None else "inner"
    return nodes.select("id", F.coalesce(F.nullif("label", F.lit("")), "id").alias("label"), "kind").join(used, "id", how).withColumn(
        "consumers", F.coalesce("consumers", F.array().cast("array<string>"))
    )


def impact_edges(edges: DataFrame, name: str, max_hops: int = 3, kind: str | None = None) -> DataFrame:
    """(node, hop, via, kind, key): what reaches a repository, each once at its first distance, by the least of its edges there."""
    hops = min(max(1, max_hops), C.MAX_HOPS)
    back = cut(edges.filter(_of("kind", kind)).select(F.col("to").alias("via"), F.col("from").alias("node"), "kind", "key").distinct())
    seen = edges.sparkSession.createDataFrame([(name, 0, None, None, None)], "node string, hop int, via string, kind string, key string")
    frontier = seen
    for hop in range(1, hops + 1):
        new = back.join(frontier.select(F.col("node").alias("via")), "via").join(seen.select("node"), "node", "left_anti")
        new = new.groupBy("node").agg(F.min(F.struct("via", "kind", "key")).alias("e")).select("node", F.lit(hop).alias("hop"), "e.*")
        frontier = cut(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("hop > 0").orderBy("hop", "node")


def find_path(edges: DataFrame, source: str, target: str, max_hops: int = 6) -> DataFrame:
    """One row (directed, hops, path): the nodes of a shortest path, else of one against the edges' direction; hops null if none.

    Of paths that are equally short the least in order is given. The same node is at zero hops, without a search.
    """
    spark, schema = edges.sparkSession, "directed boolean, hops int, path array<string>"
    if source == target:
        return spark.createDataFrame([(True, 0, [source])], schema)
    one_way = edges.select("from", "to")
    both = one_way.unionByName(one_way.select(F.col("to").alias("from"), F.col("from").alias("to")))
    for directed, table in ((True, one_way), (False, both)):
        steps = cut(table.distinct())
        seen = frontier = spark.createDataFrame([(source, [source])], "node string, path array<string>")
        for hop in range(1, min(max(1, max_hops), C.MAX_HOPS) + 1):
            new = steps.join(frontier, F.col("from") == F.col("node")).select(F.col("to").alias("node"), F.concat("path", F.array("to")).alias("path"))
            frontier = cut(new.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
            found = frontier.filter(F.col("node") == target).first()
            if found:
                return spark.createDataFrame([(directed, hop, found.path)], schema)
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
    return spark.createDataFrame([(False, None, None)], schema)


def matching_items(rows: DataFrame, items: str, terms: list[str], limit: int = 5) -> Column:
    """The first ``limit`` of an array's items that hold a term."""
    return F.slice(F.filter(items, lambda x: F.exists(F.lit(terms), lambda t: F.lower(x).contains(t))), 1, limit)


def freshness_totals(rows: DataFrame, status: str = "status") -> DataFrame:
    """One row (checked, not_fresh)."""
    return rows.agg(F.count("*").alias("checked"), F.count_if(F.col(status) != "fresh").alias("not_fresh"))


def by_domain(repos: DataFrame) -> DataFrame:
    """(domain, members), members by name."""
    return repos.groupBy("domain").agg(F.array_sort(F.collect_list("name")).alias("members"))


def pair_labels(edges: DataFrame) -> DataFrame:
    """(from, to, labels): the kinds between each two nodes of a diagram, sorted."""
    return edges.groupBy("from", "to").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("labels"))


def run_summary(runs: DataFrame, mode: str, size: str, error: str) -> DataFrame:
    """(mode, n, bytes, errors)."""
    return runs.groupBy(mode).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count_if(F.col(error).isNotNull()).alias("errors"))
