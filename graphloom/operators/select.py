"""Search, name resolution, gates, merges, budgets and refresh decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def count_in(text: Column, term: str) -> Column:
    """Occurrences of a term that don't overlap."""
    return F.regexp_count(text, F.lit("\\Q" + term + "\\E"))


def search(rows: DataFrame, fields: dict[str, int], query: str, order: Sequence[str], limit: int = 10) -> DataFrame:
    """``rows`` with a score, best first: weight times occurrences, over terms and fields."""
    import re

    terms = [t for t in re.split(r"[^a-z0-9_./-]+", query.lower()) if len(t) >= 2]
    score = F.lit(0)
    for field, weight in fields.items():
        for t in terms:
            score = score + weight * count_in(F.lower(F.coalesce(F.col(field).cast("string"), F.lit(""))), t)
    return rows.withColumn("score", score.cast("long")).filter("score > 0").orderBy(F.desc("score"), *order).limit(max(1, limit))


def resolve(names: DataFrame, asked: DataFrame, identifiers: DataFrame | None = None) -> DataFrame:
    """(asked, tier, n, name, candidates): exact name, else the same letters, else the only one with that identifier, else the only name that holds it.

    names (name), asked (asked), identifiers (name, identifier). name is null where the first
    tier with a match has several; candidates are the first 15 of them. Tiers are 1, 2, 4 (identifier) and 3 (part of a name), in this order.
    """
    n, low, a = F.col("name"), F.lower("name"), F.lower("asked")
    exact = asked.join(names, F.col("asked") == n).select("asked", "name", F.lit(1).alias("tier"))
    folded = asked.join(names, a == low).select("asked", "name", F.lit(2).alias("tier"))
    # the names are the short side: a nested loop over them is what a substring test needs
    inside = asked.join(F.broadcast(names), low.contains(a)).select("asked", "name", F.lit(3).alias("tier"))
    every = exact.unionByName(folded).unionByName(inside)
    if identifiers is not None:
        claimed = asked.join(identifiers, a == F.lower("identifier")).select("asked", "name", F.lit(4).alias("tier"))
        every = every.unionByName(claimed)
    order = F.when(F.col("tier") == 4, 2.5).otherwise(F.col("tier"))
    best = every.distinct().withColumn("order", order).withColumn("best", F.min("order").over(Window.partitionBy("asked"))).filter("order = best")
    out = best.groupBy("asked", "tier").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("name")).alias("all"))
    several = F.col("n") > 1
    return out.select("asked", "tier", "n", F.when(~several, F.col("all")[0]).alias("name"), F.when(several, F.slice("all", 1, 15)).alias("candidates"))


def greedy_prefix(rows: DataFrame, group: Sequence[str], order: Sequence[str], size: str, budget: int) -> DataFrame:
    """The leading rows of each group whose running size stays within the budget."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(w)).filter(F.col("running") <= budget)


def next_fit(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """(group, order, batch): a new batch begins where the next row doesn't fit."""
    listed = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("xs"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("batch"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        fresh = (a["used"] > 0) & (a["used"] + x["s"] > budget)
        batch = a["batch"] + F.when(fresh, 1).otherwise(0)
        return F.struct(F.when(fresh, x["s"]).otherwise(a["used"] + x["s"]).alias("used"), batch.alias("batch"), F.concat(a["out"], F.array(batch)).alias("out"))

    folded = listed.select(group, "xs", F.aggregate("xs", start, step, lambda a: a["out"]).alias("batches"))
    return folded.select(group, F.explode(F.arrays_zip(F.col("xs.o").alias("o"), F.col("batches").alias("b"))).alias("z")).select(group, F.col("z.o").alias(order), F.col("z.b").alias("batch"))


def percentile_index(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """The value at index floor(share * n) of each group's sorted values."""
    w = Window.partitionBy(group)
    ranked = rows.withColumn("i", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count("*").over(w))
    return ranked.groupBy(group).agg(*(F.max(F.when(F.col("i") == F.floor(F.col("n") * s), F.col(value))).alias(name) for name, s in shares.items()))


def shared(rows: DataFrame, key: str, owner: str, access: str) -> DataFrame:
    """Keys of more than one owner, with a map from owner to access."""
    each = rows.groupBy(key, owner).agg(F.max(access).alias(access))
    return each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(owner, access))).alias("xs")).filter(F.size("xs") > 1).select(key, F.map_from_entries("xs").alias("owners"))


def gate(items: DataFrame, files: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(items with evidence, items without)."""
    known = files.select(*on).distinct()
    return items.join(known, list(on), "left_semi"), items.join(known, list(on), "left_anti")


def merge_facts(sure: DataFrame, told: DataFrame, keys: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """Rows of ``sure`` win over ``told`` on the keys, and take what they lack in ``fill`` from them."""
    a, b = sure.alias("a"), told.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cols = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys] + [F.coalesce(F.nullif(f"a.{c}", F.lit("")), F.col(f"b.{c}")).alias(c) for c in fill]
    is_sure = F.coalesce(*(F.col(f"a.{k}") for k in keys)).isNotNull()
    return a.join(b, on, "full").select(*cols, F.when(is_sure, "sure").otherwise("told").alias("origin"))


def refresh_mode(has_old: Column, same_hash: Column, same_commit: Column, same_facts: Column, due: Column, changed: Column, limit: int) -> Column:
    """full, skip, restamp or update."""
    return (
        F.when(~has_old | ~same_hash, "full").when(same_commit & same_facts, "skip").when(same_commit, "restamp")
        .when(due | changed.isNull(), "full").when(changed == 0, "restamp").when(changed <= limit, "update").otherwise("full")
    )


def freshness(stored: Column, head: Column) -> Column:
    return F.when(stored.isNull(), "missing").when(head.isNull(), "error").when(stored == head, "fresh").otherwise("stale")
