"""Owners' answers, generic groups and drafted suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ACTIONS = ("link", "external", "generic")


def target_key(key: Column) -> Column:
    return F.lower(F.trim(key))


def answered(consumes: DataFrame, targets: DataFrame) -> DataFrame:
    """``consumes`` (repo, kind, key, ...) with action, to, external, tag, group of the answer that names them.

    targets (key, repo, action, to, external, tag, group); a null repo answers for
    every repository, after one that names it.
    """
    asked = consumes.withColumn("ask", target_key(F.col("key")))
    answer = F.struct("action", "to", "external", "tag", "group")
    keyed = targets.select(target_key(F.col("key")).alias("ask"), F.col("repo").alias("for_repo"), answer.alias("answer"))
    own = keyed.filter("for_repo is not null").select("ask", F.col("for_repo").alias("repo"), F.col("answer").alias("own"))
    any_ = keyed.filter("for_repo is null").select("ask", F.col("answer").alias("any"))
    out = asked.join(own, ["ask", "repo"], "left").join(any_, "ask", "left").withColumn("answer", F.coalesce("own", "any"))
    return out.select(*consumes.columns, "answer.*")


def stale(consumes: DataFrame, targets: DataFrame) -> DataFrame:
    """The answers that no consumer uses; one for every repository is unused where those that name theirs take all."""
    asked = consumes.select(target_key(F.col("key")).alias("ask"), "repo").distinct()
    keyed = targets.withColumn("ask", target_key(F.col("key")))
    own = keyed.filter("repo is not null")
    rest = asked.join(own.select("ask", "repo"), ["ask", "repo"], "left_anti")
    unused = own.join(asked, ["ask", "repo"], "left_anti")
    return unused.unionByName(keyed.filter("repo is null").join(rest.select("ask"), "ask", "left_anti")).select("key", "repo", "action")


def external_id(host: Column, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with external: the id of the node that lists the host, else the host."""
    owners = nodes.select(F.col("id").alias("node_id"), F.explode("hosts").alias("node_host"))
    return rows.join(owners, host == F.col("node_host"), "left").withColumn("external", F.coalesce("node_id", host)).select(*rows.columns, "external")


def generic_groups(generic: DataFrame, groups: DataFrame, place: str | None = None) -> DataFrame:
    """(group, label, tag, repos) of explicit groups that more than one repository uses; the tag is the group's, else its first row's.

    place is the column of the rows' order, which decides between rows of one (repo, kind, key); without it the least tag does.
    """
    first = F.when(F.col("tag").isNotNull(), F.struct("repo", "kind", "key", place or "tag"))
    used = generic.filter("group is not null").groupBy("group").agg(F.array_sort(F.collect_set("repo")).alias("repos"), F.min_by("tag", first).alias("first_tag"))
    out = used.filter(F.size("repos") > 1).join(groups, "group", "left")
    return out.select("group", F.coalesce(F.nullif("label", F.lit("")), "group").alias("label"), F.coalesce(F.nullif("tag", F.lit("")), "first_tag").alias("tag"), "repos")


def unresolved_targets(unresolved: DataFrame, top: int | None = None) -> DataFrame:
    """(target, kinds, consumers, candidates), of most consumers first; consumers are each repository's first row.

    unresolved (repo, kind, key, evidence, candidates).
    """
    rows = unresolved.withColumn("target", target_key(F.col("key")))
    each = rows.groupBy("target", "repo").agg(
        F.min_by(F.struct("kind", "key", "evidence"), F.struct("kind", "key", "evidence")).alias("row"), F.collect_set("kind").alias("kinds"),
        F.array_distinct(F.flatten(F.collect_list("candidates"))).alias("candidates"),
    )
    out = each.groupBy("target").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"), F.array_sort(F.collect_list(F.struct("repo", "row.evidence"))).alias("consumers"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("candidates")))).alias("candidates"),
    )
    out = out.orderBy(F.desc(F.size("consumers")), "target")
    return out if top is None else out.limit(top)


def fingerprint(*parts: Column) -> Column:
    """The first 12 hexadecimal digits of SHA-256 over the parts' JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 12)


def to_ask(targets: DataFrame, drafts: DataFrame, all_: bool = False) -> DataFrame:
    """The targets (target, fingerprint) without a draft, or with one of another fingerprint; with ``all_`` every target."""
    known = drafts.select("target", F.col("fingerprint").alias("drafted"))
    return targets if all_ else targets.join(known, "target", "left").filter(~F.col("fingerprint").eqNullSafe(F.col("drafted"))).select(*targets.columns)


def kept_drafts(drafts: DataFrame, targets: DataFrame) -> DataFrame:
    """The drafts whose target is still unresolved."""
    return drafts.join(targets.select("target"), "target", "left_semi")


def only_by(consumers: str, to: str) -> Column:
    """Whether all consumers are the one that the answer names."""
    return F.forall(consumers, lambda c: c == F.col(to))


def check_suggestions(drafts: DataFrame, targets: DataFrame, repos: DataFrame) -> DataFrame:
    """``drafts`` (target, action, to, external, tag, confidence, reason) with status ok, or why one is refused.

    An answer must be to a target that was asked, one of the actions, to a
    repository that exists and is not the only consumer, with plain names;
    confidence is low where it is no known one; reasons lose control characters.
    """
    plain = r"^[A-Za-z0-9][A-Za-z0-9 ._/-]{0,79}$"
    asked = targets.select("target", F.transform("consumers", lambda c: c["repo"]).alias("asked_by"))
    out = drafts.join(asked, "target", "left").join(repos.select(F.col("name").alias("to"), F.lit(True).alias("exists")), "to", "left")
    action = F.col("action")
    status = (
        F.when(F.col("asked_by").isNull(), "not asked").when(~F.coalesce(action.isin(*ACTIONS, "none"), F.lit(False)), "unknown action")
        .when((action == "link") & F.col("exists").isNull(), "no such repository").when((action == "link") & only_by("asked_by", "to"), "the only consumer")
        .when((action == "external") & ~F.coalesce(F.col("external").rlike(plain), F.lit(False)), "not a plain name")
        .when((action == "generic") & ~F.coalesce(F.col("tag").rlike(plain), F.lit(False)), "not a plain name").otherwise("ok")
    )
    sure = F.when(F.col("confidence").isin("high", "medium", "low"), F.col("confidence")).otherwise("low")
    reason = F.regexp_replace(F.coalesce("reason", F.lit("")), r"[\x00-\x1F\x7F]", " ")
    return out.withColumn("status", status).withColumn("confidence", sure).withColumn("reason", reason).select(*drafts.columns, "status")


def docs_targets(consumes: DataFrame, edges: DataFrame, external: DataFrame, generic: DataFrame) -> DataFrame:
    """(repo, kind, key, targets): where each consumer's key leads, for its page; generic ones by their tag."""
    led = edges.select(F.col("from").alias("repo"), "key", F.col("to").alias("target")).unionByName(
        external.select(F.col("from").alias("repo"), "key", F.col("to").alias("target"))
    ).unionByName(generic.select("repo", "key", F.col("tag").alias("target")))
    found = led.groupBy("repo", "key").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    return consumes.select("repo", "kind", "key").join(found, ["repo", "key"], "left").select("repo", "kind", "key", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))


def even_share(rows: DataFrame, group: str, budget: int, most: int = 1200) -> DataFrame:
    """``rows`` with share: the bytes that each of a group's rows may take of the budget."""
    n = rows.groupBy(group).agg(F.count("*").alias("n_rows"))
    return rows.join(n, group).withColumn("share", F.least(F.lit(most), F.floor(F.lit(budget) / F.col("n_rows")))).drop("n_rows")
