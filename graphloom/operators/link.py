"""Linking consumers to providers by ordered tiers of match.

``providers`` are (family, form, repo, rank). A consumer has an array of lookups
(family, form, rank) in order; the first lookup that another repository answers
decides. Everything is equi-joins on (family, form) with each form's providers
counted first, so the plan is the same for ten rows and for ten billion; hits
are listed only where a result holds them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config as C
from ..functions import text as T


def family(kind: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in C.FAMILY.items() for x in kv))[F.coalesce(kind, F.lit("other"))], F.lit("other"))


def _provide(df: DataFrame, fam, form: Column, tier: str, stoplist: Sequence[str]) -> DataFrame:
    out = df.select((fam if isinstance(fam, Column) else F.lit(fam)).alias("family"), F.lower(T.strip(form)).alias("form"), "repo", F.lit(C.RANK[tier]).alias("rank"))
    return out.filter(F.char_length("form") >= 2 if tier == "exact" else T.alias_ok(F.col("form"), stoplist))


def provider_index(identifiers: DataFrame, exposes: DataFrame, stores: DataFrame, packages: DataFrame, self_consumed: DataFrame, stoplist: Sequence[str] = C.GENERIC_IDENTIFIERS) -> DataFrame:
    """(family, form, repo, rank): the strongest claim of each repository on each form.

    identifiers (repo, value, own: is it the repository's name), exposes (repo,
    kind, key), stores (repo, name, access), packages (repo, ecosystem, name),
    self_consumed (repo, key): variables that a repository reads itself.
    """
    host = T.service_host(F.col("value"))
    named = identifiers.filter(F.col("own") | ~(F.lower(T.strip(F.col("value"))).isin(*stoplist) | host.isin(*stoplist)))
    path = F.col("value").contains("/") & ~F.col("value").contains("://")
    ids = named.filter(~path)
    own = identifiers.filter("own")
    fam = family(F.col("kind"))
    svc, other = exposes.filter(fam == "svc"), exposes.filter(~fam.isin("svc", "env"))
    env = exposes.filter(fam == "env").withColumn("low", F.lower(T.strip(F.col("key"))))
    env = env.join(self_consumed.select("repo", F.lower(T.strip(F.col("key"))).alias("low")).distinct(), ["repo", "low"], "left_anti")
    env = env.filter(~T.env_generic(T.strip(F.col("key")), stoplist))
    owned = stores.filter((F.col("access") == "owner") & ~F.lower(T.strip(F.col("name"))).isin(*C.GENERIC_STORES))

    def tails(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
        return df.select(*keep, F.explode(T.dotted_suffixes(F.col(column))).alias("tail"))

    package = T.package_name(F.col("ecosystem"), F.col("name"))
    parts = [
        _provide(named.filter(path), "pkg", F.col("value"), "exact", stoplist),
        _provide(ids, "svc", host, "exact", stoplist),
        _provide(ids, "svc", T.first_label(host), "alias", stoplist),
        _provide(tails(ids, "value", ["repo"]), "dotted", F.col("tail"), "alias", stoplist),
        _provide(own, "pkg", F.col("value"), "alias", stoplist),
        _provide(own, "pkg", T.package_name(F.lit("pypi"), F.col("value")), "alias", stoplist),
        _provide(env, "env", F.col("key"), "alias", stoplist),
        _provide(svc, "svc", T.service_host(F.col("key")), "exact", stoplist),
        _provide(svc, "svc", T.first_label(T.service_host(F.col("key"))), "alias", stoplist),
        _provide(other, fam, F.col("key"), "exact", stoplist),
        _provide(tails(other.filter(fam.isin("db", "other")), "key", ["repo"]), "dotted", F.col("tail"), "alias", stoplist),
        _provide(owned, "db", F.col("name"), "exact", stoplist),
        _provide(packages, "pkg", F.concat_ws(":", "ecosystem", package), "exact", stoplist),
        _provide(packages, "pkg", package, "alias", stoplist),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("family", "form", "repo").agg(F.min("rank").alias("rank"))


def lookups(kind: Column, key: Column, stoplist: Sequence[str] = C.GENERIC_IDENTIFIERS) -> Column:
    """A consumer's lookups in order: array<struct<family, form, rank>>."""

    def one(fam: str | Column, form: Column, tier: str) -> Column:
        return F.struct((F.lit(fam) if isinstance(fam, str) else fam).alias("family"), form.alias("form"), F.lit(C.RANK[tier]).alias("rank"))

    fam, low, host = family(kind), F.lower(T.strip(key)), T.service_host(key)
    none = F.filter(F.array(one("", low, "exact")), lambda x: F.lit(False))
    svc = F.array(one("svc", host, "exact"), one("svc", T.first_label(host), "alias"))
    name, conn = T.env_name(key), T.connection_key(key)
    return F.concat(
        F.when(fam == "svc", none).otherwise(F.array(one(fam, low, "exact"))),
        F.when(fam.isin("svc", "other"), svc).otherwise(none),
        F.when(fam.isin("db", "other") & (conn != ""), F.array(one("dotted", conn, "alias"))).otherwise(none),
        F.when((name != "") & ~T.env_generic(name, stoplist), F.array(one("env", F.lower(name), "alias"))).otherwise(none),
        F.transform(T.env_forms(key), lambda f: one("svc", f, "envvar")),
    )


def package_lookups(ecosystem: Column, name: Column, inferred: Column) -> Column:
    n = T.package_name(ecosystem, name)
    first = F.struct(F.lit("pkg").alias("family"), F.concat_ws(":", ecosystem, n).alias("form"), F.when(F.coalesce(inferred, F.lit(False)), 1).otherwise(0).alias("rank"))
    return F.array(first, F.struct(F.lit("pkg").alias("family"), n.alias("form"), F.lit(1).alias("rank")))


def _claims(providers: DataFrame) -> DataFrame:
    """(family, form, provider, given), once each: the providers that can answer."""
    claims = providers.filter(F.col("repo").isNotNull()).groupBy("family", "form", F.col("repo").alias("provider"))
    return claims.agg(F.max("rank").alias("given"))


def decide(consumes: DataFrame, providers: DataFrame, stoplist: Sequence[str] = C.GENERIC_IDENTIFIERS, cap: int = 3) -> DataFrame:
    """One row a consumer: consumes' columns without lookups, n_hits, bucket, match, and ask and odd, by which its hits are found.

    consumes and the verdict are those of :func:`tiered_link`. Hits are counted, not listed: each
    form's providers are tallied by rank, and the consumer's own claim is taken off, so that
    rows grow with the tables and not with consumers times providers. ask is the lookup
    that decides; only an id of several consumers whose lookups differ has its hits listed, in odd.
    """
    claims, ranks = _claims(providers), sorted(C.RANK.values())
    asked = consumes.select("consume_id", "repo", F.posexplode("lookups").alias("ord", "l")).select("consume_id", "repo", "ord", "l.*")
    asked = asked.filter(((F.col("rank") == 0) | T.alias_ok(F.col("form"), stoplist)) & F.col("repo").isNotNull())
    tally = claims.groupBy("family", "form").agg(*(F.count_if(F.col("given") == r).alias(f"n{r}") for r in ranks))
    mine = claims.select("family", "form", F.col("provider").alias("repo"), F.col("given").alias("own"))
    rest = {r: F.col(f"n{r}") - F.when(F.col("own") == r, 1).otherwise(0) for r in ranks}
    given = F.coalesce(*(F.when(rest[r] > 0, r) for r in reversed(ranks)))
    found = asked.join(tally, ["family", "form"]).join(mine, ["family", "form", "repo"], "left").filter(given.isNotNull())
    found = found.select(
        "consume_id", "ord", F.struct("family", "form", "repo", "rank", reduce(Column.__add__, rest.values()).alias("n"), F.greatest("rank", given).alias("weakest"), F.col("own").isNotNull().alias("mine")).alias("ask")
    )
    top = found.withColumn("first", F.min("ord").over(Window.partitionBy("consume_id"))).filter("ord = first")
    best = top.groupBy("consume_id").agg(F.min("ask").alias("ask"), F.max("ask").alias("last"))
    several = top.join(best.filter("ask <> last"), "consume_id", "left_semi").select("consume_id", "ask.family", "ask.form", "ask.repo", "ask.rank")
    several = several.join(claims, ["family", "form"]).filter(F.col("provider") != F.col("repo"))
    several = several.groupBy("consume_id").agg(F.array_sort(F.collect_set("provider")).alias("odd"), F.max(F.greatest("rank", "given")).alias("odd_weakest"))
    out = consumes.drop("lookups").join(best.drop("last").join(several, "consume_id", "left"), "consume_id", "left")

    n = F.when(F.col("odd").isNotNull(), F.size("odd")).otherwise(F.coalesce("ask.n", F.lit(0))).cast("int")
    weakest = F.coalesce("odd_weakest", "ask.weakest")
    fan_in = (family(F.col("kind")) == "msg") & (weakest == 0)
    inside = (n > 0) & ((n <= cap) | F.coalesce(fan_in, F.lit(False)))
    outside = (n == 0) & family(F.col("kind")).isin("svc", "other") & (F.coalesce("external", F.lit("")) != "")
    tier = F.element_at(F.array(*(F.lit(t) for t in C.RANK)), weakest + 1)
    return out.select(
        *(c for c in consumes.columns if c != "lookups"), n.alias("n_hits"),
        F.when(inside, "internal").when(outside, "external").otherwise("unknown").alias("bucket"),
        F.when(inside & (n > 1) & ~F.coalesce(fan_in, F.lit(False)), "ambiguous").when(inside, tier).when(outside, "derived").alias("match"),
        F.when(F.col("odd").isNull(), F.col("ask")).alias("ask"), "odd",
    )


#: A form's list of providers is sent to one more slice of its consumers for each so many providers, and to so many at most.
SLICE, SLICES = 1024, 256


def listed(decided: DataFrame, providers: DataFrame) -> DataFrame:
    """``decided`` with hits (sorted repositories, null without any) instead of ask and odd.

    Each form's list is built once and joined to its consumers, which are dealt into slices: what is shuffled grows with
    the tables, though the lists in the result may grow with consumers times providers.
    """
    slices = lambda n: F.least(F.ceil(n / SLICE), F.lit(SLICES))
    lists = _claims(providers).groupBy("family", "form").agg(F.array_sort(F.collect_list("provider")).alias("provided"))
    lists = lists.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices(F.size("provided")) - 1)))
    n = F.coalesce(slices(F.col("ask.n") + F.col("ask.mine").cast("int")), F.lit(SLICES))
    rows = decided.withColumns({"family": F.col("ask.family"), "form": F.col("ask.form"), "slice": F.pmod(F.xxhash64("consume_id"), n)})
    hits = F.coalesce("odd", F.when(F.col("ask.mine"), F.array_remove("provided", F.col("ask.repo"))).otherwise(F.col("provided")))
    kept = [c for c in decided.columns if c not in ("n_hits", "bucket", "match", "ask", "odd")]
    return rows.join(lists, ["family", "form", "slice"], "left").select(*kept, hits.alias("hits"), "n_hits", "bucket", "match")


def tiered_link(consumes: DataFrame, providers: DataFrame, stoplist: Sequence[str] = C.GENERIC_IDENTIFIERS, cap: int = 3) -> DataFrame:
    """One row a consumer: consumes' columns, hits (sorted repositories), n_hits, bucket, match.

    consumes (consume_id, repo, kind, key, lookups, external). Hits of the consumer's
    own repository don't count. bucket is internal, external or unknown; match is
    the tier, or ambiguous for several hits that aren't fan-in.
    """
    return listed(decide(consumes, providers, stoplist, cap), providers)


def _answers(decided: DataFrame, providers: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and provider: a row for each hit of each row."""
    asks = decided.filter(F.col("ask").isNotNull()).select(*keep, "ask.family", "ask.form", "ask.repo")
    hits = asks.join(_claims(providers), ["family", "form"]).filter(F.col("provider") != F.col("repo"))
    return hits.select(*keep, "provider").unionByName(decided.select(*keep, F.explode("odd").alias("provider")))


def edges(decided: DataFrame, providers: DataFrame) -> DataFrame:
    """(from, to, kind, key, match), the first consumer of each signature winning."""
    named = decided.withColumn("from", F.col("repo"))
    inside = _answers(named.filter("bucket = 'internal'"), providers, "consume_id", "from", "kind", "key", "match").withColumnRenamed("provider", "to")
    outside = named.filter("bucket = 'external'").select("consume_id", "from", F.col("external").alias("to"), "kind", "key", "match")
    return first_wins(inside.unionByName(outside), ["from", "to", "kind", "key"], ["consume_id"]).select("from", "to", "kind", "key", "match")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def bucket_counts(decided: DataFrame) -> DataFrame:
    return decided.agg(*(F.count_if(F.col("bucket") == b).alias(b) for b in ("internal", "external", "unknown")))


def unresolved_keys(decided: DataFrame, top: int = 25) -> DataFrame:
    """(kind, key, repos) of unresolved targets, most repositories first."""
    out = decided.filter("bucket = 'unknown'").groupBy("kind", "key").agg(F.array_sort(F.collect_set("repo")).alias("repos"))
    return out.orderBy(F.desc(F.size("repos")), "key", "kind").limit(top)


def unresolved(decided: DataFrame, providers: DataFrame, top: int = 25) -> DataFrame:
    """Unresolved targets by (kind, key), most repositories first, with the candidates that their consumers hit.

    A provider is a candidate where one who asks is another: the least or the greatest of those is, if any.
    """
    keys = unresolved_keys(decided, top)
    same = lambda x, y: F.col(f"{x}.kind").eqNullSafe(F.col(f"{y}.kind")) & F.col(f"{x}.key").eqNullSafe(F.col(f"{y}.key"))
    rows = decided.filter("bucket = 'unknown'").alias("d").join(F.broadcast(keys.select("kind", "key")).alias("k"), same("d", "k"), "left_semi")
    asks = rows.filter(F.col("ask").isNotNull()).groupBy("kind", "key", "ask.family", "ask.form").agg(F.min("ask.repo").alias("least"), F.max("ask.repo").alias("most"))
    hits = asks.join(_claims(providers), ["family", "form"]).filter((F.col("provider") != F.col("least")) | (F.col("provider") != F.col("most")))
    hits = hits.select("kind", "key", "provider").unionByName(rows.select("kind", "key", F.explode("odd").alias("provider")))
    found = hits.groupBy("kind", "key").agg(F.array_sort(F.collect_set("provider")).alias("candidates"))
    out = keys.alias("k").join(found.alias("f"), same("k", "f"), "left")
    return out.select("k.kind", "k.key", "repos", F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates")).orderBy(F.desc(F.size("repos")), "key", "kind")
