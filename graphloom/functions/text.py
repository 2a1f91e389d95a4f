"""Scalar functions of names, hosts, keys and paths, as built-in column expressions."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .. import config as C


def strip(c: Column) -> Column:
    """Without white space at both ends, of any Unicode kind."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def once(value: Column, f) -> Column:
    """f(value) with ``value`` evaluated once, however often f names it: long expressions don't multiply in generated code."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def full(c: Column, pattern: str) -> Column:
    return c.rlike(rf"\A(?:{pattern})\z")


def service_host(raw: Column) -> Column:
    """The host of a URL, host:port or bare name, in lower case; all of it where nothing is left."""
    s = F.lower(strip(raw))
    bare = F.regexp_replace(s, r"\A[a-z][a-z0-9+.\-]*://", "")
    bare = F.regexp_extract(bare, r"\A([^/?#]*)", 1)
    bare = F.regexp_replace(F.substring_index(bare, "@", -1), r":\d+\z", "")
    return F.when(bare == "", s).otherwise(bare)


def first_label(host: Column) -> Column:
    return F.substring_index(host, ".", 1)


def is_env_name(raw: Column) -> Column:
    return full(strip(raw), "[A-Z][A-Z0-9_]*")


def env_forms(raw: Column) -> Column:
    """Names of the service that a connection variable may speak of, most specific first."""
    stem = F.translate(F.lower(F.regexp_replace(strip(raw), C.ENV_SUFFIX, "")), "_", "-")
    both = F.array(stem, F.regexp_replace(stem, r"-(?:service|svc|api)\z", ""))
    return F.when(is_env_name(raw), F.array_distinct(F.filter(both, lambda x: F.char_length(x) >= 3))).otherwise(F.array().cast("array<string>"))


def env_name(raw: Column) -> Column:
    """The variable that a path or key ends in, where it has a connection suffix; else empty."""
    last = F.upper(F.regexp_replace(F.substring_index(strip(raw), "/", -1), "[-.]", "_"))
    return F.when(full(last, "[A-Z][A-Z0-9_]*") & last.rlike(C.ENV_SUFFIX), last).otherwise("")


def env_generic(name: Column, stoplist: Sequence[str] = ()) -> Column:
    """True for a variable whose stem names a kind of thing, not one of them."""
    known = [*C.GENERIC_STEMS, *stoplist]
    tokens = F.filter(F.split(F.lower(F.regexp_replace(name, C.ENV_SUFFIX, "")), "[_-]"), lambda t: t != "")
    return F.forall(tokens, lambda t: t.isin(known))


def connection_key(raw: Column) -> Column:
    """The name of a connection string; empty for what isn't a name."""
    s = F.lower(strip(F.regexp_replace(strip(raw), r"(?i)\A(?:connectionstrings[:_]{1,2}|name\s*=\s*)", "")))
    return F.when(s.rlike(r"(?U)[/:;=\s]"), "").otherwise(s)


def dotted_suffixes(raw: Column) -> Column:
    """Proper suffixes of a dotted name; none of a path or URL."""
    s = F.lower(strip(F.coalesce(raw, F.lit(""))))
    parts = F.split(s, r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.slice(parts, i, F.size(parts)))
    named = F.transform(F.filter(tails, lambda t: t[0] != ""), lambda t: F.array_join(t, "."))
    return F.when(s.contains(".") & ~s.contains("/"), named).otherwise(F.array().cast("array<string>"))


def under(host: Column, domains: Sequence[str]) -> Column:
    """True for a host that is one of ``domains`` or lies under one."""
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith("." + d)
    return out


def external_host(key: Column, kind: Column, internal: Sequence[str], placeholders: Sequence[str] = C.PLACEHOLDER_HOSTS) -> Column:
    """The host of a target that is evidently a third party; else empty."""
    if not internal:
        return F.lit("")
    text, host = strip(key), service_host(key)
    kind = F.coalesce(kind, F.lit(""))
    label = "[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
    tld = F.substring_index(host, ".", -1)
    told = text.contains("://") | (kind.isin(*C.WEB_KINDS) & (text == F.lower(text)))
    ok = told & ~is_env_name(key) & (kind != "grpc") & full(host, rf"{label}(?:\.{label})+")
    ok = ok & full(tld, "[a-z]+") & ~tld.isin(*C.INTERNAL_TLDS) & ~under(host, [*internal, *placeholders])
    return F.when(ok, host).otherwise("")


def alias_ok(form: Column, stoplist: Sequence[str]) -> Column:
    return (F.char_length(form) >= 3) & ~form.isin(*stoplist)


def package_name(ecosystem: Column, name: Column) -> Column:
    n = F.lower(strip(name))
    return F.when(ecosystem == "pypi", F.regexp_replace(n, "[-_.]+", "-")).otherwise(n)


def coordinate(group: Column, artifact: Column) -> Column:
    """group:artifact; empty for a placeholder or without an artifact."""
    joined = F.regexp_replace(F.concat(strip(F.coalesce(group, F.lit(""))), F.lit(":"), strip(F.coalesce(artifact, F.lit("")))), r"\A:+|:+\z", "")
    return F.when(joined.contains("${") | (strip(F.coalesce(artifact, F.lit(""))) == ""), "").otherwise(joined)


def remote_url(url: Column) -> Column:
    """https form of a remote without credentials and .git; paths stay."""
    u = strip(url)
    web = F.regexp_replace(u, r"\A(?:https?|ssh|git)://(?:[^@/]*@)?([^/:]+)(?::\d+)?/(.*)\z", "https://$1/$2")
    scp = F.regexp_replace(u, r"\A(?:[\w.\-]+@)?([\w.\-]+):(?!/)(.+)\z", "https://$1/$2")
    out = F.when(u.rlike(r"\A(?:https?|ssh|git)://"), web).when(u.rlike(r"\A(?:[\w.\-]+@)?[\w.\-]+:(?!/)"), scp).otherwise(u)
    return F.when(out.startswith("https://"), F.regexp_replace(F.regexp_replace(out, r"/+\z", ""), r"\.git\z", "")).otherwise(out)


def glob_pattern(glob: str) -> str:
    """A Java pattern for a glob whose * crosses /."""
    body = fnmatch.translate(glob).removesuffix(r"\Z").removesuffix(r"\z")
    return rf"\A{body}\z"


def path_matches(path: Column, globs: Sequence[str]) -> Column:
    """True where a glob fits the whole path, or the last part if it has no /."""
    out = F.lit(False)
    for g in globs:
        out = out | (path if "/" in g else F.substring_index(path, "/", -1)).rlike(glob_pattern(g))
    return out


def first_match(path: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Index of the first group of globs that fits; null where none does."""
    return F.coalesce(*(F.when(path_matches(path, g), F.lit(i)) for i, g in enumerate(groups)))


def diagram_label(text: Column, limit: int = 60) -> Column:
    s = F.substring(strip(F.regexp_replace(text, r"[\[\](){}<>\"'`|#;&\\\r\n]+", " ")), 1, limit)
    return F.when(s == "", "-").otherwise(s)


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def full_due(last_full: Column, now: Column, days: int) -> Column:
    """True if the time is missing, unreadable, without a zone, or older than ``days``."""
    zoned = last_full.rlike(r"(?:Z|[+-]\d\d:?\d\d)\z")
    at = F.try_to_timestamp(last_full)
    return F.coalesce(~zoned | at.isNull() | (at < now - F.make_dt_interval(F.lit(days))), F.lit(True))


def signal_key(category: Column, found: Column) -> Column:
    """What a signal is counted by: of links the host without its port, null where it says nothing; else the lower-cased match."""
    host = F.lower(F.substring_index(found, ":", 1))
    return F.when(category != "url", F.lower(found)).otherwise(F.when(~under(host, C.NOISE_HOSTS), host))


def domain_for(name: Column, patterns: dict[str, str]) -> Column:
    """The domain of the first glob that fits a name; empty where none does."""
    return F.coalesce(*(F.when(name.rlike(glob_pattern(g)), F.lit(d.strip().lower())) for g, d in patterns.items()), F.lit(""))


def gated_domain(domain: Column, allowed: Sequence[str]) -> tuple[Column, Column]:
    """(domain, rejected): a domain off the list is unassigned, and told of."""
    said = F.lower(F.trim(F.coalesce(domain, F.lit(""))))
    said = F.when(said == "", "unassigned").otherwise(said)
    fits = said.isin(*allowed, "unassigned") if allowed else F.lit(True)
    return F.when(fits, said).otherwise("unassigned"), F.when(fits, "").otherwise(said)


def matters(path: Column) -> Column:
    """Whether a changed file calls for a new mapping."""
    return ~path_matches(path, C.IGNORED_CHANGES)


def clip(text: Column, limit: int) -> Column:
    """At most ``limit`` bytes of UTF-8, with " ..." where it was cut; no code point is split."""
    raw, room = text.cast("binary"), max(0, limit - 4)
    whole = F.coalesce(*(F.try_validate_utf8(F.substring(raw, 1, max(0, room - k)).cast("string")) for k in range(4)), F.lit(""))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(whole, F.lit(" ...")))


def human_bytes(n: Column) -> Column:
    kb, mb = F.format_string("%.1f KB", F.bround(n / 1024.0, 1)), F.format_string("%.1f MB", F.bround(n / 1048576.0, 1))
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1048576, kb).otherwise(mb)


def human_seconds(s: Column) -> Column:
    """Seconds, half to even, below a minute; else minutes and whole seconds."""
    minutes = F.format_string("%dm%02ds", F.floor(s / 60), F.floor(s % 60))
    return F.when(s < 60, F.concat(F.bround(s, 0).cast("long").cast("string"), F.lit("s"))).otherwise(minutes)
