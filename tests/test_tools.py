import json

import pytest
from pyspark.sql import functions as F

from graphloom import bindings
from graphloom.functions import text as T
from graphloom.operators import overrides as O
from graphloom.operators import tools
from graphloom.sources import listing

EDGE = "`from` string, `to` string, kind string, key string, name string, detail string, evidence string, match string"


@pytest.fixture(scope="module")
def small(spark):
    """web -> orders -> billing, and a cycle a -> b -> c -> a."""
    rows = [("web", "orders", "http", "orders", "", None, "f:1", "exact"), ("orders", "billing", "topic", "paid", "x", None, None, "alias")]
    rows += [(x, y, "http", y, None, None, None, "exact") for x, y in (("a", "b"), ("b", "c"), ("c", "a"))]
    return spark.createDataFrame(rows, EDGE)


def test_impact_with_edges_is_safe_in_cycles(small):
    got = [(r.node, r.hop, r.via) for r in tools.impact_edges(small, "billing").collect()]
    assert got == [("orders", 1, "billing"), ("web", 2, "orders")]
    assert {r.node for r in tools.impact_edges(small, "a", 500).collect()} == {"b", "c"}
    assert [r.node for r in tools.impact_edges(small, "a", 0).collect()] == ["c"]
    assert tools.impact_edges(small, "billing", 3, "http").count() == 0


def test_paths(small):
    path = lambda a, b: tuple(tools.find_path(small, a, b).first())
    assert path("web", "billing") == (True, 2, ["web", "orders", "billing"])
    assert path("billing", "web") == (False, 2, ["billing", "orders", "web"])
    assert path("web", "web") == (True, 0, ["web"])
    assert path("web", "a") == (False, None, None)


def test_repository_with_its_sections(spark, small):
    repos = spark.createDataFrame([("orders", "d", "service"), ("web", "e", "service"), ("alone", "d", "job")], "name string, domain string, kind string")
    lost = spark.createDataFrame([("web", "http", "stripe.com", None)], "repo string, kind string, key string, evidence string")
    shared = spark.createDataFrame([("orders_db", {"orders": "owner", "web": "read"})], "name string, repos map<string,string>")
    none = small.limit(0)
    generic = lost.limit(0)
    got = {r.name: r for r in tools.get_repo(repos, small, lost, none, generic, shared).collect()}
    assert [json.loads(x)["to"] for x in got["orders"].out] == ["billing"] and len(got["orders"]["in"]) == 1
    assert json.loads(got["web"].out[0]) == {"from": "web", "to": "orders", "kind": "http", "key": "orders", "evidence": "f:1", "match": "exact"}
    assert json.loads(got["web"].unresolved[0])["key"] == "stripe.com" and len(got["web"].shared) == 1
    assert got["alone"].out == got["alone"].generic == []
    chosen, summary = tools.list_repos(repos, domain="d")
    assert [r.name for r in chosen.collect()] == ["alone", "orders"] and tuple(summary.first()) == (2, ["d", "e"])
    assert {(r.domain, tuple(r.members)) for r in tools.by_domain(repos).collect()} == {("d", ("alone", "orders")), ("e", ("web",))}


def test_external_nodes(spark):
    nodes = spark.createDataFrame([("s.com", "", "http", ["s.com"]), ("t", "Tea", "http", ["t.com", "u.com"])], "id string, label string, kind string, hosts array<string>")
    edges = spark.createDataFrame([("a", "t", "http", "t.com", None, None, None, "derived")], EDGE)
    assert {(r.id, r.label, tuple(r.consumers)) for r in tools.external_dependencies(nodes, edges).collect()} == {("s.com", "s.com", ()), ("t", "Tea", ("a",))}
    assert [r.id for r in tools.external_dependencies(nodes, edges, "a").collect()] == ["t"]
    assert tools.external_view(nodes, edges).first().label == "Tea"
    hosts = spark.createDataFrame([("u.com",), ("v.com",)], "host string")
    assert {tuple(r) for r in O.external_id(F.col("host"), nodes, hosts).collect()} == {("u.com", "t"), ("v.com", "v.com")}


def test_overrides_and_what_is_stale(spark):
    consumes = spark.createDataFrame([("a", "http", " ORDERS "), ("b", "http", "orders"), ("b", "http", "x")], "repo string, kind string, key string")
    schema = "key string, repo string, action string, to string, external string, tag string, `group` string"
    targets = spark.createDataFrame([("orders", "a", "link", "o", None, None, None), ("orders", None, "generic", None, None, "t", None), ("gone", None, "link", "o", None, None, None)], schema)
    assert sorted((r.repo, r.action) for r in O.answered(consumes, targets).collect() if r.action) == [("a", "link"), ("b", "generic")]
    assert [r.key for r in O.stale(consumes, targets).collect()] == ["gone"]


def test_the_first_of_rows_with_one_key_gives_a_group_its_tag(spark, tmp_path):
    rows = [(k, "BRAND", f"n{k // 4}", 9, t) for k, t in ((0, "B"), (1, "X"))] + [(k, "BRAND", "n0", 9, t) for k, t in ((8, "C"), (4, "A"))]
    part = spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string, p_size long, p_type string")
    part.write.parquet(f"{tmp_path}/part.parquet")
    got = bindings.generic_groups(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("g0", "g0", "B", "r0,r1")]
    generic = spark.createDataFrame([("g", "a", "k", "x", 2, "A"), ("g", "a", "k", "x", 1, "B"), ("g", "b", "k", "x", 0, "C"), ("g", "a", "k", "x", 0, None)], "`group` string, repo string, kind string, key string, n int, tag string")
    none = spark.createDataFrame([], "`group` string, label string, tag string")
    assert O.generic_groups(generic, none, "n").first().tag == "B" and O.generic_groups(generic, none).first().tag == "A"


def test_suggestions(spark):
    lost = spark.createDataFrame([("a", "http", "Orders", "f", ["x"]), ("a", "grpc", "orders ", "g", []), ("b", "http", "orders", "h", ["y"])], "repo string, kind string, key string, evidence string, candidates array<string>")
    targets = O.unresolved_targets(lost)
    one = targets.first()
    assert (one.target, one.kinds, one.candidates) == ("orders", ["grpc", "http"], ["x", "y"]) and [(c.repo, c.evidence) for c in one.consumers] == [("a", "g"), ("b", "h")]
    repos = spark.createDataFrame([("a",), ("z",)], "name string")
    rows = [("orders", "link", "z", None, None, "high", "x\ny"), ("orders", "link", "q", None, None, None, ""), ("none", "none", None, None, None, "odd", None), ("orders", "guess", None, None, None, "low", ""), ("orders", "external", None, "a\x01", None, "low", "")]
    drafts = spark.createDataFrame(rows, "target string, action string, to string, external string, tag string, confidence string, reason string")
    got = [(r.status, r.confidence) for r in O.check_suggestions(drafts, targets, repos).collect()]
    assert sorted(got) == sorted([("ok", "high"), ("no such repository", "low"), ("not asked", "low"), ("unknown action", "low"), ("not a plain name", "low")])
    marked = spark.createDataFrame([("t1", "f1"), ("t2", "f2")], "target string, fingerprint string")
    drafted = spark.createDataFrame([("t1", "f1"), ("t2", "old"), ("t3", "f")], "target string, fingerprint string")
    assert [r.target for r in O.to_ask(marked, drafted).collect()] == ["t2"] and O.to_ask(marked, drafted, True).count() == 2
    assert {r.target for r in O.kept_drafts(drafted, marked).collect()} == {"t1", "t2"}


def test_listings(spark):
    paths = ["a.py", "x/vendor/b.py", ".github/CODEOWNERS", ".git/config", "1/2/3/4/f", "1/2/3/4/5/f", "../up", "Chart.yaml", "p/x.test.js"]
    files = spark.createDataFrame([("r", p) for p in paths], "repo string, path string")
    kept = {"a.py", ".github/CODEOWNERS", "1/2/3/4/f", "Chart.yaml", "p/x.test.js"}
    assert {r.path for r in listing.tracked(files).collect()} == {r.path for r in listing.walked(files).collect()} == kept
    assert {r.path for r in listing.listed(files.limit(0), files).collect()} == kept
    assert {r.path for r in listing.named(files, ["CODEOWNERS", "*.test.*"]).collect()} == {".github/CODEOWNERS", "p/x.test.js"}
    found = spark.createDataFrame([("/a/x",), ("/b/x",), ("/c/b/x",), ("/a/y",), ("/a/z",)], "path string")
    assert {r.name for r in listing.named_apart(found, ["z"]).collect()} == {"a-x", "b-x", "c-b-x", "y"}
    text = spark.createDataFrame([("r", 3, "TOKEN=abc\nabcdefgh"), ("r", 600_000, "x")], "repo string, size long, content string")
    assert [r.content for r in listing.capped(text, 12).collect()] == ["TOKEN=[REDAC\n... truncated"]
    with pytest.raises(ValueError):
        listing.required(files.limit(0))


def test_small_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(T.clip(F.lit("aé" * 10), 12)) == "aéaéa" + " ..."
    assert value(T.clip(F.lit("short"), 12)) == "short"
    assert [value(T.human_bytes(F.lit(n))) for n in (5, 1280, 3 << 20)] == ["5 B", "1.2 KB", "3.0 MB"]
    assert [value(T.human_seconds(F.lit(s))) for s in (0.5, 59.0, 61.7)] == ["0s", "59s", "1m01s"]
    assert value(T.domain_for(F.lit("pay-api"), {"x*": "no", "pay-*": " Money "})) == "money" and value(T.domain_for(F.lit("q"), {"x*": "no"})) == ""
    assert [value(c) for c in T.gated_domain(F.lit(" Odd "), ["a"])] == ["unassigned", "odd"]
    assert [value(T.matters(F.lit(p))) for p in ("docs/a", "src/a.py", "a/b.md")] == [False, True, False]
    assert [value(T.signal_key(F.lit("url"), F.lit(h))) for h in ("Api.X.com:80", "github.com")] == ["api.x.com", None]
