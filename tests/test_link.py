"""Linking: results against brute force, and rows shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom import bindings, config as C
from graphloom.operators import link

PROVIDERS, CONSUMES = "family string, form string, repo string, rank int", "consume_id int, repo string, kind string, key string, external string"


def shuffled(spark) -> int:
    """Rows written to shuffles by this session so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def brute(providers, consumes, cap=3):
    """{(consume_id, key): (hits, bucket, match)} by loops; an id of several consumers has the hits of them all."""
    first, out = {}, {}
    for i, repo, kind, key, _, asked in consumes:
        for o, (fam, form, rank) in enumerate(asked):
            found = {(p, max(rank, given)) for f, x, p, given in providers if (f, x) == (fam, form) and p != repo}
            if found:
                first.setdefault(i, {}).setdefault(o, set()).update(found)
    for i, repo, kind, key, external, _ in consumes:
        best = first.get(i) and first[i][min(first[i])] or set()
        hits, weakest = sorted({p for p, _ in best}), max((r for _, r in best), default=None)
        fan_in = C.FAMILY.get(kind) == "msg" and weakest == 0
        inside, outside = bool(hits) and (len(hits) <= cap or fan_in), not hits and C.FAMILY.get(kind, "other") in ("svc", "other") and bool(external)
        match = ("ambiguous" if len(hits) > 1 and not fan_in else list(C.RANK)[weakest]) if inside else "derived" if outside else None
        out[i, key] = (hits or None, "internal" if inside else "external" if outside else "unknown", match)
    return out


@pytest.fixture(scope="module")
def case(spark):
    """Random claims and lookups; repositories ask for what they provide, and ids 60 to 79 are of two consumers each."""
    r = random.Random(5)
    forms = [("svc", f"host{i}") for i in range(9)] + [("msg", f"topic{i}") for i in range(4)]
    claims = {(*r.choice(forms[:11]), f"r{r.randrange(12)}"): r.randrange(3) for _ in range(70)}
    providers = [(*k, v) for k, v in claims.items()]
    consumes = []
    for n in range(100):
        asked = [(*r.choice(forms), r.randrange(2)) for _ in range(r.randrange(4))]
        consumes.append((n if n < 80 else n - 20, f"r{r.randrange(14)}", r.choice(["http", "topic", "database", "sftp"]), f"k{n % 30}-{n // 80}", r.choice(["", "x.com"]), asked))
    rows = spark.createDataFrame(consumes, CONSUMES + ", lookups array<struct<family: string, form: string, rank: int>>")
    return providers, consumes, spark.createDataFrame(providers, PROVIDERS), rows


def test_hits_are_those_of_brute_force(case):
    providers, consumes, p, c = case
    got = {(r.consume_id, r.key): (r.hits, r.bucket, r.match) for r in link.tiered_link(c, p, ()).collect()}
    assert got == brute(providers, consumes) and {len(x[0] or ()) > 3 for x in got.values()} == {True, False}
    assert all(r.n_hits == len(r.hits or ()) for r in link.tiered_link(c, p, ()).collect())


def test_long_lists_are_dealt_into_slices(case, monkeypatch):
    providers, consumes, p, c = case
    monkeypatch.setattr(link, "SLICE", 2)
    monkeypatch.setattr(link, "SLICES", 3)
    assert {(r.consume_id, r.key): (r.hits, r.bucket, r.match) for r in link.tiered_link(c, p, ()).collect()} == brute(providers, consumes)


def test_edges_counts_and_unresolved_of_brute_force(case):
    providers, consumes, p, c = case
    want, decided = brute(providers, consumes), link.decide(c, p, ())
    edges = {}
    for i, repo, kind, key, external, _ in sorted(consumes, key=lambda x: x[0]):
        hits, bucket, match = want[i, key]
        for to in hits if bucket == "internal" else [external] if bucket == "external" else []:
            edges.setdefault((repo, to, kind, key), match)
    assert {(r["from"], r.to, r.kind, r.key): r.match for r in link.edges(decided, p).collect()} == edges
    buckets = [b for _, b, _ in want.values()]
    assert list(link.bucket_counts(decided).first()) == [buckets.count(b) for b in ("internal", "external", "unknown")]
    lost = {}
    for i, repo, kind, key, _, _ in consumes:
        if want[i, key][1] == "unknown":
            repos, candidates = lost.setdefault((kind, key), (set(), set()))
            repos.add(repo)
            candidates.update(want[i, key][0] or ())
    first = sorted(lost.items(), key=lambda x: (-len(x[1][0]), x[0][1], x[0][0]))[:7]
    assert [((r.kind, r.key), r.repos, r.candidates) for r in link.unresolved(decided, p, 7).collect()] == [(k, sorted(a), sorted(b)) for k, (a, b) in first]


@pytest.mark.parametrize("name", ["tiered_link", "link_edges", "bucket_counts", "unresolved_top"])
def test_rows_shuffled_grow_with_the_pages_alone(spark, tmp_path, name):
    n = 600
    spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("https://one.example.org/"), "id").alias("url")).write.parquet(f"{tmp_path}/pages.parquet")
    before = shuffled(spark)
    rows = bindings.queries()[name](spark, str(tmp_path)).collect()
    assert shuffled(spark) - before < 40 * n  # each host's providers times its consumers are 180,000 rows
    if name == "tiered_link":
        assert len(rows) == n and {r.n_hits for r in rows} == {n // 2}
