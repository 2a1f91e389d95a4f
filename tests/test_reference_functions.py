import pytest
from pyspark.sql import functions as F

from graphloom.functions import redact as R
from graphloom.functions import text as T
from graphloom.operators import graph, link, select as S


def one(spark, f, *values):
    df = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))])
    return df.select(f(*(F.col(c) for c in df.columns)).alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "host"),
    [("https://user@Orders.Corp:8080/v1?x#y", "orders.corp"), ("orders", "orders"), (" a.b:80 ", "a.b"), ("grpc://svc.ns/path", "svc.ns"), ("/only/path", "/only/path")],
)
def test_service_host(spark, raw, host):
    assert one(spark, T.service_host, raw) == host


@pytest.mark.parametrize(("raw", "forms"), [("ORDERS_SERVICE_URL", ["orders-service", "orders"]), ("DB_URL", []), ("orders", []), ("PAY_API_BASE_URL", ["pay-api", "pay"])])
def test_env_forms(spark, raw, forms):
    assert one(spark, T.env_forms, raw) == forms


@pytest.mark.parametrize(
    ("key", "kind", "host"),
    [
        ("https://api.vendor.com/v1", "other", "api.vendor.com"), ("api.vendor.com", "http", "api.vendor.com"), ("Acme.Orm.Billing", "http", ""),
        ("billing.v1.service", "grpc", ""), ("https://x.corp.example/a", "http", ""), ("https://10.0.0.1/", "http", ""), ("VENDOR_URL", "http", ""), ("https://a.internal", "http", ""),
    ],
)
def test_external_host(spark, key, kind, host):
    assert one(spark, lambda k, d: T.external_host(k, d, ["corp.example"]), key, kind) == host


def test_small_functions(spark):
    assert one(spark, T.dotted_suffixes, "Acme.Orm.Billing") == ["orm.billing", "billing"]
    assert one(spark, T.dotted_suffixes, "a/b.c") == []
    assert one(spark, T.connection_key, "ConnectionStrings:Billing") == "billing"
    assert one(spark, T.connection_key, "host:80") == ""
    assert one(spark, T.env_name, "/prod/dataw-uri") == "DATAW_URI"
    assert one(spark, T.env_generic, "MONGO_URI") and not one(spark, T.env_generic, "ORDERS_URI")
    assert one(spark, lambda n: T.package_name(F.lit("pypi"), n), " My_Lib..x ") == "my-lib-x"
    assert one(spark, T.remote_url, "git@host.example:team/repo.git") == "https://host.example/team/repo"
    assert one(spark, T.remote_url, "https://u:p@host.example/team/repo.git") == "https://host.example/team/repo"
    assert one(spark, T.remote_url, "/srv/repo") == "/srv/repo"


def test_redact(spark):
    assert one(spark, R.redact, "api_token = abc") == "api_token = [REDACTED]"
    assert one(spark, R.redact, "x https://u:p@h/y") == "x https://[REDACTED]@h/y"
    assert one(spark, R.redact, "plain text") == "plain text"
    assert one(spark, R.redact, "Server=x;Password=hunter2;y") == "Server=x;Password=[REDACTED];y"


def linked(spark, provides, consumes, exposes=(), cap=3):
    ids = spark.createDataFrame(provides, "repo string, value string, own boolean")
    ex = spark.createDataFrame(list(exposes), "repo string, kind string, key string")
    none = spark.createDataFrame([], "repo string, name string, access string, ecosystem string, key string")
    index = link.provider_index(ids, ex, none.select("repo", "name", "access"), none.select("repo", "ecosystem", "name"), none.select("repo", "key"))
    c = spark.createDataFrame([(i, *x) for i, x in enumerate(consumes)], "consume_id int, repo string, kind string, key string")
    c = c.withColumn("lookups", link.lookups(F.col("kind"), F.col("key"))).withColumn("external", T.external_host(F.col("key"), F.col("kind"), ["corp.example"]))
    return link.tiered_link(c, index, cap=cap)


def test_link_rules(spark):
    many = [(f"orders-{i}", f"orders.cell{i}.internal", False) for i in range(4)]
    rows = linked(spark, [("pay", "pay.corp.example", False), ("api", "api.internal", False), *many, ("bill", "Acme.Orm.Billing", False), ("cart", "cart", True)], [
        ("web", "http", "https://pay.corp.example/x"), ("web", "http", "pay"), ("web", "http", "orders"), ("web", "http", "api"), ("pay", "http", "pay.corp.example"),
        ("web", "http", "https://api.vendor.com/"), ("web", "database", "ConnectionStrings:Billing"), ("web", "http", "CART_SERVICE_URL"), ("web", "topic", "order.created"),
    ], exposes=[(f"p{i}", "topic", "order.created") for i in range(4)]).orderBy("consume_id").collect()
    got = [(r.bucket, r.match, r.hits) for r in rows]
    assert got[0] == ("internal", "exact", ["pay"]) and got[1] == ("internal", "alias", ["pay"])
    assert got[2] == ("unknown", None, [f"orders-{i}" for i in range(4)])
    assert got[3][0] == "unknown" and got[4][0] == "unknown"
    assert got[5][:2] == ("external", "derived") and got[6] == ("internal", "alias", ["bill"])
    assert got[7] == ("internal", "envvar", ["cart"]) and got[8] == ("internal", "exact", ["p0", "p1", "p2", "p3"])


def test_impact_is_cycle_safe(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.hop) for r in graph.impact(edges, start, 500).collect()} == {("c", 1), ("d", 1), ("b", 2)}
    assert graph.path_length(edges, "a", "c").first().hops == 2
    assert tuple(graph.path_length(edges, "a", "d").first()) == (False, 1)


def test_next_fit(spark):
    rows = spark.createDataFrame([("g", i, s) for i, s in enumerate([5, 5, 1, 20, 3, 7])], "g string, i int, s int")
    assert [r.batch for r in S.next_fit(rows, "g", "i", "s", 10).orderBy("i").collect()] == [0, 0, 1, 2, 3, 3]
