"""Deploy and API manifests: the YAML reader, and what files claim."""

import pytest

from graphloom.sources import deploy, yamltext


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a: 1\nb:\n  c: 'x # y' # z\n  d: https://h:80/p\n", [{"a": "1", "b": {"c": "x # y", "d": "https://h:80/p"}}]),
        ("k:\n- a\n- b: 1\n  c: 2\nz: {x: [1, 'a,b'], y: }\n", [{"k": ["a", {"b": "1", "c": "2"}], "z": {"x": ["1", "a,b"], "y": ""}}]),
        ("s: |\n  # no: comment\n\n  k: v\nt: >-\n  one\n", [{"s": "# no: comment\n\nk: v", "t": "one"}]),
        ("a: &x one\nb: *x\nc: !tag\nd:\n", [{"a": "one", "b": "", "c": "", "d": None}]),
        ("---\na: 1\n---\n- - b: 2\n-\n  c: 3\n- \n...\n", [{"a": "1"}, [[{"b": "2"}], {"c": "3"}, None]]),
        ("a: 1\n\tb: 2\n", []), ("a: 1\n   b: 2\n", []), ("just text\n", []), ("- a: 1\n   b: 2\n", []), ("a: {b}\n", []), ("a: 1\n- b\n", []),
        ("", []), ("# only\n\n", []), 
        # A block scalar's body goes by the column of its line's dash, so it takes the item's further keys.
        ("- a: |\n    body\n  b: 1\n", [[{"a": "body\nb: 1"}]]),
        ("".join("  " * i + "k:\n" for i in range(3000)), []),
    ],
)
def test_reader(text, expected):
    assert yamltext.read(text) == expected


def _files(spark, rows):
    return spark.createDataFrame(rows, "repo string, path string, content string")


def _rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


SERVICE = "apiVersion: v1\nkind: Service\nmetadata:\n  name: Orders\n  namespace: shop\n---\napiVersion: v1\nkind: Service\nmetadata: {name: api}\n"
INGRESS = "apiVersion: n/v1\nkind: Ingress\nspec:\n  rules:\n  - host: orders.acme.io\n  - http: x\n  - text\n"
COMPOSE = "services:\n  pay-worker:\n    build: .\n    environment:\n      - PAY_WORKER_URL=http://x\n      - OTHER_URL=1\n  postgres:\n    image: postgres:15\n"
OPENAPI = '{"info": {"title": "orders-api-v2"}, "servers": [{"url": "https://Orders.acme.io/v1"}, {"url": "/relative"}, {"url": "https://{host}/"}, 7]}'


def test_all_facts(spark):
    files = _files(spark, [
        ("shop", "k8s/svc.yaml", SERVICE), ("shop", "k8s/ing.yml", INGRESS), ("shop", "docker-compose.yml", COMPOSE), ("shop", "api/openapi.json", OPENAPI),
        ("shop", "catalog-info.yaml", "metadata:\n  name: orders\nspec:\n  owner: team-b\n  providesApis: [orders-events, db]\n"),
        ("shop", "CODEOWNERS", "* @a team-b"), ("shop", "chart/templates/x.yaml", SERVICE.replace("Orders", "Templated")), ("shop", "Chart.yaml", "name: shop-chart\n"),
        ("shop", "p.proto", "package shop.v1;\nservice Cart {\n"), ("shop", "m.tf", 'resource "aws_sqs_queue" "q" {\n  name = "jobs"\n}\n'), ("shop", "bad.yaml", "a: 1\n  b: 2"),
        ("shop", "null.yaml", None), ("shop", "openapi-bad.json", "{"), ("other", "cm.yaml", "apiVersion: v1\nkind: ConfigMap\ndata:\n  OTHER_URI: x\n  SHOP_URI: y\n"),
    ])
    ids, exposes, stores, owners = deploy.all_facts(files, ["api", "db"])
    assert _rows(ids, "repo", "value") == [
        ("shop", v) for v in ["Orders.shop.svc.cluster.local", "orders", "orders-api-v2", "orders-events", "orders.acme.io", "pay-worker", "shop-chart", "shop.v1.Cart"]
    ]
    assert _rows(exposes, "repo", "kind", "key", "detail", "evidence") == [
        ("other", "envvar", "OTHER_URI", "kubernetes config map", "cm.yaml"),
        ("shop", "envvar", "PAY_WORKER_URL", "compose environment", "docker-compose.yml"),
        ("shop", "grpc", "shop.v1.Cart", "grpc service", "p.proto:2"),
        ("shop", "http", "Orders", "kubernetes service", "k8s/svc.yaml"),
        ("shop", "http", "orders.acme.io", "openapi server", "api/openapi.json"),
        ("shop", "queue", "jobs", "terraform queue", "m.tf:2"),
    ]
    assert stores.count() == 0
    assert _rows(owners, "repo", "owners") == [("shop", ["@a", "team-b"])]


def test_yaml_files_are_counted_by_path(spark):
    files = _files(spark, [("r", f"d{i:03}/Chart.yaml", f"name: chart-{i}\n") for i in range(deploy.MAX_YAML_FILES + 5)])
    values = {r.value for r in deploy.claims(files).collect()}
    assert len(values) == deploy.MAX_YAML_FILES and f"chart-{deploy.MAX_YAML_FILES}" not in values


def test_no_files(spark):
    assert all(df.count() == 0 for df in deploy.all_facts(_files(spark, [])))
