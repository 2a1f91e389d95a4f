"""Facts read line by line from files."""

from graphloom.sources import facts


def _files(spark, rows):
    return spark.createDataFrame(rows, "repo string, path string, content string")


def _keys(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_owners_of_the_rule_for_all(spark):
    files = _files(spark, [
        ("a", ".github/CODEOWNERS", "# *  @no\n[Section]\n/docs @docs\n*  @one @two @one # why\n* @late"),
        ("a", "docs/CODEOWNERS", "* @second-file"),
        ("b", "CODEOWNERS", "lonely\n/src @src"), ("c", "CODEOWNERS", None), ("d", "other/CODEOWNERS", "* @x"),
    ])
    assert _keys(facts.owners(files), "repo", "owners") == [("a", ["@one", "@two"]), ("b", ["@src"])]


def test_services_below_their_package(spark):
    files = _files(spark, [("a", "p/x.proto", "service Early {\npackage shop.v1;\r\n service Orders {\n}\nservice orders {"), ("a", "x.txt", "package q;\nservice Z {")])
    assert _keys(facts.grpc_services(files), "key", "evidence") == [("shop.v1.Orders", "p/x.proto:3")]


def test_resources_and_outputs(spark):
    text = 'resource "aws_sqs_queue" "q" {\n  name = "jobs"\n  other = "no"\n}\nname = "outside"\nresource "aws_s3_bucket" "b" {\n bucket = "data-x"\n}\n'
    text += 'resource "aws_sns_topic" "t" {\n  name = "${var.x}-t"\n}\noutput "billing-url" {\n  name = "none"\n}\nresource "aws_ssm_parameter" "p" {\n name = "/prod/SHOP_URI"\n}\noutput "mongo_uri" {'
    exposes, stores = facts.terraform(_files(spark, [("a", "m.tf", text)]))
    assert _keys(exposes, "kind", "key", "evidence") == [("envvar", "BILLING_URL", "m.tf:12"), ("envvar", "SHOP_URI", "m.tf:16"), ("queue", "jobs", "m.tf:2")]
    assert _keys(stores, "kind", "name", "access") == [("s3", "data-x", "owner")]


def test_only_variables_named_for_the_repository(spark):
    files = _files(spark, [("orders-service", ".env.example", "ORDERS_URL=x\nexport PAYMENTS_URL=y\nORDERS_NAME=z\n"), ("orders-service", ".env", "ORDERS_HOST=x")])
    names = spark.createDataFrame([("orders-service", "orders-service")], "repo string, value string")
    assert _keys(facts.own_variables(files, names), "key", "evidence") == [("ORDERS_URL", ".env.example:1")]
