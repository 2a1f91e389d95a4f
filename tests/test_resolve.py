"""Resolution of names."""

from graphloom.operators import select as S


def test_identifiers_come_before_parts_of_names(spark):
    names = spark.createDataFrame([(x,) for x in ("billing", "billing-api", "shop", "store")], "name string")
    identifiers = spark.createDataFrame([("shop", "API"), ("shop", "till"), ("store", "Till"), ("shop", "store")], "name string, identifier string")
    asked = spark.createDataFrame([(x,) for x in ("api", "till", "store", "BILL", "none")], "asked string")
    got = {r.asked: (r.tier, r.n, r.name, r.candidates) for r in S.resolve(names, asked, identifiers).collect()}
    assert got == {"api": (4, 1, "shop", None), "till": (4, 2, None, ["shop", "store"]), "store": (1, 1, "store", None), "BILL": (3, 2, None, ["billing", "billing-api"])}
