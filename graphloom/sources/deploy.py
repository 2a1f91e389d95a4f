"""Names, hosts, owners and variables that deploy and API manifests state, and all facts of a repository together.

``files`` are (repo, path, content). Python reads the formats, in batches, and
tells what a document claims; what counts as a name is decided by column
expressions. A null or oversized content, and a file at fault, claims nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config as C
from ..functions import text as T
from ..operators.link import first_wins
from . import facts, yamltext

#: YAML files of a repository that are read, the first by path.
MAX_YAML_FILES = 400
# API descriptions in JSON, and the version of the facts that are read.
JSON_APIS = ("openapi*.json", "swagger*.json")
FACTS_VERSION = 7

CLAIMS = "repo string, path string, nth long, role string, kind string, value string, detail string"


def _map(x) -> dict:
    return x if isinstance(x, dict) else {}


def _list(x) -> list:
    return x if isinstance(x, list) else []


def _word(x) -> str | None:
    """A scalar as text; lists and mappings are no names."""
    return None if x is None or isinstance(x, (dict, list)) else str(x)


def _api(doc: dict) -> Iterator[tuple]:
    yield "title", None, _word(_map(doc.get("info")).get("title")), None
    for server in _list(doc.get("servers")):
        yield "server", "http", _word(server.get("url") if isinstance(server, dict) else server), "openapi server"


def _catalog(doc: dict) -> Iterator[tuple]:
    spec = _map(doc.get("spec"))
    yield "name", None, _word(_map(doc.get("metadata")).get("name")), None
    yield "owner", None, _word(spec.get("owner")), None
    for api in _list(spec.get("providesApis")):
        yield "name", None, _word(api), None


def _chart(doc: dict) -> Iterator[tuple]:
    yield "name", None, _word(doc.get("name")), None


def _compose(doc: dict) -> Iterator[tuple]:
    for name, body in _map(doc.get("services")).items():
        if _map(body).get("build") is None:  # somebody else's image under a local alias
            continue
        yield "name", None, name, None
        environment = body.get("environment")
        for variable in environment if isinstance(environment, (list, dict)) else ():
            yield "variable", None, _word(variable), "compose environment"


def _service(doc: dict) -> Iterator[tuple]:
    meta = _map(doc.get("metadata"))
    name, space = (_word(meta.get(k)) for k in ("name", "namespace"))
    yield "expose", "http", name, "kubernetes service"
    if name and space and space.strip():
        yield "inside", None, name, space.strip()


def _config_map(doc: dict) -> Iterator[tuple]:
    for variable in _map(doc.get("data")):
        yield "variable", None, variable, "kubernetes config map"


def _ingress(doc: dict) -> Iterator[tuple]:
    for rule in _list(_map(doc.get("spec")).get("rules")):
        yield "expose", "http", _word(_map(rule).get("host")), "ingress host"


BY_NAME = {"catalog-info": _catalog, "docker-compose": _compose, "compose": _compose, "openapi": _api, "swagger": _api}
BY_KIND = {"Service": _service, "ConfigMap": _config_map, "Ingress": _ingress}


def document_claims(base: str, doc) -> Iterator[tuple]:
    """(role, kind, value, detail) of what one YAML document of a file claims."""
    if not isinstance(doc, dict):
        return
    base = base.lower()
    reader = _chart if base == "chart.yaml" else next((f for start, f in BY_NAME.items() if base.startswith(start)), None)
    if reader is not None:
        yield from reader(doc)
    if doc.get("apiVersion") and isinstance(doc.get("kind"), str) and doc["kind"] in BY_KIND:
        yield from BY_KIND[doc["kind"]](doc)


def _json_claims(text: str) -> list[tuple]:
    try:
        doc = json.loads(text)
    except (ValueError, RecursionError):
        return []
    return list(_api(doc)) if isinstance(doc, dict) else []


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in CLAIMS.split(", ")]
    for batch in batches:
        out = []
        for repo, path, content in zip(batch["repo"], batch["path"], batch["content"]):
            base = path.rpartition("/")[2]
            if base.endswith(".json"):
                found = _json_claims(content)
            else:
                found = [claim for doc in yamltext.read(content) for claim in document_claims(base, doc)]
            out += [(repo, path, n, *claim) for n, claim in enumerate(found) if claim[2] is not None]
        yield pd.DataFrame(out, columns=columns)


def claims(files: DataFrame) -> DataFrame:
    """(repo, path, nth, role, kind, value, detail) of the manifests that are read."""
    readable = files.filter(F.octet_length("content") <= facts.MAX_FILE_BYTES).select("repo", "path", "content")
    yaml = readable.filter(F.col("path").rlike(r"\.ya?ml\z") & ~F.col("path").contains("templates/"))
    order = Window.partitionBy("repo").orderBy(F.split("path", "/"))
    # The texts needn't be sorted to count files: the window sees paths only.
    first = yaml.select("repo", "path").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= MAX_YAML_FILES).drop("n")
    json_apis = readable.filter(T.path_matches(F.substring_index("path", "/", -1), list(JSON_APIS)))
    return yaml.join(first, ["repo", "path"], "left_semi").unionByName(json_apis).mapInPandas(_read, CLAIMS)


def usable(value: Column, stoplist: Sequence[str]) -> Column:
    """The stripped name, or null where it is too short or says nothing."""
    return T.once(T.strip(value), lambda name: F.when((F.char_length(name) >= 2) & ~F.lower(name).isin(*stoplist), name))


def exposed(found: DataFrame, stoplist: Sequence[str] = C.GENERIC_IDENTIFIERS) -> DataFrame:
    """(repo, kind, key, detail, evidence, path, nth) of services, ingress hosts and servers with a host of their own."""
    absolute = F.lower(T.strip(F.col("value"))).rlike(r"^[a-z][a-z0-9+.\-]*://")
    host = T.once(T.service_host(F.col("value")), lambda h: F.when((h != "") & ~h.contains("{") & ~T.under(h, C.NOISE_HOSTS), h))
    key = usable(F.when(F.col("role") == "expose", F.col("value")).when((F.col("role") == "server") & absolute, host), stoplist)
    return found.select("repo", "kind", key.alias("key"), "detail", F.col("path").alias("evidence"), "path", "nth").filter("key is not null")


def identifiers(found: DataFrame, services: DataFrame, stoplist: Sequence[str] = C.GENERIC_IDENTIFIERS) -> DataFrame:
    """(repo, value): names that a repository answers to, each as first written.

    services (repo, key, evidence): further exposed names, after those of ``found``.
    """
    value, role = F.col("value"), F.col("role")
    named = F.when(role == "name", value).when((role == "title") & ~T.strip(value).rlike(r"(?U)\s"), value)
    inside = F.when(role == "inside", F.concat(usable(value, stoplist), F.lit("."), "detail", F.lit(".svc.cluster.local")))
    late = F.when(F.col("path").endswith(".json"), 1).otherwise(0)
    rows = found.select("repo", late.alias("late"), "path", "nth", usable(F.coalesce(named, inside), stoplist).alias("value"))
    rows = rows.unionByName(exposed(found, stoplist).select("repo", late.alias("late"), "path", "nth", F.col("key").alias("value")))
    rows = rows.unionByName(services.select("repo", F.lit(2).alias("late"), F.col("evidence").alias("path"), F.lit(0).cast("long").alias("nth"), F.col("key").alias("value")))
    rows = rows.filter("value is not null").withColumn("low", F.lower("value")).withColumn("parts", F.split("path", "/"))
    return first_wins(rows, ["repo", "low"], ["late", "parts", "nth", "value"]).select("repo", "value")


def variables(found: DataFrame) -> DataFrame:
    """(repo, name, detail, evidence): variables that built services and config maps declare."""
    return found.filter("role = 'variable'").select("repo", F.substring_index(T.strip(F.col("value")), "=", 1).alias("name"), "detail", F.col("path").alias("evidence"))


def owners(files: DataFrame, found: DataFrame) -> DataFrame:
    """(repo, owners): those of the owners file, then the catalogs', each once."""
    listed = facts.owners(files).select("repo", F.posexplode("owners").alias("nth", "owner")).select("repo", F.lit(0).alias("late"), F.array().cast("array<string>").alias("parts"), F.col("nth").cast("long").alias("nth"), "owner")
    stated = found.filter("role = 'owner'").select("repo", F.lit(1).alias("late"), F.split("path", "/").alias("parts"), "nth", T.strip(F.col("value")).alias("owner"))
    once = first_wins(listed.unionByName(stated).filter("owner <> ''"), ["repo", "owner"], ["late", "parts", "nth"])
    at = F.struct("late", "parts", "nth", "owner")
    return once.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(at)), lambda r: r.owner).alias("owners"))


def all_facts(files: DataFrame, stoplist: Sequence[str] = C.GENERIC_IDENTIFIERS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(identifiers, exposes, stores, owners) of each repository, from all formats.

    Of several exposes with the same kind and key, whatever their case, the first
    by kind, key and evidence stays. Variables count where they are named for the
    repository or for a name that it answers to.
    """
    found = claims(files)
    services = facts.grpc_services(files, stoplist)
    terraform, stores = facts.terraform(files, stoplist)
    ids = identifiers(found, services, stoplist)
    names = ids.unionByName(files.select("repo", F.col("repo").alias("value")).distinct())
    own = facts.own_variables(files, names, stoplist, variables(found))
    parts = [exposed(found, stoplist).drop("path", "nth"), services, terraform, own]
    columns = ["repo", "kind", "key", "detail", "evidence"]
    exposes = facts.first_per_key(reduce(DataFrame.unionByName, (p.select(*columns) for p in parts)))
    return ids, exposes.select(*columns), stores, owners(files, found)
