"""Facts that a repository's files state line by line: owners, services, resources, variables.

``files`` are (repo, path, content). Everything is column expressions; a file's
state (its package, its open block) is the last mark above a line, so a window
holds the lines of one file of at most ``MAX_FILE_BYTES``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config as C
from ..functions import text as T
from ..operators.link import first_wins

# Where owners are listed, in order, and names of files that list variables.
OWNER_PATHS = ("CODEOWNERS", ".github/CODEOWNERS", "docs/CODEOWNERS", ".gitlab/CODEOWNERS")
ENV_FILES = (".env.example", ".env.sample", ".env.template", "env.example")
MAX_FILE_BYTES = 512 * 1024
# Resource types, with the attribute that holds the name, our kind, and whether it is a store.
RESOURCES = {
    "aws_sqs_queue": ("name", "queue", False), "aws_s3_bucket": ("bucket", "s3", True), "aws_dynamodb_table": ("name", "dynamodb", True),
    "aws_sns_topic": ("name", "topic", False), "aws_kinesis_stream": ("name", "stream", False), "google_pubsub_topic": ("name", "topic", False),
    "google_storage_bucket": ("name", "gcs", True), "azurerm_servicebus_queue": ("name", "queue", False),
    "azurerm_servicebus_topic": ("name", "topic", False), "aws_ssm_parameter": ("name", "envvar", False),
    "azurerm_key_vault_secret": ("name", "envvar", False), "azurerm_app_configuration_key": ("key", "envvar", False),
    "google_secret_manager_secret": ("secret_id", "envvar", False),
}

_CODE = r"""^((?:[^'"#]|'[^']*(?:'|$)|"[^"]*(?:"|$)|(?<=[^ \t])#)*+)"""


def strip_comment(line: Column) -> Column:
    """The line up to an unquoted # at its start or after a blank."""
    return F.regexp_extract(line, _CODE, 1)


def _lines(files: DataFrame) -> DataFrame:
    """(repo, path, n, line) of the readable files, numbered from 1."""
    readable = files.filter(F.octet_length("content") <= MAX_FILE_BYTES)
    return readable.select("repo", "path", F.posexplode(F.split("content", r"\r\n|\n|\r")).alias("n", "line")).withColumn("n", F.col("n") + 1)


def _part(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract("line", pattern, group)


def _last(mark: Column) -> Column:
    return F.last(mark, ignorenulls=True).over(Window.partitionBy("repo", "path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))


def _base(path: str = "path") -> Column:
    return F.substring_index(path, "/", -1)


def _row(kind: Column | str, key: Column, detail: Column | str) -> list[Column]:
    kind, detail = (F.lit(x) if isinstance(x, str) else x for x in (kind, detail))
    return ["repo", kind.alias("kind"), F.trim(key).alias("key"), detail.alias("detail"), F.concat("path", F.lit(":"), "n").alias("evidence")]


def first_per_key(rows: DataFrame) -> DataFrame:
    """The first row, by kind, key and evidence, of each kind and key of a repository, whatever their case."""
    folded = rows.withColumn("__k", F.lower("kind")).withColumn("__n", F.lower("key"))
    return first_wins(folded.withColumnRenamed("__n", "__name"), ["repo", "__k", "__name"], ["kind", "key", "evidence"]).drop("__k", "__name")


def owners(files: DataFrame) -> DataFrame:
    """(repo, owners): of the first readable owners file, those of the first rule for ``*``, else of the first rule."""
    rank = F.array_position(F.array(*(F.lit(p) for p in OWNER_PATHS)), F.col("path"))
    listed = files.filter(F.col("path").isin(*OWNER_PATHS) & (F.octet_length("content") <= MAX_FILE_BYTES)).withColumn("rank", rank)
    lines = _lines(first_wins(listed, ["repo"], ["rank"])).withColumn("line", F.trim(F.regexp_replace(strip_comment(F.col("line")), r"\s+", " ")))
    rules = lines.withColumn("words", F.split("line", " ")).filter(~F.col("line").startswith("[") & (F.size("words") >= 2))
    best = first_wins(rules.withColumn("late", F.col("words")[0] != "*"), ["repo"], ["late", "n"])
    return best.select("repo", F.array_distinct(F.slice("words", 2, F.size("words"))).alias("owners"))


def grpc_services(files: DataFrame, stoplist: Sequence[str] = C.GENERIC_IDENTIFIERS) -> DataFrame:
    """(repo, kind, key, detail, evidence): each service of a .proto file below a package line."""
    package, service = _part(r"^\s*package\s+([\w.]+)\s*;"), _part(r"^\s*service\s+(\w+)\s*\{")
    lines = _lines(files.filter(_base().endswith(".proto"))).withColumn("package", _last(F.nullif(package, F.lit(""))))
    found = lines.filter(F.col("package").isNotNull() & (service != "")).select(*_row("grpc", F.concat("package", F.lit("."), service), "grpc service"))
    return first_per_key(found.filter(~F.lower("key").isin(*stoplist)))


def terraform(files: DataFrame, stoplist: Sequence[str] = C.GENERIC_IDENTIFIERS) -> tuple[DataFrame, DataFrame]:
    """(exposes, stores) of .tf files: literal names of known resources, and outputs that name a connection."""
    resource, output = _part(r'^\s*resource\s+"(\w+)"\s+"[^"]*"\s*\{'), _part(r'^\s*output\s+"([^"]+)"\s*\{')
    mark = F.when(resource != "", resource).when((output != "") | F.col("line").startswith("}"), "")
    lines = _lines(files.filter(_base().endswith(".tf"))).withColumn("type", _last(mark))
    literal = r'^\s*(\w+)\s*=\s*"([^"]*)"\s*$'
    known = F.create_map(*(x for t, (a, k, s) in RESOURCES.items() for x in (F.lit(t), F.struct(F.lit(a).alias("attr"), F.lit(k).alias("kind"), F.lit(s).alias("store")))))
    named = lines.withColumn("r", known[F.col("type")]).filter(F.col("r.attr") == _part(literal))
    named = named.withColumn("name", F.trim(_part(literal, 2))).filter((F.col("name") != "") & ~F.col("name").contains("${"))

    def published(rows: DataFrame, raw: Column, detail: str) -> DataFrame:
        out = rows.withColumn("env", T.env_name(raw))
        return out.filter((F.col("env") != "") & ~T.env_generic(F.col("env"), stoplist)).select(*_row("envvar", F.col("env"), detail))

    plain = named.filter(~F.col("r.store") & (F.col("r.kind") != "envvar") & (F.char_length("name") >= 2) & ~F.lower("name").isin(*stoplist))
    exposes = (
        plain.select(*_row(F.col("r.kind"), F.col("name"), F.concat(F.lit("terraform "), "r.kind")))
        .unionByName(published(named.filter("r.kind = 'envvar'"), F.col("name"), "terraform published config key"))
        .unionByName(published(lines.filter(output != ""), output, "terraform output"))
    )
    stores = first_per_key(named.filter("r.store").select(*_row(F.col("r.kind"), F.col("name"), "")))
    return first_per_key(exposes), stores.select("repo", "kind", F.col("key").alias("name"), F.lit("owner").alias("access"), "evidence")


def own_variables(files: DataFrame, names: DataFrame, stoplist: Sequence[str] = C.GENERIC_IDENTIFIERS, more: DataFrame | None = None) -> DataFrame:
    """(repo, kind, key, detail, evidence): variables of example files, and ``more``, that are named for the repository.

    names (repo, value): the repository's name and identifiers. more (repo, name,
    detail, evidence): variables that other files declare. A variable that
    isn't named for one of them is what the repository reads, not what it gives.
    """
    low, host = F.lower("value"), T.service_host(F.col("value"))
    forms = names.select("repo", F.explode(F.array(low, host, T.first_label(host))).alias("form"))
    forms = forms.select("repo", F.explode(F.array("form", F.regexp_replace("form", r"-(?:service|svc|api)\z", ""))).alias("form"))
    forms = forms.filter((F.col("form") != "") & ~F.col("form").isin(*stoplist)).distinct()
    declared = _part(r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=")
    lines = _lines(files.filter(_base().isin(*ENV_FILES)))
    rows = lines.select("repo", declared.alias("name"), F.lit("env example file").alias("detail"), F.concat("path", F.lit(":"), "n").alias("evidence"))
    rows = (rows if more is None else rows.unionByName(more)).withColumn("key", T.once(F.col("name"), T.env_name))
    rows = rows.filter((F.col("key") != "") & ~T.env_generic(F.col("key"), stoplist))
    asked = rows.select("repo", "key", "detail", "evidence", F.explode(T.once(F.col("key"), T.env_forms)).alias("form"))
    own = asked.join(forms, ["repo", "form"], "left_semi")
    return first_per_key(own.select("repo", F.lit("envvar").alias("kind"), "key", "detail", "evidence"))
