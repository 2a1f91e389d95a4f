"""The lines of a repository's files that name other systems, in five categories.

``files`` are (repo, path, content). Everything is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config as C
from ..functions import redact as R
from ..functions import text as T

# Extensions of files that are read.
EXTENSIONS = (
    ".go", ".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".kt", ".rb", ".cs", ".rs", ".php", ".scala",
    ".sh", ".yaml", ".yml", ".toml", ".json", ".tf", ".hcl", ".properties", ".conf", ".cfg", ".ini", ".env",
)
# Category and pattern; the first group is the key.
PATTERNS = {
    "url": r"(?U)\bhttps?://([A-Za-z0-9_.\-]+(?::\d+)?)",
    "env": r"(?U)(?i:getenv|environ|process\.env|env::var|getenvironmentvariable|\bENV\b)\W{0,4}([A-Z][A-Z0-9_]{2,})",
    "messaging": r"""(?iU)(?:topic|queue|subscri|publish|kafka|sqs|sns|pubsub|nats)[^"']{0,60}["']([\w.\-/:]{3,})["']""",
    "datastore": (
        r"""(?iU)((?:postgres|postgresql|mysql|mongodb|redis|dynamodb|elasticsearch|s3)://[^\s"'`,)]+"""
        r"""|(?:postgres|postgresql|mysql|mongodb|redis|dynamodb|elasticsearch)[^"']{0,40}["'][^"']{3,}["'])"""
    ),
    "client": r"""(?iU)(?:grpc\.Dial|NewClient|\.Dial\(|baseURL|base_url|BaseUrl)[^"']{0,40}["']([^"']{3,})["']""",
}
# Words that make a variable worth a line without a connection suffix.
ENV_INTERESTING = ("TOPIC", "QUEUE", "BUCKET", "TABLE", "DB", "DATABASE", "KAFKA", "SQS", "SNS", "REDIS")
MAX_FILE_BYTES, MAX_FILES, PER_CATEGORY, LINE_CHARS = 512 * 1024, 4000, 60, 200

_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def hits(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``lines`` with category, pos and found: a row for each match of each pattern in the column line."""
    def each(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)), lambda k, i: F.struct(F.lit(name).alias("category"), i.alias("pos"), k.alias("found")))

    return lines.select("*", F.inline(F.concat(*(each(*x) for x in patterns.items()))))


def signal_sections(files: DataFrame, max_files: int = MAX_FILES, per_category: int = PER_CATEGORY) -> DataFrame:
    """(repo, category, position, key, line): the first line of each distinct key, as path:line: text.

    Files are read in order of path, ``max_files`` of a repository with one of the
    extensions at most; a category takes no line once it has ``per_category`` keys,
    but all keys of the line that fills it.
    """
    extension = F.concat(F.lit("."), F.substring_index("path", ".", -1))
    names = files.filter(extension.isin(*EXTENSIONS) & F.col("content").isNotNull()).select("repo", "path")
    read = names.withColumn("at", F.row_number().over(Window.partitionBy("repo").orderBy("path"))).filter(F.col("at") <= max_files)
    readable = files.filter(F.octet_length("content") <= MAX_FILE_BYTES).join(read.drop("at"), ["repo", "path"])
    text = R.redact(F.col("content"))
    text = F.when(F.char_length(text) > MAX_FILE_BYTES, F.concat(F.substring(text, 1, MAX_FILE_BYTES), F.lit("\n... truncated\n"))).otherwise(text)
    lines = readable.select("repo", "path", F.posexplode(F.split(text, _BREAK)).alias("n", "line"))
    lines = lines.select("repo", "path", (F.col("n") + 1).alias("n"), T.strip(F.col("line")).alias("line")).filter("line != ''")

    is_ = lambda name: F.col("category") == name
    found = F.col("found")
    key = F.lower(F.when(is_("url"), F.substring_index(found, ":", 1)).otherwise(found))
    noise = r"(?:\A|\.)(?:" + "|".join(h.replace(".", r"\.") for h in C.NOISE_HOSTS) + r")\z"
    told = found.rlike(C.ENV_SUFFIX) | found.rlike("|".join(ENV_INTERESTING))
    first = (
        hits(lines, PATTERNS).withColumn("key", key)
        .filter((~is_("url") | ~F.col("key").rlike(noise)) & (~is_("env") | told))
        .groupBy("repo", "category", "key").agg(F.min(F.struct("path", "n", "pos", F.substring("line", 1, LINE_CHARS).alias("text"))).alias("f"))
        .select("repo", "category", "key", "f.*")
    )
    of = Window.partitionBy("repo", "category")
    kept = first.withColumn("before", F.rank().over(of.orderBy("path", "n"))).filter(F.col("before") <= per_category)
    position = F.row_number().over(of.orderBy("path", "n", "pos"))
    return kept.select("repo", "category", position.alias("position"), "key", F.concat("path", F.lit(":"), "n", F.lit(": "), "text").alias("line"))
