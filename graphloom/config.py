"""Fixed values that carry meaning in the data model, stated as they are."""

# Consume and expose kinds by the family that they are matched in.
FAMILY = {
    "http": "svc", "grpc": "svc", "graphql": "svc", "websocket": "svc",
    "topic": "msg", "queue": "msg", "event": "msg", "stream": "msg",
    "package": "pkg", "database": "db", "envvar": "env",
}
# Strength of a match.
RANK = {"exact": 0, "alias": 1, "envvar": 2}
# Stores, identifiers and stems too common to name one owner.
GENERIC_STORES = ("db", "database", "postgres", "postgresql", "mysql", "redis", "cache", "s3", "dynamodb", "main", "default")
GENERIC_IDENTIFIERS = (
    "api", "app", "web", "db", "service", "services", "server", "backend", "frontend", "core", "common", "shared",
    "utils", "util", "lib", "libs", "client", "gateway", "internal", "main", "default", "www", "localhost",
)
GENERIC_STEMS = (*GENERIC_STORES, "mongo", "mongodb", "sql", "mssql", "sqlserver", "kafka", "rabbitmq", "amqp", "elasticsearch", "es", "storage", "queue")
# Connection suffixes of environment variables.
ENV_SUFFIX = r"_(?:BASE_URL|URL|URI|HOSTNAME|HOST|ENDPOINT|ADDRESS|ADDR|PORT)\z"
# Hosts that are never a third party, and hosts that say nothing.
PLACEHOLDER_HOSTS = ("localhost", "example.com", "example.org", "example.net", "w3.org", "json-schema.org", "schema.org")
INTERNAL_TLDS = ("local", "internal", "svc", "localhost", "lan", "localdomain")
WEB_KINDS = ("http", "graphql", "websocket")
NOISE_HOSTS = (
    "localhost", "127.0.0.1", "0.0.0.0", "example.com", "example.org", "w3.org", "json-schema.org", "schema.org", "github.com",
    "gitlab.com", "npmjs.org", "npmjs.com", "pypi.org", "golang.org", "apache.org", "maven.org", "googleapis.com", "amazonaws.com",
)
# Changes that never need a new mapping.
IGNORED_CHANGES = (
    "test/*", "tests/*", "*/test/*", "*/tests/*", "*__tests__*", "*__mocks__*", "*_test.go", "*_test.py", "test_*.py",
    "*/test_*.py", "*.test.*", "*.spec.*", "docs/*", "*/docs/*", "*.md", "*.txt", "*.png", "*.jpg", "*.gif", "*.svg",
    ".github/*", ".vscode/*", ".idea/*", "LICENSE", "CHANGELOG*",
)
# Weights of the searched fields.
SEARCH_WEIGHTS = {"name": 5, "identifiers": 4, "summary": 3, "exposes": 3, "datastores": 2, "consumes": 1, "publishes": 2, "overview": 1}
MAX_HOPS = 10
