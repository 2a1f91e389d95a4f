import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, region string, label string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source, lang]) with clashing extra columns."""

    def build(rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "y") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build
