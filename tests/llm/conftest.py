import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text) pairs."""

    def make(rows, lang="en", source="src1"):
        return spark.createDataFrame([(i, t, lang, source, len(t) if t else 0) for i, t in rows], DOCS)

    return make
