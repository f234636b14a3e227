import pytest

from trellis.session import ship_package

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark(spark):
    ship_package(spark)
    return spark


@pytest.fixture
def docs(spark):
    """Frame of documents from (id, text) pairs, with the columns of the real table and one that clashes."""

    def make(rows, *names):
        extra = "".join(f", {n} string" for n in names)
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *("x" for _ in names)) for i, t in rows], DOCS + extra)

    return make
