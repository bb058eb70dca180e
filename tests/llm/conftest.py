import pytest


@pytest.fixture(autouse=True, scope="session")
def _library(spark):
    from suite.ship import ship

    ship(spark)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text, lang, source) rows; n_chars follows."""
    def make(rows):
        full = [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows]
        return spark.createDataFrame(full, DOCS)

    return make
