import pytest

from exposure.llm.queries import ROOT


@pytest.fixture(scope="session", autouse=True)
def workers_find_the_package(spark):
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents rows from (doc_id, text) pairs, with extra columns whose names the operators use themselves."""

    def build(pairs):
        rows = [(i, t, "en", "s", len(t or ""), "k", 1, 2, 0.5, True) for i, t in pairs]
        schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, doc int, start int, score double, ids boolean"
        return spark.createDataFrame(rows, schema)

    return build
