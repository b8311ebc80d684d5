import pytest


@pytest.fixture
def docs(spark):
    """documents from (doc_id, text) rows, with columns whose names clash with the operators' own."""

    def make(rows, **more):
        schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, component_id long, class int"
        return spark.createDataFrame([(i, t, more.get("lang", {}).get(i), "s", None, 5, 0.5, 99, 3) for i, t in rows], schema)

    return make
