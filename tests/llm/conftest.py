import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, path string, set_key int"


def rows_of(pairs):
    return [(k, t, None if k == 3 else "en", None if k == 2 else "web", None if t is None else len(t), "x", None, 1) for k, t in pairs]


@pytest.fixture
def make(spark):
    """Documents with columns of clashing names from (doc_id, text) pairs."""
    return lambda pairs: spark.createDataFrame(rows_of(pairs), SCHEMA)
