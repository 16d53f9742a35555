import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from samples import make_docs  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names the operators use inside."""
    data = [(i, x, "en", "s", None if x is None else len(x), 7, "z") for i, x in rows]
    return spark.createDataFrame(data, SCHEMA + ", n_words int, found string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
