import pytest
from pyspark.sql import functions as F


@pytest.fixture
def docs(spark):
    """docs([(id, text), ...]): a documents table with further columns, some of names that operators use inside."""

    def make(rows, source=None):
        schema = "doc_id long, text string, source string, lang string, n_chars long, k1 long, fp string, h int, line int, site string, score double, first int"
        return spark.createDataFrame([(i, t, source(n) if source else f"s{n % 7}", "en", 0, 1, "x", 2, 3, "y", 0.5, 4) for n, (i, t) in enumerate(rows)], schema)

    return make


EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "É x"), (6, "word " * 30_000), (7, "same text here again and again"), (7, "same text here again and again"), (8, "same text here again and again"), (None, "no id at all"), (None, "no id at all"), (9, "a" * 100_000), (10, "nul\x00byte and \U0001f600 emoji")]


@pytest.fixture
def edges(docs):
    return docs(EDGES)


@pytest.fixture
def empty(docs):
    return docs([(1, "x")]).where(F.lit(False))
