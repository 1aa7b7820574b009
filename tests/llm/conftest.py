import pytest


@pytest.fixture
def docs(spark):
    """A frame of documents from ``(doc_id, text[, source, lang])`` tuples."""

    def make(rows, schema="doc_id long, text string, source string, lang string"):
        n = len(schema.split(","))
        return spark.createDataFrame([tuple(r) + (None,) * (n - len(r)) for r in rows], schema).repartition(3)

    return make


AWKWARD = [
    (1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (4, "one", None), (4, "one", None), (5, "one", "b"), (None, "null id", "b"),
    (None, None, None), (6, "ünï © 中文 \x00 \U0001f600", "c"), (7, "long word " * 40_000, "c"), (8, "\n" * 500, "a"), (9, "x" * 300_000, "b"),
]


@pytest.fixture
def awkward():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    return AWKWARD
