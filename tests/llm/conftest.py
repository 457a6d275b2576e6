import pytest

ODD = [
    (1, "", "en", "s"), (2, None, None, None), (3, " \t\n ", "en", "s"), (4, "one", "en", "s"), (5, "a b c d", "en", "s"), (6, "a b c d", "en", "s"),
    (None, "no id here at all", "en", "s"), (7, "é😀 ñandú über straße " * 40, "es", "s"), (8, "word " * 30_000, "en", "s"), (9, "x" * 60_000, None, "s"),
    (10, "same text of more than twenty words " * 4, "en", "s"), (10, "same text of more than twenty words " * 4, "en", "s"), (10, "another text under the same id", "fr", "s"), (-3, "negative id", "de", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids."""
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def wide(odd):
    """Extra columns, of names that operators use inside."""
    from pyspark.sql import functions as F

    names = ("score", "folded", "spans", "place", "chunk", "part", "id", "copy", "bands", "node", "class_id", "predicted", "pii_text", "y", "block", "n_chars")
    return odd.withColumns({n: F.lit(1) for n in names})


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
