import pytest

LONG = "alpha beta gamma delta " * 60_000  # over a million bytes
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "b"),
        (2, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "b"),
        (3, "The quick brown fox jumps over the lazy dog near the old river bank Today", None, None),
        (4, "", "en", "a"), (5, None, "de", "a"), (6, None, None, None), (None, "ein Text ohne Nummer", "de", "b"),
        (None, None, None, None), (7, " \t\n ", "de", ""), (8, "1234 5678 +-*/ ...", "fr", "c"),
        (9, LONG, "en", "a"), (10, "größer schöner weiter Straße", "de", "b"), (11, "x", "fr", "c"),
        (11, "y z", "fr", "c"), (12, "a\x00b \U0001F600 c", "es", "d"), (13, "word", "en", "a"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(edge):
    """Further columns with names that operators use inside."""
    from pyspark.sql import functions as F

    names = "row mark fp id score shard slot size cell start part hits items k1 k2 copy src block toxic span n_words text_crc32"
    return edge.withColumns({n: F.lit(n) for n in names.split()})


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")
