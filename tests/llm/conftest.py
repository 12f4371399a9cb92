import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty and long texts, ties, repeated rows.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "\n\n", "en", "a", 2),
    (4, "one two three four five six seven " * 3000, "en", "a", None),
    (5, "été déjà vu — naïve <|endoftext|>   　x\ty\r\nz <|startoftext|>'s don't", "fr", "b", 9),
    (5, "été déjà vu — naïve <|endoftext|>   　x\ty\r\nz <|startoftext|>'s don't", "fr", "b", 9),
    (6, "ábc   \t  \U0001f600‍\U0001f600 ΣΑΣ ΟΔΟΣ 12345 €§±", "de", "b", 1),
    (7, "x" * 5000, None, None, None),
]


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def clash(odd):
    """Columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    for name in ("hash", "n_lines", "id", "key", "pos", "count", "sequence_id", "component_id", "kept", "score", "group", "__doc", "__md5", "__drop", "__row", "__of", "__kept", "__one", "__n_lines", "__salt"):
        odd = odd.withColumn(name, F.lit("x"))
    return odd


@pytest.fixture()
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
