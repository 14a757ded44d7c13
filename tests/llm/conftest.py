import pytest
from pyspark.sql import types as T

FIELDS = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
EXTRA = ["size", "shard", "key", "h", "w", "n", "target", "weight", "epochs", "cosine", "licence", "block", "__x"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """docs(rows): documents of (doc_id, text[, source[, lang]]), with further columns whose names operators use themselves."""

    def docs(rows, extra=True):
        schema = T.StructType([T.StructField(*x) for x in FIELDS] + [T.StructField(x, T.StringType()) for x in EXTRA if extra])
        full = []
        for r in rows:
            doc, text, source, lang = (*r, *[None] * 4)[:4]
            full.append((doc, text, lang, source, None if text is None else len(text), *["x"] * len(EXTRA) * extra))
        return spark.createDataFrame(full, schema)

    return docs


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
    same = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, same, "a", "en"), (2, same, "a", "en"), (2, same, "a", "en"), (None, same, "b", "en"), (3, None, None, None), (4, "", "a", "fr"), (5, " \n\t ", "b", None), (6, long, "a", "en"), (6, long + " more", None, "en"), (None, None, None, None), (None, None, None, None), (7, "été à Évry ça", "c", "fr"), (8, "word", "c", None), (9, "word " * 3000, "c", "en"), (10, same.upper() + "!", "a", "en")]
    return make_docs(rows)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
