import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(rows):
        """rows: (doc_id, text) or texts; the columns of documents, and more whose names clash with inner ones."""
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs], SCHEMA)
        return df.selectExpr("*", "1 as key", "2 as digest", "'x' as a", "0 as rep", "'y' as kind", "7 as n_tokens", "3 as h", "1 as doc")

    return make


HARD = [None, "", " \n ", "one", "a b c d", "same words here and there again", "same words here and there again", "é ñ ß 漢字 \U0001f600 mixed", "x" * 3000, "word " * 5000]


@pytest.fixture
def hard():
    return list(HARD)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}
