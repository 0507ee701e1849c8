import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes documents of texts; a row of an own doc_id may be given as (doc_id, text)."""

    def make(texts, **extra):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0) for i, t in rows], DOC)
        for name, column in extra.items():
            df = df.withColumn(name, column)
        return df

    return make
