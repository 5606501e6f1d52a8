import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text) rows."""

    def make(rows, extra=None):
        df = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}" if i is None or i % 5 else None, None if t is None else len(t)) for i, t in rows], DOC)
        return df

    return make


@pytest.fixture
def as_dict():
    def collect(df, key="doc_id"):
        return {r[key]: r.asDict() for r in df.collect()}

    return collect
