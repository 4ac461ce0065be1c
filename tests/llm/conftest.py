import pytest

from conftest_llm import FOLDER, SCHEMA


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text) or (doc_id, text, lang, source), with columns of clashing names."""

    def make(rows):
        full = [(*r, None, None)[:4] if len(r) < 4 else r for r in rows]
        return spark.createDataFrame(
            [(*r, None if r[1] is None else len(r[1]), "s", "h", "n", "f", "t") for r in full], SCHEMA
        )

    return make


@pytest.fixture(scope="session")
def real_docs(spark):
    """The smallest test documents, as (doc_id, text) rows too."""
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return df, [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]
