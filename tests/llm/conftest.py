import pytest
from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    """Document table from (doc_id, text) or (doc_id, text, lang, source) tuples, over several partitions."""
    def make(rows, parts=3):
        full = [(*r, None, None)[:4] for r in rows]
        rows = [Row(*r, None if r[1] is None else len(r[1])) for r in full]
        return spark.createDataFrame(rows, SCHEMA).repartition(parts)

    return make


@pytest.fixture
def saved(table, tmp_path):
    """The same written as documents.parquet; gives the folder."""
    def make(rows, parts=3):
        table(rows, parts).write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return make
