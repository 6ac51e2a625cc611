import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text) rows, over several partitions."""

    def make(rows, source="src0"):
        full = [(i, t, "en", source, None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, DOCUMENT).repartition(3)

    return make


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables to a data folder and returns its path."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
