from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def documents(spark):
    """A documents table from (id, text) pairs; more columns follow by position."""

    def make(rows):
        full = [(i, t, *(more or ("en", "a")), len(t) if t is not None else None) for i, t, *more in rows]
        return spark.createDataFrame(full, DOCUMENT)

    return make
