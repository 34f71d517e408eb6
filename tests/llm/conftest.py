from __future__ import annotations

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                          T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                          T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs_of(spark: SparkSession):
    """Rows (doc_id, text[, lang[, source]]) as a documents table; extra columns with
    names that operators might use themselves."""
    def make(rows, extra: dict | None = None):
        full = [(i, t, *(rest + [None] * 2)[:2], None if t is None else len(t))
                for i, t, *rest in (tuple(r) for r in rows)]
        schema = T.StructType(DOCUMENTS.fields + [T.StructField(c, T.StringType()) for c in extra or {}])
        return spark.createDataFrame([r + tuple((extra or {}).values()) for r in full], schema)
    return make


@pytest.fixture
def read_table(spark: SparkSession):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


#: Column names that the operators use inside, or that carry marks.
CLASHES = {"row": "a", "key": "b", "node": "c", "shard": "d", "slot": "e", "h": "f", "good": "g", "id": "h",
           "_id": "i", "_mark": "m", "_runs": "n", "_part": "o", "a.b": "j", "spans": "k", "length": "l"}
