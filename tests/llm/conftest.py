"""Fixtures of the operators' tests."""

import os
import sys

import pytest
from pyspark.sql import types as T

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

from llm_prose import prose  # noqa: E402

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, extra=()):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en" if k % 3 else None, f"s{k % 2}", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        df = spark.createDataFrame(rows, DOCS)
        from pyspark.sql import functions as F

        return df.withColumns({c: F.lit(7) for c in extra})

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, very long, repeated, and odd characters."""
    long = prose(1, 30_000)
    return [None, "", " \n\t ", "word", long, long, prose(2, 60), prose(2, 60), "a b  c\n\nd \r\n é日本 \x1c x", "one two three four five", "\n".join(["same line here"] * 40)]
