import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls everywhere, empty and blank texts, repeated rows, one very long text, and a column whose name an operator uses inside."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a", 1, "x"),
        (1, "the quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a", 1, "x"),
        (2, "THE QUICK BROWN FOX jumps over the lazy dog and runs far away from here today", None, "a", 1, None),
        (3, None, "en", None, None, "x"), (4, "", "de", "b", 0, "y"), (5, " \n\t ", "de", "b", 3, "y"),
        (6, long, "en", "b", len(long), "y"), (None, "a text whose number is not known at all", "fr", "c", 5, "z"),
        (None, None, None, None, None, None), (7, "one", "es", "c", 3, "z"), (8, "one", "es", "c", 3, "z"),
        (9, "Été 中文 \U0001f600 mail me@example.com or 10.0.0.1 now", "fr", "c", 5, "z"),
    ]
    schema = T.StructType([*T._parse_datatype_string(DOCS).fields, T.StructField("class", T.StringType())])
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)
