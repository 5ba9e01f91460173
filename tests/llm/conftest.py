import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def texts(spark):
    """DataFrame of (doc_id, text) from a list of texts, with a column more whose name clashes with inner ones."""
    def make(values):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType())])
        return spark.createDataFrame([(n, v, "x") for n, v in enumerate(values)], schema)

    return make


ODD = [None, "", " ", "\n\n", "\r\n\r\n", "a", " a", "a ", "a  b", "a \n b", "\n \n", "\n\n\n\nx", "x\n", "it's we'll 'lll 's 'S", "<|endoftext|>", "▁x ▁", "é é İ ſ", "漢字とkana", "🙂👍🏽", "\x1c\x1d\x85 \xa0x", "A" * 3000, "ha" * 2000, "-" * 2500, "﻿​x", "1234567 89½²Ⅷ", "tab\tand  spaces   three", "x" * 40 + "\n" + "y z " * 50]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
