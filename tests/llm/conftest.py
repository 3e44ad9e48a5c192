import random

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, a clashing extra column."""
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "Übung", "été", "naïve", "x1", "42"]
    long = " ".join(rnd.choice(words) + str(rnd.randrange(4000)) for _ in range(30000))
    some = " ".join(rnd.choice(words) + str(rnd.randrange(400)) for _ in range(150)) + "."
    rows = [
        (1, None, None, "s", 0),
        (2, "", "en", None, None),
        (3, " \t\n\r ", "en", "s", 5),
        (4, some, "en", "s", 1),
        (5, some, "en", "s", 1),
        (5, some, "en", "s", 1),
        (6, some.replace("beta", "Beta", 1), None, "s", 1),
        (7, long, "en", "s", 1),
        (8, "one", "en", "s", 3),
        (9, "one two\none two\n\nthree", "en", "s", 3),
        (None, "no id here at all", "en", "s", 3),
        (10, " odd space\x1cend\tTab\x0bv 'll don't <|endoftext|> x", "en", "s", 3),
        (11, some[: len(some) // 2], "en", "s", 1),
    ]
    kind = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("fp", T.IntegerType())]
    )
    return spark.createDataFrame(rows, kind)


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture(params=["edge_docs", "sf_docs", "empty_docs"])
def any_docs(request):
    return request.getfixturevalue(request.param)
