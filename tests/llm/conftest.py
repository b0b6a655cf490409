import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()), T.StructField("row", T.StringType()), T.StructField("size", T.IntegerType())])


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéñß") for _ in range(rng.randint(1, 7))) for _ in range(n))


def documents():
    """(doc_id, text): copies, near copies, empty, null and long texts, repeated rows, null ids."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(1, 60)) for _ in range(40)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[i % 7] + " " * (i % 3)) for i in range(25)]
    out += [(200 + i, base[3] + f" {i % 4}") for i in range(12)]
    out += [(300, None), (301, ""), (302, " \t\n"), (303, "Only ONE"), (303, "Only ONE"), (None, "no id"), (None, None), (304, words(rng, 9000)), (305, "a\nb\na\nb"), (306, 'x "quoted" \' <|endoftext|> İ ſ ½ 漢字')]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    # other columns bear names that operators use inside
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash", 1) for i, t in documents()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
