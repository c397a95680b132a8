import random

import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns with names that the operators use inside.
CLASH = ["size", "src", "key", "bands", "label", "shard", "start", "score", "weight", "node", "digest", "times", "lost", "_id", "chain"]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with all that can be odd: nulls in every column, empty and long texts, ties, repeated rows, copies, near copies."""
    rng = random.Random(4)
    out = []
    for i in range(40):
        out.append((i, prose(rng, rng.randint(1, 120)), rng.choice(["en", "fr", None]), rng.choice(["b", "a", "Z", "é", None]), 5))
    for i in range(40, 52):  # near copies of one text
        w = out[3][1].split() + prose(random.Random(9), 90).split()
        w[rng.randrange(len(w))] = "changed"
        out.append((i, " ".join(w), "en", "a", 7))
    out += [(52, out[5][1], "en", "b", None), (53, out[5][1].upper(), None, None, None), (53, out[5][1].upper(), None, None, None)]
    out += [(54, None, "en", "a", 0), (55, "", "en", "a", 0), (56, " \n\t ", "fr", "b", 4), (None, out[6][1], "en", "a", 3), (57, "one", "en", "a", 3), (58, "naïve 漢字 🙂 Жж", None, "Z", 3)]
    out += [(59, prose(rng, 6000), "en", "b", 1), (60, prose(random.Random(7), 200) + "\n" + prose(rng, 50), "en", "a", 1), (61, prose(rng, 30) + "\n" + prose(random.Random(7), 200), "en", "b", 1)]
    out += [(62, "line one here\n" * 30, "en", "a", 1), (63, "x" * 50_000, "en", "a", 1), (64, "#$% | <> & *", "en", "b", 1)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def crowded(docs):
    """The same with columns whose names clash."""
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit("clash").alias(c) for c in CLASH))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
