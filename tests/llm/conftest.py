"""A small messy corpus: nulls, blanks, copies, near copies, long texts, repeated rows."""

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])
#: Names that operators use inside.
CLASHING = (
    "norm digest salt keep_id size copy source_size target taken root doc list key head at n windows "
    "repeats marks score predicted held_out fingerprint sketch signature piece start length spread "
    "text_hash words ranges row slot gid"
).split()


def corpus_rows():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base, passage = prose(300), prose(60)
    texts = [None, "", "   \t\n", "one", "one two", "One TWO", "one two three", prose(30)]
    texts += [base] * 4 + [base.upper()] * 2
    words = base.split()
    for k in range(8):  # near copies of growing distance
        changed = list(words)
        for i in rng.sample(range(len(words)), 2 * k):
            changed[i] = "zz" + rng.choice(vocabulary)
        texts.append(" ".join(changed))
    texts += [prose(20) + " " + passage + "\n" + prose(25) for _ in range(6)]
    texts += ["same " * 300, "same " * 250, prose(9000), "É" * 50 + " " + prose(70), "😀 " * 60]
    texts += [prose(rng.randrange(1, 200)) for _ in range(40)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    sources = ["s0", "s0", "s0", "s1", "S2", None, "é"]
    return [(7 * k - 3, texts[i], "en", sources[k % len(sources)], len(texts[i] or "")) for k, i in enumerate(order)]


@pytest.fixture(scope="session")
def rows():
    return corpus_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def repeated(docs):
    """Every row twice, and columns with names that operators use."""
    from pyspark.sql import functions as F

    return docs.unionByName(docs).withColumns({c: F.lit("x") for c in CLASHING if c not in docs.columns})
