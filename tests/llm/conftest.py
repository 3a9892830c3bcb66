import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, node string, score string, bucket string, shard string, part string, doc string"


def make_docs(spark, rows):
    """Documents with the columns of the driver's table and further ones whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "x", "x", "x", "x", "x", "x") for i, t in rows], SCHEMA)


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(id, text): ordinary texts, copies, blank and null texts, a very long text, a null and a repeated id."""
    rng = random.Random(7)
    v = [f"w{i}" for i in range(400)] + ["The", "of", "É", "naïve"]
    rows = [(i, words(rng, rng.randint(1, 120), v) + ".\n" + words(rng, rng.randint(1, 30), v)) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(25)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, words(rng, 6000, v)), (None, "some words without an id"), (204, rows[5][1]), (204, rows[5][1]), (205, "one"), (206, "two words")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return make_docs(spark, corpus).repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
