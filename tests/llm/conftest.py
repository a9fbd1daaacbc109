"""Small tables with the awkward rows that every operator has to take."""

import random

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept string"


def sentence(rng, n):
    words = "the of and river stone window garden letter morning silver paper captain market winter island".split()
    return " ".join(rng.choice(words) + rng.choice(["", "er", "ing", "s", "ed"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """doc_id and text: nulls, empty and wordless texts, copies, near copies, shared passages, a long text, ties."""
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(20, 90)) + "." for _ in range(24)]
    passage = "This passage of more than fifty bytes stands in several documents, é and ü too."
    texts = list(enumerate(base))
    texts += [(30, base[0]), (31, base[0]), (32, None), (33, ""), (34, "!!! ... ---"), (35, "one two"), (36, "one two")]
    texts += [(40, base[1] + " tail"), (41, base[2][:300] + passage + base[3][:50]), (42, passage), (43, "x" + passage + "y")]
    texts += [(44, base[4].upper()), (45, sentence(rng, 30000)), (46, "ü" * 120), (47, "ü" * 60), (48, "aé" * 40)]
    texts += [(50, base[5]), (50, base[5]), (50, base[6] + passage), (None, base[7]), (None, None)]
    return texts


@pytest.fixture(scope="session")
def documents(spark, rows):
    """The rows with further columns, some named like results."""
    full = [(i, t, "en", "src", None if t is None else len(t), 0.5, "old") for i, t in rows]
    return spark.createDataFrame(full, DOCUMENTS).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    """An empty table of documents."""
    return spark.createDataFrame([], DOCUMENTS)
