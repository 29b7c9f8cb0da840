import random

import pytest

SPACE = " \t\n\x0b\x0c\r"


def split_words(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with every oddity: nulls, empty and long texts, repeats, clashing columns."""
    rng = random.Random(1)
    shared, long = prose(rng, 60), prose(rng, 6000)
    texts = [None, "", " \t\n", "one", "two words", "three words here", shared, shared, f"{prose(rng, 30)} {shared} {prose(rng, 40)}", f"{prose(rng, 5)}  {shared}\n{prose(rng, 3)}", long, long + " x", "É é ÀB " * 30, "z " * 120, "z " * 45, "   tail", prose(rng, 34), prose(rng, 35), prose(rng, 36), "a" * 900, "b" * 399 + "a" * 400]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t), "k", i, "b", 1.5) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, "no id but text", None, None, 3, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n_words int, body string, kept double").repartition(3)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
