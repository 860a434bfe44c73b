import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, extra array<int>"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows, and extra columns of clashing names."""
    rng = random.Random(4)
    words = ["the", "Cat", "sat", "on", "é", "ß", "a1", "x.y", "###", "dog", "Zürich", "　", "end."]
    gaps = [" ", " ", " ", "\n", "  ", "\t", " \n"]
    make = lambda n: "".join(rng.choice(words) + rng.choice(gaps) for _ in range(n))
    shared = make(40)
    texts = [None, "", " ", "\n", "\n\n", "one", "The Cat", "é", make(3), shared, shared, shared.upper(), make(10) + shared, shared + make(9), make(12) + shared[20:] + make(4)]
    texts += [make(rng.randint(0, 80)) + (shared[: rng.randint(0, 200)] if rng.random() < 0.3 else "") for _ in range(60)]
    texts += [make(4000), "word " * 3000, "Same line\n" * 30 + "other"]
    texts += [f"Cookie notice \nline {i}\ncookie NOTICE" for i in range(12)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None]), None, "clash", [1]) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], rows[12], (None, shared, None, None, 1, None, None), (None, None, None, None, None, None, None)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
