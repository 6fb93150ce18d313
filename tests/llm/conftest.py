import random

import pytest

#: A documents table with every awkward row: nulls, empty and white texts, ties, repeats, a very long text, clashing column names.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, digest string, n int, key string, __key string"


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [None, "", " ", "\t\n", "a", "a ", " a", "a\x0bb", "A b c", "a b c", "Ünï cödé 😀 日本語", "▁ literal ▁", "x" * 5000, " ".join(rng.choice(words) for _ in range(20000))]
    texts += texts[:10] + texts[:5]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, ""]), len(t or "")) for i, t in enumerate(texts)]
    out += [out[3], out[3], (None, texts[4], "en", "s1", 1), (None, None, None, None, None)]
    return [(*r, 7, "x", "y", 3, "k", "kk") for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).checkpoint()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
