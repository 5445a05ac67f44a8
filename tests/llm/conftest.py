import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, spans int, size string"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Small texts with copies, near copies, shared passages, nulls, empties, one long text and odd characters."""
    rng = random.Random(5)
    base = [words(rng, rng.randrange(5, 120)) for _ in range(30)]
    passage = words(rng, 70, 5000)
    texts = [None, "", "   \n\t ", "one", "One two", "É ünï 𝛼𝛽 " * 40, "tail\x1fend \x85 x y", base[0], base[0], base[0].upper()]
    texts += base
    for b in base[:12]:
        w = b.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [f"{words(rng, 30)}\n{passage}\n{words(rng, 8)}" for _ in range(6)]
    texts += ["same line here again " * 60, "a" * 5000, words(rng, 3000, 90)]
    texts += [base[3]] * 15
    rng.shuffle(texts)
    langs, sources = ("en", "fr", None), ("s1", "s2", None, "s\U0001F600", "zz")
    # columns whose names the operators use themselves
    return [(i * 3, t, langs[i % 3], sources[i % 5] if i % 2 else "s1", len(t or ""), "x", 7, "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
