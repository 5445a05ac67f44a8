import math
import random
import re
from collections import Counter

import pytest

from marketloom.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(items, docs, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        scored = []
        for d, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // words
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in wanted.items() if t in c)
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def asked(corpus):
    rng = random.Random(3)
    texts = [t for _, t, *_ in corpus if t]
    items = [(i, " ".join(rng.choice(texts).split()[:20])) for i in range(25)]
    return items + [(30, None), (31, ""), (32, "nothing like it"), (33, "W1 w1, w1; W2"), (34, "one"), (34, "two"), (None, "w5 w6"), (35, "É ünï 𝛼𝛽"), (36, "same line here again")]


def test_against_brute_force(spark, docs, corpus, asked):
    items = spark.createDataFrame([(i, t, "x") for i, t in asked], "item_id long, text string, score string")
    assert got(ranking.rank(items, docs)) == brute(asked, [(d, t) for d, t, *_ in corpus])


def test_blocks_small_shards_and_a_full_map_change_nothing(spark, docs, corpus, asked):
    items = spark.createDataFrame(asked, "item_id long, text string")
    assert got(ranking.rank(items, docs, 3, map_bits=64, block_terms=60, cells=128)) == brute(asked, [(d, t) for d, t, *_ in corpus], 3)


def test_many_ties_and_repeated_rows(spark):
    rows = [(i, "the cat sat") for i in range(300)] + [(7, "the cat sat")] * 20 + [(None, "the cat sat"), (None, "the dog")] + [(1000 + i, f"the w{i} the") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    asked = [(1, "cat"), (2, "the"), (3, "the cat"), (4, "dog w3 the"), (5, "the the sat")]
    assert got(ranking.rank(spark.createDataFrame(asked, "item_id long, text string"), df)) == brute(asked, rows)


def test_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert ranking.rank(none, docs).collect() == []
    assert ranking.rank(some, no_docs).collect() == []
    blank = spark.createDataFrame([(1, None), (2, " \n")], "doc_id long, text string")
    assert ranking.rank(some, blank).collect() == []


def test_terms_below_the_threshold_make_no_candidates():
    """An item whose one rare term has k high impacts needs no candidates from its frequent ones."""
    block = ranking._block([(1, b"rare", 90, 9000, 8000), (1, b"the", 1, 500, 400), (1, b"of", 1, 600, 500), (2, b"the", 2, 1000, 700)])
    assert {(block.ids[i], block.terms[t]) for i, t, p in zip(block.item, block.term, block.pruned) if p} == {(1, b"the"), (1, b"of")}
    assert block.rest.tolist() == [1100, 0] and block.least.tolist() == [8000, 700]
