import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from marketloom.llm import fm_index

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").encode().lower())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=4))
def test_search_and_locate(symbols, phrase):
    index = fm_index.FMIndex(np.array(symbols))
    low, high = index.search(np.array([phrase]))
    found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert found == [i for i in range(len(symbols) - len(phrase) + 1) if symbols[i : i + len(phrase)] == phrase]


def brute(docs, items, window=13):
    phrases = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    out = {}
    for i, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for p, of in phrases.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= of
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block", [200_000, 7])
def test_against_brute_force(spark, docs, corpus, block):
    items = [(1, corpus[20][1]), (2, "w1 W2"), (10, "Changed"), (11, None), (12, "..."), (13, corpus[30][1]), (14, "one two"), (15, "É ÜNÏ 𝛼𝛽 É")]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in fm_index.decontaminate(docs, df, phrases_a_block=block, shard_bytes=4000).collect()}
    exp = brute(corpus, items)
    assert {i: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for i, r in got.items()} == exp
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in got.values())
    assert any(v[4] for v in exp.values()) and got[corpus[0][0]]["score"] == "x"


def test_empty_tables(spark, docs, no_docs, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {(r["n_hit"], r["contaminated"]) for r in fm_index.decontaminate(docs, none).collect()} == {(0, False)}
    assert fm_index.decontaminate(no_docs, none).count() == 0
