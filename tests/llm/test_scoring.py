import functools
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from marketloom.llm import scoring
from marketloom.llm.lattice import Lattice, batches_by_length, read_pieces


def toks(t):
    return (t or "").encode().lower().split()


def test_marginal_is_the_sum_over_all_spellings():
    pieces = [(b"", True, -3.0)] + [(bytes([b]), False, -2.0) for b in b"ab"] + [(b"ab", False, -1.5), (b"a", True, -2.5), (b"ab", True, -1.0), (b"ba", False, -2.2)]
    lattice = Lattice(pieces)
    w = lattice.first_weights()
    starts = {p[0]: w[i] for i, p in enumerate(pieces) if p[1]}
    inner = {p[0]: w[i] for i, p in enumerate(pieces) if not p[1]}

    def brute(word):
        def rest(s):
            return math.exp(w[-1]) if not s else sum(math.exp(inner[p]) * rest(s[len(p) :]) for p in inner if s.startswith(p))

        return sum(math.exp(v) * rest(word[len(p) :]) for p, v in starts.items() if word.startswith(p))

    for n in range(1, 6):
        for letters in itertools.product(b"ab", repeat=n):
            got = lattice.forward(np.array([letters], np.uint8), w)[0]
            assert math.isclose(math.exp(got), brute(bytes(letters)), rel_tol=1e-9)


def test_expected_counts_add_up():
    pieces = [(b"", True, -3.0)] + [(bytes([b]), False, -2.0) for b in range(256)] + [(b"ab", False, -1.5), (b"a", True, -2.5)]
    lattice, words = Lattice(pieces), [b"abab", b"ba", b"aab", b"b" * 90]
    w = lattice.first_weights()
    out = sum(lattice.expected(letters, w) for _, letters in batches_by_length(words))
    assert math.isclose(out[[i for i, p in enumerate(pieces) if p[1]]].sum(), len(words))
    assert math.isclose(sum(c * len(p[0]) for c, p in zip(out, pieces)), sum(map(len, words)))


@pytest.mark.parametrize("class_col", [None, "lang"])
def test_scores_against_plain_counts(spark, docs, corpus, class_col):
    got = {r["doc_id"]: r for r in scoring.score_documents(docs, class_col=class_col, classes=1).collect()}
    names = {None: [None], "lang": ["en", None]}[class_col]  # the most frequent value, and all others
    train, n_train = Counter(), 0
    of_class = [Counter() for _ in names]
    n_class = [0 for _ in names]
    for i, t, lang, *_ in corpus:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update(toks(t))
            n_train += 1
            k = names.index(lang if class_col and lang in names else None)
            of_class[k].update(toks(t))
            n_class[k] += 1
    total, kinds = sum(train.values()) + n_train, len(train) + 1
    assert len(got) == len(corpus)
    lattice = Lattice(read_pieces())
    fixed = learnt = lattice.first_weights()
    for _ in range(2):
        spelt = np.sum([lattice.expected(np.frombuffer(x, np.uint8)[None], learnt) for x in train], axis=0) + 0.01
        learnt = lattice.weights(spelt, len(train) + 0.01)

    @functools.cache
    def spelling(word, weights="fixed"):
        """Forward over the letters of one word, piece by piece."""
        w = fixed if weights == "fixed" else learnt
        at = {-1: 0.0, **dict.fromkeys(range(len(word) + 1), -math.inf)}
        for to in range(len(word) + 1):
            for a in range(max(-1, to - lattice.width - 1), to):
                i = place.get((word[max(a, 0) : to], a < 0))
                if i is not None and (a < 0 or to > a):
                    at[to] = np.logaddexp(at[to], at[a] + w[i])
        return at[len(word)] + w[-1]

    def mixture(word):
        return 0.1 * math.exp(spelling(word)) + 0.9 * math.exp(spelling(word, "learnt"))

    place = {p[:2]: i for i, p in enumerate(lattice.pieces)}
    for i, t, *_ in corpus:
        w, r = toks(t), got[i]
        base = sum(math.log10((train[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w) + math.log10((n_train + 0.5) / (total + 0.5 * (kinds + 1)))
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) + 1, sum(train[x] > 0 for x in w) + 1, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        parts = []
        for seen, n in zip(of_class, n_class):
            added, size = sum(c == 1 for c in seen.values()) + 1, sum(seen.values()) + n
            p = [(seen[x] + added * 0.99 * mixture(x)) / (size + added) for x in w] + [(n + added * 0.01) / (size + added)]
            parts.append(sum(map(math.log10, p)) + math.log10((n + 1) / (n_train + len(names))) if all(p) else None)
        if None not in parts:  # a probability below the least double has no logarithm here
            most = max(parts)
            assert math.isclose(r["score"], most + math.log10(sum(10 ** (x - most) for x in parts)), rel_tol=1e-6)
        assert math.isclose(r["lattice_score"], sum(spelling(x) / math.log(10) + math.log10(0.99) for x in w) - 2, rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
        assert math.isclose(r["lattice_score"], sum(spelling(x) / math.log(10) + math.log10(0.99) for x in w) - 2, rel_tol=1e-9)


def test_probabilities_of_one_word_texts_stay_below_one(spark):
    rows = [(i, w, "en") for i, w in enumerate(["a", "b", "ab", "a b", "", "a"] * 5)]
    probe = ["".join(x) for n in (1, 2, 3) for x in itertools.product("abc", repeat=n)] + [""]
    rows += [(1000 + i, w, "en") for i, w in enumerate(probe)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = scoring.score_documents(df, held_out=df["doc_id"] >= 1000).where("held_out").collect()
    assert len(got) == len(probe)
    assert sum(10 ** r["score"] for r in got) < 1


@pytest.mark.parametrize("held", [True, False])
def test_no_rows_and_nothing_to_learn(spark, no_docs, docs, held):
    from pyspark.sql import functions as F

    assert scoring.score_documents(no_docs).count() == 0
    if held:
        got = scoring.score_documents(docs.limit(4), held_out=F.lit(True)).collect()
        assert len(got) == 4 and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] < 0 for r in got)


def test_long_pieces_are_kept():
    pieces = read_pieces()
    assert {(b"international", True), (b"understanding", True)} <= {p[:2] for p in pieces}
    assert Lattice(pieces).width == max(len(p[0]) for p in pieces) > 12


def test_words_are_rows_and_meet_once(spark, docs, corpus):
    """A shard's words are no lists in one row, and a word's places come from one shuffle, without a join."""
    from pyspark.sql import functions as F

    indexed = scoring.index_shards(docs.repartition(3).select("doc_id", "text", F.lit(False).alias("held"), F.lit(0).alias("kind")), 1).cache()
    assert dict(indexed.dtypes)["word"] == "string"
    words = scoring.gathered(indexed.where("word is not null"), ["l0"])
    assert "Join" not in words._jdf.queryExecution().executedPlan().toString()
    plain = Counter(w for _, t, *_ in corpus for w in toks(t))
    got = words.collect()
    assert {r["word"].encode(): r["l0"] for r in got} == plain and len(got) == len(plain)
    places = sorted((p["shard"], p["at"]) for r in got for p in r["places"])
    assert places == sorted((r["shard"], r["at"]) for r in indexed.where("word is not null").collect())
