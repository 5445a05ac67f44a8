import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from marketloom.llm import common, graph, longest_factor, paragraphs, prefix_tree
from marketloom.llm.shingles import shingle_hashes, shingle_set, shingles_of, word_hashes


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 130)] + [(200, 200)]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: u.find(x) for e in edges if e[0] != e[1] for x in e}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_tree_finds_all_links():
    rng = random.Random(2)
    sets = []
    for _ in range(40):
        base = rng.sample(range(3000), rng.randrange(1, 40))
        for _ in range(4):
            sets.append(np.array(sorted({x if rng.random() > 0.05 else rng.randrange(3000) for x in base}), np.uint64))
    tree = prefix_tree.PrefixTree(sets)
    for s in sets:
        exp = [i for i, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 85 * len(np.union1d(s, t))]
        assert sorted(tree.similar(s, (85, 100))) == exp


def shingles(t, n=4):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


@pytest.mark.parametrize("block", [256, 2])
def test_join_against_brute_force(spark, docs, corpus, block):
    sets, u = {i: shingles(t) for i, t, *_ in corpus}, Union()
    for a, s in sets.items():
        for b, t in sets.items():
            if a < b and s and 100 * len(s & t) >= 85 * len(s | t):
                u.join(a, b)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in prefix_tree.join_documents(docs, block=block).collect()}
    assert got == {i: (len(s), u.find(i)) for i, s in sets.items()}


def test_join_odd_rows(spark, no_docs):
    assert prefix_tree.join_documents(no_docs).count() == 0
    rows = [(4, "a b c d e"), (4, "a b c d e"), (9, "A b c d  e"), (None, "a b c d e"), (2, None), (1, "")]
    got = sorted((r["doc_id"], r["component_id"]) for r in prefix_tree.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (2, 2), (4, 4), (4, 4), (9, 4)]


def test_short_sequences_are_no_shingles_of_longer_ones():
    a, b = word_hashes([b"x y z", b"x y z w"])
    assert not np.intersect1d(shingle_set(a, 4), shingle_set(b, 4)).size and not len(shingle_set(word_hashes([b""])[0], 4))


def cut_windows(rows, n):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            if w in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(w)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("length,gram", [(100, 24), (20, 6)])
def test_substrings_against_brute_force(spark, docs, corpus, length, gram):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in longest_factor.dedup_substrings(docs, length=length, gram=gram).collect()}
    assert got == cut_windows([(i, t) for i, t, *_ in corpus], length)


@pytest.mark.parametrize("seed,length", [(0, 20), (1, 100), (2, 37), (3, 8)])
def test_longest_previous_factors_against_brute_force(seed, length):
    rng = np.random.default_rng(seed)
    flat = np.concatenate([rng.integers(97, 99, 150), np.tile(rng.integers(97, 122, 45), 6), rng.integers(97, 100, 150)]).astype(np.uint8)
    flat = np.r_[flat, flat[40:300]]
    starts = np.arange(len(flat) - length + 1)
    place = rng.permutation(len(starts))
    order, lcp = longest_factor.suffix_order(flat, starts, place, length)
    got = np.empty(len(starts), np.int64)
    got[order] = longest_factor.longest_previous(place[order], lcp)
    text = flat.tobytes()

    def common(i, j):
        return next((k for k in range(length) if text[i + k] != text[j + k]), length)

    exp = [max((common(i, j) for j in starts if place[j] < place[i]), default=0) for i in starts]
    assert got.tolist() == exp
    # the shorter search agrees on what is long enough
    quick = np.empty(len(starts), np.int64)
    quick[order] = longest_factor.longest_previous(place[order], lcp, length)
    assert ((quick >= length) == (got >= length)).all()


def test_hot_anchors_are_split(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(longest_factor, "MANY", 2)
    monkeypatch.setattr(paragraphs, "MANY", 2)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in longest_factor.dedup_substrings(docs, length=40, gram=9).collect()}
    assert got == cut_windows([(i, t) for i, t, *_ in corpus], 40)
    got = {r["doc_id"]: (b" ".join((r["text"] or "").encode().lower().split()), r["removed_words"]) for r in paragraphs.dedup_paragraphs(docs, min_words=10**6).collect()}
    assert got == brute_passages([(i, t) for i, t, *_ in corpus])


def test_substrings_odd_rows(spark, no_docs, monkeypatch):
    assert longest_factor.dedup_substrings(no_docs).count() == 0
    long_ = "".join(random.Random(1).choices("abcdef", k=700))
    rows = [(1, long_), (2, long_[:300] + "X" + long_[300:]), (3, long_[200:450]), (4, "ab" * 300), (5, long_[:99]), (6, long_[:100])]
    df = spark.createDataFrame(rows + [(1, long_), (None, long_)], "doc_id long, text string")
    monkeypatch.setattr(longest_factor, "SORT_BYTES", 300)  # many sorts instead of one
    got = sorted((r["doc_id"], r["n_removed"]) for r in longest_factor.dedup_substrings(df).collect())
    exp = sorted([(i, v[1]) for i, v in cut_windows(rows, 100).items()] + [(1, 700)])
    assert got == exp


def test_tuned_bands():
    bands, rows = paragraphs.tuned(64, 0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 64
    assert 1 - (1 - 0.8 ** (rows + 1)) ** (64 // (rows + 1)) < 0.999


def brute_paragraphs(rows, least=25):
    kept, gone, u = [], defaultdict(list), Union()
    paras = [(i, k, shingles(x, 5)) for i, t in sorted(rows) for k, x in enumerate((t or "").split("\n")) if len(x.encode().split()) >= least]
    for a, (_, _, s) in enumerate(paras):
        u.find(a)
        for b in range(a):
            t = paras[b][2]
            if 100 * len(s & t) >= 80 * len(s | t):
                u.join(a, b)
    for a, (i, k, _) in enumerate(paras):
        if u.find(a) != a:
            gone[i].append(k)
    del kept
    return gone


def test_paragraphs_against_brute_force(spark, docs, corpus):
    got = {r["doc_id"]: r for r in paragraphs.dedup_paragraphs(docs).collect()}
    exp = brute_paragraphs([(i, t) for i, t, *_ in corpus])
    assert {i: list(r["removed"]) for i, r in got.items() if r["removed"]} == dict(exp)
    for i, t, *_ in corpus:
        assert got[i]["text"] == ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in exp[i]) if exp.get(i) else t)
        assert got[i]["score"] == "x"
    assert len(paragraphs.digests(paragraphs.dedup_paragraphs(docs)).collect()) == len(corpus)


def test_paragraphs_odd_rows(spark, no_docs):
    assert paragraphs.dedup_paragraphs(no_docs).count() == 0
    para = " ".join(f"p{i}" for i in range(60))
    rows = [(2, para), (2, para), (1, f"x\n{para}\ny"), (None, para), (7, None)]
    got = sorted(((r["doc_id"] or -1, r["text"]) for r in paragraphs.dedup_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(2, ""), (2, ""), (1, f"x\n{para}\ny"), (-1, para), (7, None)], key=str)


def brute_passages(rows, least=51):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = (t or "").encode().lower().split()
        runs = [tuple(w[k : k + least]) for k in range(len(w) - least + 1)]
        gone = {p for k, r in enumerate(runs) if r in seen for p in range(k, k + least)}
        out[i] = (b" ".join(x for p, x in enumerate(w) if p not in gone), len(gone))
        for r in runs:
            seen.setdefault(r, i)
    return out


def test_passages_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    fresh = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    one, two, three = fresh(51), fresh(51), fresh(90)
    short = "\n".join(" ".join(fresh(7)) for _ in range(20))
    lines = lambda w, n: "\n".join(" ".join(w[k : k + n]) for k in range(0, len(w), n))
    rows = [(1, " ".join(fresh(40) + one + fresh(70))), (2, " ".join(fresh(200) + one + fresh(90)))]  # in longer lines
    rows += [(3, " ".join(fresh(30)) + "\n" + lines(two, 6)), (4, lines(two, 9) + "\n\n" + lines(fresh(60), 10))]  # over short lines
    rows += [(5, lines(three, 8)), (6, " ".join(fresh(100) + three + fresh(100) + three[:60])), (7, " ".join(fresh(10) + [x.upper() for x in three] + one[:50] + fresh(9)))]
    rows += [(8, short), (9, short), (10, "x " * 300), (11, "x " * 120 + "y"), (12, " ".join(two[:50])), (13, None), (14, ""), (15, lines(one[1:] + fresh(3), 5))]
    monkeypatch.setattr(paragraphs, "SHARD_BYTES", 2000)
    got = {r["doc_id"]: r for r in paragraphs.dedup_paragraphs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), min_words=10**6).collect()}
    exp = brute_passages(rows)
    assert {i: (b" ".join((r["text"] or "").encode().lower().split()), r["removed_words"]) for i, r in got.items()} == exp
    assert [exp[i][1] for i in (2, 4, 6, 9, 11, 12, 15)] == [51, 51, 150, 140, 120, 0, 0]
    assert got[9]["text"] == "" and got[2]["copies_of"] == [1] and got[4]["text"].count("\n") == 6 and got[13]["text"] is None


def test_passages_beside_lines(spark):
    rng = random.Random(9)
    para, more = " ".join(f"p{rng.random()}" for _ in range(60)), " ".join(f"q{rng.random()}" for _ in range(55))
    rest = " ".join(f"r{rng.random()}" for _ in range(80))
    rows = [(1, f"{para}\nend {more} {rest}"), (2, f"a\n{para}\n  b {more}  c\n"), (2, f"a\n{para}\n  b {more}  c\n")]
    got = [r for r in paragraphs.dedup_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] == 2]
    assert [(r["text"], r["removed"], r["removed_words"], r["copies_of"]) for r in got] == [("a\n  b c\n", [1], 115, [1])] * 2


def test_near_keeps_every_row_with_a_key(spark):
    rows, keys = spark.range(200_000).selectExpr("id", "'x' AS wide"), spark.range(0, 200_000, 100).toDF("id")
    kept = common.near(rows, keys, "id", 2000)
    assert kept.columns == ["id", "wide"] and kept.join(keys, "id").count() == 2000 and kept.count() < 60_000
    assert common.near(rows, keys.limit(0), "id", 0).count() == 0


def test_candidates_are_counted_without_a_join_of_hashes(spark):
    rng = random.Random(11)
    text = lambda: " ".join(f"c{rng.randrange(10**9)}" for _ in range(200))
    shared, rows = text(), [(i, text()) for i in range(20)]
    # two texts under one id, only one of which has its like
    rows += [(5, shared), (30, shared + " more")]
    scanned = prefix_tree._scan(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    found = prefix_tree._candidates(scanned, (85, 100))
    assert {5, 30} <= {r["doc_id"] for r in found.collect()} <= {5, 30}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1


def test_only_texts_that_lose_something_are_cut(spark, docs, corpus, monkeypatch):
    read = []

    def spied(rows, keys, key, n):
        read.append((n, common.near(rows, keys, key, n)))
        return read[-1][1]

    monkeypatch.setattr(longest_factor, "near", spied)
    got = {r["doc_id"]: r["n_removed"] for r in longest_factor.dedup_substrings(docs).collect()}
    first = {}
    for i, t, *_ in sorted(corpus, key=lambda r: r[0]):
        first.setdefault(t or "", i)
    lose = {i for i in first.values() if got[i]}
    ((n, rows),) = read
    assert n == len(lose) and lose <= {r["doc_id"] for r in rows.collect()} and rows.count() < len(first)


@pytest.mark.parametrize("size", [1, 5])
def test_shingles_of_many_texts(size):
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (7, 0, 3, 5, 4, 60, 0, 6)]
    for some in (texts, texts[1:3], texts[1:2], []):
        got = shingles_of(some, size)
        assert len(got) == len(some) and all(np.array_equal(a, shingle_hashes(t, size)) for a, t in zip(got, some))


@pytest.mark.parametrize("plain", [0, 100_000])
def test_joined_by_one_join_or_hot_keys_apart(spark, monkeypatch, plain):
    monkeypatch.setattr(common, "PLAIN_ROWS", plain)
    rows = spark.createDataFrame([(i % 7 if i % 3 else 1, i) for i in range(3000)], "a long, i long")
    facts = rows.groupBy("a").agg({"i": "max", "*": "count"}).withColumnsRenamed({"max(i)": "m", "count(1)": "k"}).where("a > 0")
    found = common.joined(rows, facts, "a", 3000)
    assert found.columns[:2] == ["a", "i"] and sorted(r["i"] for r in found.select("i").collect()) == [r["i"] for r in rows.where("a > 0").orderBy("i").collect()]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == (1 if plain else 3)
    edges = spark.createDataFrame([(1, i) for i in range(2, 40)] + [(50, 51)], "a long, b long")
    assert {r["id"]: r["component"] for r in graph.components(edges).collect()} == {**{i: 1 for i in range(1, 40)}, 50: 50, 51: 50}
