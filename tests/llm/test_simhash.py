import hashlib

import numpy as np
import pytest

from marketloom.llm import simhash


def fp(hexed):
    return np.frombuffer(bytes.fromhex(hexed), np.uint8)


def test_edits_and_likeness(spark, docs, corpus):
    got = {r["doc_id"]: r for r in simhash.fingerprint_edits(docs, rows_a_range=7).collect()}
    rows = sorted((i, t or "") for i, t, *_ in corpus)
    assert len(got) == len(rows)
    by_text = {}
    for k, (i, t) in enumerate(rows):
        after, n = rows[(k + 1) % len(rows)], len(t)
        edited = t[: n - n // 2] + after[1][: n // 2]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert r["near_next"] == 1 - np.bitwise_count(fp(r["fingerprint"]) ^ fp(got[after[0]]["fingerprint"])).sum() / 128
        assert fp(r["edited_fingerprint"]).tobytes() == simhash.fingerprints([edited.encode()])[0].tobytes()
        assert r["near_edited"] == 1 - np.bitwise_count(fp(r["fingerprint"]) ^ fp(r["edited_fingerprint"])).sum() / 128


@pytest.mark.parametrize("radius", [14, 9, 4])
def test_near_counts_are_complete(spark, radius):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (40, 16), dtype=np.uint8)
    rows = []
    for b in base:
        for flips in (0, 0, 1, 2, 4, 5, 7, 9, 11, 13, 14, 15):
            bits = np.unpackbits(b)
            bits[rng.choice(128, flips, replace=False)] ^= 1
            rows.append(np.packbits(bits))
    prints = np.array(rows)
    pair = prints.view(">i8").astype(np.int64)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in pair.tolist()], "hi long, lo long")
    got = {(r["hi"], r["lo"]): r["n_near"] for r in simhash.near_counts(df.groupBy("hi", "lo").count().withColumnRenamed("count", "n"), df.distinct(), radius).collect()}
    exp = {tuple(p): int((np.bitwise_count(prints ^ q).sum(axis=1) <= radius).sum()) for p, q in zip(pair.tolist(), prints)}
    assert got == exp
    with pytest.raises(ValueError):
        simhash.near_counts(df, df, radius=15)


def test_odd_rows(spark, docs, no_docs, corpus):
    assert simhash.fingerprint_edits(no_docs).count() == 0
    one = spark.createDataFrame([(5, "only one text")], "doc_id long, text string")
    r = simhash.fingerprint_edits(one).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"only only o").hexdigest()[:0] + hashlib.sha256(("only one text"[:7] + "only one text"[:6]).encode()).hexdigest()
    twice = spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "x"), (6, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.fingerprint_edits(twice).collect()) == [5, 5, 6]
    out = simhash.with_near_counts(simhash.fingerprint_edits(docs), every=50).collect()
    assert len(out) == len(corpus) and all((r["n_near"] is not None) == (r["doc_id"] % 50 == 0) for r in out)
