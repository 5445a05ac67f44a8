import hashlib
import zlib
from itertools import groupby

from marketloom.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(digests):
    """All levels, the leaves first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return levels


def steps(levels, i):
    """(siblings before, siblings after) at each level below the top."""
    out = []
    for below in levels[:-1]:
        a = i // 16 * 16
        out.append((below[a:i], below[i + 1 : a + 16]))
        i //= 16
    return out


def brute(rows):
    order = lambda v: (v is not None, v)
    rows = sorted(((s, d, leaf_of(d, s, la, n, t), leaf_of(d, s, la, n, lower(t))) for d, t, la, s, n, *_ in rows), key=lambda r: (r[0] is not None, (r[0] or "").encode(), order(r[1]), r[2]))
    groups = [(s, list(g)) for s, g in groupby(rows, key=lambda r: r[0])]
    trees = [tree([r[2] for r in g]) for _, g in groups]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, (_, g) in enumerate(groups):
        for i, (_, d, leaf, changed) in enumerate(g):
            path = steps(trees[k], i) + steps(top, k)
            at = changed if d is not None and zlib.crc32(str(d).encode()) % 5 == 0 else leaf
            for left, right in path:
                at = h("".join([*left, at, *right]))
            out.append((d, leaf, trees[k][-1][0], top[-1][0], h("".join("".join(a + b) for a, b in path)), at, at == top[-1][0]))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_against_brute_force(docs, corpus):
    assert got(merkle.manifest_documents(docs)) == brute(corpus)


def test_deep_trees_and_many_sources(spark):
    """Three levels in a source, more than one level of subroots, sources of one row, and a row that repeats."""
    rows = [(i, f"T{i}", "en", "big" if i < 700 else f"s{i}", i) for i in range(725)]
    rows += [(None, None, None, None, None), (3, "T3", "en", "big", 3), (3, "T3", "en", "big", 3), (8, "other", "en", "big", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    found = got(merkle.manifest_documents(df))
    assert found == brute(rows)
    assert {r[6] for r in found} == {True, False}


def test_nodes_looked_up_by_shuffle_are_the_same(docs, corpus, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 2)
    monkeypatch.setattr("marketloom.llm.common.BROADCAST_ROWS", 0)
    assert got(merkle.manifest_documents(docs)) == brute(corpus)


def test_one_row_and_no_rows(spark, no_docs):
    one = spark.createDataFrame([(5, "A", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert got(merkle.manifest_documents(one)) == brute([(5, "A", None, None, 1)])
    assert merkle.manifest_documents(no_docs).collect() == []


def test_tampering_shows(spark, docs):
    """Any change of a leaf or of its place is seen; the same rows prove again."""
    from pyspark.sql import functions as F

    rows = docs.where("text is not null").select("doc_id", "source", merkle.leaf_digest("doc_id", "text").alias("leaf"), merkle.leaf_digest("doc_id", F.concat("text", F.lit("x"))).alias("other"))
    shown = merkle.prove(merkle.manifest(rows, "source", ["doc_id"]))
    judged = shown.select((merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("kept"), (merkle.folded(F.col("other"), F.col("path")) == F.col("root")).alias("changed"))
    assert {tuple(r) for r in judged.collect()} == {(True, False)}
