import random

import corpus_pipeline

from marketloom.llm import queries
from marketloom.llm.common import documents

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = documents(spark, SF)
    n = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        docs = out.cache()
        n.append(docs.count())
    assert n[0] > n[1] > n[2] >= n[3] >= n[4] == n[5] > 0
    assert sum(r["taken"] for r in docs.collect()) > 0


def test_every_operator_has_a_query():
    assert [f"op{n}_" for n in range(1, 14)] == sorted({q.split("_")[0] + "_" for q in queries.QUERIES if q.startswith("op")}, key=lambda q: int(q[2:-1]))


def test_join_stage_against_brute_force_at_five_words(spark):
    rng = random.Random(11)
    rows = []
    for i in range(8):
        base = [f"b{i}x{k}" for k in range(200)]
        for j, edits in enumerate((0, 3, 4, 5, 7)):
            text = list(base)
            for k in range(edits):
                text[20 + 25 * k] = f"e{rng.random()}"
            rows.append((10 * i + j, " ".join(text)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    up = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((up[a], up[b]))
                up = {i: low if u == high else u for i, u in up.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.keep_one_of_linked(spark, df, SF).collect()} == set(up.values())


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, and extra columns with names that operators use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, removed string, component_id string, spans int, size string, target long"
    rng = random.Random(3)
    long_ = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, long_, None, "a", len(long_)), (4, "one two three", "en", None, 13), (4, "one two three", "en", None, 13), (None, "no id at all", "en", "a", 12), (5, "é" * 5000, "fr", "b", 5000)]
    df = spark.createDataFrame([(*r, 0.5, "x", "y", 1, "z", None) for r in rows], schema)
    own = {"quality": None, "ngram_join": 6, "substring_dedup": 7, "decontamination": 7, "mixing": 7}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        got = out.collect()
        assert own[name] is None or len(got) == own[name]
        if name != "mixing":
            assert out.columns == df.columns
            if name != "quality":
                assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 5, None} and {r["text"] for r in got} == {r[1] for r in rows}
        else:
            assert {r["doc_id"]: r["taken"] for r in got if r["doc_id"] in (1, 2)} == {1: 0, 2: 0}
        empty = stage(spark, df.limit(0), SF)
        assert empty.count() == 0
