import duckdb
import pytest

from marketloom.llm import mixing


def fill(sizes, weights, most):
    """Clamping and resharing again and again."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > most * sizes[i] + 1e-9}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = float(most * sizes[i])
            left -= target[i]
        open_ -= over
    return target


def test_targets_and_taken(spark, docs, corpus):
    got = mixing.mix(docs).collect()
    assert len(got) == len(corpus)
    names = sorted({r["source"] for r in got if r["source"] is not None}, key=lambda s: s.encode()) + [None]
    sizes = {s: sum(r["size"] for r in got if r["source"] == s) for s in names}
    target = dict(zip(names, fill([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3)))
    for s in names:
        rows = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 * max(1, target[s]) and r["source_size"] == sizes[s] for r in rows)
        assert abs(sum(r["taken"] for r in rows) - target[s]) <= 1
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["repeats"] * r["size"] + r["part_words"] for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)


def test_sql_twin(spark, docs, corpus):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas())
    exp = sorted(tuple(r) for r in con.execute(f"SELECT doc_id, taken FROM ({mixing.SQL})").fetchall())
    assert exp == sorted((r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect())


def test_odd_tables(spark, no_docs):
    assert mixing.mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mixing.mix(blank).collect()] == [(0, 0.0), (0, 0.0)]
    same = spark.createDataFrame([(1, "a b c", "a")] * 4 + [(None, "d", "a")], "doc_id long, text string, source string")
    got = mixing.mix(same).collect()
    assert len(got) == 5 and sum(r["taken"] for r in got) == 13
    with pytest.raises(ValueError):
        mixing.mix(blank, most_epochs=0.5)


def test_main_path_is_native(spark, docs, capsys):
    mixing.mix(docs).explain("formatted")
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))
