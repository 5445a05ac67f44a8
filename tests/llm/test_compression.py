import random
import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from marketloom.llm import compression


def _labelled(spark, n=400):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        w = [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.choice(['', 'ing', 'ed'])}" for _ in range(rng.randrange(20, 120))]
        docs.append((i, " ".join(w) if good else "!! ".join(x.upper() for x in w)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark):
    docs, labels = _labelled(spark)
    got = compression.score(docs, compression.fit(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 50 and sum(r["predicted"] == r["quality"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = _labelled(spark, 200)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert compression.fit(docs, labels) == compression.fit(docs, flipped)


def test_odd_rows(spark, docs, no_docs, corpus):
    own, labels = _labelled(spark, 200)
    model = compression.fit(own, labels)
    got = compression.score(docs, model).collect()
    assert len(got) == len(corpus) and set(docs.columns) <= set(got[0].asDict())
    by_text = {}
    for r in got:
        assert by_text.setdefault(r["text"] or "", r["score"]) == r["score"]
    assert compression.score(no_docs, model).count() == 0
    alone = compression.fit(own, labels.where("quality = 1"))
    assert not alone.weights and {r["score"] for r in compression.score(docs, alone).collect()} == {alone.prior}
    assert compression.fit(no_docs, labels.limit(0)).prior == 0.5


def test_scores_against_sizes_taken_apart(spark, docs):
    """Each score anew from the two packed sizes, with the model's calibration; it rises with both differences."""
    own, labels = _labelled(spark, 300)
    model = compression.fit(own, labels)
    bad, good = (zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False) for d in model.dictionaries)

    def size(c, text, n):
        return [len(c.compress(text[i : i + n])) for i in range(0, max(1, len(text)), n)]

    for r in compression.score(docs, model).collect():
        t = (r["text"] or "").encode()
        x, y = sum(size(bad, t, 128)), sum(size(good, t, 128))
        blocks = [(b - g) / (b + g) for b, g in zip(size(bad, t, 512), size(good, t, 512))]
        if len(t) > 512 and len(t) % 512 and len(t) % 512 <= 256:
            blocks.pop()
        z = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], ((x - y) / (x + y), min(blocks)), model.mean, model.scale))
        assert abs(r["score"] - 1 / (1 + np.exp(-max(-30, min(30, z))))) < 1e-9
    assert len(model.weights) == 3 and min(model.weights[1:]) >= 0
