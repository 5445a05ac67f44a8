"""Operator 3, quality by compression: Zstandard dictionaries built from good and from bad labelled text.

A text that the good dictionary packs tighter than the bad one reads like good text. The measure is the normalised
difference of the two packed sizes, (bad - good) / (bad + good), taken twice: over the whole text, packed in pieces of
PIECE bytes so that a long text doesn't teach itself, and for the block of BLOCK bytes where it is least. A logistic
calibration that never falls as a difference grows turns both into the chance of label 1; nothing else enters the score.
Fitting sees a sample of labelled rows of bounded size; scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from marketloom.llm.common import as_bytes, in_shards, written

LEVEL = 3
PIECE, BLOCK = 128, 512
DICTIONARY_BYTES = 112_640
#: Labelled rows per class that the dictionaries are built from, and as many others for the calibration, one row in three.
FIT_ROWS = 4000
#: Pieces of their texts given to the dictionary builder, per class.
PIECES, PIECE_BYTES = 16_000, 512
RIDGE = 1e-3
THRESHOLD = 0.7
SHARD_BYTES = 4 << 20


@dataclass
class Model:
    """Dictionaries (bad, good) and the calibration; without both classes only the share of label 1 is known."""

    dictionaries: tuple[bytes, ...] = ()
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    prior: float = 0.5


class Sizes:
    """Packed sizes of a text under both dictionaries."""

    def __init__(self, dictionaries: tuple[bytes, ...]):
        self.pack = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False).compress for d in dictionaries]

    def differences(self, text: bytes) -> list[float]:
        """The normalised size difference of the text in pieces, and the least one of its blocks."""
        bad, good = self.pack
        x = y = 0
        for i in range(0, max(1, len(text)), PIECE):
            x += len(bad(text[i : i + PIECE]))
            y += len(good(text[i : i + PIECE]))
        least = 1.0
        # a rest of less than half a block is no block
        for i in range(0, max(1, len(text) - BLOCK // 2), BLOCK):
            b, g = len(bad(text[i : i + BLOCK])), len(good(text[i : i + BLOCK]))
            least = min(least, (b - g) / (b + g))
        return [(x - y) / (x + y), least]


def dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too few pieces to choose from: they are the dictionary
        return b"".join(pieces)[:DICTIONARY_BYTES] or b"\n" * 8


def logistic(rows: np.ndarray, label: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> Model:
    """Ridge logistic regression by Newton's method, each step halved until the loss falls."""
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    x = np.c_[np.ones(len(rows)), (rows - mean) / scale]
    w, weight = np.zeros(x.shape[1]), weight / weight.sum()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - label * z) + ridge / 2 * (w[1:] @ w[1:]))

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - label)) + ridge * np.r_[0, w[1:]]
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step, now, t = np.linalg.solve(hessian, gradient), loss(w), 1.0
        while t > 1e-6 and loss(w - t * step) > now:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-7:
            break
    if (w[1:] < 0).any():  # the score must not fall as a difference grows: that measure is left out
        return logistic(rows * (w[1:] >= 0), label, weight * len(rows), ridge)
    return Model(mean=mean.tolist(), scale=scale.tolist(), weights=w.tolist())


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the rows that may be learnt from: crc32 of the id as text mod 4 is not 2."""
    return labels.where("quality in (0, 1) and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()


def fit(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from at most fit_rows labelled rows for each class and purpose, the first by a hash of the id.

    Documents with contradicting labels count for both. The classes' weights are those of all labelled rows.
    """
    known = training_labels(labels).withColumn("use", (F.shiftright(F.crc32(F.col("doc_id").cast("string")), 2) % 3 == 0).cast("int")).persist()
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    total = sum(counts.values())
    model = Model(prior=(counts.get(1, 0) + 1) / (total + 2))
    chosen = None
    for quality in (0, 1):
        for use in (0, 1):
            part = known.where((F.col("quality") == quality) & (F.col("use") == use)).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(fit_rows)
            chosen = part if chosen is None else chosen.unionByName(part)
    # at most 4 * fit_rows ids are broadcast
    sample = written(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id"), "labelled")
    known.unpersist()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(q, t[i : i + PIECE_BYTES]) for q, t in zip(b.column("quality").to_pylist(), as_bytes(b.column("text"))) for i in range(0, len(t), PIECE_BYTES)]
            yield pa.RecordBatch.from_pydict({"quality": pa.array([x[0] for x in got], pa.int32()), "piece": pa.array([x[1] for x in got], pa.binary())})

    pieces = sample.where("use = 0").mapInArrow(cut, "quality int, piece binary")
    dictionaries = []
    for quality in (0, 1):
        got = pieces.where(F.col("quality") == quality).orderBy(F.xxhash64("piece"), "piece").limit(PIECES).collect()
        if not got:
            return model
        dictionaries.append(dictionary([bytes(r["piece"]) for r in got]))
    sizes = sample.sparkSession.sparkContext.broadcast(tuple(dictionaries))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = Sizes(sizes.value)
        for b in batches:
            found = [packed.differences(t) for t in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.string()), "quality": b.column("quality"), "x": pa.array(found, pa.list_(pa.float64()))})

    got = sorted(sample.where("use = 1").mapInArrow(measure, "doc_id string, quality int, x array<double>").collect())
    label = np.array([r["quality"] for r in got], float)
    if not len(got) or label.min() == label.max():
        return model
    share = np.array([counts[0], counts[1]]) / np.bincount(label.astype(int), minlength=2)
    fitted = logistic(np.array([r["x"] for r in got]), label, share[label.astype(int)])
    return Model(tuple(dictionaries), fitted.mean, fitted.scale, fitted.weights, model.prior)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of docs with score (0 to 1) and predicted (1 from the threshold on) added or replaced.

    Scores depend on the text alone, so repeated rows score alike; null counts as empty, and an empty text gets the
    score of its (constant) features. A model that lacks a class gives the share of label 1 to every text.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        packed = Sizes(m.dictionaries) if m.weights else None
        for shard in in_shards(batches, SHARD_BYTES, text_col):
            if packed:
                x = (np.array([packed.differences(t) for t in as_bytes(shard.column(text_col))]).reshape(-1, len(m.mean)) - m.mean) / m.scale
                found = 1 / (1 + np.exp(-np.clip(m.weights[0] + (x * m.weights[1:]).sum(axis=1), -30, 30)))
            else:
                found = np.full(shard.num_rows, m.prior)
            shard = shard.append_column("score", pa.array(found, pa.float64())).append_column("predicted", pa.array((found >= threshold).astype(np.int32)))
            yield from shard.to_batches()

    return base.mapInArrow(run, schema)
