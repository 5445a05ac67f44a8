"""Operator 1 on Spark: lattice scores of all words of a corpus, corpus counts and document scores.

One pass turns shards of whole documents into their distinct words and postings. A shard's words are rows (word, uses)
that meet once, sorted by word, and become one row a word with the places it has in the shards, so rows grow with the text
and not with shards times buckets. The lattice runs once per distinct word of the corpus, not per use. Word scores go back
to these places without a join, and the postings add them up. Nothing that grows with the corpus is broadcast or collected,
and no row but a shard's postings is larger than a word with its shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from marketloom.llm.common import LOWER, as_bytes, in_shards, packed, unpacked, written
from marketloom.llm.lattice import VOCABULARY, Lattice, batches_by_length, read_pieces

SHARD_BYTES = 16 << 20
#: Words of a shard that are handed over at a time.
WORD_ROWS = 20_000
#: Of what is kept for unseen tokens, the end's part.
END_SHARE = 0.01
#: Most frequent values of the class column with word counts of their own; all other rows share one more class.
CLASSES = 6
#: How often expected uses are taken for the weights that are interpolated, and their part of an unseen word.
ROUNDS, LEARNT_SHARE = 2, 0.9


class _Numbered(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def index_shards(docs: DataFrame, classes: int) -> DataFrame:
    """One row for each distinct word of a shard: its place there and for each class the uses that are learnt (l0, l1 ..); and
    one row a shard without a word: its postings, for each word the documents that have it and how often. Words are rows of
    their own, as a reader takes thousands of rows at a time and would hold as many shards."""
    learnt_names = [f"l{k}" for k in range(classes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = ["shard", "at", "word", *learnt_names, "postings", "ids", "held"]
        for k, shard in enumerate(in_shards(batches, SHARD_BYTES)):
            number = _Numbered()
            ids = [np.fromiter(map(number.__getitem__, t.translate(LOWER).split()), np.int32) for t in as_bytes(shard.column("text"))]
            sizes = np.array([len(x) for x in ids], np.int64)
            pairs = np.concatenate(ids).astype(np.int64)
            del ids
            pairs = (pairs << 32) | np.repeat(np.arange(len(sizes)), sizes)
            pairs.sort()
            first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, np.int64)
            uses = np.diff(np.r_[first, len(pairs)])
            word, doc = pairs[first] >> 32, pairs[first] & 0xFFFFFFFF
            del pairs
            held = np.asarray(shard.column("held")).astype(bool)
            kind = np.asarray(shard.column("kind")).astype(np.int64)
            learnt = np.bincount(word * classes + kind[doc], np.where(held[doc], 0, uses), minlength=classes * len(number)).astype(np.int64).reshape(-1, classes)
            lengths = np.bincount(word, minlength=len(number))
            postings = packed([b"".join(x.astype("<i4").tobytes() for x in (np.array([len(number), len(doc)]), lengths, doc, uses, sizes))])
            del word, doc, uses
            shard_id, words = (part << 32) | k, list(number)
            del number
            for i in range(0, len(words), WORD_ROWS):
                n = len(words[i : i + WORD_ROWS])
                counts = [pa.array(np.ascontiguousarray(learnt[i : i + n, c]).astype(np.int32)) for c in range(classes)]
                rows = [pa.array(np.full(n, shard_id)), pa.array(np.arange(i, i + n, dtype=np.int32)), pa.array(words[i : i + n], pa.binary()).cast(pa.string()), *counts]
                yield pa.RecordBatch.from_arrays([*rows, *(pa.nulls(n, t) for t in (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_())))], names)
            one = [pa.array([postings[0]], pa.binary()), pa.array([shard.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([held.tolist()], pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays([pa.array([shard_id], pa.int64()), *(pa.nulls(1, t) for t in (pa.int32(), pa.string(), *[pa.int32()] * classes)), *one], names)

    return docs.mapInArrow(run, "shard long, at int, word string, " + "".join(f"{x} int, " for x in learnt_names) + "postings binary, ids array<long>, held array<boolean>")


def gathered(uses: DataFrame, counts: list[str]) -> DataFrame:
    """(word, counts, places): one row a word of rows (shard, at, word, counts), its counts added up, and where it stands.

    A word has at most one row a shard, so no word is much in one task.
    """

    def one_a_word(t: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        column = lambda c: t.column(c).combine_chunks()
        places = pa.StructArray.from_arrays([column("shard"), column("at")], ["shard", "at"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, t.num_rows].astype(np.int32)), places)
        sums = [pa.array(np.add.reduceat(np.asarray(column(c)).astype(np.int64), first)) for c in counts]
        return pa.RecordBatch.from_arrays([column("word").take(pa.array(first)), *sums, lists], ["word", *counts, "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            word = t.column("word").combine_chunks()
            first = np.r_[0, np.flatnonzero(np.asarray(pc.not_equal(word[1:], word[:-1]))) + 1].astype(np.int64)
            if len(first) > 1:
                yield one_a_word(t.slice(0, first[-1]), first[:-1])
            # the last word may go on in the next batch
            held = t.slice(first[-1])
        if held is not None:
            yield one_a_word(held, np.zeros(1, np.int64))

    rows = uses.select("shard", "at", "word", *counts).repartition("word").sortWithinPartitions("word")
    return rows.mapInArrow(run, "word string, " + "".join(f"{c} long, " for c in counts) + "places array<struct<shard: long, at: int>>")


def refine(words: DataFrame, lattice_var, weights: np.ndarray) -> np.ndarray:
    """Weights by the expected uses of the pieces in the distinct words that are learnt."""
    held = words.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(held.value))
        for b in batches:
            mine = as_bytes(b.column("word"))
            out[-1] += len(mine)
            for _, letters in batches_by_length(mine):
                out[:-1] += lattice_var.value.expected(letters, held.value)
        yield pa.RecordBatch.from_pydict({"x": pa.array([out.astype("<f8").tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value))
        for b in batches:
            for x in b.column("x").to_pylist():
                total += np.frombuffer(x, "<f8")
        yield pa.RecordBatch.from_pydict({"x": pa.array([total.tobytes()], pa.binary())})

    # tasks' sums meet in a few tasks first: the driver gets at most eight of the vocabulary's size
    parts = words.where(" + ".join(c for c in words.columns if c[0] == "l") + " > 0").select("word").mapInArrow(run, "x binary").repartition(8).mapInArrow(add, "x binary").collect()
    total = sum((np.frombuffer(bytes(r["x"]), "<f8") for r in parts), np.zeros(len(weights))) + 0.01
    return lattice_var.value.weights(total[:-1], total[-1])


def spelt(words: DataFrame, lattice_var, learnt: np.ndarray) -> DataFrame:
    """Rows of words with the natural logs of the word's marginal probability, `spelling`, and of its mixture with the marginal
    under the learnt weights, `mixture`, in place of the word."""
    kept = [f for f in words.schema.fields if f.name != "word"]
    held = words.sparkSession.sparkContext.broadcast(learnt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_var.value
        weights = lattice.first_weights()
        for b in batches:
            fixed, own = np.empty(b.num_rows), np.empty(b.num_rows)
            for at, letters in batches_by_length(as_bytes(b.column("word"))):
                fixed[at], own[at] = lattice.forward(letters, weights), lattice.forward(letters, held.value)
            mixture = np.logaddexp(fixed + np.log(1 - LEARNT_SHARE), own + np.log(LEARNT_SHARE))
            yield b.select([f.name for f in kept]).append_column("spelling", pa.array(fixed)).append_column("mixture", pa.array(mixture))

    return words.mapInArrow(run, T.StructType([*kept, T.StructField("spelling", T.DoubleType()), T.StructField("mixture", T.DoubleType())]))


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang", held_out=None, vocabulary: str = VOCABULARY, classes: int = CLASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score), one row per row of docs.

    `held_out` is a boolean column of docs' rows that are scored but not learnt from (default: crc32 of the id as text
    mod 5 is 1). `lattice_score` is the log10 of the text's marginal probability under the vocabulary's fixed weights
    alone, each word with all its segmentations and a constant for the end. `score` is the log10 probability of the same
    tokens under a mixture of one word model a class, with marginals interpolated into the words learnt: a class gives
    (uses + a * m) / (tokens + a), a being its words used once plus one, and m a mixture, one to nine, of the marginal
    under the vocabulary's weights and of that under weights from the pieces' expected uses in the words learnt. The class column
    only sorts the texts learnt from: the `classes` most frequent values have counts of their own, all other rows share
    one more class, and a text is scored under all. `base_score` adds half a count to every word. Null and empty texts
    have one token, the end. Repeated rows count and are scored as often as they occur; without rows to learn from all
    counts are 0 and the marginal remains; no rows give no rows. Only the named columns are read.
    """
    spark = docs.sparkSession
    held = F.crc32(F.col(id_col).cast("string")) % 5 == 1 if held_out is None else held_out
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held, F.lit(False)).alias("held"), (F.col(class_col) if class_col else F.lit(None).cast("string")).alias("label"))
    common = rows.where("not held and label is not null").groupBy("label").count().orderBy(F.desc("count"), "label").limit(classes).collect() if class_col else []
    kind = F.lit(len(common))
    for k, r in enumerate(common):
        kind = F.when(F.col("label") == r["label"], k).otherwise(kind)
    n = len(common) + 1
    ends = np.zeros(n)
    for r in rows.where("not held").groupBy(kind.alias("k")).count().collect():
        ends[r["k"]] = r["count"]
    indexed = written(index_shards(rows.select("doc_id", "text", "held", kind.cast("int").alias("kind")), n), "postings")
    counts = [f"l{k}" for k in range(n)]
    lattice_var = spark.sparkContext.broadcast(Lattice(read_pieces(vocabulary)))
    counted = written(gathered(indexed.where("word is not null"), counts), "words")
    learnt = lattice_var.value.first_weights()
    for _ in range(ROUNDS):
        learnt = refine(counted, lattice_var, learnt)

    c = F.expr(" + ".join(counts))
    sums = [F.sum(x) for x in counts] + [F.count_if(F.col(x) == 1) for x in counts] + [F.count_if(c > 0)]
    facts = [x or 0 for x in counted.agg(*[x.alias(f"f{i}") for i, x in enumerate(sums)]).first()]
    of_class, added = np.array(facts[:n]) + ends, np.array(facts[n : 2 * n]) + 1.0
    total, all_ends = int(of_class.sum()), int(ends.sum())
    distinct = facts[-1] + int(all_ends > 0)

    answers = spelt(counted, lattice_var, learnt).select("spelling", "mixture", *counts, F.inline("places")).withColumnRenamed("shard", "to")
    end_score = np.log10((ends + added * END_SHARE) / (of_class + added))
    share = np.log10((ends + 1) / (ends + 1).sum())

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        posted = np.frombuffer(unpacked([left.column("postings")[0].as_py()])[0], "<i4")
        ids, held = left.column("ids")[0].as_py(), left.column("held")[0].as_py()
        m, many = posted[:2]
        lengths, doc, uses, sizes = np.split(posted[2:], np.cumsum([m, many, many]))
        at, size, word = np.asarray(right.column("at")), len(ids), np.repeat(np.arange(m), lengths)
        low = total + 0.5 * (distinct + 1)

        def of_words(name: str) -> np.ndarray:
            out = np.zeros(m)
            out[at] = np.asarray(right.column(name))
            return out

        def add(values: np.ndarray, end: float) -> np.ndarray:
            return np.bincount(doc, uses * values[word], minlength=size) + end

        uses_of, spelling, mixture = [of_words(x) for x in counts], of_words("spelling"), of_words("mixture")
        c, s = np.sum(uses_of, axis=0), spelling / np.log(10)

        def probability(k: int) -> np.ndarray:
            # sums of logs keep a long word's tiny marginal from becoming 0
            seen = np.log(uses_of[k], out=np.full(m, -np.inf), where=uses_of[k] > 0)
            return np.logaddexp(seen, np.log(added[k] * (1 - END_SHARE)) + mixture) / np.log(10) - np.log10(of_class[k] + added[k])

        sums = np.stack([add(probability(k), end_score[k] + share[k]) for k in range(n)], axis=1)
        most = sums.max(axis=1)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), "n_tokens": sizes.astype(np.int64) + 1, "n_known": add(c > 0, all_ends > 0).astype(np.int64), "train_tokens": np.full(size, total),
                "base_score": add(np.log10((c + 0.5) / low), np.log10((all_ends + 0.5) / low)), "score": most + np.log10((10 ** (sums - most[:, None])).sum(axis=1)), "lattice_score": add(s + np.log10(1 - END_SHARE), np.log10(END_SHARE)),
            }
        )

    shards = indexed.where("postings is not null").select(F.col("shard").alias("of"), "postings", "ids", "held")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"
    return shards.groupBy("of").cogroup(answers.groupBy("to")).applyInArrow(add_up, schema)
