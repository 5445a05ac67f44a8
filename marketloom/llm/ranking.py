"""Operator 13, ranked lexical search of queries against all documents by a threshold-seeded join.

For each term the k highest impacts that it has on any document are stored. An item's k-th score can't be lower than its terms'
k-th impacts, nor than the k-th best exact score of the documents behind the stored impacts: that is the item's threshold.
Its terms are ordered by their highest possible share; where what is left of the bounds (the suffix) is below the threshold, a
document with no earlier term can't be among the k, so the terms of the suffix produce no candidates. Candidates whose share so
far plus the suffix reaches the threshold are scored anew in whole numbers.

Documents are counted once and kept as lists of the terms that any item has. Items go to them in blocks of bounded size; a task
scores a shard of documents against a block and gives back at most k rows an item, so no row a pair is ever shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from marketloom.llm.common import LOWER_WORD, as_bytes, in_shards, joined, written

TOP = 10
#: Bits of the map of the items' terms that counting looks words up in: 512 KB at any number of terms.
MAP_BITS = 1 << 22
#: Terms of items that are sent to tasks at a time, some 30 bytes each; a block holds at least one item.
BLOCK_TERMS = 200_000
#: Bytes of text, and cells of documents by items, that a task holds at a time.
SHARD_BYTES, CELLS = 16 << 20, 1 << 21
COUNTED = "doc_id long, n long, terms array<binary>, tfs array<long>"


def _words(text: bytes) -> list[bytes]:
    return text.translate(LOWER_WORD).split()


def _slot(word: bytes, map_bits: int) -> int:
    return xxhash.xxh3_64_intdigest(word) % map_bits


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, q): how often an item has a term; rows of one id are one item."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms, q = [], [], []
            for i, text in zip(batch.column("item_id").to_pylist(), as_bytes(batch.column("text"))):
                held = Counter(_words(text))
                ids += [i] * len(held)
                terms += held.keys()
                q += held.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary()), pa.array(q, pa.int64())], ["item_id", "term", "q"])

    found = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(count, "item_id long, term binary, q long")
    return found.groupBy("item_id", "term").agg(F.sum("q").alias("q"))


def term_map(terms: DataFrame, map_bits: int = MAP_BITS) -> bytes:
    """The bits of the words' slots. 64 slots a row are joined in tasks, so at most map_bits / 64 rows come here."""

    def slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.fromiter((_slot(t, map_bits) for t in batch.column("term").to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(at & 63)], ["cell", "bit"])

    cells = terms.select("term").mapInArrow(slots, "cell long, bit long").groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits"))
    bits = np.zeros(map_bits // 64, np.int64)
    for row in cells.collect():
        bits[row["cell"]] = row["bits"]
    return bits.tobytes()


def count_terms(docs: DataFrame, bits: bytes) -> DataFrame:
    """(doc_id, n, terms, tfs): the number of a document's terms, and those whose slot is in the map with their occurrences.
    Documents without a term are left out, as they don't count."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(sent.value, np.uint64)
        known: dict[bytes, bool] = {}
        for shard in in_shards(batches, SHARD_BYTES):
            ids, ns, terms, tfs, ends = [], [], [], [], [0]
            for i, text in zip(shard.column("doc_id").to_pylist(), as_bytes(shard.column("text"))):
                words = _words(text)
                if not words:
                    continue
                for word, tf in Counter(words).items():
                    held = known.get(word)
                    if held is None:
                        slot = _slot(word, 64 * len(cells))
                        held = known[word] = bool(int(cells[slot >> 6]) >> (slot & 63) & 1)
                    if held:
                        terms.append(word)
                        tfs.append(tf)
                ids.append(i)
                ns.append(len(words))
                ends.append(len(terms))
            if len(known) > 1_000_000:
                known.clear()
            ends_ = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends_, pa.array(terms, pa.binary())), pa.ListArray.from_arrays(ends_, pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, COUNTED)


def share(tf: np.ndarray, n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """A term's impact on a document without the term's weight, in 64-bit whole numbers rounded down."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * (100 - 75 + 75 * n * docs // words))


def _flat(batch: pa.RecordBatch, docs: int, words: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Place in the batch, term and share of each term of its documents."""
    terms, tfs = batch.column("terms"), batch.column("tfs")
    at = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(terms)))
    return at, terms.flatten(), share(np.asarray(tfs.flatten()), np.asarray(batch.column("n"))[at], docs, words)


def term_facts(counted: DataFrame, docs: int, words: int, k: int = TOP) -> tuple[DataFrame, DataFrame]:
    """(term, df, w, top, kth) a term, and (term, doc_id, share) for the k highest shares of each term. A task gives a term's
    count and k highest once a batch, and again only k a term and partition are shuffled."""

    def tops(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, terms, shares = _flat(batch, docs, words)
            named = terms.dictionary_encode()
            code = np.asarray(named.indices)
            order = np.lexsort((-shares, code))
            code, first = code[order], np.flatnonzero(np.r_[True, np.diff(code[order]) > 0]) if len(order) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[first, len(code)])
            rank = np.arange(len(code)) - np.repeat(first, sizes)
            kept = rank < k
            df = np.where(rank == 0, np.repeat(sizes, sizes), 0)[kept]
            ids = batch.column("doc_id").take(pa.array(at[order][kept]))
            yield pa.RecordBatch.from_arrays([named.dictionary.take(pa.array(code[kept])), ids, pa.array(shares[order][kept]), pa.array(df.astype(np.int64))], ["term", "doc_id", "share", "df"])

    part = written(counted.mapInArrow(tops, "term binary, doc_id long, share long, df long"), "tops")
    best = written(
        part.select("term", "doc_id", "share", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("share"), "doc_id")).alias("rank")).where(F.col("rank") <= k), "kth"
    )
    bounds = best.groupBy("term").agg(F.max("share").alias("top"), F.max(F.when(F.col("rank") == k, F.col("share"))).alias("kth"))
    df = part.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(float(2 * docs + 2)) / (2 * F.col("df") + 1)).cast("double"))).cast("long")
    return df.join(bounds, "term").select("term", "df", weight.alias("w"), "top", F.coalesce("kth", F.lit(0)).alias("kth")), best


@dataclass(frozen=True)
class Block:
    """Items by number: ids, thresholds, suffix bounds; (item, term, weight times uses, whether pruned) by item, terms by number."""

    ids: list
    least: np.ndarray
    rest: np.ndarray
    item: np.ndarray
    term: np.ndarray
    qw: np.ndarray
    pruned: np.ndarray
    terms: list[bytes]


def _block(rows: list[tuple]) -> Block:
    item_ids, words, qw, bound, lowest = ([r[c] for r in rows] for c in range(5))
    ids = {i: k for k, i in enumerate(dict.fromkeys(item_ids))}
    terms = {t: k for k, t in enumerate(dict.fromkeys(map(bytes, words)))}
    item, bound = np.array([ids[i] for i in item_ids], np.int64), np.array(bound, np.int64)
    least = np.ones(len(ids), np.int64)
    np.maximum.at(least, item, np.array(lowest, np.int64))
    order = np.lexsort((bound, item))
    item, bound = item[order], bound[order]
    # from the least bound upwards: a term is pruned while all up to it stay below the threshold
    first = np.flatnonzero(np.r_[True, np.diff(item) > 0])
    run = np.cumsum(bound)
    run -= np.repeat(np.r_[0, run[first[1:] - 1]], np.diff(np.r_[first, len(item)]))
    pruned = run < least[item]
    rest = np.zeros(len(ids), np.int64)
    np.add.at(rest, item[pruned], bound[pruned])
    term = np.array([terms[bytes(t)] for t in words], np.int64)[order]
    return Block(list(ids), least, rest, item, term, np.array(qw, np.int64)[order], pruned, list(terms))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges: whose each place is, and the place."""
    whose = np.repeat(np.arange(len(sizes)), sizes)
    return whose, np.arange(len(whose)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def search(counted: DataFrame, probes: list[tuple], docs: int, words: int, k: int = TOP, cells: int = CELLS) -> DataFrame:
    """(item_id, doc_id, score): the k best of each partition's documents for each item of a block, if they reach its threshold.
    probes are rows (item_id, term, qw, bound, least)."""
    sent = counted.sparkSession.sparkContext.broadcast(_block(probes))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = sent.value
        n_items, n_terms = len(b.ids), len(b.terms)
        vocabulary = pa.array(b.terms, pa.binary())
        # the items of each term that makes candidates, and the terms of each item
        seeds = np.flatnonzero(~b.pruned)
        seeds = seeds[np.argsort(b.term[seeds], kind="stable")]
        s_from = np.searchsorted(b.term[seeds], np.arange(n_terms + 1))
        i_from = np.searchsorted(b.item, np.arange(n_items + 1))
        step = max(1, cells // max(n_items, 1))
        kept: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                at, terms, shares = _flat(batch, docs, words)
                code = pc.index_in(terms, vocabulary)
                ok = np.asarray(code.is_valid())
                at, shares, code = at[ok], shares[ok], np.asarray(code.drop_null()).astype(np.int64)
                total = np.zeros(batch.num_rows * n_items, np.int64)
                # a document's terms meet their items a slice at a time, so that what is held is bounded
                sizes = s_from[code + 1] - s_from[code]
                ends = np.searchsorted(np.cumsum(sizes), np.arange(cells, sizes.sum() + cells, cells), side="left") + 1
                for c, d in zip(np.r_[0, ends[:-1]], ends):
                    whose, place = _spread(s_from[code[c:d]], sizes[c:d])
                    pair = seeds[place]
                    np.add.at(total, at[c:d][whose] * n_items + b.item[pair], shares[c:d][whose] * b.qw[pair])
                found = np.flatnonzero((total > 0) & (total + np.tile(b.rest, batch.num_rows) >= np.tile(b.least, batch.num_rows)))
                if not len(found):
                    continue
                key = at * n_terms + code
                order = np.argsort(key)
                key, held = np.r_[key[order], -1], np.r_[shares[order], 0]
                exact = np.zeros(len(found), np.int64)
                doc, item = np.divmod(found, n_items)
                for c in range(0, len(found), max(1, cells // 64)):
                    d = c + max(1, cells // 64)
                    whose, place = _spread(i_from[item[c:d]], i_from[item[c:d] + 1] - i_from[item[c:d]])
                    wanted = doc[c:d][whose] * n_terms + b.term[place]
                    near = np.searchsorted(key[:-1], wanted)
                    np.add.at(exact[c:d], whose, np.where(key[near] == wanted, held[near], 0) * b.qw[place])
                good = exact >= b.least[item]
                if good.any():
                    kept.append((item[good], exact[good], batch.column("doc_id").take(pa.array(doc[good]))))
                if sum(len(x[0]) for x in kept) > cells // 4:
                    kept = [_best(kept, k)]
        if kept:
            item, exact, ids = _best(kept, k)
            yield pa.RecordBatch.from_arrays([pa.array([b.ids[i] for i in item.tolist()], pa.int64()), ids, pa.array(exact)], ["item_id", "doc_id", "score"])

    return counted.mapInArrow(score, "item_id long, doc_id long, score long")


def _best(parts: list[tuple[np.ndarray, np.ndarray, pa.Array]], k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each item, the k highest scores; equal ones by ascending id, null first."""
    item, score = (np.concatenate([p[x] for p in parts]) for x in (0, 1))
    ids = pa.chunked_array([p[2] for p in parts]).combine_chunks()
    known = np.asarray(ids.is_valid())
    order = np.lexsort((np.asarray(pc.fill_null(ids, 0)), known, -score, item))
    item = item[order]
    first = np.flatnonzero(np.r_[True, np.diff(item) > 0])
    rank = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
    order = order[rank < k]
    return item[rank < k], score[order], ids.take(pa.array(order))


def best(found: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score)."""
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank(items: DataFrame, docs: DataFrame, k: int = TOP, *, map_bits: int = MAP_BITS, block_terms: int = BLOCK_TERMS, cells: int = CELLS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents.

    Rows of items with one id are one item, a null id included; an item without a term that some document has gives no rows. A
    null text has no terms, as an empty one; a very long text is read whole, in one task; equal scores go by id, null first,
    and documents that repeat are ranked side by side; without documents or items the result is empty. Only item_id, doc_id and
    text are read, whatever other columns there are.
    """
    probes = written(item_terms(items), "item-terms")
    counted = written(count_terms(docs, term_map(probes, map_bits)), "counted")
    n_docs, n_words = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return best(docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long"), k)
    facts, tops = term_facts(counted.where(F.size("terms") > 0), n_docs, n_words, k)
    uses = probes.groupBy("term").agg(F.count("*").alias("k"))
    n_probes = probes.count()
    facts = written(facts.where("w > 0").join(uses, "term"), "facts")
    qw = (F.col("q") * F.col("w")).alias("qw")
    weighed = joined(probes, facts, "term", n_probes).select("item_id", "term", qw, (qw * F.col("top")).alias("bound"), (qw * F.col("kth")).alias("least"))
    blocks = max(1, math.ceil(n_probes / block_terms))
    by_block = written(weighed.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), "probes")
    # documents behind the stored impacts, at most k a term, raise the thresholds
    seeds = written(counted.join(tops.join(facts, "term", "left_semi").select("doc_id").distinct(), "doc_id", "left_semi"), "seeds")
    parts = []
    for block in range(blocks):
        rows = by_block.where(F.col("block") == block).drop("block").collect()
        if not rows:
            continue
        seeded = best(search(seeds, rows, n_docs, n_words, k, cells), k).where(F.col("rank") == k).select("item_id", "score").collect()
        least = {r["item_id"]: r["score"] for r in seeded}
        raised = [(r["item_id"], r["term"], r["qw"], r["bound"], max(r["least"], least.get(r["item_id"], 0))) for r in rows]
        parts.append(written(search(counted, raised, n_docs, n_words, k, cells), f"found-{block}"))
    found = parts[0] if parts else docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for more in parts[1:]:
        found = found.unionByName(more)
    return best(found, k)


SQL = """
WITH words AS (
  SELECT doc_id, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS r FROM documents)),
asked AS (
  SELECT item_id, term, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
lengths AS (SELECT r, count(*) AS n FROM words GROUP BY r),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths),
uses AS (SELECT doc_id, r, term, count(*) AS tf FROM words GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM uses, whole GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, r, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words)))) AS BIGINT) AS score
  FROM asked JOIN uses USING (term) JOIN weights USING (term) JOIN lengths USING (r), whole GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, r) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, r) <= 10
"""
