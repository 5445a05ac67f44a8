"""Operator 4, benchmark decontamination by an FM-index per shard of the corpus.

A shard is a run of whole documents. Its words become symbols, its suffixes are sorted, and the Burrows-Wheeler
transform is held as a wavelet matrix. Test phrases are found by backward search, their occurrences located by walking
to sampled suffix positions, and overlapping occurrences merged to spans. Shards are independent tasks: no shuffle, and
a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from marketloom.llm.common import LOWER_WORD, as_bytes, distinct_pairs, in_shards

WINDOW = 13
SHARD_BYTES = 4 << 20
PHRASES_A_BLOCK = 200_000
ADDED = "n_words long, n_hit long, n_items long, item_ids array<string>, items_sha256 string, spans array<struct<start:long,end:long>>, contaminated boolean"


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, with A-Z in lower case."""
    return text.translate(LOWER_WORD).split()


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; suffixes that are already apart are not sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)
    heads = np.flatnonzero(np.r_[True, symbols[order][1:] != symbols[order][:-1]])
    rank[order] = np.repeat(heads, np.diff(np.r_[heads, n]))
    width = 1
    while True:
        # ranks are the places where groups start, so a group alone at its place is final
        size = np.bincount(rank, minlength=n)
        tied = np.flatnonzero(size[rank[order]] > 1)
        if not len(tied) or width >= n:
            return order
        at = order[tied]
        after = at + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        sort = np.lexsort((second, rank[at]))
        at, second = at[sort], second[sort]
        order[tied] = at
        first = rank[at]
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        heads = np.flatnonzero(new)
        rank[at] = np.repeat(tied[heads], np.diff(np.r_[heads, len(at)]))
        width *= 2


class WaveletMatrix:
    """Bit planes of a symbol sequence, highest bit first, each with its running count of ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            plane = (symbols >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(plane)].astype(np.int32))
            self.zeros.append(len(plane) - int(self.ones[-1][-1]))
            symbols = np.r_[symbols[plane == 0], symbols[plane == 1]]

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        low, high = np.zeros(len(symbol), np.int64), end.astype(np.int64)
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self.ones[i][low], self.ones[i][high]
            low = np.where(one, self.zeros[i] + a, low - a)
            high = np.where(one, self.zeros[i] + b, high - b)
        return high - low


class FMIndex:
    """Index of a sequence of symbols >= 1; 0 parts what must not be matched across and is never searched."""

    def __init__(self, symbols: np.ndarray, sample: int = 8):
        symbols = np.r_[symbols, 0].astype(np.int64)
        order = suffix_order(symbols)
        self.bwt = symbols[order - 1]
        bits = max(1, int(symbols.max()).bit_length())
        self.counts = np.r_[0, np.cumsum(np.bincount(symbols, minlength=1 << bits))].astype(np.int64)
        self.wavelet = WaveletMatrix(self.bwt, bits)
        self.n, self.top = len(symbols), 1 << bits
        # a separator has no rank of its own to walk through, so whatever follows one is sampled too
        self.sampled = np.where((order % sample == 0) | (self.bwt == 0), order, -1)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [from, to) of phrases of one length, by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.flatnonzero(phrases.max(axis=1) < self.top) if len(phrases) else np.zeros(0, np.int64)
        high[np.setdiff1d(np.arange(len(phrases)), alive)] = 0
        for column in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, column]
            low[alive] = self.counts[c] + self.wavelet.rank(c, low[alive])
            high[alive] = self.counts[c] + self.wavelet.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step backwards to a sampled position and add the steps."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(self.sampled[at] < 0)
        while len(open_):
            c = self.bwt[at[open_]]
            at[open_] = self.counts[c] + self.wavelet.rank(c, at[open_])
            steps[open_] += 1
            open_ = open_[self.sampled[at[open_]] < 0]
        return self.sampled[at] + steps


class Phrases:
    """One block of test phrases: symbols for their words, and the items each phrase belongs to."""

    def __init__(self, rows: list[tuple[bytes, list[str]]]):
        self.texts = [r[0].split(b" ") for r in rows]
        self.items = sorted({x for r in rows for x in r[1]})
        place = {x: i for i, x in enumerate(self.items)}
        self.of = [np.array(sorted(place[x] for x in r[1]), np.int64) for r in rows]
        self.symbol = {w: i + 1 for i, w in enumerate(sorted({w for t in self.texts for w in t}))}
        self.shortest = min(map(len, self.texts), default=0)
        self.by_length = {}
        for n in sorted(set(map(len, self.texts))):
            ids = np.array([i for i, t in enumerate(self.texts) if len(t) == n], np.int64)
            self.by_length[n] = ids, np.array([[self.symbol[w] for w in self.texts[i]] for i in ids], np.int64)


def phrase_blocks(items: DataFrame, window: int, item_col: str, text_col: str, most: int) -> list[Phrases]:
    """The items' distinct windows, in blocks of at most about `most`, so that each block has a bounded size."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {}
            for item, text in zip(b.column("i").to_pylist(), as_bytes(b.column("t"))):
                w = words_of(text)
                for k in range(max(1, len(w) - window + 1) if w else 0):
                    out[b" ".join(w[k : k + window]), item] = 1
            yield pa.RecordBatch.from_pydict({"phrase": pa.array([k[0] for k in out], pa.binary()), "item": pa.array([k[1] for k in out], pa.string())})

    cut_items = items.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null")
    phrases = cut_items.mapInArrow(cut, "phrase binary, item string").groupBy("phrase").agg(F.collect_set("item").alias("items")).persist()
    try:
        blocks = max(1, -(-phrases.count() // most))
        part = F.pmod(F.xxhash64("phrase"), F.lit(blocks))
        return [Phrases([(bytes(r[0]), r[1]) for r in phrases.where(part == k).orderBy("phrase").collect()]) for k in range(blocks)]
    finally:
        phrases.unpersist()


def scan_shard(texts: list[bytes], blocks: list[Phrases]) -> list[tuple]:
    """Per text: words, hit words, ids of items found, and merged spans of hit words."""
    words = [words_of(t) for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(n_words)
    starts = ends - n_words
    step = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int32)
    found: list[set[str]] = [set() for _ in texts]
    for block in blocks:
        if not block.shortest:
            continue
        get = block.symbol.get
        parts = []  # with a separator behind every document
        for w in words:
            parts.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
            parts.append(np.zeros(1, np.int64))
        line = np.concatenate(parts)
        # only runs of words that occur in phrases, at least as long as the shortest phrase, can hold one
        edge = np.flatnonzero(np.diff(np.r_[0, (line > 0).astype(np.int8), 0]))
        first, last = edge[::2], edge[1::2]
        long_enough = last - first >= block.shortest
        first, last = first[long_enough], last[long_enough]
        if not len(first):
            continue
        size = last - first + 1  # one separator behind each
        from_ = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        index = FMIndex(line[from_])
        for n, (ids, symbols) in block.by_length.items():
            low, high = index.search(symbols)
            many = high - low
            hit = np.flatnonzero(many)
            if not len(hit):
                continue
            phrase = np.repeat(hit, many[hit])
            rows = np.repeat(low[hit] - np.r_[0, np.cumsum(many[hit])[:-1]], many[hit]) + np.arange(many[hit].sum())
            at = from_[index.locate(rows)]
            doc = np.searchsorted(ends + np.arange(1, len(ends) + 1), at, side="right")
            at = at - doc  # the separators before it
            np.add.at(step, at, 1)
            np.add.at(step, at + n, -1)
            for d, p in zip(*distinct_pairs(doc, phrase)):
                found[d].update(block.items[i] for i in block.of[ids[p]])
    hit = np.cumsum(step[:-1]) > 0
    total = np.r_[0, np.cumsum(hit)]
    n_hit = total[ends] - total[starts] if len(ends) else []
    out = []
    for d in range(len(texts)):
        spans = []
        if n_hit[d]:
            edge = np.flatnonzero(np.diff(np.r_[0, hit[starts[d] : ends[d]].astype(np.int8), 0]))
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]
        out.append((int(n_words[d]), int(n_hit[d]), sorted(found[d]), spans))
    return out


def decontaminate(
    docs: DataFrame, items: DataFrame, *, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = SHARD_BYTES, phrases_a_block: int = PHRASES_A_BLOCK
) -> DataFrame:
    """All rows and columns of docs, with n_words, n_hit, n_items, item_ids, items_sha256, spans and contaminated added.

    Spans are half-open ranges of word numbers. A null or empty text has no words, no hits and is not contaminated; an
    item without words matches nothing; repeated rows are judged one by one; without items nothing is hit. A column of
    docs that has the name of an added one is replaced.
    """
    spark = docs.sparkSession
    block_vars = [spark.sparkContext.broadcast(b) for b in phrase_blocks(items, window, item_col, item_text_col, phrases_a_block)]
    added = {x.split()[0] for x in ADDED.split(", ")}
    kept = [c for c in docs.columns if c not in added]
    base = docs.select(*kept)
    schema = T.StructType(base.schema.fields + T.StructType.fromDDL(ADDED).fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in in_shards(batches, shard_bytes, text_col):
            found = scan_shard(as_bytes(shard.column(text_col)), [b.value for b in block_vars])
            shard = shard.append_column("n_words", pa.array([x[0] for x in found], pa.int64()))
            shard = shard.append_column("n_hit", pa.array([x[1] for x in found], pa.int64()))
            shard = shard.append_column("n_items", pa.array([len(x[2]) for x in found], pa.int64()))
            shard = shard.append_column("item_ids", pa.array([x[2] for x in found], pa.list_(pa.string())))
            shard = shard.append_column("items_sha256", pa.array([hashlib.sha256(",".join(x[2]).encode()).hexdigest() for x in found]))
            shard = shard.append_column("spans", pa.array([x[3] for x in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            shard = shard.append_column("contaminated", pa.array([x[1] > 0 and 20 * x[1] >= x[0] for x in found]))
            yield from shard.to_batches()

    return base.mapInArrow(scan, schema)


#: Word runs, windows and hit words by joins on window strings.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM p),
x AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, n WHERE len(w) >= n)),
h AS (SELECT x.doc_id, x.k, x.n, p.item_id FROM x JOIN p ON x.phrase = p.phrase AND x.n = p.n),
hits AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS word FROM h) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)
"""
