"""Operator 5, SimHash fingerprints, and permuted block tables that find fingerprints within a Hamming radius.

A text's words vote with the signs of their 128-bit hashes, each word with a whole-number weight that grows with the
logarithm of its uses; a bit is set where the votes are positive. Whole numbers make the sums exact in any order, so
equal texts have equal fingerprints wherever they are computed. A fingerprint is cut into five blocks, and for each there
is a table with that block moved to the front as its key. Fingerprints within RADIUS bits differ by at most two bits in
one block at least, so a query that asks each table for its block and all keys within two bits of it meets all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from marketloom.llm.common import LOWER, in_shards, written

BITS = 128
#: Near copies by five-word Jaccard similarity of 0.8 are mostly within this; see the README for their share.
RADIUS = 14
#: From the highest bit of the fingerprint.
BLOCK_BITS = (26, 26, 26, 25, 25)
BATCH_BYTES = 1 << 20
ROWS_A_RANGE = 4096


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """One row of 16 bytes a text; a text without words has all bits 0."""
    number: dict[bytes, int] = {}
    per_text = []
    for t in texts:
        words = t.translate(LOWER).split()
        for w in words:
            if w not in number:
                number[w] = len(number)
        per_text.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, number)), np.uint8).reshape(-1, BITS // 8)
    signs = np.unpackbits(digests, axis=1).astype(np.float32) * 2 - 1
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for i, ids in enumerate(per_text):
        if len(ids):
            ids, uses = np.unique(ids, return_counts=True)
            weight = np.rint(8 * (1 + np.log2(uses))).astype(np.float32)
            votes = np.zeros(BITS)
            for k in range(0, len(ids), 1 << 14):  # sums below 2 ** 24 are exact
                votes += weight[k : k + (1 << 14)] @ signs[ids[k : k + (1 << 14)]]
            out[i] = np.packbits(votes > 0)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, row by row."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def _ranges(ids: DataFrame, rows_a_range: int) -> tuple[np.ndarray, dict[int, int]]:
    """Inner bounds of id ranges of like size, and the least id of each range that has one."""
    n = ids.count()
    parts = min(50_000, max(1, -(-n // rows_a_range)))
    bounds = np.zeros(0, np.int64)
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        bounds = np.unique(np.array(ids.agg(F.percentile_approx("doc_id", shares, 20 * parts).alias("q")).first()["q"], np.int64))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for b in batches:
            x = np.sort(np.asarray(b.column("doc_id")))
            r, first = np.unique(np.searchsorted(bounds, x), return_index=True)
            for k, v in zip(r.tolist(), x[first].tolist()):
                found[k] = min(v, found.get(k, v))
        yield pa.RecordBatch.from_pydict({"range": pa.array(list(found), pa.int64()), "least": pa.array(list(found.values()), pa.int64())})

    rows = ids.mapInArrow(least, "range long, least long").groupBy("range").agg(F.min("least").alias("least")).collect()
    return bounds, {r["range"]: r["least"] for r in sorted(rows)}


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per row of docs.

    The edited text ends in the start of the next document's text. Next is by doc_id (equal ids by their packed texts); after the last comes the
    first, so a single document is its own next. Null counts as empty; empty texts have the fingerprint of no words and
    are alike. Rows without an id are left out, as they have no place in the order. No rows give no rows. Ids are dealt
    to ranges; each range also gets the first document of the range behind it, so texts move once and no task sees more
    than its ranges.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bounds, least = _ranges(rows.select("doc_id"), rows_a_range)
    present = sorted(least)
    before = {least[r]: present[i - 1] for i, r in enumerate(present)}  # first id -> range that borrows it
    firsts = np.array(sorted(before), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for shard in in_shards(batches, 4 * BATCH_BYTES):
            ids = np.asarray(shard.column("doc_id"))
            text = pa.array([pack(t) for t in pc.fill_null(shard.column("text"), "").cast(pa.binary()).to_pylist()], pa.binary())
            own = pa.RecordBatch.from_pydict({"range": np.searchsorted(bounds, ids).astype(np.int64), "borrowed": np.zeros(len(ids), bool), "doc_id": ids, "packed": text})
            yield own
            lent = np.flatnonzero(np.isin(ids, firsts))
            if len(lent):
                yield pa.RecordBatch.from_pydict({"range": np.array([before[i] for i in ids[lent].tolist()], np.int64), "borrowed": np.ones(len(lent), bool), "doc_id": ids[lent], "packed": text.take(pa.array(lent))})

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress

        def pairs() -> Iterator[tuple[int, str, str]]:
            last = None
            for b in batches:
                for r, borrowed, i, p in zip(*(b.column(c).to_pylist() for c in ("range", "borrowed", "doc_id", "packed"))):
                    if last is not None and last[0] == r:
                        text = unpack(p).decode()
                        yield last[1], last[2], text
                        last = None if borrowed else (r, i, text)
                    elif not borrowed:
                        last = (r, i, unpack(p).decode())

        def done(held: list[tuple[int, str, str]]) -> pa.RecordBatch:
            own, edited, following = [], [], []
            for _, text, after in held:
                k = len(text) // 2
                own.append(text.encode())
                edited.append((text[: len(text) - k] + after[:k]).encode())
                following.append(after.encode())
            # a text's successor is nearly always the next text: fingerprint it once
            place = {t: i for i, t in enumerate(dict.fromkeys(own + edited + following))}
            prints = fingerprints(list(place))
            a, b, c = (prints[[place[t] for t in x]] for x in (own, edited, following))
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([h[0] for h in held], pa.int64()), "n_chars": pa.array([len(h[1]) for h in held], pa.int64()), "edited_sha256": [hashlib.sha256(t).hexdigest() for t in edited],
                    "fingerprint": [x.tobytes().hex() for x in a], "edited_fingerprint": [x.tobytes().hex() for x in b], "near_edited": likeness(a, b), "near_next": likeness(a, c),
                    "hi": a[:, :8].copy().view(">i8")[:, 0].astype(np.int64), "lo": a[:, 8:].copy().view(">i8")[:, 0].astype(np.int64),
                }
            )

        held, size = [], 0
        for row in pairs():
            held.append(row)
            size += len(row[1])
            if size >= BATCH_BYTES:
                yield done(held)
                held, size = [], 0
        if held:
            yield done(held)

    dealt = rows.mapInArrow(deal, "range long, borrowed boolean, doc_id long, packed binary")
    # equal ids go by text: the packed bytes of a text are the same everywhere
    return dealt.repartition("range").sortWithinPartitions("range", "borrowed", "doc_id", "packed").mapInArrow(
        edit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, hi long, lo long"
    )


def _blocks(hi: str, lo: str) -> list[str]:
    """The fingerprint's blocks as SQL; the third lies across its halves."""
    return [f"(shiftrightunsigned({hi}, 38) & 67108863)", f"(shiftrightunsigned({hi}, 12) & 67108863)", f"(({hi} & 4095) * 16384 + shiftrightunsigned({lo}, 50))", f"(shiftrightunsigned({lo}, 25) & 33554431)", f"({lo} & 33554431)"]


def _masks(bits: int, flips: int) -> list[int]:
    return [sum(1 << i for i in at) for n in range(flips + 1) for at in combinations(range(bits), n)]


def near_counts(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(hi, lo, n_near) for each query fingerprint: the rows of prints within `radius` bits, found in the block tables.

    Both sides are distinct fingerprints (prints with how many rows have them as n). A pair that meets in several tables
    counts in the first one alone. Radii beyond what two bits in one of five blocks guarantee are refused.
    """
    flips = radius // len(BLOCK_BITS)
    if flips > 2:
        raise ValueError(f"block tables are complete up to a radius of {RADIUS}")
    keys = [F.expr(f"{t} * {1 << 26}L + {b}") for t, b in enumerate(_blocks("hi", "lo"))]
    tables = prints.withColumn("key", F.explode(F.array(*keys))).hint("shuffle_hash")

    def probed(key, bits: int):
        return F.transform(F.lit(_masks(bits, flips)), lambda m: key.bitwiseXOR(m.cast("long")))

    probes = F.flatten(F.array(*map(probed, keys, BLOCK_BITS)))
    asked = queries.select(F.explode(probes).alias("key"), F.col("hi").alias("qhi"), F.col("lo").alias("qlo"))
    apart = [f"bit_count({b}) > {flips}" for b in _blocks("(hi ^ qhi)", "(lo ^ qlo)")]
    first = " ".join(f"when {t} then {' and '.join(apart[:t]) or 'true'}" for t in range(len(apart)))
    close = tables.join(asked, "key").where(f"bit_count(hi ^ qhi) + bit_count(lo ^ qlo) <= {radius} and case shiftright(key, 26) {first} end")
    return close.groupBy("qhi", "qlo").agg(F.sum("n").alias("n_near")).selectExpr("qhi as hi", "qlo as lo", "n_near")


def with_near_counts(found: DataFrame, every: int = 50, radius: int = RADIUS) -> DataFrame:
    """fingerprint_edits's rows with n_near, for ids divisible by `every` the number of rows within `radius`, else null."""
    held = written(found, "fingerprints")
    asks = F.col("doc_id") % every == 0
    counted = near_counts(held.groupBy("hi", "lo").agg(F.count("*").alias("n")), held.where(asks).select("hi", "lo").distinct(), radius)
    asking = held.where(asks).join(counted, ["hi", "lo"], "left")
    return held.where(~asks).withColumn("n_near", F.lit(None).cast("long")).unionByName(asking.select(*held.columns, "n_near")).drop("hi", "lo")
