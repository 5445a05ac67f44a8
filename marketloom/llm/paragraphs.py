"""Operator 2, paragraph dedup by MinHash bands, exact Jaccard and components.

1. Each paragraph (line) of at least MIN_WORDS words gets a name, the hash of its words, and MinHash values of its word
   shingles, cut into bands that are tuned to the wanted recall. Bands are rows (hash, name), counted with map-side
   combination; a paragraph goes on if one of its bands is met by another name. Equal paragraphs need no bands: they share
   a name.
2. Paragraphs that collide, directly or in turn, make up a group, cut into blocks whose pairs are verified by exact
   Jaccard similarity.
3. Links and equal names make components; each keeps its first paragraph in order of (doc_id, place), all others go.
4. Every PASSAGE words in a row are a paragraph too, wherever lines begin and end. These have one band of one value, the
   least hash of all runs of GRAM words among them, so equal ones collide for certain. Those that collide with another
   document's are verified by the hash of all their words, and all but the first document's go."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from marketloom.llm.common import LOWER, arrays, as_bytes, in_shards, joined, lists, packed, unpacked, written
from marketloom.llm.graph import components
from marketloom.llm.prefix_tree import BLOCK, _blocks, _links
from marketloom.llm.shingles import mixed, shingle_set, shingles_of, word_hashes

SHINGLE, LINK = 5, (80, 100)
MIN_WORDS = 25
#: Words that make a repeated passage, and words of the runs that anchors are chosen from.
PASSAGE, GRAM = 51, 20
HASHES, RECALL = 30, 0.999
SHARD_BYTES = 4 << 20
#: Text of the documents that share an anchor, for each bucket of windows.
WINDOW_BYTES = 8 << 20
#: Documents of an anchor from which on its windows are dealt out one by one.
MANY = 5_000
#: As bytes.split() parts words.
WORD = re.compile(rb"[^ \t\n\r\x0b\x0c]+")
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def tuned(hashes: int = HASHES, threshold: float = LINK[0] / LINK[1], recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows): the most rows a band with which a pair at the threshold still collides with probability recall."""
    fits = [(hashes // r, r) for r in range(1, hashes + 1) if 1 - (1 - threshold**r) ** (hashes // r) >= recall]
    return max(fits, key=lambda f: f[1]) if fits else (hashes, 1)


def min_hashes(tokens: list[np.ndarray], hashes: int) -> np.ndarray:
    """`hashes` minima for each non-empty array of shingle hashes."""
    flat = np.concatenate(tokens)
    starts = np.cumsum([0, *map(len, tokens[:-1])])
    out = np.empty((len(tokens), hashes), np.uint64)
    for k in range(hashes):
        salt = mixed(np.array([k + 1], np.uint64))[0]
        out[:, k] = np.minimum.reduceat((flat ^ salt) * np.uint64(0x9E3779B97F4A7C15 | 1) ^ (flat >> np.uint64(29)) * salt, starts)
    return out


def band_hashes(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(minima), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(minima), b + 1, np.uint64)
        for r in range(rows):
            key = mixed(key * np.uint64(0xC2B2AE3D27D4EB4F) + minima[:, b * rows + r])
        out[:, b] = key
    return out


def split(text: bytes, min_words: int) -> list[tuple[int, int, int]]:
    """(place, from word, to word) of the lines that are long enough."""
    out, at = [], 0
    for i, line in enumerate(text.split(b"\n")):
        n = len(line.split())
        if n >= min_words:
            out.append((i, at, at + n))
        at += n
    return out


def name_of(words: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(words.tobytes())


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` words in a row, equal wherever they stand: sums of powers, modulo 2 ** 64."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(words * _powers(_STEP, len(words)), dtype=np.uint64)]
    return mixed((total[size:] - total[:-size]) * _powers(_BACK, len(words) - size + 1))


def window_anchors(words: np.ndarray, passage: int, gram: int) -> np.ndarray:
    """For each `passage` words in a row the least hash of the `gram` words in a row among them."""
    least = run_hashes(words, gram)
    if len(words) < passage:
        return least[:0]
    width, have = passage - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least


def _scan(docs: DataFrame, size: int, min_words: int, bands: int, rows: int, passage: int, gram: int) -> DataFrame:
    """(doc_id, doc_key, lines, n_bytes, places, names, banded, bands, anchors): a document's paragraphs; `bands` hashes for each
    name of `banded` (a name of many paragraphs of a shard is banded once); and the anchors of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in in_shards(batches, SHARD_BYTES):
            raw = as_bytes(shard.column("text"))
            found = [split(t, min_words) for t in raw]
            many = [len(f) for f in found]
            words = word_hashes(raw)
            texts = [w[a:b] for w, f in zip(words, found) for _, a, b in f]
            cuts = np.cumsum([0, *many])
            names = np.fromiter(map(name_of, texts), np.uint64, len(texts))
            keys = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in raw), np.uint64, len(raw))
            lead, banded = np.zeros(0, np.int64), np.zeros((0, bands), np.uint64)
            if texts:
                _, lead = np.unique(names, return_index=True)
                lead.sort()
                banded = band_hashes(min_hashes(shingles_of([texts[i] for i in lead], size), bands * rows), bands, rows)
            at = np.searchsorted(lead, cuts)
            yield pa.RecordBatch.from_arrays(
                [
                    shard.column("doc_id").combine_chunks(), pa.array(keys.astype(np.int64)), pa.array([t.count(b"\n") + 1 if t else 0 for t in raw], pa.int32()), pa.array([len(t) for t in raw], pa.int64()), pa.array([[i for i, _, _ in f] for f in found], pa.list_(pa.int32())), lists([names[a:b] for a, b in zip(cuts, cuts[1:])]), lists([names[lead[a:b]] for a, b in zip(at, at[1:])]), lists([banded[a:b].ravel() for a, b in zip(at, at[1:])]),
                    lists([np.unique(window_anchors(w, passage, gram)) for w in words]),
                ],
                SCANNED,
            )

    SCANNED = ["doc_id", "doc_key", "lines", "n_bytes", "places", "names", "banded", "bands", "anchors"]
    return docs.mapInArrow(run, "doc_id long, doc_key long, lines int, n_bytes long, places array<int>, names array<long>, banded array<long>, bands array<long>, anchors array<long>")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_key, packed, n_bytes): the texts, as they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = as_bytes(b.column("text"))
            keys = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys), pa.array(packed(raw), pa.binary()), pa.array([len(t) for t in raw], pa.int64())], ["doc_id", "doc_key", "packed", "n_bytes"])

    return docs.mapInArrow(run, "doc_id long, doc_key long, packed binary, n_bytes long")


def _colliding(scanned: DataFrame, bands: int) -> DataFrame:
    """(name): paragraphs that meet another name in a band."""
    rows = scanned.select("banded", F.posexplode("bands").alias("at", "band")).select("band", F.expr(f"banded[at div {bands}]").alias("name"))
    facts = rows.groupBy("band").agg(F.min("name").alias("a"), F.max("name").alias("z"), F.count("*").alias("k")).where("a <> z").select("band", "k")
    total = scanned.agg(F.coalesce(F.sum(F.size("bands")), F.lit(0)).alias("n")).first()["n"]
    return joined(rows, facts, "band", total).select("name").distinct()


def _sharing(scanned: DataFrame, many: int) -> DataFrame:
    """(doc_id, doc_key, met, split): the anchors that another document has too, and those of more than `many` documents."""
    # a document is named by its id and text: copies of a text under other ids are other documents
    rows = scanned.select("doc_id", "doc_key", F.explode("anchors").alias("anchor"))
    called = F.xxhash64("doc_id", "doc_key")
    facts = rows.groupBy("anchor").agg(F.min(called).alias("a"), F.max(called).alias("z"), F.count("*").alias("k")).where("a <> z").select("anchor", "k")
    total = scanned.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0)).alias("n")).first()["n"]
    return joined(rows, facts, "anchor", total).groupBy("doc_id", "doc_key").agg(F.collect_set("anchor").alias("met"), F.collect_set(F.when(F.col("k") > many, F.col("anchor"))).alias("split"))


def _met_sets(docs: DataFrame, first: DataFrame, size: int, min_words: int, bands: int, rows_a_band: int) -> DataFrame:
    """(cls, n, tokens, bands): the shingle set and band hashes of each name of `first` (name, p: its first place)."""
    wanted = first.groupBy(F.col("p.doc_id").alias("doc_id"), F.col("p.doc_key").alias("doc_key")).agg(F.collect_list("p.place").alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in in_shards(batches, SHARD_BYTES, "n_bytes"):
            raw = unpacked(shard.column("packed").to_pylist())
            words = []
            for t, w, places in zip(raw, word_hashes(raw), shard.column("wanted").to_pylist()):
                keep = set(places)
                words += [w[a:b] for i, a, b in split(t, min_words) if i in keep]
            keyed = band_hashes(min_hashes(shingles_of(words, size), bands * rows_a_band), bands, rows_a_band)
            sets = [shingle_set(w, size) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(map(name_of, words), np.uint64, len(words)).astype(np.int64)), pa.array([len(s) for s in sets], pa.int64()), lists(sets), lists(list(keyed))], ["cls", "n", "tokens", "bands"])

    return _packed(docs).join(wanted, ["doc_id", "doc_key"]).mapInArrow(run, "cls long, n long, tokens array<long>, bands array<long>").dropDuplicates(["cls"])


WINDOWS = "to int, bucket int, doc_id binary, doc_key binary, starts binary, sizes binary, hashes binary, sources binary"


def _unlike(a: np.ndarray) -> np.ndarray:
    return np.r_[True, a[1:] != a[:-1]]


def _told(doc: np.ndarray, start: np.ndarray, source: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> dict[str, list]:
    """A row a document: where its repeated windows start and the documents that had them first."""
    order = np.lexsort((start, doc))
    doc, start, source = doc[order], start[order], source[order]
    at = np.flatnonzero(_unlike(doc)) if len(doc) else np.zeros(0, np.int64)
    cut = list(zip(at.tolist(), np.r_[at[1:], len(doc)].tolist()))
    lead = doc[at]
    return {"doc_id": ids[lead].tolist(), "doc_key": keys[lead].tolist(), "starts": [start[a:b].astype("<i4").tobytes() for a, b in cut], "sources": [np.unique(source[a:b]).astype("<i8").tobytes() for a, b in cut]}


def _windows(texts: DataFrame, buckets: int, passage: int, gram: int) -> DataFrame:
    """A shard's windows for each bucket of their anchors, those of a kind of its first document alone; those that a document of the
    shard repeats from an earlier one are told at once (bucket -1), so a passage that is everywhere goes once a shard.
    """
    columns = [x.split()[0] for x in WINDOWS.split(", ")]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in in_shards(batches, SHARD_BYTES, "n_bytes"):
            ids, keys = (np.asarray(shard.column(c)).astype(np.int64) for c in ("doc_id", "doc_key"))
            order = np.lexsort((keys, ids))
            order = order[_unlike(ids[order]) | _unlike(keys[order])]
            ids, keys = ids[order], keys[order]
            shard = shard.take(pa.array(order))
            words = word_hashes(unpacked(shard.column("packed").to_pylist()))
            hashes = [run_hashes(w, passage) for w in words]
            many = np.array([len(h) for h in hashes])
            met, many_of = (shard.column(c).to_pylist() for c in ("met", "split"))
            doc, start = np.repeat(np.arange(len(ids)), many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            anchor = [window_anchors(w, passage, gram) for w in words]
            keep = np.concatenate([np.isin(a, np.array(m, np.int64).astype(np.uint64)) for a, m in zip(anchor, met)])
            doc, start, anchor, hashes = doc[keep], start[keep], np.concatenate(anchor)[keep], np.concatenate(hashes)[keep]
            if not len(hashes):
                continue
            hot = np.isin(anchor, np.array([x for s in many_of for x in s], np.int64).astype(np.uint64))
            # documents are in order, so the first window of a kind is the earliest document's
            _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
            source = doc[first][kind]
            later = source != doc
            told = _told(doc[later], start[later], ids[source[later]], ids, keys)
            n = len(told["doc_id"])
            rows = {"to": (np.arange(n) % buckets).tolist(), "bucket": [-1] * n, "sizes": [None] * n, "hashes": [None] * n} | told
            for c in ("doc_id", "doc_key"):
                rows[c] = [np.array([x], "<i8").tobytes() for x in rows[c]]
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in zip(columns, kinds)], columns)
            doc, start, anchor, hashes, hot = doc[~later], start[~later], anchor[~later], hashes[~later], hot[~later]
            # stretches of windows of one document and anchor; windows of a hot anchor go one by one, by their own hash
            cut = np.flatnonzero(_unlike(doc) | _unlike(anchor) | np.r_[True, start[1:] != start[:-1] + 1] | hot)
            sizes = np.diff(np.r_[cut, len(doc)])
            bucket = (np.where(hot[cut], hashes[cut], anchor[cut]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            wide = np.split(np.argsort(np.repeat(bucket, sizes), kind="stable"), np.cumsum(np.bincount(bucket, sizes).astype(np.int64)[np.unique(bucket)])[:-1])
            out = []
            for mine, all_ in zip(np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1), wide):
                b, at = int(bucket[mine[0]]), cut[mine]
                out.append((b, b, ids[doc[at]].astype("<i8").tobytes(), keys[doc[at]].astype("<i8").tobytes(), start[at].astype("<i4").tobytes(), sizes[mine].astype("<i4").tobytes(), hashes[all_].astype("<u8").tobytes(), None))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], columns)

    return texts.mapInArrow(run, WINDOWS)


def _passages(windows: DataFrame, buckets: int, passage: int) -> DataFrame:
    """(doc_id, doc_key, passages, passages_of): the words, as bounds of stretches, that an earlier document has."""
    columns = ["doc_id", "doc_key", "starts", "sources"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(held: list[tuple]) -> pa.RecordBatch:
            ids, keys, start, sizes, hashes = (np.concatenate([np.frombuffer(x[i], t) for x in held]) for i, t in enumerate(("<i8", "<i8", "<i4", "<i4", "<u8")))
            order = np.lexsort((keys, ids))
            fresh = _unlike(ids[order]) | _unlike(keys[order])
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.cumsum(fresh) - 1
            ids, keys = ids[order][fresh], keys[order][fresh]
            doc = np.repeat(rank, sizes)
            start = np.repeat(start, sizes) + np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order = np.argsort(hashes)
            at = np.flatnonzero(_unlike(hashes[order]))
            source = np.empty(len(doc), np.int64)
            source[order] = np.repeat(np.minimum.reduceat(doc[order], at), np.diff(np.r_[at, len(doc)]))
            later = source != doc
            told = _told(doc[later], start[later], ids[source[later]], ids, keys)
            return pa.RecordBatch.from_arrays([pa.array(told[c], t) for c, t in zip(columns, kinds)], columns)

        held, last = [], None
        for b in batches:
            own = b.filter(pc.equal(b.column("bucket"), -1))
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([*(pa.array([int(np.frombuffer(x, "<i8")[0]) for x in own.column(c).to_pylist()], pa.int64()) for c in columns[:2]), own.column("starts"), own.column("sources")], columns)
            rest = b.filter(pc.not_equal(b.column("bucket"), -1))
            for bucket, *row in zip(*(rest.column(c).to_pylist() for c in ("bucket", "doc_id", "doc_key", "starts", "sizes", "hashes"))):
                if bucket != last and held:
                    yield judged(held)
                    held = []
                last = bucket
                held.append(tuple(row))
        if held:
            yield judged(held)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bounds, sources = [], []
            for starts, of in zip(b.column("starts").to_pylist(), b.column("sources").to_pylist()):
                at = np.unique(np.frombuffer(b"".join(starts), "<i4"))
                cut = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + passage])
                bounds.append(np.stack([at[cut], np.r_[at[cut[1:] - 1], at[-1]] + passage], axis=1).ravel().tolist())
                sources.append(np.unique(np.frombuffer(b"".join(of), "<i8")).tolist())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "doc_key": b.column("doc_key"), "passages": pa.array(bounds, pa.list_(pa.int32())), "passages_of": pa.array(sources, pa.list_(pa.int64()))})

    told = windows.repartition(buckets, "to").sortWithinPartitions("bucket").mapInArrow(run, "doc_id long, doc_key long, starts binary, sources binary")
    return told.groupBy("doc_id", "doc_key").agg(F.collect_list("starts").alias("starts"), F.collect_list("sources").alias("sources")).mapInArrow(joined, "doc_id long, doc_key long, passages array<int>, passages_of array<long>")


def cut_text(text: str, removed: set[int], passages: list[int]) -> tuple[str, int]:
    """The text without lines and passages, and how many words are gone. A line with nothing left goes as a whole."""
    last = max(passages, default=0)
    gone = bytearray(last)
    for a, b in zip(passages[::2], passages[1::2]):
        gone[a:b] = b"\1" * (b - a)
    out, at, n = [], 0, 0
    for i, line in enumerate(text.encode().split(b"\n")):
        spans = [m.span() for m in WORD.finditer(line)]
        hit = [k for k in range(len(spans)) if at + k < last and gone[at + k]]
        at += len(spans)
        if i in removed:
            n += len(spans)
            continue
        if hit:
            n += len(hit)
            parts, done = [], 0
            for k in hit:
                parts.append(line[done : spans[k][0]])
                done = spans[k + 1][0] if k + 1 < len(spans) else len(line)
            line = b"".join([*parts, line[done:]])
            if not line.strip():
                continue
        out.append(line)
    return b"\n".join(out).decode(), n


def removals(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, link: tuple[int, int] = LINK, min_words: int = MIN_WORDS, hashes: int = HASHES, recall: float = RECALL, block: int = BLOCK,
    passage: int = PASSAGE, gram: int = GRAM,
) -> DataFrame:
    """(doc_id, doc_key, n_lines, n_paragraphs, removed, passages, copies_of), one row a distinct (id, text).

    `removed` holds the line numbers (from 0) that repeat a paragraph of an earlier (doc_id, line), `passages` the bounds
    (from, to) of all stretches of words in whose every place stand `passage` words in a row that an earlier document's
    text has, wherever lines begin or end; `copies_of` the documents with the kept ones. Lines of fewer than min_words
    words are no paragraphs; null and empty texts have no lines; rows that repeat an id with its text are one document; a
    missing id leaves a row out.
    """
    bands, rows_a_band = tuned(hashes, link[0] / link[1], recall)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scanned = written(_scan(texts, size, min_words, bands, rows_a_band, passage, gram), "signatures")
    rows = scanned.select("doc_id", "doc_key", F.explode(F.arrays_zip("places", "names")).alias("p")).select("doc_id", "doc_key", F.col("p.places").alias("place"), F.col("p.names").alias("name"))
    rows = written(rows.dropDuplicates(["doc_id", "doc_key", "place"]), "paragraphs")
    sharing = written(_sharing(scanned, MANY), "shared-anchors")
    volume = scanned.select("doc_id", "doc_key", "n_bytes").join(sharing, ["doc_id", "doc_key"], "left_semi").agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()["b"]
    windows = max(8, int(volume // WINDOW_BYTES) + 1)
    repeated = written(_passages(_windows(_packed(texts).join(sharing, ["doc_id", "doc_key"]), windows, passage, gram), windows, passage), "passages")
    # the same paragraph may lie in a third of all documents; its first place stands for all
    names = written(rows.groupBy("name").agg(F.min(F.struct("doc_id", "doc_key", "place")).alias("p"), F.count("*").alias("k")), "names")
    met = written(_met_sets(texts, names.join(_colliding(scanned, bands), "name", "left_semi"), size, min_words, bands, rows_a_band), "colliding")
    keyed = met.select("cls", F.explode("bands").alias("band"))
    first = keyed.groupBy("band").agg(F.min("cls").alias("a"), F.max("cls").alias("z"), F.count("*").alias("k")).where("a <> z")
    groups = components(joined(keyed, first, "band", bands * met.count()).where("cls <> a").select("a", F.col("cls").alias("b")).distinct())
    linked = components(_links(_blocks(met.select("cls", "n", "tokens"), groups, block, link), link))
    held = names.join(linked.select(F.col("id").alias("name"), F.col("component").alias("far")), "name", "left").withColumn("component", F.coalesce("far", "name")).drop("far").withColumnRenamed("k", "uses")
    keeper = held.groupBy("component").agg(F.min("p").alias("keep"), F.sum("uses").alias("all"), F.count("*").alias("k")).where("all > 1").drop("all")
    fate = written(joined(held, keeper, "component", names.count()).select("name", F.col("uses").alias("k"), "keep"), "fates")
    gone = joined(rows, fate, "name", rows.count()).where(F.struct("doc_id", "doc_key", "place") != F.col("keep"))
    by_doc = gone.groupBy("doc_id", "doc_key").agg(F.array_sort(F.collect_list("place")).alias("removed"), F.collect_set("keep.doc_id").alias("lines_of"))
    facts = scanned.select("doc_id", "doc_key", F.col("lines").alias("n_lines"), F.size("places").cast("long").alias("n_paragraphs")).distinct()
    none, nobody = F.expr("cast(array() as array<int>)"), F.expr("cast(array() as array<long>)")
    found = facts.join(by_doc, ["doc_id", "doc_key"], "left").join(repeated, ["doc_id", "doc_key"], "left")
    copies = F.array_sort(F.array_union(F.coalesce("lines_of", nobody), F.coalesce("passages_of", nobody))).alias("copies_of")
    return found.select("doc_id", "doc_key", "n_lines", "n_paragraphs", F.coalesce("removed", none).alias("removed"), F.coalesce("passages", none).alias("passages"), copies)


def dedup_paragraphs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of docs with repeated paragraphs and passages cut out of the text column, and n_lines, n_paragraphs, removed,
    passages and copies_of of removals() and the number of words cut out, removed_words, added or replaced. A text without removals stays as it is, null too; rows without an id
    stay untouched, with no lines. Rows that repeat an id with its text come out alike, as one document would.
    """
    added = ["n_lines", "n_paragraphs", "removed", "passages", "removed_words", "copies_of"]
    base = docs.select(*[c for c in docs.columns if c not in added])
    found = removals(docs, id_col=id_col, text_col=text_col, **options).withColumnsRenamed({"doc_id": "__id", "doc_key": "__key"})
    # several texts under one id are told apart by their keys below
    by_id = found.groupBy("__id").agg(F.collect_list(F.struct("__key", *[c for c in added if c != "removed_words"])).alias("__found"))
    schema = T.StructType([*base.schema.fields, *T.StructType.fromDDL("n_lines int, n_paragraphs long, removed array<int>, passages array<int>, removed_words long, copies_of array<long>").fields])

    names = base.columns
    pack_kind = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == text_col else f for f in base.schema.fields])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = packed(as_bytes(b.column(text_col)))
            texts = pa.array([t if ok else None for t, ok in zip(some, b.column(text_col).is_valid().to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([texts if c == text_col else b.column(c) for c in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {c: [] for c in added}
            texts = []
            for raw, found in zip(b.column(text_col).to_pylist(), b.column("__found").to_pylist()):
                text = unpacked([raw])[0].decode() if raw is not None else None
                key = np.uint64(xxhash.xxh3_64_intdigest((text or "").encode())).astype(np.int64)
                own = next((f for f in found or () if f["__key"] == key), {"n_lines": 0, "n_paragraphs": 0, "removed": [], "passages": [], "copies_of": []})
                left, n = cut_text(text, set(own["removed"]), own["passages"]) if own["removed"] or own["passages"] else (text, 0)
                texts.append(left)
                for c in added:
                    out[c].append(n if c == "removed_words" else own[c])
            arrays = [pa.array(texts, pa.string()) if c == text_col else b.column(c) for c in names]
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(out[c], t) for c, t in zip(added, kinds))], [*names, *added])

    short = base.mapInArrow(pack, pack_kind)
    return short.join(by_id, short[id_col].cast("long") == by_id["__id"], "left").drop("__id").mapInArrow(run, schema)


def digests(deduped: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_paragraphs, n_removed, n_passages, removed_words, n_chars, kept_sha256, copies_of)."""
    text = F.coalesce("text", F.lit(""))
    return deduped.select("doc_id", "n_lines", "n_paragraphs", F.size("removed").cast("long").alias("n_removed"), F.expr("size(passages) div 2").alias("n_passages"), "removed_words", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("kept_sha256"), "copies_of")


