"""Operator 6, exact substring dedup by longest-previous-factor arrays.

1. Texts are compared as UTF-8 bytes. Of equal texts the first stays in the search; later ones go whole if they are long
   enough to hold a window.
2. Each window of `length` bytes has an anchor, the leftmost of its k-grams with the least hash. Equal windows have
   equal anchors, so windows need to be compared only where anchors meet. Anchors are rows of (hash, document), counted
   with map-side combination; those of one text only are dropped. What is left goes on with the bytes that the anchor's
   windows cover: its context.
3. A task gets all contexts of an anchor. An anchor of more than MANY documents is split: its windows go by their least
   k-gram that is no such anchor, on which equal windows agree too. Contexts that are equal in every byte are told apart
   before, once a shard and once more where they meet.
4. The windows of a task's contexts are put into suffix order with the common prefixes of neighbours. The nearest
   suffixes before and behind that start earlier in the corpus give each window its longest previous factor; windows
   with a factor of `length` bytes are later copies.
5. Windows of later copies become byte spans, merged per document and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from marketloom.llm.common import arrays, as_bytes, in_shards, joined, near, packed, unpacked, written
from marketloom.llm.shingles import mixed

LENGTH, GRAM = 100, 24
SHARD_BYTES = 2 << 20
#: Text with shared anchors for each bucket of contexts.
CONTEXT_BYTES = 6 << 20
#: Bytes that are put into suffix order at a time.
SORT_BYTES = 2 << 20
#: Documents of an anchor from which on its windows are split further.
MANY = 5_000
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k bytes: hashes of runs of 1, 2, 4 .. bytes are put together to k."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, used = np.zeros(n, np.uint64), 0
    run, width = data.astype(np.uint64) + np.uint64(1), 1
    while True:
        step = np.uint64(pow(_BASE, width, 1 << 64))
        if k & width:
            out = out * step + run[used : used + n]
            used += width
        if 2 * width > k:
            return mixed(out)
        run = run[:-width] * step + run[width:]
        width *= 2


def anchors(h: np.ndarray, ends: np.ndarray, length: int, gram: int, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window) of each anchor in texts laid end to end; windows never cross an end.

    h holds the hashes of all k-grams; grams with a hash in `but` are anchors only of windows without any other.
    """
    none = np.zeros(0, np.int64)
    span = length - gram + 1
    n = len(h) - span + 1
    if n <= 0:
        return none, none, none
    high = h >> np.uint64(32)
    if but is not None:
        high = np.where(np.isin(h, but), np.uint64(0xFFFFFFFF), high)
    # hash and place in one number, so that the least is the leftmost of equals
    key = (high << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    # least of each window from the suffix minima of one block and the prefix minima of the next
    full = np.r_[key, np.full(-len(key) % span, ~np.uint64(0))].reshape(-1, span)
    prefix = np.minimum.accumulate(full, axis=1).ravel()
    suffix = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(suffix[:n], prefix[span - 1 : span - 1 + n])
    start = np.arange(n)
    inside = start + length <= np.repeat(ends, np.diff(ends, prepend=0))[:n]
    start = start[inside]
    if not len(start):
        return none, none, none
    place = (least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    return place[first], start[first], start[last]


def suffix_order(flat: np.ndarray, starts: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (by number) in order of their first `length` bytes, those that agree by place, and how many bytes each has
    in common with the one before, at most `length`. Bytes are ranked by prefix doubling."""
    n = len(flat)
    padded = np.r_[flat, np.zeros(8, np.uint8)]
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    width, ranks = 8, []
    while True:
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(n, np.uint32)
        rank[order] = np.cumsum(np.r_[0, s[1:] != s[:-1]]).astype(np.uint32)
        ranks.append((width, rank))
        if width >= length:
            break
        step = min(width, length - width)
        behind = np.r_[rank[step:].astype(np.uint64) + np.uint64(1), np.zeros(step, np.uint64)]
        key = (rank.astype(np.uint64) << np.uint64(32)) | behind
        width += step
    own = rank[starts]
    order = np.lexsort((place, own))
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = np.where(own[order][1:] == own[order][:-1], length, 0)
    apart = np.flatnonzero(lcp[1:] == 0) + 1
    a, b = starts[order[apart - 1]], starts[order[apart]]
    at = np.zeros(len(apart), np.int64)
    for width, rank in [r for r in reversed(ranks) if r[0] & (r[0] - 1) == 0]:
        near = np.minimum(np.maximum(a, b) + at, n - 1) - np.maximum(a, b)
        at += np.where((near == at) & (rank[a + near] == rank[b + near]), width, 0)
    open_ = np.flatnonzero(at < length)
    for _ in range(7):
        open_ = open_[padded[a[open_] + at[open_]] == padded[b[open_] + at[open_]]]
        at[open_] += 1
        open_ = open_[at[open_] < length]
    # what is apart within `length` bytes can't have them all in common
    lcp[apart] = np.minimum(at, length - 1)
    return order, lcp


def longest_previous(place: np.ndarray, lcp: np.ndarray, enough: int = 1) -> np.ndarray:
    """For suffixes in suffix order the longest prefix that each shares with one of smaller place.

    It is shared with the nearest smaller place before or behind. Each suffix steps from its neighbour over all that are
    known to be greater, taking the least common prefix along, until it meets a smaller place; what shares less than
    `enough` isn't followed further, its length is then only an upper bound below `enough`.
    """
    found = np.zeros(len(place), np.int64)
    for back in (False, True):
        p, low = (place[::-1], np.r_[0, lcp[:0:-1]]) if back else (place, lcp.copy())
        near = np.arange(len(p)) - 1
        open_ = np.flatnonzero((near >= 0) & (p[near] > p) & (low >= enough))
        while len(open_):
            c = near[open_]
            low[open_], near[open_] = np.minimum(low[open_], low[c]), near[c]
            open_ = open_[(near[open_] >= 0) & (p[near[open_]] > p[open_]) & (low[open_] >= enough)]
        low[near < 0] = 0
        low = np.where((near >= 0) & (p[near] > p), np.minimum(low, enough - 1), low)
        found = np.maximum(found, low[::-1] if back else low)
    return found


def later_copies(hashes: np.ndarray, doc: np.ndarray, first: np.ndarray, offset: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, from window, to window) of windows that occur earlier; contexts come in order of (doc, first window).

    A context holds the bytes of an anchor's windows, the first of which starts at `first`; contexts with one hash are
    compared.
    """
    lead = leads(hashes, offset, texts)
    copies = np.flatnonzero(lead != np.arange(len(texts)))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = [(copies, np.zeros(len(copies), np.int64), sizes[copies] - length)]
    heads = np.flatnonzero(lead == np.arange(len(texts)))
    heads = heads[np.argsort(hashes[heads], kind="stable")]
    h = hashes[heads]
    same = h[1:] == h[:-1]
    heads = heads[np.r_[same, False] | np.r_[False, same]]  # others have no second reading
    cut = np.flatnonzero(np.r_[True, hashes[heads][1:] != hashes[heads][:-1]]) if len(heads) else heads
    total = np.r_[0, np.cumsum(sizes[heads])]
    at = 0
    while at < len(heads):
        # whole groups, about SORT_BYTES of them; one group may be larger
        to = int(np.searchsorted(total, total[at] + SORT_BYTES))
        k = int(np.searchsorted(cut, to, side="right")) - 1
        to = int(cut[k]) if k >= 0 and cut[k] > at else (int(cut[k + 1]) if k + 1 < len(cut) else len(heads))
        if to <= at or to > len(heads) or (k + 1 >= len(cut) and total[-1] - total[at] <= SORT_BYTES):
            to = len(heads)
        part = np.sort(heads[at:to])  # contexts are numbered in corpus order
        at = to
        flat = np.frombuffer(b"".join(texts[i] for i in part), np.uint8)
        size = sizes[part]
        begin = np.cumsum(size) - size
        windows = size - length + 1
        owner = np.repeat(np.arange(len(part)), windows)
        window = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        # a document's contexts follow each other by first window, but further ones may start before one ends
        place = np.empty(len(owner), np.int64)
        place[np.lexsort((first[part][owner] + window, doc[part][owner]))] = np.arange(len(owner))
        order, lcp = suffix_order(flat, begin[owner] + window, place, length)
        later = np.sort(order[longest_previous(place[order], lcp, length) >= length])
        if len(later):
            o, w = owner[later], window[later]
            new = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (w[1:] != w[:-1] + 1)])
            end = np.r_[new[1:], len(o)] - 1
            out.append((part[o[new]], w[new], w[end]))
    return tuple(np.concatenate(x) for x in zip(*out))


def leads(hashes: np.ndarray, offset: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """For each context the first one with the same hash, place of the anchor and bytes."""
    number: dict[tuple, int] = {}
    return np.fromiter((number.setdefault(k, i) for i, k in enumerate(zip(hashes.tolist(), offset.tolist(), texts))), np.int64, len(texts))


def _scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, n_bytes, key, anchors, again): each text's digest, anchor hashes, and those that it has twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in in_shards(batches, SHARD_BYTES):
            texts = as_bytes(shard.column("text"))
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            ends = np.cumsum(sizes)
            h = gram_hashes(np.frombuffer(b"".join(texts), np.uint8), gram)
            place, _, _ = anchors(h, ends, length, gram)
            doc, h = np.searchsorted(ends, place, side="right"), h[place]
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order].astype(np.int64)
            new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])][: len(h)]
            twice = ~new & np.r_[False, new[:-1]][: len(h)]
            columns = []
            for some in (new, twice):
                cuts = np.r_[0, np.cumsum(np.bincount(doc[some], minlength=len(texts)))].astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(h[some])))
            yield pa.RecordBatch.from_arrays([shard.column("doc_id").combine_chunks(), pa.array(sizes), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), *columns], ["doc_id", "n_bytes", "key", "anchors", "again"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, key binary, anchors array<long>, again array<long>")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, packed): the texts as they are shuffled and kept, with their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = as_bytes(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary()), pa.array(packed(raw), pa.binary())], ["doc_id", "key", "packed"])

    return docs.mapInArrow(run, "doc_id long, key binary, packed binary")


def _shared(scanned: DataFrame, many: int) -> DataFrame:
    """(doc_id, met, split): anchors that another text has too, or the text itself twice; those of more than `many` texts."""
    named = scanned.select(F.xxhash64("key").alias("text"), "doc_id", "anchors", "again")
    both = named.select("text", F.explode("anchors").alias("h"), F.lit(0).alias("t")).unionByName(named.select("text", F.explode("again").alias("h"), F.lit(1).alias("t")))
    facts = both.groupBy("h").agg(F.min("text").alias("a"), F.max("text").alias("z"), F.max("t").alias("t"), F.count("*").alias("k")).where("a <> z or t = 1").select("h", "k")
    total = scanned.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0)).alias("n")).first()["n"]
    met = joined(named.select("doc_id", F.explode("anchors").alias("h")), facts, "h", total)
    return met.groupBy("doc_id").agg(F.collect_list("h").alias("met"), F.collect_list(F.when(F.col("k") > many, F.col("h"))).alias("split"))


CONTEXTS = "bucket int, hashes binary, docs binary, first binary, shift binary, sizes binary, bytes binary"


def _contexts(texts: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """Packed rows, one a bucket and shard, of shared anchors with the bytes that their windows cover.

    Of contexts of a shard that are equal in every byte only the first goes on; the others are told at once, in rows of
    bucket -1 without bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in in_shards(batches, SHARD_BYTES, "n_bytes"):
            ids = np.asarray(shard.column("doc_id")).astype(np.int64)
            shard = shard.take(pa.array(np.argsort(ids, kind="stable")))
            ids.sort()
            texts = unpacked(shard.column("packed").to_pylist())
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            ends = np.cumsum(sizes)
            raw = b"".join(texts)
            h = gram_hashes(np.frombuffer(raw, np.uint8), gram)
            place, first, last = anchors(h, ends, length, gram)
            name = h[place]
            # an anchor that is shared is so in every text that has it
            chosen = np.isin(name, np.concatenate(arrays(shard.column("met").combine_chunks())))
            place, first, last, name = place[chosen], first[chosen], last[chosen], name[chosen]
            split = np.unique(np.concatenate(arrays(shard.column("split").combine_chunks())))
            if len(split):
                # windows of a hot anchor go by their least other gram as well
                other, begin, _ = anchors(h, ends, length, gram, split)
                hot = np.isin(name, split)
                at = begin[np.isin(np.searchsorted(first, begin, side="right") - 1, np.flatnonzero(hot))]
                starts = np.unique(np.r_[first, at])
                run_ = np.searchsorted(first, starts, side="right") - 1
                inside = starts <= last[run_]
                starts, run_ = starts[inside], run_[inside]
                next_ = np.r_[starts[1:], len(h) + 1]
                last = np.minimum(last[run_], next_ - 1)
                place, name, hot, first = place[run_], name[run_], hot[run_], starts
                second = h[other[np.searchsorted(begin, starts, side="right") - 1]]
                name = np.where(hot, mixed(name ^ mixed(second)), name)
            if not len(place):
                continue
            doc = np.searchsorted(ends, place, side="right")
            begin = (ends - sizes)[doc]
            bytes_ = [raw[x:y] for x, y in zip(first.tolist(), (last + length).tolist())]
            lead = leads(name, place - first, bytes_)
            bucket = np.where(lead == np.arange(len(lead)), (mixed(name) % np.uint64(buckets)).astype(np.int64), -1)
            order = np.argsort(bucket, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                b = int(bucket[mine[0]])
                columns = (name[mine].astype("<u8"), ids[doc[mine]], first[mine] - begin[mine], place[mine] - first[mine], last[mine] - first[mine] + length)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("hashes", "docs", "first", "shift", "sizes"), columns)}, "bytes": pa.array([b"" if b < 0 else b"".join(bytes_[i] for i in mine)], pa.binary())})

    return texts.mapInArrow(run, CONTEXTS)


def _spans(contexts: DataFrame, buckets: int, length: int) -> DataFrame:
    """(doc_id, s, e): byte spans of later copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(bucket: int, held: list[tuple]) -> pa.RecordBatch:
            h, doc, first, shift, sizes = (np.concatenate([np.frombuffer(x[i], "<u8" if i == 0 else "<i8") for x in held]) for i in range(5))
            if bucket < 0:
                return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "s": pa.array(first, pa.int64()), "e": pa.array(first + sizes, pa.int64())})
            texts = []
            for x in held:
                ends = np.cumsum(np.frombuffer(x[4], "<i8"))
                texts += [x[5][a:b] for a, b in zip((ends - np.frombuffer(x[4], "<i8")).tolist(), ends.tolist())]
            order = np.lexsort((first, doc))
            c, lo, hi = later_copies(h[order], doc[order], first[order], shift[order], [texts[i] for i in order], length)
            at = order[c]
            d, s, e = doc[at], first[at] + lo, first[at] + hi + length
            sort = np.lexsort((s, d))
            d, s, e = d[sort], s[sort], e[sort]
            return pa.RecordBatch.from_pydict({"doc_id": pa.array(d, pa.int64()), "s": pa.array(s, pa.int64()), "e": pa.array(e, pa.int64())})

        held, last = [], None
        for b in batches:
            for bucket, *row in zip(*(b.column(c).to_pylist() for c in ("bucket", "hashes", "docs", "first", "shift", "sizes", "bytes"))):
                if bucket != last and held:
                    yield work(last, held)
                    held = []
                last = bucket
                held.append(tuple(row))
        if held:
            yield work(last, held)

    spread = F.when(F.col("bucket") < 0, F.xxhash64("docs", "first")).otherwise(F.col("bucket"))
    return contexts.repartition(buckets, spread).sortWithinPartitions("bucket").mapInArrow(run, "doc_id long, s long, e long")


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), one row per row of docs with an id.

    A byte goes if it lies in a string of `length` bytes that also starts earlier, in a document of smaller id or before
    in its own; all strings are judged on the input. Null counts as empty, texts shorter than `length` stay whole. Of
    rows that repeat with the same id and text one is the first; ids must not stand for different texts otherwise. Rows
    without an id are left out, no rows give no rows, and other columns are not read.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scanned = written(_scan(rows, length, gram), "anchors")
    facts = scanned.groupBy("doc_id", "key").agg(F.count("*").alias("m"), F.first("n_bytes").alias("n_bytes"))
    first = facts.groupBy("key").agg(F.min("doc_id").alias("lead"), F.count("*").alias("k"))
    told = joined(facts, first, "key", scanned.count()).withColumn("is_first", F.col("doc_id") == F.col("lead")).drop("lead", "k")
    shared = written(_shared(scanned, MANY), "shared-anchors")
    told = written(told.join(shared.select("doc_id", F.lit(True).alias("shares")), "doc_id", "left"), "texts")
    search = told.where("is_first and shares").select("doc_id", "key", "n_bytes").join(shared, "doc_id")
    texts = _packed(rows).join(search, ["doc_id", "key"])
    # rows that repeat an id with its text are one text
    repeats = told.where("m > 1").select("doc_id").limit(1).count()
    texts = written(texts.dropDuplicates(["doc_id"]) if repeats else texts, "shared-texts")
    found = texts.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()["b"]
    parts = max(6, int(found // CONTEXT_BYTES) + 1)
    spans = _spans(_contexts(texts.select("doc_id", "n_bytes", "packed", "met", "split"), parts, length, gram), parts, length)
    held = written(spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans")), "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s:long,e:long>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {n: [] for n in ("n_removed", "n_spans", "kept_sha256", "spans")}
            for t, spans_ in zip(unpacked(b.column("packed").to_pylist()), b.column("spans").to_pylist()):
                merged: list[list[int]] = []
                for x in spans_:
                    if merged and x["s"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["e"])
                    else:
                        merged.append([x["s"], x["e"]])
                kept = hashlib.sha256()
                at = 0
                for s, e in merged:
                    kept.update(t[at:s])
                    at = e
                kept.update(t[at:])
                out["n_removed"].append(sum(e - s for s, e in merged))
                out["n_spans"].append(len(merged))
                out["kept_sha256"].append(kept.hexdigest())
                out["spans"].append([{"s": s, "e": e} for s, e in merged])
            kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_bytes": b.column("n_bytes"), "n_removed": pa.array(out["n_removed"], pa.int64()), "n_spans": pa.array(out["n_spans"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "spans": pa.array(out["spans"], kind)})

    # only texts that lose something are read again
    searched = near(texts.select("doc_id", "n_bytes", "packed"), held, "doc_id", held.count()).join(held, "doc_id").mapInArrow(cut, schema)
    # copies of a first text, further rows of a first document among them
    extra = told.withColumn("k", F.col("m") - F.col("is_first").cast("int")).where("k > 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))))
    whole = F.col("n_bytes") >= length
    none = F.expr("cast(array() as array<struct<s:long,e:long>>)")
    copies = extra.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.lit(0)).cast("long").alias("n_removed"), whole.cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.lower(F.hex("key"))).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("n_bytes").alias("e")))).otherwise(none).alias("spans"),
    )
    clean = told.where("is_first").join(held.select("doc_id"), "doc_id", "left_anti").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lower(F.hex("key")).alias("kept_sha256"), none.alias("spans"))
    return searched.unionByName(copies).unionByName(clean)


#: All windows of 100 bytes as hexadecimal strings.
SQL = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, k, md5(substr(h, 2 * k + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS k FROM t WHERE len(h) >= 200)),
f AS (SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) > 1 AS again FROM p),
m AS (SELECT doc_id, k, k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS gap FROM f WHERE again),
s AS (SELECT doc_id, k, sum(CASE WHEN gap IS NULL OR gap > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM m),
r AS (SELECT doc_id, run, min(k) AS a, max(k) + 100 AS b FROM s GROUP BY doc_id, run),
q AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS s, list(b ORDER BY a) AS e FROM r GROUP BY doc_id)
SELECT t.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN q.doc_id IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(s) + 1), lambda i: substr(h, 2 * CASE WHEN i = 0 THEN 0 ELSE e[i] END + 1, 2 * (CASE WHEN i = len(s) THEN len(h) // 2 ELSE s[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE e[i] END))), '') END)) AS kept_sha256
FROM t LEFT JOIN q USING (doc_id)
"""
