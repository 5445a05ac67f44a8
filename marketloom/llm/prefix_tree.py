"""Operator 7, n-gram Jaccard join: exact links between sets of word shingles, and their components.

1. Every text's shingles are hashed; those hashes that lie in the lowest quarter of the range, the same ones wherever they
   occur, are rows (hash, document), counted with map-side combination. A linked document lacks at most a known number of
   a document's shingles, so no more of its sample occurs in it alone; this clears nearly all documents.
2. Equal sets become one class. Shingles are ordered by how many classes have them, rarest first, then by hash; classes
   that may be linked meet at a shingle of both their prefixes (the part of a set that any similar set must touch).
3. Classes that meet, directly or in turn, make up a candidate group. A group is cut by set size into bands so that linked
   sets lie in one band or in neighbouring ones, and bands into blocks. Each pair of blocks of these is one piece of work:
   a prefix tree of the one's ordered sets is traversed with each set of the other.
4. Links found join classes to components; copies of a set share its class. No link is missed and none is guessed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marketloom.llm.common import arrays, as_bytes, in_shards, joined, lists, near, written
from marketloom.llm.graph import components
from marketloom.llm.shingles import set_key, shingle_set, word_hashes

SHINGLE, LINK = 4, (85, 100)
SHARD_BYTES = 8 << 20
#: Of the 64-bit hashes those below this bound are sampled.
SAMPLED = np.uint64(1 << 62)
#: Classes in a block of a candidate group.
BLOCK = 256


def least_overlap(n: np.ndarray | int, link: tuple[int, int]):
    """Shingles of a set of n that any linked set must share: ceil(n * num / den)."""
    return -(-n * link[0] // link[1])


class PrefixTree:
    """Ordered sets with their common beginnings stored once; edges hold runs of tokens."""

    def __init__(self, sets: list[np.ndarray]):
        vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.vocabulary = vocabulary
        sizes = np.array([len(s) for s in sets])
        ends = np.cumsum(sizes)
        self.sets = [flat[e - n : e] for e, n in zip(ends, sizes)]
        order = sorted(range(len(sets)), key=lambda i: self.sets[i].astype(">u4").tobytes())
        # nodes: tokens of the edge into it, children, members that end here, least and most set size below
        self.edge: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.children: list[list[int]] = [[]]
        self.members: list[list[int]] = [[]]
        path, before = [(0, 0)], None  # (node, depth at its end)
        for i in order:
            s = self.sets[i]
            if before is None:
                shared = 0
            else:
                k = min(len(s), len(before))
                apart = np.flatnonzero(s[:k] != before[:k])
                shared = int(apart[0]) if len(apart) else k
            last = None
            while path[-1][1] > shared:
                last = path.pop()
            if path[-1][1] < shared:  # the edge into `last` is cut where the two part
                node, _ = last
                cut = shared - path[-1][1]
                upper = self._new(self.edge[node][:cut])
                self.edge[node] = self.edge[node][cut:]
                siblings = self.children[path[-1][0]]
                siblings[siblings.index(node)] = upper
                self.children[upper].append(node)
                path.append((upper, shared))
            if len(s) > shared:
                leaf = self._new(s[shared:])
                self.children[path[-1][0]].append(leaf)
                path.append((leaf, len(s)))
            self.members[path[-1][0]].append(i)
            before = s
        self.least, self.most = np.zeros(len(self.edge), np.int64), np.zeros(len(self.edge), np.int64)
        self._span(0, 0)

    def _new(self, tokens: np.ndarray) -> int:
        self.edge.append(tokens)
        self.children.append([])
        self.members.append([])
        return len(self.edge) - 1

    def _span(self, root: int, depth: int) -> None:
        stack = [(root, depth, False)]
        while stack:
            node, depth, back = stack.pop()
            end = depth + len(self.edge[node])
            if not back:
                stack.append((node, depth, True))
                stack += [(c, end, False) for c in self.children[node]]
            else:
                below = [self.least[c] for c in self.children[node]] + [end] * bool(self.members[node])
                self.least[node] = min(below, default=end)
                self.most[node] = max([self.most[c] for c in self.children[node]] + [end] * bool(self.members[node]), default=end)

    def similar(self, probe: np.ndarray, link: tuple[int, int]) -> Iterator[int]:
        """Members with den * intersection >= num * union, as they are found."""
        num, den = link
        place = np.searchsorted(self.vocabulary, probe)
        known = place[(place < len(self.vocabulary))]
        known = known[self.vocabulary[known] == probe[place < len(self.vocabulary)]]
        mark = np.zeros(len(self.vocabulary) + 1, np.int64)
        mark[known] = 1
        left = np.r_[np.cumsum(mark[::-1])[::-1], 0]  # marked tokens from a place on
        n = len(probe)
        stack = [(0, 0, 0)]
        while stack:
            node, depth, overlap = stack.pop()
            tokens = self.edge[node]
            if len(tokens):
                overlap += int(mark[tokens].sum())
                depth += len(tokens)
            # the largest overlap that a set below can still reach, against what the smallest of them needs
            rest = min(int(self.most[node]) - depth, int(left[tokens[-1] + 1]) if len(tokens) else len(known))
            if (den + num) * (overlap + rest) < num * (n + int(self.least[node])):
                continue
            if den * min(n, int(self.most[node])) < num * n:
                continue
            for m in self.members[node]:
                if den * overlap >= num * (n + depth - overlap):
                    yield m
            stack += [(c, depth, overlap) for c in self.children[node]]


class Joined:
    """Union-find over positions, the least position of a set leading."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _scan(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, key, sample): set size, name and sampled hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in in_shards(batches, SHARD_BYTES):
            sets = [shingle_set(w, size) for w in word_hashes(as_bytes(shard.column("text")))]
            sample = [s[: np.searchsorted(s, SAMPLED)] for s in sets]
            yield pa.RecordBatch.from_arrays([shard.column("doc_id").combine_chunks(), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), lists(sample)], ["doc_id", "n", "key", "sample"])

    return docs.mapInArrow(run, "doc_id long, n long, key binary, sample array<long>")


def _candidates(scanned: DataFrame, link: tuple[int, int]) -> DataFrame:
    """(doc_id, n, key) of documents that may be linked: of their samples enough occurs twice in the corpus.

    A hash that occurs once tells its only document, so those without a second place are counted and nothing is joined."""
    rows = scanned.select("doc_id", F.explode("sample").alias("token"))
    lone = rows.groupBy("token").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("k")).where("k = 1").groupBy("doc_id").agg(F.count("*").alias("lone"))
    # several texts may stand under the id; what the others have may all be alone
    of_id = scanned.groupBy("doc_id").agg(F.sum(F.size("sample")).alias("all"))
    lacks = f"n - (n * {link[0]} + {link[1] - 1}) div {link[1]}"
    both = scanned.where("n > 0").select("doc_id", "n", "key", F.size("sample").alias("own")).join(of_id, "doc_id").join(lone, "doc_id", "left")
    return both.where(f"coalesce(lone, 0) - (all - own) <= {lacks}").select("doc_id", "n", "key")


def _candidate_sets(docs: DataFrame, candidates: DataFrame, size: int, n: int) -> DataFrame:
    """(cls, n, tokens): the distinct sets of the n candidates; cls is the least doc_id that has the set."""
    chosen = candidates.groupBy("key").agg(F.min("doc_id").alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in in_shards(batches, SHARD_BYTES):
            sets = [shingle_set(w, size) for w in word_hashes(as_bytes(shard.column("text")))]
            # several texts may stand under the id
            same = [i for i, (s, key) in enumerate(zip(sets, shard.column("key").to_pylist())) if set_key(s) == key]
            sets = [sets[i] for i in same]
            yield pa.RecordBatch.from_arrays([shard.column("doc_id").combine_chunks().take(pa.array(same, pa.int64())), pa.array([len(s) for s in sets], pa.int64()), lists(sets)], ["cls", "n", "tokens"])

    return near(docs, chosen, "doc_id", n).join(chosen, "doc_id").mapInArrow(run, "cls long, n long, tokens array<long>")


def _heads(sets: DataFrame, link: tuple[int, int]) -> DataFrame:
    """(cls, token): the prefix of each class, shingles in order of how many classes have them, then of hash.

    Shingles of one class come first and can't be met, so they are counted but not returned."""
    rows = sets.select("cls", F.explode("tokens").alias("token"))
    facts = rows.groupBy("token").agg(F.count("*").alias("k")).where("k > 1")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shared = joined(rows, facts, "token", total).groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("k", "token"))).alias("s")).join(sets.select("cls", "n"), "cls")
    length = F.expr(f"cast(greatest(0, n - (n * {link[0]} + {link[1] - 1}) div {link[1]} + 1 - (n - size(s))) as int)")
    return shared.select("cls", F.explode(F.slice("s", F.lit(1), length)).alias("x")).select("cls", "x.token")


def _meetings(heads: DataFrame) -> DataFrame:
    """Edges (a, b) between classes that share a shingle of both prefixes: each class with the least one at the shingle."""
    first = heads.groupBy("token").agg(F.min("cls").alias("a"), F.count("*").alias("k")).where("k > 1")
    return joined(heads, first, "token", heads.count()).where("cls <> a").select("a", F.col("cls").alias("b")).distinct()


def _blocks(classes: DataFrame, groups: DataFrame, block: int, link: tuple[int, int]) -> DataFrame:
    """(grp, i, j, own, cls, tokens): each class once for each pair of blocks that holds its block; a pair lies in one size
    band or in neighbouring ones, as sizes of linked sets differ by less than a band."""
    width = math.log(link[1] / link[0]) * 1.000001
    held = classes.join(groups.select(F.col("id").alias("cls"), F.col("component").alias("grp")), "cls").withColumn("band", F.floor(F.log(F.col("n")) / width).cast("int"))
    count = held.groupBy("grp", "band").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    count = count.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("band", "parts"))).alias("parts"))
    dealt = held.join(count, "grp").withColumn("part", F.pmod(F.xxhash64("cls"), F.element_at("parts", F.col("band"))).cast("int"))

    def name(band, part):
        return band.cast("long") * (1 << 32) + part

    def parts(band):
        n = F.coalesce(F.try_element_at("parts", band), F.lit(0))
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))

    band, part = F.col("band"), F.col("part")
    same = F.transform(parts(band), lambda o: F.struct(name(band, F.least(o, part)).alias("i"), name(band, F.greatest(o, part)).alias("j")))
    above = F.transform(parts(band + 1), lambda o: F.struct(name(band, part).alias("i"), name(band + 1, o).alias("j")))
    below = F.transform(parts(band - 1), lambda o: F.struct(name(band - 1, o).alias("i"), name(band, part).alias("j")))
    return dealt.withColumn("p", F.explode(F.concat(same, above, below))).select("grp", "p.i", "p.j", name(band, part).alias("own"), "cls", "tokens")


def _links(blocks: DataFrame, link: tuple[int, int]) -> DataFrame:
    """(a, b): links that join all classes linked within a pair of blocks, no more of them than classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(i: int, j: int, rows: list[tuple]) -> pa.RecordBatch:
            rows.sort(key=lambda r: r[1])
            sets = [r[2] for r in rows]
            tree_side = [x for x, r in enumerate(rows) if r[0] == j]
            tree = PrefixTree([sets[x] for x in tree_side])
            joined, found = Joined(len(rows)), []
            for x, r in enumerate(rows):
                if r[0] == i:
                    for m in tree.similar(sets[x], link):
                        y = tree_side[m]
                        if y != x and joined.join(x, y):
                            found.append((r[1], rows[y][1]))
            return pa.RecordBatch.from_pydict({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

        held, last = [], None
        for b in batches:
            for g, i, j, own, cls, raw in zip(*(b.column(c).to_pylist() for c in ("grp", "i", "j", "own", "cls")), arrays(b.column("tokens"))):
                if (g, i, j) != last and held:
                    yield work(last[1], last[2], held)
                    held = []
                last = (g, i, j)
                held.append((own, cls, raw))
        if held:
            yield work(last[1], last[2], held)

    return blocks.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(run, "a long, b long")


def join_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, link: tuple[int, int] = LINK, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs with an id.

    Words are lower-cased (A-Z) and parted by ASCII white space; a text of fewer than `size` words is one shingle, a null
    or empty one has none, links with nothing and is its own component. Documents link when
    link[1] * intersection >= link[0] * union; ties and repeated rows link like any equal sets. Rows without an id are
    left out, an empty table gives no rows, and other columns are not read.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scanned = written(_scan(rows, size), "samples")
    candidates = written(_candidates(scanned, link), "candidates")
    many = candidates.count()
    sets = _candidate_sets(rows, candidates, size, many)
    if not candidates.groupBy("doc_id", "key").count().where("count > 1").isEmpty():
        sets = sets.dropDuplicates(["cls", "tokens"])  # rows that repeat an id with its text
    sets = written(sets, "classes")
    groups = components(_meetings(written(_heads(sets, link), "heads")))
    linked = components(_links(_blocks(sets, groups, block, link), link))
    # a class is named by its least doc_id, so a component's least class is its least document
    named = candidates.groupBy("key").agg(F.min("doc_id").alias("cls"), F.count("*").alias("k")).join(linked.select(F.col("id").alias("cls"), F.col("component").alias("far")), "cls", "left")
    named = named.select("key", "k", F.coalesce("far", "cls").alias("component"))
    both = joined(candidates, named, "key", many).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    alone = scanned.join(candidates.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_anti")
    return alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")).unionByName(both)


#: Links by a join on shingle strings, components by a recursive walk.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.reach) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.id = d.doc_id GROUP BY d.doc_id
"""
