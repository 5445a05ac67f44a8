"""Operator 11, a Merkle manifest of a dataset with proofs by coordinates.

Rows hash to leaves. Within a group, leaves in order form a tree: every `FAN_OUT` consecutive nodes hash to one above, up to
the group's subroot; the subroots, in order of the groups, form the tree of the whole dataset in the same way. All digests
are lower-case hexadecimal SHA-256 and are hashed as that text.

The nodes are a table by (tree, level, place). Which siblings a proof needs follows from a leaf's place and its tree's size,
so they are exploded as coordinates, joined to the node table, put in order, concatenated and folded. The leaves of one run
need the same nodes above it, so the run asks for these once, and its leaves are each other's siblings below.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from marketloom.llm.common import BROADCAST_ROWS, beside, indexed, written

FAN_OUT = 16
UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_digest(*columns: str | Column) -> Column:
    """Digest of the columns' values, each with its length in bytes before it, so that no two rows spell the same text; a null
    is a dash."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return digest(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]))


@dataclass(frozen=True)
class Forest:
    """Trees over places. `runs` holds each run of leaves (tree, run, size, members); `nodes` all digests above the leaves
    (tree, level, place, digest), a row a node; `tops` each tree's last node (tree, size, digest); `per_level` their numbers."""

    runs: DataFrame
    nodes: DataFrame
    tops: DataFrame
    per_level: dict[int, int]


def _depth(levels: int) -> Column:
    """Levels above the leaves of a tree of `size` leaves."""
    return sum((F.when(F.col("size") > FAN_OUT**k, 1).otherwise(0) for k in range(levels)), F.lit(0))


def _spelt(members: Column, field: str) -> Column:
    return F.concat_ws("", F.transform(members, lambda m: m[field]))


def forest(leaves: DataFrame, name: str) -> Forest:
    """The trees over rows (tree, place, size, leaf, other columns, which stay with the leaf)."""
    other = [c for c in leaves.columns if c not in ("tree", "size")]
    run = F.floor(F.col("place") / FAN_OUT).alias("run")
    # at most FAN_OUT rows a group
    members = F.sort_array(F.collect_list(F.struct("place", "leaf", *[c for c in other if c not in ("place", "leaf")]))).alias("members")
    runs = written(leaves.groupBy("tree", run).agg(F.first("size").alias("size"), members), f"{name}-runs")
    largest = runs.agg(F.max("size")).first()[0] or 0
    found = [runs.where("size > 1").select("tree", "size", F.lit(1).alias("level"), F.col("run").alias("place"), digest(_spelt(F.col("members"), "leaf")).alias("digest"))]
    tops = [runs.where("size = 1").select("tree", "size", F.col("members")[0]["leaf"].alias("digest"))]
    level, per_level = 1, {}
    while True:
        found[-1] = written(found[-1], f"{name}-level{level}")
        per_level[level] = found[-1].count()
        tops.append(found[-1].where(F.col("size") <= FAN_OUT**level).select("tree", "size", "digest"))
        if largest <= FAN_OUT**level:
            break
        below = found[-1].where(F.col("size") > FAN_OUT**level)
        kept = F.sort_array(F.collect_list(F.struct("place", "digest")))
        above = below.groupBy("tree", F.floor(F.col("place") / FAN_OUT).alias("up")).agg(F.first("size").alias("size"), digest(_spelt(kept, "digest")).alias("digest"))
        level += 1
        found.append(above.select("tree", "size", F.lit(level).alias("level"), F.col("up").alias("place"), "digest"))
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    first, *rest = tops
    for more in rest:
        first = first.unionByName(more)
    return Forest(runs, nodes.drop("size"), first, per_level)


def _looked_up(asked: DataFrame, trees: Forest) -> DataFrame:
    """The coordinates asked for with their nodes' digests. A node is asked for by all below its siblings, so the upper levels,
    down to where there are too many nodes to broadcast, are broadcast; a node further down has few rows that ask for it."""
    cut, held = max(trees.per_level) + 1, 0
    while cut > 1 and held + trees.per_level[cut - 1] <= BROADCAST_ROWS:
        cut -= 1
        held += trees.per_level[cut]
    key = ["tree", "level", "place"]
    high = asked.where(F.col("level") >= cut).join(F.broadcast(trees.nodes.where(F.col("level") >= cut)), key, "left")
    return high if cut == 1 else high.unionByName(asked.where(F.col("level") < cut).join(trees.nodes.where(F.col("level") < cut), key, "left"))


def upper_paths(trees: Forest) -> DataFrame:
    """(tree, run, upper): a step (left, right) for each level from 1 to below the top, each the siblings' digests in order."""
    levels = max(trees.per_level)
    power = F.element_at(F.array(*[F.lit(FAN_OUT**k).cast("long") for k in range(levels + 2)]), F.col("level") + 1)
    depth = _depth(levels + 1)
    asked = (
        trees.runs.select("tree", "run", "size", depth.alias("depth")).where("depth > 1")
        .select("tree", "run", "size", "depth", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("level"))
        .withColumn("own", F.floor(F.col("run") / F.element_at(F.array(*[F.lit(FAN_OUT**k).cast("long") for k in range(levels + 2)]), F.col("level"))))
        .withColumn("last", F.ceil(F.col("size") / power) - 1)
        .withColumn("from", F.floor(F.col("own") / FAN_OUT) * FAN_OUT)
    )
    places = F.filter(F.sequence(F.col("from"), F.least(F.col("from") + FAN_OUT - 1, F.col("last"))), lambda p: p != F.col("own"))
    asked = asked.select("tree", "run", "depth", "level", "own", F.explode_outer(places).alias("place"))
    # at most FAN_OUT - 1 rows a level of a run
    step = F.struct("level", "place", (F.col("place") < F.col("own")).alias("left"), "digest")
    found = _looked_up(asked, trees).groupBy("tree", "run").agg(F.first("depth").alias("depth"), F.sort_array(F.collect_list(step)).alias("steps"))

    def side(level: Column, left: bool) -> Column:
        return _spelt(F.filter("steps", lambda s: (s["level"] == level) & (s["left"] == F.lit(left))), "digest")

    upper = F.transform(F.sequence(F.lit(1), F.col("depth") - 1), lambda k: F.struct(side(k, True).alias("left"), side(k, False).alias("right")))
    return found.select("tree", "run", upper.alias("upper"))


NO_STEPS = "cast(array() as array<struct<left:string,right:string>>)"


def proofs(trees: Forest, runs: DataFrame | None = None, more: str | None = None) -> DataFrame:
    """A row a leaf: its columns, its tree and `path`, the steps from the leaf to the top of its tree, then those of column
    `more` of `runs`."""
    rows = (trees.runs if runs is None else runs).join(upper_paths(trees), ["tree", "run"], "left")
    upper = F.coalesce(F.col("upper"), F.expr(NO_STEPS))
    upper = F.concat(upper, F.col(more)) if more else upper
    keep = [c for c in rows.columns if c not in ("run", "members", "upper", "size", more)]
    m = rows.select(*keep, "size", upper.alias("upper"), "members", F.explode("members").alias("m"))
    left = _spelt(F.filter("members", lambda x: x["place"] < F.col("m.place")), "leaf").alias("left")
    right = _spelt(F.filter("members", lambda x: x["place"] > F.col("m.place")), "leaf").alias("right")
    path = F.when(F.col("size") > 1, F.concat(F.array(F.struct(left, right)), F.col("upper"))).otherwise(F.col("upper"))
    return m.select(*keep, "m.*", path.alias("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    return F.aggregate(path, leaf, lambda at, s: digest(F.concat(s["left"], at, s["right"])))


def siblings_digest(path: Column) -> Column:
    return digest(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))))


@dataclass(frozen=True)
class Manifest:
    """The groups' trees, the tree of their subroots and the root (null without rows)."""

    groups: Forest
    top: Forest
    root: str | None


def manifest(leaves: DataFrame, group: str, order: Sequence[str]) -> Manifest:
    """The manifest of rows with `leaf`, a digest. A group's leaves ascend by `order`, then by leaf; a null group is one of its
    own, the first; rows that repeat are leaves of their own; other columns stay with their leaf."""
    carried = [c for c in leaves.columns if c not in (group, "tree", "place", "rows")]
    placed = indexed(written(leaves.select(group, *carried), "leaves"), [group], [*order, "leaf"], "placed")
    groups = forest(placed.drop(group).withColumnRenamed("rows", "size"), "groups")
    tops = groups.tops.select(F.col("tree").alias("of"), F.col("size").alias("k"), F.col("digest").alias("leaf"))
    top = forest(indexed(written(tops, "subroots"), [], ["of"], "order").withColumnRenamed("rows", "size"), "top")
    last = top.tops.first()
    return Manifest(groups, top, last["digest"] if last else None)


def prove(made: Manifest) -> DataFrame:
    """A row a leaf: its columns, subroot, root and `path`, all steps from the leaf by its subroot to the root."""
    above = proofs(made.top).select(F.col("of").alias("tree"), "k", F.col("leaf").alias("subroot"), F.col("path").alias("beyond"))
    above = written(above, "above")
    runs = made.groups.runs
    total = above.agg(F.sum("k")).first()[0] or 0
    # runs of a group are at most its leaves, so the bound on hot groups holds for them as well
    rows = proofs(made.groups, beside(runs, above, "tree", total), "beyond")
    return rows.withColumn("root", F.lit(made.root)).drop("tree", "place")


def manifest_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of docs.

    Where 5 divides the CRC of the id, the leaf shown for verification is that of the row with its text's A-Z in lower case,
    so such a row fails exactly if its text holds one of A-Z. Nulls, in any column, are dashes in the leaf; a null id comes
    first in its source and is never tampered with; an empty or very long text is hashed like others; rows that repeat are
    leaves side by side; without documents the result is empty. Only the contract's columns are read.
    """
    fields = ["doc_id", "source", "lang", "n_chars"]
    changed = leaf_digest(*fields, F.translate("text", UPPER, LOWER_CASE))
    leaf = leaf_digest(*fields, "text")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(tampered, changed).otherwise(leaf).alias("shown"))
    shown = prove(manifest(rows, "source", ["doc_id"])).withColumn("folded_root", folded(F.col("shown"), F.col("path")))
    return shown.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_leaf(text: str) -> str:
    one = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"
    return f"sha256({' || '.join(map(one, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _sql_levels(name: str, key: str, levels: int) -> str:
    """Levels of the trees in table `name`0 (key, i, d), and the siblings of each node on the way up; a tree of one node stays."""
    steps = []
    for k in range(levels):
        a, b = f"{name}{k}", f"{name}{k + 1}"
        steps.append(f"""{a}n AS MATERIALIZED (SELECT {key}, i, d, count(*) OVER (PARTITION BY {key}) AS n FROM {a}),
{b} AS MATERIALIZED (SELECT {key}, i // {FAN_OUT} AS i, CASE WHEN max(n) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {a}n GROUP BY {key}, i // {FAN_OUT}),
{a}s AS MATERIALIZED (SELECT x.{key}, x.i, max(x.n) > 1 AS more, coalesce(string_agg(y.d, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS l, coalesce(string_agg(y.d, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS r
  FROM {a}n x JOIN {a}n y ON x.{key} = y.{key} AND x.i // {FAN_OUT} = y.i // {FAN_OUT} GROUP BY x.{key}, x.i)""")
    return ",\n".join(steps)


def _sql() -> str:
    """The SQL twin, for sources of up to 16**6 documents and up to 16**4 sources."""
    low, high = 6, 4
    crc = "list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))"
    step = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    byte = "SELECT i, i AS c FROM range(256) r(i)"
    for _ in range(8):
        byte = f"SELECT i, {step.format('c')} AS c FROM ({byte})"
    joins = "".join(f" JOIN g{k}s ON g{k}s.g = w.g AND g{k}s.i = w.i // {FAN_OUT**k}" for k in range(low)) + "".join(f" JOIN h{k}s ON h{k}s.h = 0 AND h{k}s.i = w.g // {FAN_OUT**k}" for k in range(high))
    names = [f"g{k}s" for k in range(low)] + [f"h{k}s" for k in range(high)]
    path = "list_filter([" + ", ".join(f"{{'m': {n}.more, 'l': {n}.l, 'r': {n}.r}}" for n in names) + "], lambda s: s.m)"
    walk = f"walk AS MATERIALIZED (SELECT w.doc_id, w.leaf, w.shown, w.g, {path} AS path FROM leaves w{joins})"
    return f"""
WITH crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM ({byte})),
shown AS (SELECT doc_id, source, {_sql_leaf('text')} AS leaf, {_sql_leaf(f"translate(text, '{UPPER}', '{LOWER_CASE}')")} AS changed, xor({crc}, 4294967295) % 5 = 0 AS hit FROM documents, crc),
leaves AS MATERIALIZED (SELECT doc_id, leaf, CASE WHEN hit THEN changed ELSE leaf END AS shown, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM shown),
g0 AS (SELECT g, i, leaf AS d FROM leaves),
{_sql_levels('g', 'g', low)},
h0 AS (SELECT 0 AS h, g AS i, d FROM g{low}),
{_sql_levels('h', 'h', high)},
{walk},
folds AS (SELECT *, list_reduce(list_prepend({{'m': true, 'l': shown, 'r': ''}}, path), lambda a, s: {{'m': true, 'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root FROM walk)
SELECT doc_id, leaf, g{low}.d AS subroot, h{high}.d AS root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root, folded_root = h{high}.d AS verified
FROM folds JOIN g{low} USING (g), h{high}
"""


SQL = _sql()
