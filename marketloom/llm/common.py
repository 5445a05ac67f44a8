"""Helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Upper-case ASCII to lower case, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and a blank for every byte that is neither a digit, a letter nor part of a character beyond ASCII.
LOWER_WORD = bytes(LOWER[b] if 48 <= LOWER[b] <= 57 or 97 <= LOWER[b] <= 122 or b >= 128 else 32 for b in range(256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: joined() broadcasts keys with more than one in HOT_KEYS of all rows, so never more keys than this.
HOT_KEYS = 1000
#: Up to so many rows joined() leaves as they are: all of one key still make a small task, and the plan is a third.
PLAIN_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on one machine a folder of our own where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marketloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: it cuts the lineage and outlives executors.

    The shuffles behind it aren't needed any more. Spark removes their files once the driver has collected what refers to
    them, which a driver with little to do puts off until disks are full; so it is asked to.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def joined(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined to facts, which has one row a key and the number of the key's rows as k.

    All rows of a key would meet in one task. So keys with more than total / HOT_KEYS rows, which can't be more than
    HOT_KEYS, are sent to where their rows are; the rest is joined by key. Of few rows none are.
    """
    if total <= PLAIN_ROWS:
        return rows.join(facts, key)
    most = total // HOT_KEYS
    hot = F.broadcast(facts.where(F.col("k") > most))
    rest = rows.join(hot.select(key), key, "left_anti").join(facts.where(F.col("k") <= most), key)
    return rows.join(hot, key).unionByName(rest)


#: Facts of at most so many rows are broadcast by beside() and indexed(); more go another way.
BROADCAST_ROWS = 20_000


def same(left: DataFrame, right: DataFrame, keys: Iterable[str]) -> Column:
    """Equality of the named columns of both sides, a null being a value like others."""
    return F.lit(True) if not (on := [left[k].eqNullSafe(right[k]) for k in keys]) else on[0] if len(on) == 1 else on[0] & same(left, right, list(keys)[1:])


def indexed(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with `tree`, a number of the row's group that ascends with the group; `place`, from 0 in the group by `order`; and
    `rows`, how many the group has. Nulls come first; rows alike in all these columns get places in any order.

    No group is sorted in one task: rows are dealt out by ranges, counted a range and group, and the counts before a range
    are added to the place within it. df is read twice, as ranges are sampled first: hand in a written table.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    rows = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("range", F.shiftright("at", 33))
    # a row for each range and group: at most as many as there are ranges and groups together
    runs = rows.groupBy("range", *group).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(*(group or [F.lit(1)]))
    before = F.coalesce(F.sum("n").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    facts = written(runs.select("range", *group, "first", before.alias("before"), F.min("first").over(whole).alias("tree"), F.sum("n").over(whole).alias("rows")), f"{name}-ranges")
    side = F.broadcast(facts) if facts.count() <= BROADCAST_ROWS else facts
    both = rows.join(side, same(rows, facts, ["range", *group]))
    return both.select(*[rows[c] for c in df.columns], "tree", (F.col("at") - F.col("first") + F.col("before")).alias("place"), "rows")


#: near() keeps at least so many bits for each key, and at most so many in all (2 MB); more keys only let more rows through.
KEY_BITS, MOST_BITS = 8, 1 << 24


def near(rows: DataFrame, keys: DataFrame, key: str, n: int) -> DataFrame:
    """rows without most of those whose key is none of `keys` (n of them at most); none that has such a key is lost.

    Hashes of the keys are bits, 64 a row, and these rows are broadcast. Put before a join of wide rows with keys that only some
    of them have, so that the others aren't shuffled.
    """
    bits = min(MOST_BITS, 1 << max(12, (KEY_BITS * n - 1).bit_length()))
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    held = keys.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    dealt = rows.withColumn("slot", slot).withColumn("cell", F.expr("slot div 64"))
    return dealt.join(F.broadcast(held), "cell").where("getbit(bits, cast(slot % 64 as int)) = 1").select(*rows.columns)


def beside(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """joined(), where few facts are broadcast as they are. `facts` is a written table."""
    return rows.join(F.broadcast(facts.drop("k")), key) if facts.count() <= BROADCAST_ROWS else joined(rows, facts, key, total).drop("k")


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return pc.fill_null(column, "").cast(pa.large_binary()).to_pylist()


def packed(texts: list[bytes]) -> list[bytes]:
    """Texts as they go through a shuffle."""
    pack = zstandard.ZstdCompressor(level=3).compress
    return [pack(t) for t in texts]


def unpacked(texts: list[bytes]) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(t) for t in texts]


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    """Arrays of hashes as a column of lists of int64."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)))


def arrays(column: pa.Array) -> list[np.ndarray]:
    """The other way round: each list as an array of uint64."""
    flat, ends = np.asarray(column.values).view(np.uint64), np.asarray(column.offsets)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def in_shards(batches: Iterable[pa.RecordBatch], most_bytes: int, column: str = "text") -> Iterator[pa.Table]:
    """Consecutive rows gathered to tables of about most_bytes of text (at least one row); a text is never cut. The column
    holds the texts, or their sizes as numbers."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        held_in = batch.column(column)
        sizes = np.asarray(pc.fill_null(held_in if pa.types.is_integer(held_in.type) else pc.binary_length(held_in), 0))
        start = 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > most_bytes:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, total, start = [], 0, i
            total += n
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def distinct_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of two small non-negative integer arrays, in order."""
    both = np.unique((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64))
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
