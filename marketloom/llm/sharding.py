"""Operator 12, shards by jump consistent hashing (Lamping and Veach, 2014).

A row's stable key alone, with the number of shards, says where it goes; there is no ring or table of shards. When shards are
appended, a row either stays or goes to a new one, and only the necessary share goes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType

from marketloom.llm.common import indexed, written

SHARDS = 16
#: Fixed values of the published method: the multiplier of its generator.
MULTIPLIER = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key. A key's jumps go to ever higher shards; the last below `shards` counts."""
    if shards < 1:
        raise ValueError("there must be a shard")
    state = keys.astype(np.uint64)
    at, ahead = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    going = np.arange(len(keys))
    while len(going):
        at[going] = ahead[going]
        state[going] = state[going] * np.uint64(MULTIPLIER) + np.uint64(1)
        reach = float(1 << 31) / ((state[going] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[going] = ((at[going] + 1) * reach).astype(np.int64)
        going = going[ahead[going] < shards]
    return at


def stable_key(column: str) -> Column:
    """60 bits of a digest of the value's text; a null has the digest of no text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def shard_of(key: Column, shards: int) -> Column:
    return F.pandas_udf(lambda keys: pd.Series(jump(keys.to_numpy(), shards).astype(np.int32)), IntegerType())(key)


def assign(docs: DataFrame, id_col: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """docs with `shard`, and `grown_shard` with one shard more. A null id has one shard like any other value; rows of one id
    go together. Columns of these names are replaced."""
    rows = docs.drop("shard", "grown_shard", "jump_key").withColumn("jump_key", stable_key(id_col))
    return rows.withColumn("shard", shard_of(F.col("jump_key"), shards)).withColumn("grown_shard", shard_of(F.col("jump_key"), shards + 1)).drop("jump_key")


def moved(docs: DataFrame, before: int, after: int, id_col: str = "doc_id") -> DataFrame:
    """The rows that go elsewhere when shards are appended, with `shard` (before) and `new_shard`: no others need be written."""
    if after < before:
        raise ValueError("shards are appended, not taken away")
    rows = docs.withColumn("shard", shard_of(stable_key(id_col), before)).withColumn("new_shard", shard_of(stable_key(id_col), after))
    return rows.where("shard <> new_shard")


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", shards: int = SHARDS) -> None:
    """Whole rows as Parquet below path/shard=N. A shard is dealt over several tasks by ranges of ids and its files, by name, are
    in order of ids."""
    rows = docs.drop("shard").withColumn("shard", shard_of(stable_key(id_col), shards))
    rows.repartitionByRange("shard", id_col).sortWithinPartitions("shard", id_col).write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of docs. The law is `key`.

    A slot is the row's place in its shard by ascending id, null first, then by CRC and size. A null text has no bytes: size 1
    and the CRC of nothing, like an empty one; very long texts are only measured and never moved; rows with equal texts need
    not share a shard, as the id alone decides, while rows that repeat do, in slots side by side; without documents the result
    is empty. Only doc_id and text are read, whatever other columns docs has.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = indexed(written(assign(rows, "doc_id", shards), "sharded"), ["shard"], ["doc_id", "text_crc32", "size"], "slots")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("place").alias("slot"), "grown_shard")


def _sql() -> str:
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = "SELECT i, i AS c FROM range(256) r(i)"
    for _ in range(8):
        byte = f"SELECT i, {step} AS c FROM ({byte})"
    codes = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM ({byte})),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, CAST(xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM documents, crc),
walk AS (
  SELECT r, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT)::UHUGEINT AS k, 0::BIGINT AS j FROM docs
  UNION ALL
  SELECT r, n, CAST(floor((j + 1) * (2147483648.0::DOUBLE / ((n >> 33)::DOUBLE + 1.0::DOUBLE))) AS BIGINT) FROM (SELECT r, j, (k * {MULTIPLIER}::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS n FROM walk WHERE j <= {SHARDS})),
shards AS (SELECT r, CAST(max(j) FILTER (j < {SHARDS}) AS INT) AS shard, CAST(max(j) FILTER (j <= {SHARDS}) AS INT) AS grown_shard FROM walk GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM docs JOIN shards USING (r)
"""


SQL = _sql()
