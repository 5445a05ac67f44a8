"""Incremental counterparts of the batch rollups: event time, watermarks and keyed state over an event log.

Each function takes a streaming or a batch frame alike where the plan allows it; `drain` runs a stream over what is there
and returns the sink's rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marketloom.session import shared_dir

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
DAY_CAP = 3
HOURS_2ND, HOURS_LATER = 2, 24


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The event files of a folder as a stream, with a zoned event time."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", name).parquet(folder)
    return raw.withColumn("at", F.col("ts").cast("timestamp"))


def event_batch(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).parquet(f"{folder}/{name}").withColumn("at", F.col("ts").cast("timestamp"))


def windowed_rollup(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and failures of each kind per window; rows later than the watermark are dropped by the stream."""
    w = events.withWatermark("at", late).groupBy(F.window("at", length), "event_type")
    return w.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.max("value").alias("top")).select(F.col("window.start").alias("since"), "event_type", "n", "failed", "top")


def daily_use(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Uses per key and day, how many are within the cap, and whether the cap was passed."""
    g = events.withWatermark("at", late).groupBy(F.window("at", "1 day"), "user_id").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("day"), "user_id", "n", F.least("n", F.lit(DAY_CAP)).alias("allowed"), (F.col("n") > DAY_CAP).alias("capped"))


def first_last_seen(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count("*").alias("seen"))


COOLDOWN = "user_id long, attempts long, last_at timestamp, blocked_until timestamp"


def cooldowns(failures: DataFrame) -> DataFrame:
    """Keyed state: the second failure of a user blocks for two hours, each later one for a day."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last, until = state.get if state.exists else (0, 0, 0)
        times = sorted(int(t.value // 1000) for b in batches for t in b["at"])
        for t in times:
            count, last = count + 1, t
            hours = 0 if count < 2 else HOURS_2ND if count == 2 else HOURS_LATER
            until = t + hours * 3_600_000_000 if hours else until
        state.update((count, last, until))
        stamp = lambda us: pd.Timestamp(us, unit="us")
        yield pd.DataFrame({"user_id": [key[0]], "attempts": [count], "last_at": [stamp(last)], "blocked_until": [stamp(until) if until else pd.NaT]})

    return failures.groupBy("user_id").applyInPandasWithState(step, COOLDOWN, "count long, last long, until long", "update", GroupStateTimeout.NoTimeout)


def cooldowns_batch(failures: DataFrame) -> DataFrame:
    """The same end state from a whole log, by ranks."""
    w = Window.partitionBy("user_id").orderBy(F.desc("at"), F.desc("event_id"))
    last = failures.withColumn("k", F.row_number().over(w)).withColumn("attempts", F.count("*").over(Window.partitionBy("user_id"))).where("k = 1")
    hours = F.when(F.col("attempts") == 2, F.expr(f"interval {HOURS_2ND} hours")).when(F.col("attempts") > 2, F.expr(f"interval {HOURS_LATER} hours"))
    return last.select("user_id", "attempts", F.col("at").alias("last_at"), (F.col("at") + hours).alias("blocked_until"))


def attached(events: DataFrame, parents: DataFrame) -> DataFrame:
    """Events with their parent where it is known already; an event whose parent is missing keeps a null."""
    return events.join(parents, events["user_id"] == parents["parent_id"], "left")


def drain(df: DataFrame, mode: str = "append", checkpoint: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is available and return the rows of its sink, a table in the shared folder.

    In append mode these are the rows of all batches, in complete mode those of the last batch; in update mode the last
    row of each of `keys`, or all updates if none are given. Each batch is a folder of its own, so a batch that is run
    again replaces what it wrote. A checkpoint's sink lies beside it, so a later run goes on where the last one ended.
    """
    spark = df.sparkSession
    sink = f"{checkpoint.rstrip('/')}-sink" if checkpoint else f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{sink}/batch_id={batch_id}")

    query = df.writeStream.outputMode(mode).trigger(availableNow=True).foreachBatch(keep).option("checkpointLocation", checkpoint or f"{sink}-checkpoint").start()
    query.awaitTermination()
    try:
        rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch_id", T.LongType())])).parquet(sink)
    except Exception as missing:  # a stream without input has no batch
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], df.schema)
    if mode == "complete":
        last = rows.agg(F.max("batch_id").alias("b")).first()["b"]
        rows = rows.where(F.col("batch_id") == last)
    elif mode == "update" and keys:
        latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), "batch_id").alias("r"))
        return latest.select("r.*")
    return rows.select(*df.columns)


def new_only(batch: DataFrame, known_path: str, keys: list[str], batch_id: int) -> DataFrame:
    """A micro-batch's rows whose keys no earlier batch had (for foreachBatch).

    Each batch is a folder of the known table, so a batch that is run again replaces what it wrote and returns the same.
    """
    spark, own = batch.sparkSession, f"{known_path}/batch_id={batch_id}"
    fresh = batch.dropDuplicates(keys)
    try:
        earlier = spark.read.parquet(known_path).where(F.col("batch_id") != batch_id).select(*keys)
        fresh = fresh.join(earlier, keys, "left_anti")
    except Exception as missing:  # the table starts with the first batch
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    fresh.write.mode("overwrite").parquet(own)
    return spark.read.schema(batch.schema).parquet(own)
