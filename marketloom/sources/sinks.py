"""Writers that never replace a good table by a bad one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


class Refused(RuntimeError):
    """The new rows don't pass the guard; the old table stays."""


def swap(df: DataFrame, path: str, *, floor: int = 1, most_drop: float = 0.5) -> int:
    """Write beside the table, count, then take its place: fewer rows than `floor`, or a loss of more than `most_drop` of the
    rows there are, leaves everything as it was. The old table is put aside before the new one takes its place and goes last,
    so one of them is there whatever happens in between; where a run was cut off in between, the next one puts the old table back
    and counts against it. Returns the number of rows."""
    spark = df.sparkSession
    fs, old, new = _paths(spark, path)
    aside = old.suffix(".before")
    if fs.exists(aside) and not fs.exists(old) and not fs.rename(aside, old):
        raise OSError(f"{path}.before, left by a run that was cut off, could not be put back")
    df.write.mode("overwrite").parquet(f"{path}.staged")
    n = spark.read.parquet(f"{path}.staged").count()
    before = spark.read.parquet(path).count() if fs.exists(old) else 0
    if n < floor or n < before * (1 - most_drop):
        fs.delete(new, True)
        raise Refused(f"{n} rows would follow {before}")
    if fs.exists(old):
        fs.delete(aside, True)
        if not fs.rename(old, aside):
            raise OSError(f"{path} could not be put aside")
    if not fs.rename(new, old):
        if fs.exists(aside):
            fs.rename(aside, old)
        raise OSError(f"{path}.staged could not take the place of {path}")
    fs.delete(aside, True)
    return n


def _paths(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    old = jvm.org.apache.hadoop.fs.Path(path)
    return old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), old, jvm.org.apache.hadoop.fs.Path(f"{path}.staged")


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls written out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def dry_run(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """What a run would write, as JSON lines below path, a folder a table; returns the numbers of rows. No table is touched."""
    for name, df in tables.items():
        write_json(df, f"{path}/{name}")
    return {name: df.sparkSession.read.text(f"{path}/{name}").count() for name, df in tables.items()}


def fresh_cache(cache: DataFrame, keys: DataFrame, key: str, version: str, as_of, hours: int = 6) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of keys in a result cache: rows of this version that are younger than `hours`."""
    ok = cache.where((F.col("version") == version) & (F.col("created_at") > F.lit(as_of) - F.expr(f"interval {hours} hours")))
    return keys.join(ok, key), keys.join(ok.select(key), key, "left_anti")
