"""Replacing a manufacturer's catalogue by a fresh capture without losing what the capture doesn't know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketloom.operators.guards import split_rows
from marketloom.operators.joins import top_per_group

#: What a capture is often silent about and what is dear to find again.
CARRIED = ("drivetrain", "attrs", "price_basis", "source_url", "fuel_type")
ROW = ("year", "make", "model", "trim", "msrp", *CARRIED)
KEY = ("mk", "year", "model", "tr")


def gated(fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): a published list price is a positive whole number; a fraction shows that it was computed."""
    price = F.col("msrp")
    return split_rows(fresh, {"price": (price > 0) & (price == F.floor(price))})


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select(*ROW, F.lower("make").alias("mk"), F.coalesce("trim", F.lit("")).alias("tr"))


def _order(*first: Column) -> list[Column]:
    return [*first, *[F.col(c).cast("string").asc_nulls_last() for c in ROW]]


def write_verdicts(before: DataFrame, batch: DataFrame, floor: int = 10, drop: float = 0.5) -> DataFrame:
    """(mk, prev_n, next_n, verdict) a make in either: a make of `floor` rows or more is not replaced by a capture that would
    lose more than `drop` of them, and one that nothing was captured of stays as it is."""
    a, b = (df.groupBy("mk").agg(F.count("*").alias(n)) for df, n in ((before, "prev_n"), (batch, "next_n")))
    both = a.join(b, "mk", "full_outer").select("mk", F.coalesce("prev_n", F.lit(0)).alias("prev_n"), F.coalesce("next_n", F.lit(0)).alias("next_n"))
    collapse = (F.col("prev_n") >= floor) & (F.col("next_n") < F.col("prev_n") * (1 - drop))
    return both.withColumn("verdict", F.when(F.col("next_n") == 0, "untouched").when(collapse, "refused").when(F.col("prev_n") == 0, "new").otherwise("replaced"))


def batch_of(fresh: DataFrame, basis: str | None = None) -> DataFrame:
    """What of a capture may be written: through the price gate, stamped with the capture's price basis where a row states none,
    the cheapest row of each key (makes alike in lower case are one, a null trim is an empty one)."""
    stamped = _keyed(gated(fresh)[0]).withColumn("price_basis", F.coalesce("price_basis", F.lit(basis).cast("string")))
    return top_per_group(stamped, KEY, _order(F.col("msrp")))


def catalog_changes(before: DataFrame, fresh: DataFrame, basis: str | None = None, allow_collapse: bool = False, floor: int = 10, drop: float = 0.5) -> DataFrame:
    """Both catalogues' rows with `action` and `carried`: the catalogue to follow is that of the rows kept or written.

    A fresh row takes over what it is silent about (CARRIED) from the row of its key, so that a poorer version never displaces a
    richer one; `carried` counts these values. Rows of a replaced make are `deleted`, but rows with a source_url, which a person
    has verified, are only `superseded` where the capture has their key, or, as a summary without a trim, where it has any trim of
    their model and year. Rows of makes that are refused or not captured are kept, and their fresh rows don't appear.
    """
    old, batch = _keyed(before), batch_of(fresh, basis)
    verdicts = write_verdicts(old, batch, floor, drop)
    goes = F.col("verdict").isin("new", "replaced", *(["refused"] if allow_collapse else []))
    replaced = verdicts.where(goes).select("mk", F.lit(True).alias("goes"))
    batch = batch.join(replaced.drop("goes"), "mk", "left_semi")

    richest = top_per_group(old, KEY, _order(F.col("source_url").isNull()))
    known = richest.select(*KEY, *[F.col(c).alias(f"old_{c}") for c in CARRIED])
    both = batch.join(known, list(KEY), "left")
    took = sum((F.when(F.col(c).isNull() & F.col(f"old_{c}").isNotNull(), 1).otherwise(0) for c in CARRIED), F.lit(0))
    filled = [F.coalesce(F.col(c), F.col(f"old_{c}")).alias(c) if c in CARRIED else F.col(c) for c in ROW]
    written = both.select(*filled, took.alias("carried"), F.lit("written").alias("action"))

    same_key = batch.select(*KEY, F.lit(True).alias("same"))
    same_model = batch.select("mk", "year", "model").distinct().withColumn("again", F.lit(True))
    seen = old.join(replaced, "mk", "left").join(same_key, list(KEY), "left").join(same_model, ["mk", "year", "model"], "left")
    over = F.col("same").isNotNull() | (F.col("trim").isNull() & F.col("again").isNotNull())
    action = (
        F.when(F.col("goes").isNull(), "kept")
        .when(F.col("source_url").isNull(), "deleted")
        .when(over, "superseded")
        .otherwise("kept")
    )
    return written.unionByName(seen.select(*ROW, F.lit(0).alias("carried"), action.alias("action")))


def catalog_after(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("action").isin("kept", "written")).select(*ROW)
