"""Counts in bands out of a curve of percentiles, adding up to the whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Shares are whole numbers of this part, so that remainders are exact and ties are ties.
PARTS = 1_000_000
INFINITE = float("inf")


def pieces(curve: Column) -> Column:
    """The stretches (x, y) between a curve's points; of one point a stretch of no length."""
    return F.when(F.size(curve) == 1, F.transform(curve, lambda x: F.struct(x.alias("x"), x.alias("y")))).otherwise(
        F.zip_with(F.slice(curve, F.lit(1), F.greatest(F.size(curve) - 1, F.lit(0))), F.slice(curve, F.lit(2), F.greatest(F.size(curve) - 1, F.lit(0))), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    )


def share_between(stretches: Column, low: float | None, high: float | None) -> Column:
    """How many PARTS of a distribution lie in [low, high): along a stretch of an ascending curve it is even, and a stretch of no length lies
    at its value. Open ends are null; without a stretch nothing lies anywhere."""
    a, b = F.lit(-INFINITE if low is None else float(low)), F.lit(INFINITE if high is None else float(high))

    def held(s: Column) -> Column:
        x, y = s["x"], s["y"]
        flat = F.when((x >= a) & (x < b), 1.0).otherwise(0.0)
        return F.when(x == y, flat).otherwise(F.greatest(F.lit(0.0), F.least(y, b) - F.greatest(x, a)) / (y - x))

    total = F.aggregate(stretches, F.lit(0.0), lambda t, s: t + F.coalesce(held(s), F.lit(0.0)))
    return F.when(F.size(stretches) > 0, F.floor(total / F.size(stretches) * PARTS + 0.5)).otherwise(0).cast("long")


def apportioned(rows: DataFrame, shares: str, total: str, at: int, name: str) -> DataFrame:
    """rows with array `name`: whole numbers in proportion to the array `shares` that add up to `total`. Each is its quota rounded down, and
    what is left goes one by one to the largest remainders, the first of equal ones. Where all shares are nothing, all goes to place `at`."""
    add = lambda t, q: t + q
    none = F.lit(0).cast("long")
    # step by step, so that no step's expression is spelt out in the next
    rows = rows.withColumn("__whole", F.aggregate(shares, none, add))
    part = lambda s: F.col(total) * s % F.greatest(F.col("__whole"), F.lit(1).cast("long"))
    rows = rows.withColumn("__rest", F.transform(shares, part))
    quota = F.zip_with(shares, "__rest", lambda s, r: ((F.col(total) * s - r) / F.greatest(F.col("__whole"), F.lit(1))).cast("long"))
    rows = rows.withColumn("__quota", quota).withColumn("__left", (F.col(total) - F.aggregate("__quota", none, add)).cast("int"))
    ordered = F.array_sort(F.transform("__rest", lambda r, i: F.struct((-r).alias("r"), i.alias("i"))))
    rows = rows.withColumn("__lucky", F.transform(F.slice(ordered, F.lit(1), F.col("__left")), lambda o: o["i"]))
    shared = F.transform("__quota", lambda q, i: q + F.when(F.array_contains("__lucky", i), 1).otherwise(0))
    alone = F.transform("__quota", lambda q, i: F.when(i == at, F.col(total)).otherwise(0).cast("long"))
    return rows.withColumn(name, F.when(F.col("__whole") > 0, shared).otherwise(alone)).drop("__whole", "__rest", "__quota", "__left", "__lucky")


def with_band_counts(rows: DataFrame, curve: str, total: str, edges: Sequence[float], at: int, name: str = "bands") -> DataFrame:
    """rows with array `name`: counts in the bands below, between and above ascending edges, from an array of percentiles; they add up to
    `total`."""
    ends = [None, *edges, None]
    shares = F.array(*[share_between(F.col("__pieces"), a, b) for a, b in zip(ends[:-1], ends[1:])])
    rows = rows.withColumn("__pieces", pieces(F.col(curve))).withColumn("__shares", shares).drop("__pieces")
    return apportioned(rows, "__shares", total, at, name).drop("__shares")
