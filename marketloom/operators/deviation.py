"""Deviation of asking prices from reference prices: one pass, one row, and a floor on how few rows may be told about."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketloom.functions.columns import AT_TOLERANCE_PCT
from marketloom.functions.windows import interpolated

CURVE = [i / 20 for i in range(21)]


def deviation_summary(listings: DataFrame, min_n: int = 25) -> DataFrame:
    """One row from live new listings with both prices; below min_n (25 at least) only that there are too few."""
    floor = max(int(min_n or 25), 25)
    pct = 100.0 * (F.col("sale_price") - F.col("msrp")) / F.col("msrp")
    d = listings.where("delisted_on is null and condition = 'new' and msrp > 0 and sale_price > 0").select("dealer_id", pct.alias("pct"))
    over, under = F.col("pct") > AT_TOLERANCE_PCT, F.col("pct") < -AT_TOLERANCE_PCT
    counts = d.agg(
        F.count("*").alias("n"), F.count_distinct("dealer_id").alias("dealers"), F.count_if(over).alias("over_n"), F.count_if(under).alias("under_n"), F.count_if(~over & ~under).alias("at_n")
    )
    # one row each
    curve = interpolated(d, [], "pct", {f"c{i}": p for i, p in enumerate(CURVE)}).select(F.array(*[f"c{i}" for i in range(len(CURVE))]).alias("c"))
    a = counts.crossJoin(F.broadcast(curve)).crossJoin(F.broadcast(interpolated(d.where(under), [], "pct", {"m": 0.5})))
    enough = F.col("n") >= floor
    told = lambda c: F.when(enough, c)
    return a.select(
        enough.alias("enough"), "n", F.lit(floor).alias("min_n"), told(F.col("dealers")).alias("dealers"),
        told(F.round(F.col("c")[10], 2)).alias("median_pct"), told(F.round(F.col("c")[5], 2)).alias("p25_pct"), told(F.round(F.col("c")[15], 2)).alias("p75_pct"),
        told(F.col("over_n")).alias("over_n"), told(F.col("under_n")).alias("under_n"), told(F.col("at_n")).alias("at_n"),
        told(F.round(100.0 * F.col("over_n") / F.greatest("n", F.lit(1)), 1)).alias("over_share"), told(F.round(100.0 * F.col("under_n") / F.greatest("n", F.lit(1)), 1)).alias("under_share"),
        told(F.round(F.coalesce("m", F.lit(0.0)), 2)).alias("median_discount_pct"), told(F.array_join(F.transform("c", lambda x: F.round(x, 1).cast("string")), "|")).alias("curve"),
    )
