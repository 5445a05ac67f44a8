"""City and province price indices with publication gates. Percentiles here are nearest-rank: observed values."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from marketloom.functions.windows import nearest_ranks

MIN_DEALERS, MIN_LISTINGS, STALE_DAYS, PROVINCE_MIN = 3, 12, 7, 25


def _fresh(newest, as_of: dt.datetime, days: int):
    return F.coalesce(newest >= F.lit(as_of - dt.timedelta(days=days)), F.lit(False))


def city_index(matched: DataFrame, as_of: dt.datetime, *, min_dealers: int = MIN_DEALERS, min_listings: int = MIN_LISTINGS, stale_days: int = STALE_DAYS) -> DataFrame:
    """One row a city from (city, dealer_id, deviation_pct, deviation_dollars, updated_at)."""
    facts = matched.groupBy("city").agg(
        F.count_distinct("dealer_id").alias("n_dealers"), F.count("*").alias("n_listings"), F.avg("deviation_dollars").alias("avg_deviation_dollars"), F.min("updated_at").alias("min_updated_at"), F.max("updated_at").alias("max_updated_at")
    )
    ranks = nearest_ranks(matched, ["city"], "deviation_pct", {"index_pct": 0.5, "p25_pct": 0.25, "p75_pct": 0.75})
    publish = (F.col("n_dealers") >= min_dealers) & (F.col("n_listings") >= min_listings) & _fresh(F.col("max_updated_at"), as_of, stale_days)
    return facts.join(ranks, "city", "left").withColumn("is_publishable", publish)


def province_read(calls: DataFrame, as_of: dt.datetime, *, min_listings: int = PROVINCE_MIN, stale_days: int = STALE_DAYS, key: str = "province") -> DataFrame:
    """One row a province from (province, dealer_id, dir, floor_pct, exact, stated_msrp, infl_floor_pct, updated_at).

    The publication floor counts directional calls alone; counts of the four directions add up to n_matched.
    """
    directional = F.col("dir") != "indeterminate"
    facts = calls.groupBy(key).agg(
        F.count("*").alias("n_matched"), F.count_if(directional).alias("n_directional"), F.count_distinct(F.when(directional, F.col("dealer_id"))).alias("n_dealers"),
        *[F.count_if(F.col("dir") == d).alias(f"{d}_n") for d in ("under", "at", "over", "indeterminate")],
        F.count_if("exact").alias("all_in_n"), F.count_if(F.col("stated_msrp") > 0).alias("sticker_stated_n"), F.count("infl_floor_pct").alias("sticker_inflated_n"),
        F.min("updated_at").alias("min_updated_at"), F.max("updated_at").alias("max_updated_at"),
    )
    # three series of values in one pass: all directional calls, those below, and inflated stickers
    series = F.array(
        F.struct(F.lit("told").alias("series"), F.when(directional, F.col("floor_pct")).alias("v")), F.struct(F.lit("under").alias("series"), F.when(F.col("dir") == "under", F.col("floor_pct")).alias("v")),
        F.struct(F.lit("sticker").alias("series"), F.when(F.col("stated_msrp") > 0, F.col("infl_floor_pct")).alias("v")),
    )
    values = calls.select(key, F.explode(F.filter(series, lambda x: x["v"].isNotNull())).alias("s")).select(key, "s.series", "s.v")
    quarters = {"p25_pct": 0.25, "median_pct": 0.5, "p75_pct": 0.75}
    ranks = nearest_ranks(values, [key, "series"], "v", quarters | {f"c{i:02d}": i / 20 for i in range(21)})
    of = lambda name, column, alias: F.max(F.when(F.col("series") == name, F.col(column))).alias(alias)
    told = ranks.groupBy(key).agg(*[of("told", c, c) for c in [*quarters, *[f"c{i:02d}" for i in range(21)]]], of("under", "median_pct", "median_discount_pct"), of("sticker", "median_pct", "sticker_inflated_median_pct"))
    curve = F.when(F.col("n_directional") >= 2, F.array_join(F.array(*[F.round(f"c{i:02d}", 1).cast("string") for i in range(21)]), "|"))
    publish = (F.col("n_directional") >= min_listings) & _fresh(F.col("max_updated_at"), as_of, stale_days)
    out = facts.join(told, key, "left").withColumn("curve", curve).withColumn("is_publishable", publish)
    for c in ("median_pct", "p25_pct", "p75_pct", "median_discount_pct", "sticker_inflated_median_pct"):
        out = out.withColumn(c, F.round(c, 2))
    return out.drop(*[f"c{i:02d}" for i in range(21)])


def published(read: DataFrame, as_of: dt.datetime, stale_days: int = STALE_DAYS) -> DataFrame:
    """Read side of a stored result: rows that may be shown, with their state."""
    state = F.when(_fresh(F.col("max_updated_at"), as_of, stale_days), "live").otherwise("stale")
    return read.withColumn("state", state).where("is_publishable")
