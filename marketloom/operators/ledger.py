"""Ledgers of signed entries; money is decimal and shares add up to the cent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def balances(entries: DataFrame, key: str, delta: str, holds: DataFrame | None = None) -> DataFrame:
    """(key, balance): the sum of signed entries less holds that are active."""
    total = entries.groupBy(key).agg(F.sum(delta).alias("balance"))
    if holds is None:
        return total
    held = holds.groupBy(key).agg(F.sum("amount").alias("held"))
    return total.join(held, key, "left").select(key, (F.col("balance") - F.coalesce("held", F.lit(0))).alias("balance"))


def unsettled(entries: DataFrame, keys: Sequence[str], amount: str, tolerance: str = "0.005") -> DataFrame:
    """Groups whose entries don't cancel out."""
    return entries.groupBy(*keys).agg(F.sum(amount).alias("residual")).where(F.abs("residual") > F.lit(tolerance).cast("decimal(10,5)"))


def allocate(amounts: DataFrame, shares: DataFrame, amount_id: str, amount: str, whole: int = 10_000) -> DataFrame:
    """(amount_id, name, share): each amount over holders (name, bps) in cents; the rounding residual goes to the largest
    share, by name on a tie. Holders are a parameter list."""
    rows = amounts.crossJoin(F.broadcast(shares)).withColumn("part", F.round(F.col(amount) * F.col("bps") / whole, 2).cast("decimal(18,2)"))
    each = Window.partitionBy(amount_id)
    first = Window.partitionBy(amount_id).orderBy(F.desc("bps"), "name")
    rows = rows.withColumn("residual", F.col(amount) - F.sum("part").over(each)).withColumn("rn", F.row_number().over(first))
    return rows.select(amount_id, "name", (F.col("part") + F.when(F.col("rn") == 1, F.col("residual")).otherwise(F.lit(0))).cast("decimal(18,2)").alias("share"))


def accrue(lines: DataFrame, holders: DataFrame, charged: DataFrame, fx: DataFrame) -> DataFrame:
    """Charges (line_id, name, amount) of each cost line by share, in home currency, that aren't in `charged` yet."""
    due = lines.join(F.broadcast(fx), "currency").crossJoin(F.broadcast(holders))
    amount = F.round(F.col("cost") * F.col("rate") * F.col("bps") / 10_000, 2).cast("decimal(18,2)")
    return due.select("line_id", "name", amount.alias("amount")).join(charged.select("line_id", "name").distinct(), ["line_id", "name"], "left_anti")


def true_up(should: DataFrame, charged: DataFrame, keys: Sequence[str], least: str = "0.01") -> DataFrame:
    """Adjustments (keys, adjustment) that bring what was charged to what it should be; below a cent nothing moves."""
    a = should.groupBy(*keys).agg(F.sum("amount").alias("should"))
    b = charged.groupBy(*keys).agg(F.sum("amount").alias("charged"))
    gap = F.coalesce("should", F.lit(0)) - F.coalesce("charged", F.lit(0))
    return a.join(b, list(keys), "full_outer").select(*keys, gap.cast("decimal(18,2)").alias("adjustment")).where(F.abs("adjustment") >= F.lit(least).cast("decimal(18,2)"))
