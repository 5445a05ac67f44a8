"""Verification of listings: rules as a list, flags as an array, a score that falls with each flag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def flagged(df: DataFrame, rules: Sequence[tuple[str, Column, int]], start: int = 100) -> DataFrame:
    """df with flags (names of rules that hold, in order), score (start less their deductions, 0 at least) and action."""
    flags = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c, _ in rules]), lambda x: x.isNotNull())
    lost = sum((F.when(F.coalesce(c, F.lit(False)), d).otherwise(0) for _, c, d in rules), F.lit(0))
    score = F.greatest(F.lit(start) - lost, F.lit(0))
    action = F.when(score < 30, "reject").when(score < 70, "review").otherwise("accept")
    return df.withColumn("flags", F.array_join(flags, ",")).withColumn("score", score).withColumn("action", action)


def capped_sum(base: float, terms: Sequence[tuple[Column, float]], low: float = 0.0, high: float = 10.0) -> Column:
    """base plus terms, each at most its cap, clamped and to one decimal; a null term adds nothing."""
    total = F.lit(base)
    for value, cap in terms:
        total = total + F.coalesce(F.least(value, F.lit(cap)), F.lit(0.0))
    return F.round(F.greatest(F.lit(low), F.least(F.lit(high), total)), 1)


def repaired(df: DataFrame, rules: Sequence[tuple[str, str, Column, Column]]) -> DataFrame:
    """Invariants in order: (name, column, holds, repair). A broken one is repaired, and later rules see the repair."""
    names = []
    for name, column, holds, repair in rules:
        broken = ~F.coalesce(holds, F.lit(True))
        df = df.withColumn(f"__{name}", broken).withColumn(column, F.when(F.col(f"__{name}"), repair).otherwise(F.col(column)))
        names.append(name)
    found = F.filter(F.array(*[F.when(F.col(f"__{n}"), n) for n in names]), lambda x: x.isNotNull())
    return df.withColumn("repairs", F.array_join(found, ",")).drop(*[f"__{n}" for n in names])


def checkpoints(df: DataFrame, key: str, outcomes: dict[str, Column]) -> DataFrame:
    """(key, checkpoint, outcome), one row for each checkpoint that has an outcome."""
    cells = F.array(*[F.struct(F.lit(n).alias("checkpoint"), c.alias("outcome")) for n, c in outcomes.items()])
    return df.select(key, F.explode(cells).alias("x")).select(key, "x.*").where("outcome is not null")


def consensus(readings: DataFrame, key: str, field: str, value: str, tolerance: float = 1.0) -> DataFrame:
    """(key, field, value, n, kind): sources that agree within a tolerance give `cross`, one alone `structured`, others a
    conflict without a value."""
    g = readings.where(F.col(value).isNotNull()).groupBy(key, field).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    agree = F.col("hi") - F.col("lo") <= tolerance
    kind = F.when(F.col("n") == 1, "structured").when(agree, "cross").otherwise("conflict")
    return g.select(key, field, F.when(agree, F.col("lo")).alias("value"), "n", kind.alias("kind"))
