"""Data-quality guards as tables: what passes, what doesn't and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def split_rows(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): rejected rows name the first rule that they break; a rule that is null is broken."""
    reason = F.lit(None).cast("string")
    for name, rule in reversed(rules.items()):
        reason = F.when(~F.coalesce(rule, F.lit(False)), name).otherwise(reason)
    judged = df.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def collapse(before: DataFrame, after: DataFrame, key: str, floor: int = 10, drop: float = 0.5) -> DataFrame:
    """(key, prev_n, next_n, refused): a group of `floor` rows or more must not lose more than `drop` of them."""
    a, b = (df.groupBy(key).agg(F.count("*").alias(n)) for df, n in ((before, "prev_n"), (after, "next_n")))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("prev_n", F.lit(0)).alias("prev_n"), F.coalesce("next_n", F.lit(0)).alias("next_n"))
    return both.withColumn("refused", (F.col("prev_n") >= floor) & (F.col("next_n") < F.col("prev_n") * (1 - drop)))


def freshness(before: DataFrame, after: DataFrame, key: str, row_id: str) -> DataFrame:
    """(key, ok, reason) by comparing two snapshots: ids must advance and counts must not halve."""
    facts = lambda df, p: df.groupBy(key).agg(F.count("*").alias(f"{p}_n"), F.max(row_id).alias(f"{p}_max"))
    both = facts(before, "pre").join(facts(after, "post"), key, "full_outer")
    reason = (
        F.when(F.coalesce("post_n", F.lit(0)) == 0, "empty")
        .when(F.col("pre_n").isNull(), "new")
        .when(F.col("post_n") * 2 < F.col("pre_n"), "halved")
        .when(F.col("post_max") <= F.col("pre_max"), "not_advanced")
        .otherwise("ok")
    )
    return both.select(key, reason.isin("ok", "new").alias("ok"), reason.alias("reason"))


def floor_of(n: Column, least: int, value: Column) -> Column:
    """A figure that is only told about groups of `least` or more."""
    return F.when(n >= least, value)
