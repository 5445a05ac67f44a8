"""Rollups of event logs and facts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marketloom.functions.windows import discrete, same_keys


def provider_rollup(calls: DataFrame, keys: Sequence[str], since: dt.datetime) -> DataFrame:
    """Calls, failures, cost and discrete latency percentiles of each provider since a time."""
    recent = calls.where(F.col("ts") >= F.lit(since))
    counts = recent.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.count_if("ok").alias("ok_n"), F.count_if(~F.col("ok")).alias("failed"), F.round(100.0 * F.count_if(~F.col("ok")) / F.greatest(F.lit(1), F.count("*")), 1).alias("fail_pct"),
        F.sum("credits").alias("credits"),
    )
    latency = discrete(recent, keys, "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95}).withColumnsRenamed({k: f"__{k}" for k in keys})
    return counts.join(latency, same_keys(list(keys), [f"__{k}" for k in keys]), "left").drop(*[f"__{k}" for k in keys])


def worst(calls: DataFrame, key: str, k: int = 8) -> DataFrame:
    """The k keys with most failures; keys without any are left out, ties go by key."""
    return calls.groupBy(key).agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failed")).where("failed > 0").orderBy(F.desc("failed"), key).limit(k)


def period_to_date(facts: DataFrame, at: str, amount: str, as_of: dt.datetime) -> DataFrame:
    """(period, n, amount) for the day, ISO week and month that as_of lies in, up to as_of; empty periods show as zero."""
    now = F.lit(as_of)
    rows = facts.where((F.col(at) >= F.date_trunc("month", now) - F.expr("interval 7 days")) & (F.col(at) <= now))
    inside = lambda p: F.col(at) >= F.date_trunc(p, now)
    one = rows.agg(*[F.count_if(inside(p)).alias(f"n_{p}") for p in ("day", "week", "month")], *[F.coalesce(F.sum(F.when(inside(p), F.col(amount))), F.lit(0)).alias(f"a_{p}") for p in ("day", "week", "month")])
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"n_{p}").alias("n"), F.col(f"a_{p}").alias("amount")) for p in ("day", "week", "month")])).alias("x")).select("x.*")


def pivot_shares(df: DataFrame, key: str, category: str, categories: Sequence[str], amount: str) -> DataFrame:
    """One row a key: an amount for each category, and each one's share of the total to one decimal."""
    wide = df.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col(category) == c, F.col(amount))), F.lit(0)).alias(f"amount_{c.lower()}") for c in categories], F.sum(amount).alias("total"))
    return wide.select("*", *[F.round(100.0 * F.col(f"amount_{c.lower()}").cast("double") / F.nullif(F.col("total").cast("double"), F.lit(0.0)), 1).alias(f"share_{c.lower()}") for c in categories])


def ordered_document(df: DataFrame, key: str, fields: Sequence[Column], order: Sequence[str], name: str = "doc") -> DataFrame:
    """(key, doc): each group's rows as one text, in order; fields must be strings."""
    row = F.struct(*[F.col(o) for o in order], F.concat_ws(":", *fields).alias("__v"))
    return df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["__v"]), "|").alias(name))


def unanimous(df: DataFrame, keys: Sequence[str], value: str, least: int = 2) -> DataFrame:
    """(keys, value, n): groups of `least` rows or more that all agree."""
    return df.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("__top"), F.count("*").alias("n"), F.count(value).alias("__told")).where(F.col(value).eqNullSafe(F.col("__top")) & (F.col("n") >= least) & (F.col("n") == F.col("__told"))).drop("__top", "__told")


def spans(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """(outer, doc): for each inner value its least and greatest value, nested in order of inner."""
    two = df.groupBy(outer, inner).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return ordered_document(two, outer, [F.col(inner).cast("string"), F.concat(F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string"))], [inner], "doc")
