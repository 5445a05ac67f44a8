"""Snapshot maintenance without a merge statement: states are rebuilt by joins, changes come out as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from marketloom.operators.joins import top_per_group


def upsert_snapshot(old: DataFrame, seen: DataFrame, keys: Sequence[str], describe: Sequence[str], overwrite: Sequence[str], day: str) -> DataFrame:
    """The state after a crawl. Descriptive columns keep their old value where the new one is null or empty; prices and
    flags take the new value, null included; what is seen again is live. `is_new` and `moved` tell what happened: a new
    row counts as a price move, rows not seen keep their state."""
    o = old.select(*keys, *[F.col(c).alias(f"o_{c}") for c in [*describe, *overwrite, "first_seen", "last_seen", "delisted_on"]], F.lit(True).alias("was"))
    n = seen.select(*keys, *[F.col(c).alias(f"n_{c}") for c in [*describe, *overwrite]], F.lit(True).alias("now"))
    now, was = F.coalesce("now", F.lit(False)), F.coalesce("was", F.lit(False))
    blank = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    moved = F.lit(False)
    for c in overwrite:
        moved = moved | ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    return o.join(n, list(keys), "full_outer").select(
        *keys, *[F.coalesce(blank(f"n_{c}"), F.col(f"o_{c}")).alias(c) for c in describe], *[F.when(now, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in overwrite],
        F.coalesce("o_first_seen", F.to_date(F.lit(day))).alias("first_seen"), F.when(now, F.to_date(F.lit(day))).otherwise(F.col("o_last_seen")).alias("last_seen"), F.when(~now, F.col("o_delisted_on")).alias("delisted_on"),
        (now & ~was).alias("is_new"), (now & (~was | moved)).alias("moved"),
    )


def mark_delisted(state: DataFrame, seen: DataFrame, group: str, key: str, day: str, least_live: int = 10) -> DataFrame:
    """Live rows that a full crawl didn't see are delisted, unless the crawl saw less than half of what a group had live."""
    live = state.where("delisted_on is null").groupBy(group).agg(F.count("*").alias("__live"))
    saw = seen.groupBy(group).agg(F.count("*").alias("__saw"))
    guard = live.join(saw, group, "left").select(group, ((F.col("__live") > least_live) & (F.coalesce("__saw", F.lit(0)) < F.floor(F.col("__live") / 2))).alias("__skip"))
    hit = seen.select(group, key).distinct().withColumn("__hit", F.lit(True))
    gone = F.col("delisted_on").isNull() & F.col("__hit").isNull() & ~F.coalesce("__skip", F.lit(False))
    return state.join(guard, group, "left").join(hit, [group, key], "left").withColumn("delisted_on", F.when(gone, F.to_date(F.lit(day))).otherwise(F.col("delisted_on"))).drop("__skip", "__hit")


def carry_forward(rows: DataFrame, before: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """rows with nulls in `columns` filled from the row of the same key before; a null in the key is a value like others."""
    old = before.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"o_{c}") for c in columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = rows.join(top_per_group(old, [f"__{k}" for k in keys], [F.col(f"o_{c}") for c in columns]), cond, "left")
    carried = sum((F.when(F.col(c).isNull() & F.col(f"o_{c}").isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))
    return joined.withColumn("carried", carried).select(*[F.coalesce(c, f"o_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns], "carried")


def keyed_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str], replace: bool = True) -> DataFrame:
    """One row a key: the new one if `replace` (on conflict update), else the old one (on conflict do nothing)."""
    both = old.withColumn("__side", F.lit(1 if replace else 0)).unionByName(new.withColumn("__side", F.lit(0 if replace else 1)), allowMissingColumns=True)
    return top_per_group(both, list(keys), [F.col("__side"), *[F.col(c) for c in order]]).drop("__side")


def seen_spans(events: DataFrame, key: str, at: str, before: DataFrame | None = None) -> DataFrame:
    """(key, first_seen, last_seen, seen), merged with an earlier state of the same shape."""
    now = events.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("seen"))
    both = now if before is None else now.unionByName(before)
    return both.groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("seen").alias("seen"))


def column_audit(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, field, old_value, new_value) for every watched column that changed, null-safe."""
    o = old.select(key, *[F.col(c).cast("string").alias(f"o_{c}") for c in columns])
    n = new.select(key, *[F.col(c).cast("string").alias(f"n_{c}") for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"o_{c}").alias("old_value"), F.col(f"n_{c}").alias("new_value")) for c in columns])
    return o.join(n, key).select(key, F.explode(cells).alias("x")).select(key, "x.*").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def new_keys(fresh: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of fresh whose key, in upper case, isn't known."""
    up = [F.upper(F.col(k).cast("string")).alias(f"__{k}") for k in keys]
    return fresh.withColumns({f"__{k}": F.upper(F.col(k).cast("string")) for k in keys}).join(known.select(*up).distinct(), [f"__{k}" for k in keys], "left_anti").drop(*[f"__{k}" for k in keys])
