"""What may happen between two versions of a table: ledgers that are only added to, sealed rows, statuses with allowed steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A statement's statuses, where it starts, the steps it may take, and how long it may wait.
FIRST_STATUS = "pending_approval"
STEPS = {"pending_approval": ("approved", "cancelled", "expired"), "approved": ("sent", "cancelled")}
WAITS_DAYS = 20


def _sides(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Both versions of each key beside each other; `was` and `now` tell which there is."""
    a = before.select(key, *[F.col(c).alias(f"o_{c}") for c in columns], F.lit(True).alias("was"))
    b = after.select(key, *[F.col(c).alias(f"n_{c}") for c in columns], F.lit(True).alias("now"))
    return a.join(b, key, "full_outer")


def _changed(columns: Sequence[str]) -> Column:
    """The columns that differ, a null being a value like others."""
    return F.array_compact(F.array(*[F.when(~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), F.lit(c)) for c in columns]))


def _named(rows: DataFrame, key: str, *reasons: tuple[str, Column]) -> DataFrame:
    """(key, violation), a row for each reason that holds."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(name)) for name, when in reasons]))
    return rows.select(key, F.explode(found).alias("violation"))


def ledger_violations(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str], once: Sequence[str] = (), once_where: Column | None = None) -> DataFrame:
    """(key, violation) of a ledger that is only added to: `deleted`, `edited: columns`, and `charged twice` for all but the first row, by
    key, of those that share `once` among rows where `once_where` holds (nulls in `once` are no values and repeat freely)."""
    both = _sides(before, after, key, columns)
    edits = _changed(columns)
    kept = F.col("was").isNotNull() & F.col("now").isNotNull()
    edited = both.where(kept & (F.size(edits) > 0)).select(key, F.concat(F.lit("edited: "), F.array_join(edits, ", ")).alias("violation"))
    out = _named(both, key, ("deleted", F.col("now").isNull())).unionByName(edited)
    if once:
        some = after.where(once_where if once_where is not None else F.lit(True)).dropna(subset=list(once))
        place = F.row_number().over(Window.partitionBy(*once).orderBy(key))
        out = out.unionByName(some.withColumn("__place", place).where("__place > 1").select(key, F.lit("charged twice").alias("violation")))
    return out


def sealed_violations(before: DataFrame, after: DataFrame, key: str, seal: str, columns: Sequence[str]) -> DataFrame:
    """(key, violation) of rows that `seal`, a time, freezes once: `sealed row deleted`, `unsealed`, `sealed again`, `sealed row changed:
    columns`. A row may change in the very version that seals it."""
    both = _sides(before, after, key, [seal, *columns]).where(F.col(f"o_{seal}").isNotNull())
    o, n, gone = F.col(f"o_{seal}"), F.col(f"n_{seal}"), F.col("now").isNull()
    edits = _changed(columns)
    out = _named(both, key, ("sealed row deleted", gone), ("unsealed", ~gone & n.isNull()), ("sealed again", n != o))
    changed = both.where(~gone & (F.size(edits) > 0)).select(key, F.concat(F.lit("sealed row changed: "), F.array_join(edits, ", ")).alias("violation"))
    return out.unionByName(changed)


def status_violations(
    before: DataFrame, after: DataFrame, key: str, frozen: Sequence[str], as_of: Column, steps: Mapping[str, Sequence[str]] = STEPS, first: str = FIRST_STATUS, days: int = WAITS_DAYS
) -> DataFrame:
    """(key, violation) of rows (key, status, created_at, frozen columns) that go from status to status.

    `illegal step: a -> b`; `deleted`; `starts as s` for a new row in another status than the first; `snapshot changed` where a frozen
    column differs although the row isn't being approved, the one step that freezes it anew; `expired early` before its days are over, and
    `not expired` for one that still waits after them.
    """
    both = _sides(before, after, key, ["status", "created_at", *frozen])
    o, n = F.col("o_status"), F.col("n_status")
    new, gone = F.col("was").isNull(), F.col("now").isNull()
    allowed = o.eqNullSafe(n)
    for a, targets in steps.items():
        allowed = allowed | ((o == a) & n.isin(*targets))
    illegal = both.where(~new & ~gone & ~F.coalesce(allowed, F.lit(False)))
    spelt = F.concat(F.lit("illegal step: "), F.coalesce(o, F.lit("none")), F.lit(" -> "), F.coalesce(n, F.lit("none")))
    start = both.where(new & ~n.eqNullSafe(F.lit(first))).select(key, F.concat(F.lit("starts as "), F.coalesce(n, F.lit("none"))).alias("violation"))
    approving = (o == first) & (n == "approved")
    stale = F.col("n_created_at") < as_of - F.expr(f"interval {days} days")
    rest = _named(
        both, key, ("deleted", gone), ("snapshot changed", ~new & ~gone & (F.size(_changed(frozen)) > 0) & ~F.coalesce(approving, F.lit(False))),
        ("expired early", (n == "expired") & ~o.eqNullSafe(F.lit("expired")) & ~stale), ("not expired", (n == first) & stale),
    )
    return illegal.select(key, spelt.alias("violation")).unionByName(start).unionByName(rest)
