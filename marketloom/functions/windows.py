"""Exact order statistics over groups of any size, by ranks instead of collected arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Cells to a factor of e. A group's rows in one cell are put in order by one task, its cells' totals by one.
CELLS = 20_000
_AWAY = 10**9


def same_keys(a: list[str], b: list[str]):
    """Null-safe equality of two lists of columns."""
    out = F.lit(True)
    for x, y in zip(a, b):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def cell_of(value: Column, cells: int = CELLS) -> Column:
    """A whole number that never falls as the value rises: the place of its magnitude on a logarithmic scale, with its sign. What is not a
    number comes last, as in Spark's order."""
    x = value.cast("double")
    place = F.floor(F.ln(F.abs(x)) * cells) + _AWAY
    finite = F.when(x == 0, 0).when(x > 0, place).otherwise(-place)
    return F.when(F.isnan(x), 4 * _AWAY).when(x == float("inf"), 3 * _AWAY).when(x == float("-inf"), -3 * _AWAY).otherwise(finite).cast("long")


def at_places(df: DataFrame, keys: Sequence[str], value: str, places: dict[str, Callable[[Column], Column]], size: str | None = None, cells: int = CELLS) -> DataFrame:
    """For each group the values at places in ascending order, from 0, one column a place; a place is made from the group's number of values,
    which comes along as column `size` if named. Nulls are left out.

    Equal values of a group are counted first. The totals of its cells say which cell holds a place, and only such cells are put in order,
    each on its own, so that no task sorts a large group. Cells depend on the value alone, so they take no pass over the rows.
    """
    keys = list(keys)
    others = [f"__{k}" for k in keys]
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n")).withColumn("__cell", cell_of(F.col("__v"), cells))
    whole = Window.partitionBy(*(keys or [F.lit(1)]))
    ahead = whole.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = counted.groupBy(*keys, "__cell").agg(F.sum("__n").alias("__m"))
    totals = totals.withColumn("__before", F.coalesce(F.sum("__m").over(ahead), F.lit(0))).withColumn("__all", F.sum("__m").over(whole))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("__all")).cast("long").alias("at")) for name, place in places.items()])
    inside = F.filter(asked, lambda x: (x["at"] >= F.col("__before")) & (x["at"] < F.col("__before") + F.col("__m")))
    wanted = totals.withColumn("__p", inside).where(F.size("__p") > 0).select(*keys, F.col("__cell").alias("__in"), "__before", "__all", "__p").withColumnsRenamed(dict(zip(keys, others)))
    run = Window.partitionBy(*keys, "__cell").orderBy("__v")
    ordered = counted.join(wanted, same_keys([*keys, "__cell"], [*others, "__in"])).withColumn("__to", F.col("__before") + F.sum("__n").over(run))
    hit = F.filter("__p", lambda x: (x["at"] >= F.col("__to") - F.col("__n")) & (x["at"] < F.col("__to")))
    found = ordered.select(*keys, "__v", "__all", hit.alias("__hit")).where(F.size("__hit") > 0).select(*keys, "__v", "__all", F.explode("__hit.name").alias("__name"))
    told = [F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in places]
    return found.groupBy(*keys).agg(*told, *([F.max("__all").alias(size)] if size else []))


def nearest_ranks(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """For each group the observed values at places floor((n - 1) * p + 0.5), one column a point."""
    return at_places(df, keys, value, {name: (lambda n, p=float(p): F.floor((n - 1) * p + 0.5)) for name, p in points.items()})


def discrete(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """For each group the first observed value at or below which a share p of the values lies, one column a point."""
    return at_places(df, keys, value, {name: (lambda n, p=float(p): F.greatest(n - F.floor(n - n * p), F.lit(1)) - 1) for name, p in points.items()})


def interpolated(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """For each group the values at (n - 1) * p, between two observed values in proportion, one column a point. Without keys and without
    values it is one row of nulls."""
    at = lambda p: lambda n: (n - 1) * F.lit(float(p))
    places = {}
    for name, p in points.items():
        places[f"{name}__low"], places[f"{name}__high"] = (lambda n, p=p: F.floor(at(p)(n))), (lambda n, p=p: F.ceil(at(p)(n)))
    rows = at_places(df, keys, value, places, size="__size")

    def between(name: str, p: float) -> Column:
        place = at(p)(F.col("__size"))
        low, high = F.col(f"{name}__low"), F.col(f"{name}__high")
        return F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(name)

    return rows.select(*keys, *[between(name, p) for name, p in points.items()])
