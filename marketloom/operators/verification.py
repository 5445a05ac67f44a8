"""Whether a crawled listing may be published, and how much a buyer can lean on what a report found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketloom.functions.columns import half_up

# Least and most price by fuel, prices that stand for none, words of swindles, and the shortest name.
FLOORS = {"BEV": 8000, "PHEV": 10000, "Hybrid": 5000, "Gas": 2000, "Diesel": 5000}
CAPS = {"BEV": 150000, "PHEV": 120000, "Hybrid": 100000, "Gas": 150000, "Diesel": 100000}
PLACEHOLDERS = (1, 100, 111, 222, 333, 999, 1000, 1111, 9999, 99999, 100000, 123456)
SWINDLES = (
    "paypal only", "western union", "money order", "cashier check", "deployed overseas", "military", "out of country", "ebay motors", "god fearing", "missionary", "inspection fee", "shipping only",
    "whatsapp me", "contact me at", "email only for details",
)
SHORTEST_NAME = 8


def listing_rules(this_year: int) -> list[tuple[str, Column, str | None, int]]:
    """(flag, when, action, points lost) in order; a flag without an action only informs."""
    c = F.col
    zero = lambda name: F.coalesce(c(name).cast("double"), F.lit(0.0))
    price, km, year = zero("price"), zero("km"), F.coalesce(c("year").cast("int"), F.lit(0))
    fuel = F.coalesce(F.nullif("fuel", F.lit("")), F.lit("Gas"))
    by_fuel = lambda table: F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))])[fuel]
    said = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit(""))))
    missing = lambda name: F.coalesce(c(name).isin("", "Unknown"), F.lit(True))
    none = lambda name: F.coalesce(c(name) == "", F.lit(True))
    age = F.lit(this_year) - year
    return [
        ("PRICE_TOO_LOW", (price < by_fuel(FLOORS)) | (price == 0), "reject", 50),
        ("PRICE_TOO_HIGH", price > by_fuel(CAPS), "review", 20),
        ("PLACEHOLDER_PRICE", price.isin(*map(float, PLACEHOLDERS)), "reject", 60),
        ("INVALID_YEAR", (year < 2000) | (year > this_year + 2), "reject", 40),
        ("KM_TOO_HIGH", km > 500_000, "review", 15),
        ("KM_NEGATIVE", km < 0, "reject", 50),
        ("SCAM_KEYWORDS", said.rlike("|".join(SWINDLES)), "reject", 80),
        ("NAME_TOO_SHORT", F.length(F.coalesce("name", F.lit(""))) < SHORTEST_NAME, "reject", 30),
        ("MISSING_MAKE", missing("make"), "review", 20),
        ("MISSING_MODEL", missing("model"), "review", 20),
        ("MISSING_EXTERNAL_ID", none("external_id"), "reject", 50),
        ("MISSING_URL", none("listing_url"), "review", 10),
        ("PRICE_ANOMALY", (year >= this_year - 1) & (price < 15_000) & (fuel != "Gas"), "review", 25),
        ("KM_YEAR_MISMATCH", (km > F.greatest(F.lit(30_000), age * 35_000)) & (age < 10), "review", 15),
        ("OVER_EVAP_CAP", fuel.isin("BEV", "PHEV") & (price > 50_000), None, 0),
    ]


def verified_listings(listings: DataFrame, this_year: int) -> DataFrame:
    """listings with flags, an array in order, score and action: publish, review or reject.

    Each flag takes points from 100, 0 at least. Below 30 points a listing is rejected and below 70 reviewed; from there on the last flag with
    an action decides, so that a mild flag after a grave one softens it.
    """
    rules = listing_rules(this_year)
    rows = listings.withColumns({f"__{name}": F.coalesce(when, F.lit(False)) for name, when, *_ in rules})
    flags = F.array_compact(F.array(*[F.when(F.col(f"__{name}"), name) for name, *_ in rules]))
    lost = sum((F.when(F.col(f"__{name}"), points).otherwise(0) for name, _, _, points in rules), F.lit(0))
    last = F.lit("publish")
    for name, _, action, _ in rules:
        last = F.when(F.col(f"__{name}"), action).otherwise(last) if action else last
    rows = rows.withColumn("flags", flags).withColumn("score", F.greatest(F.lit(0), F.lit(100) - lost)).withColumn("__last", last)
    action = F.when(F.col("score") < 30, "reject").when(F.col("score") < 70, "review").otherwise(F.col("__last"))
    return rows.withColumn("action", action).drop("__last", *[f"__{name}" for name, *_ in rules])


def leverage_terms() -> dict[str, Column]:
    """What adds to a buyer's leverage, from columns quoted, reference, basis, ceiling, over_ceiling, flagged_fees, recalls_checked, recalls,
    financing_checked, financing_consistent, days; null where a finding isn't there."""
    c = F.col
    priced = (c("reference") > 0) & (c("quoted") > 0)
    delta = (c("quoted") - c("reference")) / c("reference")
    gap = c("quoted") - c("reference")
    exact, floor = priced & (c("basis") == "exact"), priced & (c("basis") == "starting_at")
    above = c("over_ceiling") > 0
    some_above = F.coalesce(above, F.lit(False))
    capped = lambda value, cap: F.least(F.lit(cap), value)
    return {
        "above_list": F.when(exact & (delta > 0.005), capped(delta * 100 * 0.3, 2.5)),
        "below_list": F.when(exact & (delta < -0.02), F.lit(-1.0)),
        "above_lineup": F.when(floor & above, capped(c("over_ceiling") / c("ceiling") * 100 * 0.3, 2.5)),
        "above_trim": F.when(floor & ~some_above & (gap > c("reference") * 0.2) & (gap > 6000), capped(gap / c("reference") * 100 * 0.15, 1.5)),
        "fees": F.when(c("flagged_fees") > 0, capped(c("flagged_fees") / 1000, 2.0)),
        "recalls": F.when(c("recalls_checked") & (c("recalls") > 0), capped(c("recalls") * 0.7, 2.0)),
        "financing": F.when(c("financing_checked") & ~c("financing_consistent"), F.lit(1.0)),
        "days": F.when(c("days") >= 90, 2.5).when(c("days") >= 60, 1.5).when(c("days") >= 30, 0.75),
    }


def with_leverage(reports: DataFrame, base: float = 2.0) -> DataFrame:
    """reports with leverage, from 0 to 10 with one decimal, and leverage_basis, the findings that it rests on in order."""
    terms = leverage_terms()
    rows = reports.withColumns({f"__{name}": value for name, value in terms.items()})
    total = F.lit(base)
    for name in terms:
        total = total + F.coalesce(F.col(f"__{name}"), F.lit(0.0))
    basis = F.array_compact(F.array(*[F.when(F.col(f"__{name}").isNotNull(), name) for name in terms]))
    score = F.greatest(F.lit(0.0), F.least(F.lit(10.0), half_up(total, 1)))
    return rows.withColumn("leverage", score).withColumn("leverage_basis", basis).drop(*[f"__{name}" for name in terms])
