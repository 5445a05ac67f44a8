"""Configurator summaries: one built car's price lines, and whether a trim's list price may be taken from them.

A summary prices a car in one colour. The colour's price can be part of the package line or of the list price line, so a summary
counts only if it adds up and its colour is known to cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The province's added lines (most dealer fees, air conditioning, tyre levy, dealer council) and the two parts of
#: the charge for registering a loan.
ADDED_LINES = (999, 100, 25, 10)
LOAN_LINES = (14, 4)
#: Fixed value: how a package line says that it holds the colour.
PAINT_AT_END = r"(?i)\bwith\s+premium\s+paint\s*$"
TWO_TONE = r"(?i)\bwith\s+.*\broof\b"
CENT = 0.02

SUMMARY = (
    "summary_id long, model string, trim string, msrp_line double, package_line string, package_price double, exterior string, "
    "no_cost boolean, block_heater double, delivery double, printed_subtotal double"
)


def _or_zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def added_lines() -> Column:
    """The lines that every car has, with this model's delivery; null without it, as it differs by model."""
    return F.col("delivery") + F.lit(float(sum(ADDED_LINES)))


def computed_subtotal() -> Column:
    return F.col("msrp_line") + _or_zero("package_price") + _or_zero("block_heater") + added_lines()


def refusal() -> Column:
    """Why a summary gives no list price, the first reason that applies; null if it gives one."""
    printed = F.col("printed_subtotal").isNotNull()
    return (
        F.when(F.col("msrp_line").isNull(), "no list price line")
        .when(printed & F.col("delivery").isNull(), "no delivery line")
        .when(printed & (F.abs(computed_subtotal() - F.col("printed_subtotal")) >= CENT), "does not add up")
        .when(F.coalesce(F.col("package_line").rlike(PAINT_AT_END), F.lit(False)), "package holds the colour")
        .when(F.coalesce(F.col("exterior").rlike(TWO_TONE), F.lit(False)), "two-tone exterior")
        .when(~F.coalesce(F.col("no_cost"), F.lit(False)), "colour not known to be free")
    )


def assessed(summaries: DataFrame) -> DataFrame:
    """summaries with seedable, msrp, all_in and reason (null where seedable)."""
    rows = summaries.withColumn("reason", refusal())
    ok = F.col("reason").isNull()
    return rows.withColumns(
        {"seedable": ok, "msrp": F.when(ok, F.col("msrp_line") + _or_zero("package_price")), "all_in": F.when(ok, F.col("printed_subtotal"))}
    )


def solved_bases(summaries: DataFrame) -> DataFrame:
    """(model, trim, builds, base, premium, reason): builds of one trim without a package that differ in colour alone. The lowest
    list price line is the trim's price and what the dearest has more is its colour; builds of one price tell nothing."""
    plain = summaries.where(F.col("package_line").isNull())
    g = plain.groupBy("model", "trim").agg(F.count("msrp_line").alias("builds"), F.min("msrp_line").alias("low"), F.max("msrp_line").alias("high"))
    reason = F.when(F.col("builds") == 0, "no list price line").when(F.col("builds") == 1, "one build").when(F.col("low") == F.col("high"), "same list price line")
    g = g.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return g.select("model", "trim", "builds", F.when(ok, F.col("low")).alias("base"), F.when(ok, F.col("high") - F.col("low")).alias("premium"), "reason")


def lineup_delta(lineup_from: Column) -> Column:
    """Published floor less what the base would make: list price, heater, added lines and the loan's registration."""
    return F.round(lineup_from - (F.col("msrp_line") + _or_zero("block_heater") + added_lines() + F.lit(float(sum(LOAN_LINES)))), 2)


def corroborated(bases: DataFrame, lineup: DataFrame) -> DataFrame:
    """bases with `delta` and `lineup_verdict` from (model, lineup_from, surface). The floor is the price of the model's cheapest
    trim, on the surface `lineup` alone: dearer than it says is a colour or a cheaper trim, cheaper can't be."""
    rows = bases.join(lineup, "model", "left")
    usable = (F.col("surface") == "lineup") & F.col("delivery").isNotNull() & F.col("lineup_from").isNotNull()
    delta = F.when(usable, lineup_delta(F.col("lineup_from")))
    verdict = (
        F.when(F.col("lineup_from").isNull(), "no published floor")
        .when(F.coalesce(F.col("surface") != "lineup", F.lit(True)), "other surface")
        .when(F.col("delivery").isNull(), "no delivery line")
        .when(F.col("msrp_line").isNull(), "no list price line")
        .when(F.abs(delta) < CENT, "confirmed")
        .when(delta < 0, "above the floor")
        .otherwise("below the floor")
    )
    return rows.withColumn("delta", F.when(F.abs(delta) < CENT, 0.0).otherwise(delta)).withColumn("lineup_verdict", verdict)


def with_evidence(summaries: DataFrame, lineup: DataFrame) -> DataFrame:
    """summaries whose no_cost also holds where the line-up shows it: a build is in a free colour if it is recorded so, if it is
    the cheaper of builds of its trim that differ, or if its list price makes the model's published floor."""
    solved = solved_bases(summaries).where("reason is null").select("model", "trim", "base", "premium")
    rows = corroborated(summaries.join(solved, ["model", "trim"], "left"), lineup)
    plain = F.col("package_line").isNull()
    shown = (plain & (F.col("msrp_line") == F.col("base"))) | (plain & (F.col("lineup_verdict") == "confirmed"))
    return rows.withColumn("no_cost", F.coalesce(F.col("no_cost"), F.lit(False)) | F.coalesce(shown, F.lit(False)))
