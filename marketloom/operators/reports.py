"""Finished reports: rules that must hold before one goes out, and what each of its thirteen checks came to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from marketloom.functions.columns import vin_valid

#: What a report holds, as far as rules and checks look at it. `add_ons` is the number of itemised lines, null without a list.
REPORT = (
    "feature string, quoted_price double, price_disclosure string, render_checked boolean, render_confirmed boolean, vehicle string, summary string, "
    "vin string, vin_check struct<present:boolean,valid:boolean,vin:string>, year int, make string, model string, condition string, "
    "msrp double, msrp_source string, msrp_basis string, msrp_unavailable string, inflation struct<dealer_stated:double,manufacturer:double,over_by:double>, "
    "days_on_lot struct<days:int,source:string,source_label:string>, odometer_checked boolean, odometer_km int, "
    "recalls struct<checked:boolean,confirmed:boolean,count:int,matched_model:string,queried_model:string,error:string>, add_ons int, doc_fee_kind string, "
    "fuel_type string, warranty struct<verified:boolean,coverage:string>, remaining_make string, financing_disclosed boolean, "
    "financing_check struct<checked:boolean,consistent:boolean>, reference struct<apr:double,term_months:int>, dealer_apr struct<apr:double,source:string>, "
    "manufacturer_apr double, dealer_name string, leverage struct<inputs:int,score:double>, licence struct<state:string,number:string>"
)
# What of a summary denies a price, and the text that takes its place around the vehicle and the price.
DENIES_PRICE = (
    r"(?i)\bno (?:pricing|price|advertised(?: selling| asking)? price)\b(?![-–])|\bprice (?:is |was )?not (?:shown|disclosed|advertised|published|present)\b"
    r"|\b(?:doesn'?t|does not|do not) disclose\b[^.]{0,60}\bpric"
)
REBUILT = (
    " is advertised at $",
    " on the dealer's own listing page. The figures on this report were read from the page's own data and rendered view. Confirm the out-the-door total, "
    "any add-on fees, and financing details directly with the dealer before signing anything.",
)
# Sources of a dealer's rate that are evidence for it.
RATE_SOURCES = ("sm360_feed", "convertus_vms", "page_text")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _some(text: Column) -> Column:
    return _yes(text != "")


def _bare_vin() -> Column:
    return F.nullif(F.regexp_replace(F.upper(F.trim("vin")), r"\s+", ""), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """Where it applies it must hold; a broken rule is repaired where a column is given, else flagged."""

    name: str
    applies: Column
    holds: Column
    column: str | None = None
    repair: Column | None = None


def report_rules() -> list[Rule]:
    c = F.col
    priced = _yes(c("quoted_price") > 0)
    gap = F.floor(c("inflation.dealer_stated") - c("inflation.manufacturer") + 0.5)
    anchored = (c("inflation.dealer_stated") > c("inflation.manufacturer")) & (c("inflation.over_by") == gap) & (c("msrp") == c("inflation.manufacturer"))
    vin = _bare_vin()
    check = F.struct(F.lit(True).alias("present"), vin_valid(vin).alias("valid"), vin.alias("vin"))
    named = F.when(F.trim("vehicle") != "", F.trim("vehicle")).otherwise("This vehicle")
    rebuilt = F.concat(named, F.lit(REBUILT[0]), F.format_number(F.floor(c("quoted_price") + 0.5), 0), F.lit(REBUILT[1]))
    return [
        Rule("PRICE_DISCLOSURE_MATCHES_PRICE", priced, ~c("price_disclosure").eqNullSafe("contact_for_price"), "price_disclosure", F.lit("advertised")),
        Rule(
            "PRICE_NOT_ACCUSED_UNCONFIRMED", _yes(c("render_checked")) & (c("price_disclosure") == "contact_for_price") & ~priced, c("render_confirmed"), "price_disclosure", F.lit("not_shown")
        ),
        Rule("VIN_CHECK_MATCHES_VIN", vin.isNotNull(), c("vin_check.present") & (c("vin_check.vin") == vin), "vin_check", check),
        Rule("CATALOG_MSRP_BASIS_LABELLED", (c("msrp_source") == "catalog") & (c("msrp") > 0), c("msrp_basis").isin("exact", "starting_at")),
        Rule("MSRP_INFLATION_ANCHORED", c("inflation").isNotNull(), anchored),
        Rule("MSRP_HAS_PROVENANCE", c("msrp") > 0, _some(c("msrp_source"))),
        Rule("DAYS_ON_LOT_HAS_PROVENANCE", c("days_on_lot.days") > 0, _some(c("days_on_lot.source")) & _some(c("days_on_lot.source_label"))),
        Rule("SUMMARY_MATCHES_PRICE", priced & c("summary").rlike(DENIES_PRICE), F.lit(False), "summary", rebuilt),
    ]


def asserted(reports: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """reports as repaired, with `repaired` and `flagged`, the names of broken rules in order. A repair is seen by the rules after it; what
    can't be judged because a part is missing is broken where the rule applies."""
    rules = rules or report_rules()
    for r in rules:
        broken = _yes(r.applies) & ~_yes(r.holds)
        reports = reports.withColumn(f"__{r.name}", broken)
        if r.column:
            reports = reports.withColumn(r.column, F.when(F.col(f"__{r.name}"), r.repair).otherwise(F.col(r.column)))
    names = lambda some: F.array_compact(F.array(*[F.when(F.col(f"__{r.name}"), r.name) for r in some]))
    out = reports.withColumn("repaired", names([r for r in rules if r.column])).withColumn("flagged", names([r for r in rules if not r.column]))
    return out.drop(*[f"__{r.name}" for r in rules])


def number_text(c: Column) -> Column:
    """A number as it is told: whole ones without a fraction, an unknown one as a question mark."""
    return F.coalesce(F.regexp_replace(c.cast("string"), r"\.0$", ""), F.lit("?"))


def _told(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("?")) for p in parts])


def report_checks() -> dict[str, Column]:
    """Each check's struct(outcome, detail), null where it has none. `verified` and `checked_no_match` are good, `error` and `not_attempted`
    bad; `not_applicable` counts neither way and always rests on something known about the vehicle or the upload."""
    c = F.col
    out = lambda outcome, *detail: F.struct(F.lit(outcome).alias("outcome"), _told(*detail).alias("detail"))
    first = lambda *cases: F.coalesce(*[x if w is None else F.when(_yes(w), x) for w, x in cases])
    url, priced = _yes(c("feature") == "listing_url"), _yes(c("quoted_price") > 0)
    new = _yes(F.lower(F.trim("condition")) == "new")
    fuel = F.coalesce(F.lower(F.trim("fuel_type")), F.lit(""))
    dealer = _some(c("dealer_name"))
    complete = _yes(c("year") != 0) & _some(c("make")) & _some(c("model"))
    trusted = (c("dealer_apr.apr") > 0) & c("dealer_apr.source").isin(*RATE_SOURCES)
    return {
        "msrp": first(
            (c("msrp") > 0, out("verified", c("msrp_source"), "/", c("msrp_basis"))),
            (~new & (c("msrp_unavailable") == "used_original_msrp_not_held"), out("not_applicable", "used, its first list price isn't held")),
            (~complete, out("not_attempted", "year, make or model missing")),
            (None, out("error", "not in the catalogue: ", c("year").cast("string"), " ", c("make"), " ", c("model"))),
        ),
        "odometer": first(
            (c("odometer_checked"), out("verified", number_text(c("odometer_km")), " km")),
            (new, out("not_applicable", "new vehicle")),
            (c("odometer_km").isNull(), out("not_attempted", "no odometer published")),
            (None, out("not_attempted", "no year to judge by")),
        ),
        "recalls": first(
            (c("recalls").isNull(), out("not_attempted", "year, make or model missing")),
            (~_yes(c("recalls.checked")), out("error", F.coalesce(c("recalls.error"), F.lit("registry not reached")))),
            (~_yes(c("recalls.confirmed")), out("error", "model not confirmed: ", c("recalls.queried_model"))),
            (c("recalls.count") > 0, out("verified", number_text(c("recalls.count")), " open")),
            (None, out("checked_no_match", "none open for ", F.coalesce(c("recalls.matched_model"), c("recalls.queried_model"), F.lit("model")))),
        ),
        "fees": first(
            (c("add_ons") > 0, out("verified", number_text(c("add_ons")), " itemised")),
            (c("doc_fee_kind").isNotNull(), out("verified", "document fee ", c("doc_fee_kind"))),
            (c("add_ons").isNotNull() & priced, out("checked_no_match", "priced lines read, none added")),
            (c("add_ons").isNotNull(), out("not_attempted", "no price read, so no lines prove nothing")),
            (None, out("not_attempted", "no list of lines")),
        ),
        "ev_rebate": first(
            (fuel == "", out("not_attempted", "fuel not known")),
            (fuel.isin("bev", "phev"), out("verified", F.upper(fuel))),
            (None, out("not_applicable", fuel, ", no rebate")),
        ),
        "vin": first(
            (c("vin_check.present") & c("vin_check.valid"), out("verified", "…", F.right(F.coalesce("vin", F.lit("")), F.lit(6)))),
            (c("vin_check.present"), out("error", "not a valid number")),
            (None, out("not_attempted", "none published")),
        ),
        "warranty": first(
            (c("warranty.verified"), out("verified", F.substring(c("warranty.coverage"), 1, 60))),
            (_some(c("remaining_make")), out("verified", "what remains was computed")),
            (~c("warranty.verified"), out("error", "none on file for ", F.coalesce(c("make"), F.lit("make")))),
            (None, out("not_attempted", "none resolved")),
        ),
        "financing": first(
            (c("financing_check.checked"), out("verified", F.when(_yes(c("financing_check.consistent")), "adds up").otherwise("doesn't add up"))),
            (c("reference.apr").isNotNull() & priced, out("verified", "from the maker's ", number_text(c("reference.apr")), "% over ", number_text(c("reference.term_months")), " months")),
            (~_yes(c("financing_disclosed")) & priced, out("not_applicable", "priced, no financing told and no maker's rate")),
            (~_yes(c("financing_disclosed")), out("not_attempted", "nothing read")),
            (None, out("not_attempted", "told in part")),
        ),
        "apr": first(
            (trusted, out("verified", "dealer ", number_text(c("dealer_apr.apr")), "%")),
            (c("manufacturer_apr") > 0, out("verified", "maker ", number_text(c("manufacturer_apr")), "%")),
            (None, out("not_attempted", "no advertised rate and none on file for ", F.coalesce(c("make"), F.lit("make")))),
        ),
        # with a dealer's name the look-up of opinions has this row to itself
        "reputation": F.when(~dealer, out("not_attempted", "no dealer named")),
        "leverage": first(
            (c("leverage.inputs") > 0, out("verified", number_text(c("leverage.inputs")), " inputs, score ", number_text(c("leverage.score")))),
            (None, out("not_attempted", "no input was verified")),
        ),
        "days_on_lot": first(
            (~url, out("not_applicable", "uploaded, no listing to age")),
            (c("days_on_lot.days") > 0, out("verified", number_text(c("days_on_lot.days")), " days (", c("days_on_lot.source"), ")")),
            (None, out("not_attempted", "not told by the site")),
        ),
        "amvic": first(
            (_some(c("licence.state")), out("verified", c("licence.state"), F.coalesce(F.concat(F.lit(" #"), F.nullif(c("licence.number"), F.lit(""))), F.lit("")))),
            (~url, out("not_attempted", "not looked up for uploads")),
            (dealer, out("not_attempted", "no sure match for ", c("dealer_name"))),
            (None, out("not_attempted", "no dealer named")),
        ),
    }


def report_checkpoints(reports: DataFrame, key: str) -> DataFrame:
    """(key, checkpoint, outcome, detail), a row for each check of a report."""
    cells = F.array(*[F.when(c.isNotNull(), F.struct(F.lit(name).alias("checkpoint"), c["outcome"].alias("outcome"), c["detail"].alias("detail"))) for name, c in report_checks().items()])
    return reports.select(key, F.explode(F.array_compact(cells)).alias("x")).select(key, "x.*")


def failure_rates(checkpoints: DataFrame) -> DataFrame:
    """(checkpoint, n, failed, rate): bad outcomes among those that count."""
    bad = F.col("outcome").isin("error", "not_attempted")
    g = checkpoints.where("outcome <> 'not_applicable'").groupBy("checkpoint").agg(F.count("*").alias("n"), F.count_if(bad).alias("failed"))
    return g.withColumn("rate", F.round(F.col("failed") / F.col("n"), 4))
