"""Verdicts about one listing or quote as Column expressions: price authority, financing, warranty, odometer, region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marketloom.functions.columns import half_up

# Words by which a quote's lines are told apart.
FEE_WORDS = r"\b(doc(ument(ation)?)?|registration|licen[sc]e|title|freight|pdi|destination|delivery|a\/?c (levy|tax)|air ?conditioning|tire (levy|tax|fee|recycl)|environment|omvic|amvic|govern|filing|excise|luxury tax|green levy|gst|pst|hst|qst|sales tax)\b"
ADDON_WORDS = r"\b(protection|paint|fabric|leather|etch|nitrogen|pulse|tint|z[ie]bart|gold shield|wheel lock|appearance|under(coat|body|carriage)|rust ?proof|\bgap\b|theft|lojack|3m|ceramic|clear ?coat|addendum|accessor|admin|dealer prep|prep (fee|charge)|recon(dition(ing)?)?|vin (etch|engrav)|key (replace|protect)|road hazard|maintenance package|fabric|scotchgard)\b"
DISCOUNT_WORDS = r"\b(discount|rebate|savings|incentive|loyalty|conquest)\b"
# A stated price is inflated beyond this share and this amount.
INFLATED_SHARE, INFLATED_AMOUNT = 1.03, 800
PAYMENTS_A_YEAR = {"weekly": 52, "biweekly": 26, "monthly": 12}


def msrp_authority(stated: Column, reference: Column, exact: Column) -> Column:
    """struct(msrp, basis, source, over_by): an exact catalogue price stands before the stated one, that before a floor."""
    told, known = F.coalesce(stated > 0, F.lit(False)), F.coalesce(reference > 0, F.lit(False))
    sure = known & F.coalesce(exact, F.lit(False))
    inflated = sure & told & (stated > reference * INFLATED_SHARE) & (stated - reference > INFLATED_AMOUNT)
    return F.struct(
        F.when(sure, reference).when(told, stated).when(known, reference).otherwise(F.lit(0.0)).alias("msrp"),
        F.when(sure, "exact").when(told | ~known, "dealer_stated").otherwise("starting_at").alias("basis"),
        F.when(sure, "catalog").when(told | ~known, "listing").otherwise("catalog").alias("source"),
        F.when(inflated, half_up(stated - reference)).alias("over_by"),
    )


def line_class(name: Column, price: Column, verdict: Column) -> Column:
    """discount, addon or fee; a line that no word tells apart goes by its verdict, and is an addon without one."""
    text = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(F.coalesce(price < 0, F.lit(False)), "discount")
        .when(text.rlike(DISCOUNT_WORDS) & F.coalesce(price <= 0, F.lit(True)), "discount")
        .when(text.rlike(ADDON_WORDS), "addon")
        .when(text.rlike(FEE_WORDS), "fee")
        .when(F.coalesce(verdict.isin("standard", "good"), F.lit(False)), "fee")
        .otherwise("addon")
    )


def reconcile(lines: DataFrame, quote_id: str, name: str, price: str, verdict: str, quotes: DataFrame, selling: str) -> DataFrame:
    """(quote_id, fees, addons, discounts, on_top, pre_tax), one row a quote: discounts are part of the selling price."""
    kind = line_class(F.col(name), F.col(price), F.col(verdict))
    of = lambda k: F.coalesce(F.sum(F.when(kind == k, F.col(price))), F.lit(0))
    sums = lines.groupBy(quote_id).agg(of("fee").alias("fees"), of("addon").alias("addons"), of("discount").alias("discounts"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = quotes.select(quote_id, selling).join(sums, quote_id, "left").select(quote_id, selling, zero("fees"), zero("addons"), zero("discounts"))
    return joined.withColumn("on_top", F.col("fees") + F.col("addons")).withColumn("pre_tax", F.col(selling) + F.col("on_top")).drop(selling)


def interest(principal: Column, apr: Column, months: Column) -> Column:
    """All interest of an amortised loan."""
    rate = apr / 1200.0
    paid = principal * rate * months / F.nullif(1 - F.pow(1 + rate, -months), F.lit(0.0))
    return F.when((principal > 0) & (months > 0) & (rate > 0), F.greatest(F.lit(0.0), paid - principal)).otherwise(F.lit(0.0))


def financing_trap(discount: Column, dealer_apr: Column, promo_apr: Column, months: Column, loan: Column, gap: float = 0.1) -> Column:
    """struct(mode, extra_interest, net, is_trap), null without a discount: does the dealer's rate cost more than it saves?"""
    extra = half_up(interest(loan, dealer_apr, months) - interest(loan, promo_apr, months))
    told = F.coalesce((dealer_apr > promo_apr + gap) & loan.isNotNull() & months.isNotNull(), F.lit(False))
    return F.when(discount > 0, F.struct(F.when(told, "quantified").otherwise("awareness").alias("mode"), F.when(told, extra).alias("extra_interest"), F.when(told, half_up(discount - extra)).alias("net"), F.when(told, extra > discount).alias("is_trap")))


def coverage(text: Column) -> Column:
    """struct(years, km) of a warranty; km is null where distance has no limit."""
    years = F.regexp_extract(text, r"(?i)(\d+)\s*-?\s*year", 1).try_cast("int")
    km = F.regexp_replace(F.regexp_extract(text, r"(?i)([\d,]+)\s*km", 1), ",", "").try_cast("int")
    return F.when(years.isNotNull(), F.struct(years.alias("years"), F.when(~text.rlike("(?i)unlimited"), km).alias("km")))


def warranty_left(cover: Column, model_year: Column, odometer: Column, this_year: int) -> Column:
    """struct(years_left, km_left, active): the limit that comes first ends it; an unknown odometer ends nothing."""
    years = cover["years"] - F.greatest(F.lit(0), F.lit(this_year) - model_year)
    km = cover["km"] - odometer
    return F.when(cover.isNotNull() & model_year.isNotNull(), F.struct(years.alias("years_left"), km.alias("km_left"), ((years > 0) & F.coalesce(km > 0, F.lit(True))).alias("active")))


def payment_stream(payment: Column, months: Column, total: Column, frequency: Column) -> Column:
    """struct(payments, expected, verdict), null where too little is disclosed: does the stream add up to the total?

    Sales tax explains a total of up to 16 % more.
    """
    a_year = F.create_map(*[x for k, v in PAYMENTS_A_YEAR.items() for x in (F.lit(k), F.lit(v))])[frequency]
    n = half_up(months / 12.0 * a_year).cast("int")
    ratio = total / F.nullif(payment * n, F.lit(0.0))
    verdict = F.when(ratio.between(0.98, 1.02), "equal").when((ratio > 1.02) & (ratio <= 1.16), "tax").when(ratio < 1, "short").otherwise("over")
    return F.when((payment > 0) & (months > 0) & (total > 0) & (n > 0), F.struct(n.alias("payments"), half_up(payment * n).alias("expected"), verdict.alias("verdict")))


def odometer_check(km: Column, year: Column, is_new: Column, this_year: int) -> Column:
    """struct(kind, flag), null without a year or a sensible reading."""
    age = F.greatest(F.lit(0), F.lit(this_year) - year)
    kind = (
        F.when(is_new & (km <= 500), "delivery").when(is_new, "not_new").when(age <= 1, "nearly_new")
        .when(km < age * 6_000, "low").when(km > age * 30_000, "high").otherwise("normal")
    )
    return F.when((km >= 0) & year.isNotNull(), F.struct(kind.alias("kind"), kind.isin("not_new", "low").alias("flag")))


def region_gate(country: Column, region: Column, served: Sequence[tuple[str, str]]) -> Column:
    """struct(served, reason): who can't be placed is served."""
    c, r = F.nullif(F.upper(F.trim(country)), F.lit("")), F.nullif(F.upper(F.trim(region)), F.lit(""))
    unknown = c.isNull() | r.isNull()
    hit = F.concat_ws("|", c, r).isin([f"{a}|{b}" for a, b in served])
    home = c.isin(sorted({a for a, _ in served}))
    return F.struct((unknown | hit).alias("served"), F.when(unknown, "unknown").when(hit, "served").when(home, "other_province").otherwise("other_country").alias("reason"))


#: What a fetch's trace says, the first that is found.
MISSES = [("parser-bug", "PARSER BUG"), ("responded-no-feed", "200"), ("blocked", "HTTP (401|403|429)"), ("server-error", r"HTTP 5\d\d"), ("timeout", "TimeoutError|AbortError"), ("unreachable", "TypeError|ENOTFOUND|ECONNREFUSED|CertificateError|fetch failed")]


def miss_class(trace: Column) -> Column:
    """The kind of an array of trace lines."""
    text = F.array_join(trace, " | ")
    kind = F.when(F.coalesce(F.size(trace), F.lit(0)) < 1, "no-trace")
    for name, pattern in MISSES:
        kind = kind.when(text.rlike(pattern), name)
    return kind.otherwise("responded-no-feed")


def graded(points: DataFrame, listing_id: str, grade: str) -> DataFrame:
    """(listing_id, verdict): one false accusation or wrong point fails a listing; without a graded point there is none."""
    has = lambda g: F.count_if(F.col(grade) == g) > 0
    verdict = F.when(has("false_accusation"), "false_accusation").when(has("wrong"), "fail").when(F.count_if(F.col(grade) != "not_gradable") == 0, "not_gradable").otherwise("pass")
    return points.groupBy(listing_id).agg(verdict.alias("verdict"))


def grade_summary(verdicts: DataFrame) -> DataFrame:
    """One row: counts, accuracy, and the rule of three's bound (3 / n) where nothing failed."""
    n, good = F.count_if(F.col("verdict") != "not_gradable"), F.count_if(F.col("verdict") == "pass")
    counts = verdicts.agg(F.count("*").alias("listings"), n.alias("graded"), good.alias("passed"), F.count_if(F.col("verdict") == "false_accusation").alias("false_accusations"))
    share = lambda a: half_up(a / F.col("graded") * 1000) / 10
    return counts.withColumn("accuracy_pct", F.when(F.col("graded") > 0, share(F.col("passed")))).withColumn("bound_pct", F.when((F.col("graded") > 0) & (F.col("passed") == F.col("graded")), share(F.lit(3.0))))
