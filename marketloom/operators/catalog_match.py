"""Listings matched to catalogue trims: an equi join on the model, scores as columns, the best candidate by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketloom.functions.columns import drive, fuel, price_implausible

#: Words that tell trims apart.
KEY_WORDS = (
    "xle xse se le limited platinum nightshade trd sr sr5 touring preferred sport premium ultimate calligraphy denali laramie rubicon sahara raptor lariat woodland prime n type "
    "signature select essential technology luxury execline progressif gt ex lx dx exl"
).split()


# Words of a trim's name that say its fuel or its drive, and so tell no trims apart, and the dashes that are one.
FUEL_WORDS = r"\b(hybrid|phev|plug-?in|bev|electric|gas(oline)?|diesel)\b"
DRIVE_WORDS = r"\b(fwd|awd|rwd|4wd|4x4|4matic|4motion|xdrive|quattro)\b"
DASHES = r"[‐-―−]"


def trim_words(text: Column) -> Column:
    """The words that tell a trim apart, in order, repeats kept."""
    s = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), DASHES, "-"))
    s = F.regexp_replace(F.regexp_replace(s, FUEL_WORDS, " "), r"[^a-z0-9]+", " ")
    return F.filter(F.split(F.trim(F.regexp_replace(s, DRIVE_WORDS, " ")), " +"), lambda w: w != "")


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def match_listings(listings: DataFrame, catalog: DataFrame, keys: list[str], listing_id: str = "listing_id") -> DataFrame:
    """(listing_id, matched_msrp, matched_trim, basis, score), one row a listing that has a candidate.

    listings: listing_id, keys, trim, price, fuel_type, drivetrain, and if they have them vin_drive and features, an array of names.
    catalog: keys, trim, msrp, fuel_type, drivetrain, and if it has them attrs, an array of the features that mark a trim. basis is `exact`
    only if one candidate stands out, states the listing's drive and is not far below its price. Of candidates with one score the cheapest
    comes first, since tables have no order.
    """
    names = F.array(*[F.lit(w) for w in KEY_WORDS])
    key_of = lambda words: F.array_intersect(words, names)
    none = F.array().cast("array<string>")
    lowered = lambda c: F.coalesce(F.transform(c, lambda x: F.lower(x)), none)
    want_drive = F.coalesce(drive(F.col("drivetrain")), drive(_column(listings, "vin_drive", "string")))
    want_fuel = F.when(fuel(F.col("fuel_type")) != "gas", fuel(F.col("fuel_type"))).when(F.lower("trim").rlike("hybrid|phev"), "hybrid").otherwise("gas")
    left = listings.select(
        listing_id, *keys, F.when(F.col("price") > 0, F.col("price")).alias("price"), trim_words(F.col("trim")).alias("words"), want_drive.alias("want_drive"),
        F.coalesce(want_drive, drive(F.col("trim"))).alias("stated"), want_fuel.alias("want_fuel"), lowered(_column(listings, "features", "array<string>")).alias("features"),
    )
    right = catalog.where("msrp > 0").select(
        *keys, F.col("trim").alias("c_trim"), F.col("msrp").alias("c_msrp"), fuel(F.col("fuel_type")).alias("c_fuel"), F.coalesce(drive(F.col("drivetrain")), drive(F.col("trim"))).alias("c_drive"),
        trim_words(F.col("trim")).alias("c_words"), lowered(_column(catalog, "attrs", "array<string>")).alias("attrs"),
    )
    each = Window.partitionBy(listing_id)
    rows = left.join(right, keys).withColumn("n_valid", F.count("*").over(each))
    rows = rows.withColumn("fuel_fits", F.max((F.col("c_fuel") == F.col("want_fuel")).cast("int")).over(each)).where("n_valid = 1 or fuel_fits = 0 or c_fuel = want_fuel")
    shared = F.filter("c_words", lambda w: F.array_contains("words", w))
    key_shared = F.filter(shared, lambda w: F.array_contains(names, w))
    apart = (F.size(key_of(F.col("words"))) > 0) & (F.size(key_of(F.col("c_words"))) > 0) & ~F.arrays_overlap(key_of(F.col("words")), key_of(F.col("c_words")))
    gap = F.abs(F.col("c_msrp") - F.col("price"))
    has = F.size(F.filter("attrs", lambda x: F.array_contains("features", x)))
    lacks = F.when(F.size("features") > 0, F.size("attrs") - has).otherwise(0)
    score = (
        F.when(F.col("want_drive").isNull() | F.col("c_drive").isNull(), 0).when(F.col("want_drive") == F.col("c_drive"), 4).otherwise(-6)
        + F.size(shared) + F.size(key_shared) - F.when(apart, 5).otherwise(0) + 2 * has - lacks
        + F.when(F.col("price").isNull(), 0).when(gap == F.min(gap).over(each), 2).when(gap < 3000, 1).otherwise(0)
    )
    rows = rows.withColumn("score", score)
    by_score = Window.partitionBy(listing_id).orderBy(F.desc("score"), "c_msrp", "c_trim")
    ranked = rows.withColumn("rank", F.row_number().over(by_score)).withColumn("next_score", F.lead("score").over(by_score)).withColumn("next_msrp", F.lead("c_msrp").over(by_score))
    top = ranked.withColumn("cheapest", F.min(F.struct("c_msrp", "c_trim")).over(each)).where("rank = 1")
    confirmed = (F.col("stated").isNull() | F.coalesce(F.col("c_drive") == F.col("stated"), F.lit(False))) & ~price_implausible(F.col("c_msrp"), F.col("price"))
    alone = F.col("n_valid") == 1
    no_signal = ~alone & (F.col("score") <= 0) & (F.size("words") == 0) & F.col("want_drive").isNull() & (F.size("features") == 0)
    clear = F.col("next_score").isNull() | (F.col("score") - F.col("next_score") >= 2) | (F.abs(F.col("c_msrp") - F.col("next_msrp")) < 500)
    named = F.coalesce(F.col("c_trim") != "", F.lit(False))
    exact = F.when(alone, named & confirmed).when(no_signal, F.lit(False)).otherwise(clear & confirmed)
    return top.select(
        listing_id, F.when(no_signal, F.col("cheapest.c_msrp")).otherwise(F.col("c_msrp")).alias("matched_msrp"), F.when(no_signal, F.col("cheapest.c_trim")).otherwise(F.col("c_trim")).alias("matched_trim"),
        F.when(exact, "exact").otherwise("starting_at").alias("basis"), F.when(alone | no_signal, 0).otherwise(F.col("score")).alias("score"),
    )
