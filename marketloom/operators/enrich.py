"""Records completed from a second source, each value with where it came from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketloom.operators.joins import top_per_group

FILLED = ("trim", "vin", "odometer_km", "condition", "fuel_type", "dealer_name", "dealer_city", "vehicle", "year", "make", "model", "summary")
DEFAULT_METHOD = "scrapfly_render_vision"


def merged_rescued(reports: DataFrame, rescued: DataFrame, key: str, filled: Sequence[str] = FILLED) -> DataFrame:
    """reports completed from a second reading of their page, where there is one.

    Prices are taken where the report has none above zero, other values where it has none or an empty text, and lines where it has no line.
    The source of a price goes with the price, so it changes only if the price was taken; so do the note that a hidden price was found and
    its message. Columns: quoted_price, quoted_price_source, msrp, gated_recovered, gate_message, add_ons (an array), method, and `filled`.
    """
    own = ["quoted_price", "msrp", "quoted_price_source", "gated_recovered", "gate_message", "add_ons", "method", *filled]
    r = rescued.select(key, *[F.col(c).alias(f"__{c}") for c in own], F.lit(True).alias("__there"))
    c, o = F.col, lambda name: F.col(f"__{name}")
    there = F.coalesce(c("__there"), F.lit(False))
    none = lambda x: ~F.coalesce(x > 0, F.lit(False))
    taken = there & none(c("quoted_price")) & F.coalesce(o("quoted_price") > 0, F.lit(False))
    found = taken & F.coalesce(o("gated_recovered"), F.lit(False))
    text = lambda x: F.when(x.cast("string") != "", x)
    new = {
        "quoted_price": F.when(taken, o("quoted_price")).otherwise(c("quoted_price")),
        "msrp": F.when(none(c("msrp")) & F.coalesce(o("msrp") > 0, F.lit(False)), o("msrp")).otherwise(c("msrp")),
        "quoted_price_source": F.when(taken, F.coalesce(o("quoted_price_source"), c("quoted_price_source"))).otherwise(c("quoted_price_source")),
        "gated_recovered": F.when(found, F.lit(True)).otherwise(c("gated_recovered")),
        "gate_message": F.when(found, o("gate_message")).otherwise(c("gate_message")),
        "add_ons": F.when(F.coalesce(F.size("add_ons"), F.lit(0)) <= 0, F.coalesce(F.when(F.size(o("add_ons")) > 0, o("add_ons")), c("add_ons"))).otherwise(c("add_ons")),
        "method": F.when(there, F.coalesce(text(o("method")), F.lit(DEFAULT_METHOD))).otherwise(c("method")),
        **{f: F.coalesce(text(c(f)), text(o(f)), c(f)) for f in filled},
    }
    return reports.join(r, key, "left").select(*[new[x].alias(x) if x in new else F.col(x) for x in reports.columns])


def verified_fuel(reports: DataFrame, catalog: DataFrame) -> DataFrame:
    """reports with the catalogue's fuel for their year, make and model, and fuel_verified: true where the catalogue has one, false where it
    has none, null where the report lacks one of the three. Of several fuels most rows have the first by count, then by name."""
    k = catalog.where("fuel_type is not null").groupBy("year", F.lower("make").alias("__mk"), F.lower("model").alias("__md"), F.col("fuel_type").alias("__fuel")).agg(F.count("*").alias("__n"))
    one = top_per_group(k, ["year", "__mk", "__md"], [F.desc("__n"), F.col("__fuel")]).drop("__n").withColumnRenamed("year", "__year")
    complete = (F.col("year") != 0) & (F.col("make") != "") & (F.col("model") != "")
    rows = reports.withColumn("__ok", F.coalesce(complete, F.lit(False)))
    match = (F.col("year") == F.col("__year")) & (F.lower("make") == F.col("__mk")) & (F.lower("model") == F.col("__md"))
    rows = rows.join(one, match, "left").withColumn("fuel_verified", F.when(F.col("__ok"), F.col("__fuel").isNotNull()))
    return rows.withColumn("fuel_type", F.when(F.col("__ok"), F.coalesce("__fuel", "fuel_type")).otherwise(F.col("fuel_type"))).drop("__ok", "__year", "__mk", "__md", "__fuel")


#: A platform's vehicle, as far as it is read; all values as text, since feeds quote some numbers.
FEED = (
    "struct<hasPrice:string,salePrice:string,listPrice:string,serialNo:string,odometer:string,paymentOptions:struct<finance:struct<term:struct<apr:string,term:string,payment:string,"
    "aprDetails:struct<totalObligation:string>>>,addedItems:struct<items:array<struct<description:string,retail:string>>>,bestIncentives:struct<dealerRebates:string>>>"
)


def _positive(text: Column) -> Column:
    n = text.try_cast("double")
    return F.when((n > 0) & (n < float("inf")), n)


def feed_facts(vehicles: DataFrame, key: str, json: str = "json") -> DataFrame:
    """(key, price, apr, term_months, payment, total_obligation, vin, km, add_ons) of a platform's vehicle: the sale price before the list
    price unless it says that it has none; a rate above 0 up to 30 with its terms, else none of them; itemised lines, the rebate as a
    negative one."""
    v = vehicles.select(key, F.from_json(json, FEED).alias("v"))
    t = F.col("v.paymentOptions.finance.term")
    apr = F.when(_positive(t["apr"]) <= 30, _positive(t["apr"]))
    cents = lambda x: F.floor(x * 100 + 0.5) / 100
    vin = F.upper(F.trim("v.serialNo"))
    line = lambda name, price: F.struct(name.alias("name"), price.alias("price"))
    items = F.coalesce(F.transform("v.paymentOptions.addedItems.items", lambda i: line(F.trim(i["description"]), _positive(i["retail"]))), F.array().cast("array<struct<name:string,price:double>>"))
    items = F.filter(items, lambda i: F.coalesce(i["name"] != "", F.lit(False)) & i["price"].isNotNull())
    rebate = _positive(F.col("v.paymentOptions.bestIncentives.dealerRebates"))
    lines = F.when(rebate.isNotNull(), F.concat(items, F.array(line(F.lit("Dealer discount"), -rebate)))).otherwise(items)
    return v.select(
        key, F.when(~F.coalesce(F.col("v.hasPrice") == "false", F.lit(False)), F.coalesce(_positive(F.col("v.salePrice")), _positive(F.col("v.listPrice")))).alias("price"), apr.alias("apr"),
        F.when(apr.isNotNull(), F.floor(_positive(t["term"]) + 0.5)).cast("int").alias("term_months"), F.when(apr.isNotNull(), cents(_positive(t["payment"]))).alias("payment"),
        F.when(apr.isNotNull(), cents(_positive(t["aprDetails"]["totalObligation"]))).alias("total_obligation"), F.when(vin.rlike("^[A-HJ-NPR-Z0-9]{17}$"), vin).alias("vin"),
        _positive(F.col("v.odometer")).alias("km"), lines.alias("add_ons"),
    )


# Makes that a registry spells shorter, and the words of a drive.
SHORT_MAKES = {"mercedes benz": "mercedes", "alfa romeo": "alfa"}
POOL_DRIVES = ((r"\b(awd|4wd|4x4|sh-awd|4matic|4motion|xdrive|quattro|all.?wheel)\b", "AWD"), (r"\b(fwd|front.?wheel)\b", "FWD"), (r"\b(rwd|rear.?wheel)\b", "RWD"))


def bare(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def pooled_drives(models: DataFrame, registry: DataFrame) -> DataFrame:
    """(make, model, drive, reason, entries) for each make and model: the drive that all registry entries of the model agree on. An entry is
    the model's if its name is the model or goes on after it at a word's end; what follows says its drive. `reason` tells why there is none.

    Entries are exploded at word ends, so that they meet models by equality."""
    short = lambda c: F.coalesce(F.create_map(*[F.lit(x) for pair in SHORT_MAKES.items() for x in pair])[bare(c)], bare(c))
    words = F.split("__entry", " ")
    entries = registry.select(short(F.col("make")).alias("__mk"), bare(F.col("model")).alias("__entry")).distinct()
    heads = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    heads = entries.select("__mk", "__entry", F.explode(heads).alias("__md"))
    rest = F.substring(F.col("__entry"), F.length("__md") + 1, F.length("__entry"))
    drive = F.lit(None).cast("string")
    for pattern, name in reversed(POOL_DRIVES):
        drive = F.when(rest.rlike(pattern), name).otherwise(drive)
    pool = heads.groupBy("__mk", "__md").agg(F.count("*").alias("entries"), F.min(drive).alias("low"), F.max(drive).alias("high"), F.count(drive).alias("told"))
    m = models.select("make", "model").distinct().withColumn("__mk", short(F.col("make"))).withColumn("__md", bare(F.col("model")))
    agreed = (F.col("told") == F.col("entries")) & (F.col("low") == F.col("high"))
    reason = F.when(F.col("entries").isNull(), "no entry").when(F.col("told") == 0, "no entry tells").when(agreed, "all agree").otherwise("sold both ways")
    return m.join(pool, ["__mk", "__md"], "left").select("make", "model", F.when(agreed, F.col("low")).alias("drive"), reason.alias("reason"), F.coalesce("entries", F.lit(0)).alias("entries"))


def origin(raw: Column) -> Column:
    """https:// and the host of an address, null for mail and telephone links and for what has no host with a domain."""
    text = F.trim(raw)
    host = F.lower(F.regexp_extract(text, r"(?i)^(?:https?://)?(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(~text.rlike(r"(?i)^(mailto:|tel:)") & host.rlike(r"^[a-z0-9.-]+\.[a-z]{2,}$"), F.concat(F.lit("https://"), host))


def licensed_hosts(dealers: DataFrame, licensees: DataFrame, host: str = "host", website: str = "website", status: str = "status") -> DataFrame:
    """dealers with `licensed`: is their host that of a licensee whose licence is issued?"""
    issued = licensees.where(F.col(status).rlike("(?i)issued")).select(origin(F.col(website)).alias(host)).where(F.col(host).isNotNull()).distinct().withColumn("__issued", F.lit(True))
    return dealers.join(issued, host, "left").withColumn("licensed", F.col("__issued").isNotNull()).drop("__issued")


def unique_by(rows: DataFrame, expressions: dict[str, Column], order: Sequence[Column]) -> DataFrame:
    """The first row, by `order`, of each key that is made of expressions, as a unique index over expressions keeps it: a null in one of them
    is no key, so such rows all stay."""
    keyed = rows.withColumns({f"__{name}": e for name, e in expressions.items()})
    names = [f"__{name}" for name in expressions]
    loose = F.lit(False)
    for name in names:
        loose = loose | F.col(name).isNull()
    place = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    first = keyed.where(~loose).withColumn("__place", place).where("__place = 1").drop("__place")
    return first.unionByName(keyed.where(loose)).drop(*names)


def object_agg(rows: DataFrame, keys: Sequence[str], name: str, value: str, order: Sequence[Column]) -> DataFrame:
    """(keys, object): the names and values of each group as a map sorted by name, the last value by `order` of a name that repeats; null
    names are left out. A group's names are one object, so they are held together."""
    backwards = [c.desc() for c in order]
    last = top_per_group(rows.where(F.col(name).isNotNull()), [*keys, name], backwards)
    entries = F.sort_array(F.collect_list(F.struct(F.col(name).alias("k"), F.col(value).alias("v"))))
    return last.groupBy(*keys).agg(F.map_from_entries(entries).alias("object"))


# Vendors by a word of their mails, and where an invoice tells its amount, number, period and day of payment.
VENDORS = ("anthropic", "scrapfly", "nimble")
AMOUNTS = (
    (r"(?i)\bCA\$\s*([\d,]+\.\d{2})", "CAD"), (r"(?i)\bUS\$\s*([\d,]+\.\d{2})", "USD"), (r"(?i)\$\s*([\d,]+\.\d{2})\s*(USD|CAD)\b", None),
    (r"(?i)\b(?:total|amount due|amount paid)\b[^\d]{0,20}\$?\s*([\d,]+\.\d{2})", ""),
)
NUMBER, PERIOD = r"#?\b([A-Z0-9]{6,10}-\d{3,5})\b", r"(\d{4}-\d{2}-\d{2})\s*(?:-|–|to)\s*(\d{4}-\d{2}-\d{2})"
PAID, PAID_LONG = r"(?i)\b(?:payment date|paid on|paid)\b[^\d]{0,20}(\d{4}-\d{2}-\d{2})", r"\b(?i:payment date|paid on|paid)\b[^A-Za-z]{0,20}([A-Z][a-z]+ \d{1,2},? \d{4})"


def parsed_invoice(sender: Column, subject: Column, body: Column) -> Column:
    """struct(vendor, invoice_no, amount, currency, period_start, period_end, paid_at, note) out of a mail. An amount without a currency
    beside it has none; the note names what couldn't be read."""
    hay = F.concat(F.coalesce(subject, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))
    lower = F.lower(F.concat(F.coalesce(sender, F.lit("")), F.lit(" "), hay))
    got = lambda pattern, group=1: F.nullif(F.regexp_extract(hay, pattern, group), F.lit(""))
    vendor = F.lit("other")
    for v in reversed(VENDORS):
        vendor = F.when(F.contains(lower, F.lit(v)), v).otherwise(vendor)
    amount = F.regexp_replace(F.coalesce(*[got(p) for p, _ in AMOUNTS]), ",", "").try_cast("double")
    currency = F.lit(None).cast("string")
    for p, c in reversed(AMOUNTS):
        currency = F.when(got(p).isNotNull(), F.upper(got(p, 2)) if c is None else F.nullif(F.lit(c), F.lit(""))).otherwise(currency)
    long_day = F.try_to_timestamp(F.regexp_replace(got(PAID_LONG), ",", ""), F.lit("MMMM d yyyy")).cast("date").cast("string")
    missing = F.array_compact(F.array(F.when(vendor == "other", "vendor"), F.when(amount.isNull(), "amount"), F.when(currency.isNull(), "currency")))
    note = F.when(F.size(missing) > 0, F.concat(F.lit("could not parse: "), F.array_join(missing, ", "))).otherwise("parsed cleanly")
    return F.struct(
        vendor.alias("vendor"), got(NUMBER).alias("invoice_no"), amount.alias("amount"), currency.alias("currency"), got(PERIOD).alias("period_start"), got(PERIOD, 2).alias("period_end"),
        F.coalesce(got(PAID), long_day).alias("paid_at"), note.alias("note"),
    )
