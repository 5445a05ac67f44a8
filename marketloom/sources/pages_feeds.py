"""Inventories inside raw pages: objects that a script assigns, and repeated cards."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from marketloom.functions.columns import vin_valid

#: A string, whole or cut off at the end of the page, or a bracket.
_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)|[{}\[\]]', re.S)
_CLOSES = {"{": "}", "[": "]"}


def balanced(text: str | None, marker: str) -> str | None:
    """The first object or list that follows `marker`, up to the bracket that closes it; brackets within strings don't count.
    Null without the marker, where a bracket of the wrong kind closes, and where nothing does, as in a page cut off."""
    at = -1 if text is None else text.find(marker)
    if at < 0:
        return None
    return _closed(text, at + len(marker) - 1)


def _closed(text: str, start: int) -> str | None:
    """The object or list whose opening bracket is at `start`."""
    open_: list[str] = []
    for token in _TOKEN.finditer(text, start):
        found = token.group()
        if found in _CLOSES:
            open_.append(_CLOSES[found])
        elif found[0] != '"':
            if not open_ or open_.pop() != found:
                return None
            if not open_:
                return text[start : token.end()]
    return None


def after_key(text: str | None, key: str) -> Iterator[str]:
    """The objects and lists that follow `"key":` anywhere in a text, one by one; what never closes is left out."""
    for found in re.finditer(rf'"{re.escape(key)}"\s*:\s*(?=[{{\[])', text or ""):
        whole = _closed(text, found.end())
        if whole is not None:
            yield whole


def assigned_object(html: Column, marker: str) -> Column:
    """balanced() as a column; the marker ends with the opening bracket. Pages without it never leave the JVM's side."""
    if not marker or marker[-1] not in _CLOSES:
        raise ValueError("the marker ends with the bracket that opens the object")
    scan = F.pandas_udf(lambda texts: pd.Series([balanced(t, marker) for t in texts], dtype=object), "string")
    return scan(F.when(F.contains(html, F.lit(marker)), html))


#: A vehicle of an assigned object, as far as it is read; all values as text, since sites quote some numbers and not others.
UNIT = "struct<vin:string,stockNum:string,year:string,make:string,model:string,trim:string,condition:string,mileage:string,OriginalPrice:string,demo:string>"
MARKER = "vehicleArray = {"


def _number(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9.]", "").try_cast("double")


def inline_vehicles(pages: DataFrame, marker: str = MARKER, html: str = "html") -> DataFrame:
    """The vehicles of the object that each page's script assigns, keyed by unit: other columns of pages, then vin, stock_no, year,
    make, model, trim, condition, km, list_price, demo.

    An object that never closes, or that is no JSON, gives no rows rather than half of them; a vehicle without a valid number is left
    out and doesn't take the others along. The site's own list price is not taken, as no other source confirms it.
    """
    keep = [c for c in pages.columns if c != html]
    units = F.from_json(assigned_object(F.col(html), marker), f"map<string,{UNIT}>")
    v = pages.select(*keep, F.explode(F.map_values(units)).alias("v"))
    vin = F.upper(F.trim("v.vin"))
    price = _number(F.col("v.OriginalPrice"))
    rows = v.select(
        *keep, vin.alias("vin"), F.col("v.stockNum").alias("stock_no"), _number(F.col("v.year")).cast("int").alias("year"), F.col("v.make").alias("make"),
        F.col("v.model").alias("model"), F.nullif(F.col("v.trim"), F.lit("")).alias("trim"),
        F.when(F.lower("v.condition").contains("used"), "used").otherwise("new").alias("condition"), _number(F.col("v.mileage")).cast("int").alias("km"),
        F.when(price > 0, price).alias("list_price"), F.coalesce(F.col("v.demo").isin("1", "true"), F.lit(False)).alias("demo"),
    )
    return rows.where(F.coalesce(vin_valid(F.col("vin")), F.lit(False)))


#: How the group's cards begin and end, and what they print around a price.
CARD_START = '<a class="contents" aria-label="'
CARD_END = "Check Availability"
PRICE_LABELS = ("cash price", "your price", "all-in price")
WITHHELD = ("call for price", "contact us for price", "contact for price", "please call", "price on request")
TABS = (*PRICE_LABELS, *WITHHELD, "finance", "lease")
#: How much of a card is read where its closing link is missing.
LONGEST = 60_000


def plain_text(html: Column) -> Column:
    """Markup and scripts taken out, the usual references decoded, white space as one blank."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", " "), r"<[^>]+>", " ")
    for name, value in (("&nbsp;", " "), ("&#x27;", "'"), ("&#39;", "'"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def card_vehicles(pages: DataFrame, html: str = "html") -> DataFrame:
    """A row a vehicle card: other columns of pages, then place (from 0), year, make, model_trim, condition, list_price, was_price,
    withheld, dealer, city, url.

    A card ends at its own closing link, however heavy its markup is, or where the next begins, so what a page says below its last card
    is no part of it. A price that the dealer withholds is told apart from one that can't be read. The dealer stands before the closing link, behind what the card
    prints around its price. Cards have no vehicle number.
    """
    keep = [c for c in pages.columns if c != html]
    parts = F.split(F.col(html), rf"(?={CARD_START})")
    cards = pages.select(*keep, F.posexplode(F.filter(parts, lambda c: F.startswith(c, F.lit(CARD_START)))).alias("place", "card"))
    end = F.locate(CARD_END, F.col("card"))
    cards = cards.withColumn("card", F.substring(F.col("card"), F.lit(1), F.when(end > 0, end + len(CARD_END) - 1).otherwise(F.lit(LONGEST))))
    cards = cards.select(
        *keep, "place", _found(F.col("card"), r'aria-label="([^"]+)"').alias("label"), _found(F.col("card"), r'href="([^"?]+)').alias("url"), plain_text(F.col("card")).alias("text")
    )
    name = r"^(\d{4})\s+(\S+)\s+(.*)$"
    money = r"\$\s*([\d,]{4,})"
    amount = lambda pattern: F.regexp_replace(_found(F.col("text"), pattern), ",", "").try_cast("double")
    where = rf"([A-Za-z][A-Za-z0-9'&.-]*(?:\s+[A-Za-z][A-Za-z0-9'&.-]*){{0,5}}),\s*([A-Za-z][A-Za-z.-]*(?:\s+[A-Za-z.-]+){{0,2}})\s+{CARD_END}"
    withheld = F.col("text").rlike(f"(?i){'|'.join(WITHHELD)}")
    dealer = _found(F.col("text"), where)
    label = F.trim("label")
    return cards.where(label.rlike(name)).select(
        *keep, "place", _found(label, name).cast("int").alias("year"), _found(label, name, 2).alias("make"), F.trim(_found(label, name, 3)).alias("model_trim"),
        F.when(F.col("text").rlike(r"(?i)\|\s*new\b"), "new").when(F.col("text").rlike(r"(?i)\|\s*used\b"), "used").alias("condition"),
        F.when(~withheld, F.nullif(amount(rf"(?i)(?:{'|'.join(PRICE_LABELS)})[^$]{{0,60}}{money}"), F.lit(0.0))).alias("list_price"),
        F.nullif(amount(rf"(?i)was\s*{money}"), F.lit(0.0)).alias("was_price"), withheld.alias("withheld"),
        F.nullif(F.trim(F.regexp_replace(dealer, rf"(?i)^.*(?:{'|'.join(TABS)})\s*", "")), F.lit("")).alias("dealer"),
        F.trim(_found(F.col("text"), where, 2)).alias("city"), "url",
    )


#: Where the platform's pages keep cash incentives and what an entry holds; all values as text.
INCENTIVES = "cash_incentives"
OFFER = "name:string,cash_value:string,payee:string,expiryDate:string"
ENTRY = f"struct<amount:string,totalAmount:string,stackable_offers:array<struct<{OFFER}>>>"
#: Fixed value: words that make an offer depend on who buys.
CONDITION = r"(?i)eligible|potential|qualif"


def incentive_entries(text: str | None) -> list[str]:
    """The entries of a page's incentive blocks that are objects with a list of offers, as JSON; other shapes are passed over."""
    out = []
    for block in after_key(text, INCENTIVES):
        try:
            entries = json.loads(block)
        except ValueError:
            continue
        for entry in entries if isinstance(entries, list) else []:
            offers = entry.get("stackable_offers") if isinstance(entry, dict) else None
            if isinstance(offers, list):
                out.append(json.dumps({**entry, "stackable_offers": [o for o in offers if isinstance(o, dict)]}))
    return out


def money(text: Column) -> Column:
    """A positive amount, written with or without a dollar sign and commas; null for anything else."""
    bare = F.regexp_replace(text, r"(?U)[$,\s]", "")
    amount = F.when(bare.rlike(r"^[0-9]+(\.[0-9]+)?$"), bare.cast("double"))
    return F.when(amount > 0, amount)


def cash_incentives(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, price_after, total, offers): the richest set of stacked offers that a page states, pages without one have no row.

    A page repeats its block for each way to pay. Of the sets with a total, stated or else summed up, the one with the most named offers
    counts, then the largest total, then the first. A block that doesn't close or isn't JSON is no set; an offer without a name is none.
    """
    scan = F.pandas_udf(lambda texts: pd.Series([incentive_entries(t) for t in texts], dtype=object), "array<string>")
    found = scan(F.when(F.contains(F.col(html), F.lit(f'"{INCENTIVES}"')), F.col(html)))
    rows = pages.select(key, F.posexplode(found).alias("at", "entry")).select(key, "at", F.from_json("entry", ENTRY).alias("e"))
    offer = lambda o: F.struct(
        F.trim(o["name"]).alias("name"), money(o["cash_value"]).alias("value"), F.nullif(F.trim(o["payee"]), F.lit("")).alias("payee"),
        F.nullif(F.trim(o["expiryDate"]), F.lit("")).alias("expiry"),
    )
    offers = F.filter(F.transform("e.stackable_offers", offer), lambda o: F.coalesce(o["name"] != "", F.lit(False)))
    rows = rows.select(key, "at", money(F.col("e.amount")).alias("price_after"), F.col("e.totalAmount").alias("stated"), offers.alias("offers")).where(F.size("offers") > 0)
    summed = F.aggregate("offers", F.lit(0.0), lambda t, o: t + F.coalesce(o["value"], F.lit(0.0)))
    rows = rows.withColumn("total", F.coalesce(money(F.col("stated")), summed)).where("total > 0")
    best = rows.groupBy(key).agg(F.max_by(F.struct("price_after", "total", "offers"), F.struct(F.size("offers"), F.col("total"), -F.col("at"))).alias("b"))
    return best.select(key, "b.*")


def incentive_lines(incentives: DataFrame, key: str) -> DataFrame:
    """(key, place, name, price, conditional, to_dealer, verdict, expiry): each offer as a discount line. `watch` where the money goes to
    the dealer or depends on who buys, else `good`."""
    rows = incentives.select(key, F.posexplode("offers").alias("place", "o"))
    conditional = F.col("o.name").rlike(CONDITION)
    to_dealer = F.coalesce(F.upper("o.payee") == "DEALER", F.lit(False))
    return rows.select(
        key, "place", F.col("o.name").alias("name"), (-F.col("o.value")).alias("price"), conditional.alias("conditional"), to_dealer.alias("to_dealer"),
        F.when(conditional | to_dealer, "watch").otherwise("good").alias("verdict"), F.col("o.expiry").alias("expiry"),
    )
