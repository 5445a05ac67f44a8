"""Record-level rules as column expressions: nothing here leaves the JVM."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, where value is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


# --- numbers -----------------------------------------------------------------------------------------------------


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half towards positive infinity."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def share_of(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage with a zero guard."""
    return F.round(100.0 * part / F.greatest(F.lit(1), whole), digits)


def nearest_rank(values: Column, p: float) -> Column:
    """An observed value of an array of numbers, never interpolated; null for an empty array."""
    ordered = F.sort_array(values)
    place = F.floor((F.size(ordered) - 1) * F.lit(float(p)) + 0.5).cast("int") + 1
    return F.when(F.size(ordered) > 0, F.element_at(ordered, F.greatest(place, F.lit(1))))


def payment(principal: Column, apr: Column, months: Column) -> Column:
    """Monthly amortised payment to the cent; a rate of zero spreads the principal evenly."""
    rate = apr / 1200.0
    growth = F.pow(1 + rate, months)
    return half_up(F.when(apr == 0, principal / months).otherwise(principal * rate * growth / F.nullif(growth - 1, F.lit(0.0))), 2)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


# --- prices ------------------------------------------------------------------------------------------------------

#: What may lie between a catalogue price and the price on the windscreen, by what the catalogue price holds.
FREIGHT_AND_FEES, FEES_ONLY = 5500.0, 1500.0
AT_TOLERANCE_PCT = 0.05


def effective_price(sale: Column, list_: Column) -> Column:
    """Sale before list; zero and below count as missing."""
    return F.coalesce(F.when(sale > 0, sale), F.when(list_ > 0, list_))


def reference_window(msrp: Column, all_in: Column, basis: Column) -> Column:
    """struct(low, high, exact); null without a usable catalogue price."""
    top = F.when(basis == "incl_freight", msrp + FEES_ONLY).otherwise(msrp + FREIGHT_AND_FEES)
    return F.when(all_in > 0, F.struct(all_in.alias("low"), all_in.alias("high"), F.lit(True).alias("exact"))).when(
        msrp > 0, F.struct(msrp.alias("low"), top.alias("high"), F.lit(False).alias("exact"))
    )


def direction(price: Column, window: Column) -> Column:
    """struct(dir, floor_pct): a price inside an inexact window is indeterminate, never over or under."""
    low = 100.0 * (price - window["low"]) / window["low"]
    high = 100.0 * (price - window["high"]) / window["high"]
    kind = F.when(low < -AT_TOLERANCE_PCT, "under").when(high > AT_TOLERANCE_PCT, "over").when(window["exact"], "at").otherwise("indeterminate")
    floor = F.when(low < -AT_TOLERANCE_PCT, low).when(high > AT_TOLERANCE_PCT, high).when(window["exact"], low)
    return F.when((price > 0) & window.isNotNull(), F.struct(kind.alias("dir"), floor.alias("floor_pct")))


def inflation_floor(stated: Column, window: Column) -> Column:
    """By how many percent a stated reference price is above anything the catalogue allows."""
    return F.when((stated > 0) & (stated > window["high"]), 100.0 * (stated - window["high"]) / window["high"])


def price_implausible(reference: Column, asking: Column) -> Column:
    gap = asking - reference
    return F.coalesce((asking > 0) & (reference > 0) & (gap > reference * 0.20) & (gap > 6000), F.lit(False))


# --- words -------------------------------------------------------------------------------------------------------


def _compatible() -> tuple[str, str]:
    """Characters beyond ASCII whose compatibility form is one ASCII character, and that character."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(128, 0x20000) if not 0xD800 <= c < 0xE000]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and b < "\x80"]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_WIDE, _PLAIN = _compatible()


def city_key(raw: Column) -> Column:
    """One key for the spellings of a city: full-width and other compatibility letters to ASCII, province suffix off, Saint
    and Sainte folded, punctuation to blanks. Compatibility forms of several letters (ligatures) are not taken apart."""
    s = F.lower(F.translate(raw, _WIDE, _PLAIN))
    s = F.regexp_replace(s, r",\s*(ab|alta|alberta)\.?\s*$", "")
    s = F.regexp_replace(s, r"\b(sainte|ste)\b", "ste")
    s = F.regexp_replace(s, r"\b(saint|st)\b", "st")
    s = F.trim(F.regexp_replace(s, r"[^a-z0-9]+", " "))
    return F.nullif(s, F.lit(""))


def drive(text: Column) -> Column:
    t = F.lower(F.regexp_replace(text, r"[‐-―−]", "-"))
    return (
        F.when(t.rlike(r"all.?wheel|\bawd\b|4matic|4motion|xdrive|quattro|\b4wd\b|4x4"), "AWD")
        .when(t.rlike(r"front.?wheel|\bfwd\b"), "FWD")
        .when(t.rlike(r"rear.?wheel|\brwd\b"), "RWD")
    )


def fuel(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.rlike("phev|plug"), "phev").when(t.rlike("hybrid"), "hybrid").when(t.rlike(r"bev|electric|\bev\b"), "bev").when(t.rlike("diesel"), "diesel").otherwise("gas")


def email_identity(raw: Column) -> Column:
    """Mailboxes that deliver to one person: no tag, no dots and one domain where the host ignores them."""
    v = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    local = F.split_part(F.split_part(v, F.lit("@"), F.lit(1)), F.lit("+"), F.lit(1))
    domain = F.split_part(v, F.lit("@"), F.lit(2))
    dotless = domain.isin("gmail.com", "googlemail.com")
    local = F.when(dotless, F.regexp_replace(local, r"\.", "")).otherwise(local)
    domain = F.when(dotless, "gmail.com").otherwise(domain)
    return F.when(~F.contains(v, F.lit("@")) | (local == ""), v).otherwise(F.concat(local, F.lit("@"), domain))


#: Fee labels by the first pattern that a line item's name matches.
FEE_LABELS = [
    (r"\b(nitrogen|n2)\b", "nitrogen"),
    (r"(market\s*(value\s*)?adjustment|additional\s*dealer\s*mark|^adm\b|dealer\s*mark[- ]?up)", "market_adjustment"),
    (r"\brecon(dition(ing)?)?\b", "reconditioning"),
    (r"(doc(ument(ation)?)?)\s*(fee|charge)|^doc\b", "documentation"),
    (r"admin(istration|istrative)?\s*(fee|charge)?", "admin"),
    (r"(paint|fabric|interior|exterior|appearance|protection\s*package|ceramic|sealant)", "protection_pkg"),
    (r"(rust|undercoat|corrosion|rustproof)", "rustproofing"),
    (r"(tire\s*&?\s*(and)?\s*(wheel|rim)|wheel\s*&?\s*(and)?\s*tire|road\s*hazard)", "tire_wheel"),
    (r"(theft|vin\s*etch|anti[- ]?theft|window\s*etch)", "theft_protection"),
    (r"(gap|guaranteed\s*asset)", "gap"),
    (r"(extended\s*warranty|service\s*contract|protection\s*plan|mechanical\s*breakdown|vsc\b)", "extended_warranty"),
    (r"(freight|pdi|pre[- ]?delivery|destination|transport)", "freight_pdi"),
    (r"(amvic|omvic|regulatory|licen[sc]\w*|registration)", "regulatory"),
    (r"(tire\s*(levy|tax|fee|recycl)|environmental|green\s*levy|(a/?c|air\s*condition\w*)\s*tax|luxury\s*tax|excise)", "levy_tax"),
    (r"(block\s*heater|wheel\s*lock|cargo|mats|accessor)", "accessories"),
    (r"(delivery|dealer\s*prep|preparation)", "delivery_prep"),
]


#: For each pattern of FEE_LABELS pieces of which a text that matches has at least one.
FEE_PIECES = {
    "nitrogen": "nitrogen n2", "market_adjustment": "market dealer adm", "reconditioning": "recon", "documentation": "doc", "admin": "admin",
    "protection_pkg": "paint fabric interior exterior appearance protection ceramic sealant", "rustproofing": "rust undercoat corrosion", "tire_wheel": "tire road",
    "theft_protection": "theft etch", "gap": "gap guaranteed", "extended_warranty": "extended service protection mechanical vsc", "freight_pdi": "freight pdi delivery destination transport",
    "regulatory": "amvic omvic regulatory licen registration", "levy_tax": "tire environmental levy tax excise", "accessories": "heater lock cargo mats accessor", "delivery_prep": "delivery prep",
}


def fee_label(raw: Column, labels: list[tuple[str, str]] = FEE_LABELS) -> Column:
    """The first label whose pattern the text has; a pattern is only tried where the text has a piece that it needs, as most don't."""
    s = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    out = F.when(s == "", "unlabeled")
    for pattern, label in labels:
        pieces = FEE_PIECES[label].split() if (pattern, label) in FEE_LABELS else []
        some = functools.reduce(lambda a, b: a | b, [s.contains(x) for x in pieces]) if pieces else F.lit(True)
        out = out.when(some & s.rlike(pattern), label)
    return out.otherwise("other")


def device_class(agent: Column) -> Column:
    a = F.lower(F.coalesce(agent, F.lit("")))
    return F.when(a.rlike("ipad|tablet"), "tablet").when(a.rlike("mobi|iphone|android"), "mobile").otherwise("desktop")


def _fnv1a(codes: Column) -> Column:
    step = lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619), F.lit(1 << 32))
    return F.lpad(F.lower(F.hex(F.aggregate(codes, F.lit(2166136261).cast("long"), step))), 8, "0")


def _units(text: Column, charset: str, digits: int) -> Column:
    """Code units of a text as whole numbers."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(text, charset)), F.lit(f"(.{{{digits}}})"), F.lit(1)), lambda unit: F.conv(unit, 16, 10).cast("long"))


def fnv1a_32(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as eight hex digits."""
    return _fnv1a(_units(text, "utf-8", 2))


def dealer_id(name: Column, city: Column) -> Column:
    """A dealer's opaque id: FNV-1a over the UTF-16 units of "name|city" in lower case, "unknown" without either."""
    tidy = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^\s+|\s+$", "")
    key = F.concat(tidy(name), F.lit("|"), tidy(city))
    return F.when(key == "|", "unknown").otherwise(F.concat(F.lit("d_"), _fnv1a(_units(key, "utf-16be", 4))))


# --- vehicle identification numbers ------------------------------------------------------------------------------

#: Weight of each place of the number, and what its letters count.
VIN_WEIGHTS = [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]
VIN_FROM, VIN_TO = "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789"


def vin_valid(raw: Column) -> Column:
    """Check digit at place 9: weighted sum of the places mod 11, ten written X. Null for a missing number."""
    vin = F.upper(F.trim(raw))
    counts = F.translate(vin, VIN_FROM, VIN_TO)
    terms = [F.substring(counts, i + 1, 1).try_cast("int") * w for i, w in enumerate(VIN_WEIGHTS) if w]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    expected = F.when(total % 11 == 10, "X").otherwise((total % 11).cast("string"))
    formed = vin.rlike("^[A-HJ-NPR-Z0-9]{17}$")
    return F.when(vin.isNotNull() & (vin != ""), formed & F.coalesce(F.substring(vin, 9, 1) == expected, F.lit(False)))
