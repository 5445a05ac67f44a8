"""Where a dealer is, from whatever a report says about it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from marketloom.functions.columns import let

# Names of provinces, first letters of postal codes, area codes and cities by province, in the order in which they are
# tried, and the provinces whose advertised prices must be all-in.
PROVINCE_NAMES = {
    "alberta": "AB", "british columbia": "BC", "ontario": "ON", "quebec": "QC", "québec": "QC", "saskatchewan": "SK", "manitoba": "MB",
    "nova scotia": "NS", "new brunswick": "NB", "newfoundland": "NL", "prince edward island": "PE",
}
POSTAL_LETTERS = {"T": "AB", "V": "BC", "S": "SK", "R": "MB", "G": "QC", "H": "QC", "J": "QC", "E": "NB", "B": "NS", "C": "PE", "A": "NL"}
AREA_CODES = {
    "AB": "403,587,780,825,368", "BC": "604,778,236,250,672", "ON": "416,647,437,905,289,365,613,343,519,226,548,705,249,807,942",
    "QC": "514,438,450,579,418,581,367,819,873,263,354,468", "SK": "306,639", "MB": "204,431", "NS": "902,782", "NB": "506", "NL": "709",
}
CITIES = {
    "AB": "calgary,edmonton,red deer,lethbridge,airdrie,okotoks,st albert,sherwood park,grande prairie,medicine hat,fort mcmurray,spruce grove,leduc,cochrane,camrose,lloydminster",
    "BC": "vancouver,surrey,burnaby,richmond,victoria,kelowna,abbotsford,coquitlam,langley,nanaimo,kamloops",
    "ON": "toronto,ottawa,mississauga,brampton,hamilton,london,markham,vaughan,kitchener,windsor,oshawa,barrie",
    "QC": "montreal,quebec,laval,gatineau,longueuil,sherbrooke,trois-rivieres,levis",
}
ALL_IN = ("AB", "BC", "ON", "QC")
# Of two provinces with one area code the one named last has it.
SHARED_CODES = {"902": "PE"}

CITY_PROVINCE = {city: code for code, cities in CITIES.items() for city in cities.split(",")}
AREA_PROVINCE = {area: code for code, areas in AREA_CODES.items() for area in areas.split(",")} | SHARED_CODES
POSTAL = r"\b[A-Z]\d[A-Z]\s?\d[A-Z]\d\b"
PHONE = r"(?:^|[^\d])\(?([2-9]\d{2})\)?[\s.-]\d{3}[\s.-]\d{4}(?!\d)"
NOWHERE = "struct<code:string,signal:string,found:string>"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def _city(text: Column) -> Column:
    """The first city, in their order, that a lower-case text names as words or runs together, as addresses of sites do."""
    names = list(CITY_PROVINCE)
    some = "|".join(dict.fromkeys(n for city in names for n in (city, city.replace(" ", ""))))
    hit = lambda c: F.rlike(text, F.concat(F.lit(r"\b"), c, F.lit(r"\b"))) | F.contains(text, F.replace(c, F.lit(" "), F.lit("")))
    found = F.filter(F.array(*[F.lit(n) for n in names]), hit)
    return F.when(text.rlike(some), F.get(found, 0))


def scan_place(raw: Column) -> Column:
    """struct(code, signal, found) out of a text: a province's name, else the first postal code, else the first phone number's area, else a
    city; null where nothing is known."""
    return let(F.lower(F.coalesce(raw, F.lit(""))), _scanned)


def _scanned(text: Column) -> Column:
    def signal(name: str, table: dict[str, str], found: Column, key: Column | None = None) -> Column:
        placed = lambda f: F.when(_lookup(table, key(f) if key else f).isNotNull(), F.struct(_lookup(table, key(f) if key else f).alias("code"), F.lit(name).alias("signal"), f.alias("found")))
        return let(found, placed)

    named = F.get(F.filter(F.array(*[F.lit(n) for n in PROVINCE_NAMES]), lambda n: F.contains(text, n)), 0)
    return F.coalesce(
        signal("province name", PROVINCE_NAMES, named),
        signal("postal code", POSTAL_LETTERS, F.regexp_extract(F.upper(text), POSTAL, 0), lambda f: F.substring(f, 1, 1)),
        signal("area code", AREA_PROVINCE, F.regexp_extract(text, PHONE, 1)),
        signal("city", CITY_PROVINCE, _city(text)),
    )


def jurisdiction(fields: Sequence[tuple[str, Column]]) -> Column:
    """struct(code, field, signal, found) of the first field that tells a province; null where none does."""
    of = lambda name: lambda hit: F.when(hit.isNotNull(), F.struct(hit["code"].alias("code"), F.lit(name).alias("field"), hit["signal"].alias("signal"), hit["found"].alias("found")))
    return F.coalesce(*[let(scan_place(value), of(name)) for name, value in fields])


def all_in(code: Column) -> Column:
    """Must advertised prices hold all fees? Null, not no, where the province isn't known: then nothing may be claimed."""
    return F.when(code.isNotNull(), code.isin(*ALL_IN))


def dealer_city(stated: Column, others: Sequence[Column]) -> Column:
    """The city as stated, else the longest name of a city within the other texts, also run together, each word with a capital."""
    hay = F.concat_ws(" ", *[F.lower(F.coalesce(c, F.lit(""))) for c in others])
    longest = sorted(CITY_PROVINCE, key=len, reverse=True)
    found = F.get(F.filter(F.array(*[F.lit(c) for c in longest]), lambda c: F.contains(hay, c) | F.contains(hay, F.replace(c, F.lit(" "), F.lit("")))), 0)
    return F.coalesce(F.nullif(F.trim(stated), F.lit("")), title_case(found))


def title_case(text: Column) -> Column:
    """A capital at the start of each run of letters, digits and underscores; the rest as it is."""
    parts = F.split(text, r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    raised = F.transform(parts, lambda p: F.when(p.rlike("^[A-Za-z0-9_]"), F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))).otherwise(p))
    return F.array_join(raised, "")
