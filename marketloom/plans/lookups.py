"""Places, recalls and conditions read out of texts made of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import claims, places
from marketloom.operators import joins, recalls
from marketloom.session import table

# texts by the remainder of a key, the same for Spark and the twin
ADDRESSES = ["Calle 5, Spain", "12 Main St, T2P 1J9", "Call (905) 555-0100 now", "x 902.555.0100", "No 403-555-01001", "Ste A1B2C3", "z9z 9z9 or H2X 1Y4", ""]
DEALERS = ["Stampede Toyota", "Red Deer Ford", "Québec Autos", "Londonderry Kia", "British Columbia Cars", None]
URLS = ["https://www.stampedetoyotacalgary.com/new", "https://grandeprairiecars.ca", "http://example.com", None, "https://x.ca/London/used"]
CITY_FIELD = ["", None, "Trois-Rivieres", "st albert", "Nowhere"]
ASKED = ["2022 honda civic", "Land Rover range rover 2019", "mercedes-benz C 300 2031", "1969 ford", "kia", "", "  alfa   romeo ", "2024", "rolls royce 2020 2021 ghost", "Aston"]
MODELS = ["Civic Touring Sedan", "Civic", "CIVIC touring", "RAV4 Prime XSE", "rav4", "F-150 Lariat Super Crew", " ", None]
BASES = [None, "Civic", "Rav4", " ", "F-150"]
SENTENCES = [
    "Price includes $3,000 delivery allowance in lieu of special financing rates.", "MSRP $52,199. Includes $2,500 Finance Cash. See dealer.", "Contact our finance department.", "Advertised price when financed with us.",
    "<script>var d = {'id':1, 'a': 'b'}; var e = \"Advertised price includes $2,000 Finance Cash and is only available with dealer financing.\";</script>", "Cash price does not include the financed savings; non-financed price shown.",
    "<script>var d = \"APR - Must finance through Ford Credit Canada. Subject to lending terms.\";</script>", "Credit approval required to qualify for advertised pricing.", "<style>.finance-cash{a:1}</style> Financing from 3.99%",
]


def _pick(values: list, key: str) -> str:
    spelt = lambda v: "NULL" if v is None else "'" + v.replace("'", "’") + "'"
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {spelt(v)}" for i, v in enumerate(values)) + " END"


FIELDS = {"city": (CITY_FIELD, "c_custkey"), "address": (ADDRESSES, "c_custkey"), "dealer name": (DEALERS, "(c_custkey + 1)"), "listing url": (URLS, "(c_custkey + 2)")}


def dealer_places(spark, sf_dir):
    """The province and city of a dealer a customer, from four fields."""
    c = table(spark, sf_dir, "customer").select("c_custkey", *[F.expr(_pick(*v)).alias(k.replace(" ", "_")) for k, v in FIELDS.items()])
    where = places.jurisdiction([(k, F.col(k.replace(" ", "_"))) for k in FIELDS])
    city = places.dealer_city(F.col("city"), [F.col("address"), F.col("dealer_name"), F.col("listing_url")])
    texts = [k.replace(" ", "_") for k in FIELDS]
    out = joins.once_a_text(c, texts, [where.alias("j"), city.alias("found_city")]).select("c_custkey", "j", F.col("found_city").alias("city"))
    return out.select("c_custkey", "j.code", "j.field", "j.signal", "j.found", places.all_in(F.col("j.code")).alias("all_in"), "city")


def recall_queries(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr(f"concat({_pick(ASKED, 'c_custkey')}, CASE WHEN c_custkey % 3 = 0 THEN ' x-trail é_b' ELSE '' END)").alias("raw"))
    return joins.once_a_text(c, ["raw"], [recalls.parsed_query(F.col("raw"), 2026).alias("q")]).select("c_custkey", "q.*")


def recall_lookups(spark, sf_dir):
    """What a registry of parts says about each customer's car."""
    k = F.col("c_custkey")
    q = table(spark, sf_dir, "customer").select(
        k.alias("query_id"), (F.lit(2015) + k % 12).cast("int").alias("year"), F.when(k % 17 != 0, F.element_at(F.array(F.lit("Honda"), F.lit("toyota "), F.lit("Ford")), (k % 3).cast("int") + 1)).alias("make"),
        F.expr(_pick(MODELS, "c_custkey")).alias("model"), F.expr(_pick(BASES, "c_custkey")).alias("base_model"),
    )
    p = F.col("p_partkey")
    registry = table(spark, sf_dir, "part").select(
        F.element_at(F.array(F.lit("HONDA"), F.lit("TOYOTA"), F.lit("FORD")), (p % 3).cast("int") + 1).alias("make"), F.element_at(F.array(F.lit("CIVIC"), F.lit("RAV4"), F.lit("F-150"), F.lit("CIVIC TOURING"), F.lit("F-150 LARIAT")), (p % 5).cast("int") + 1).alias("model"),
        (F.lit(2009) + F.floor(p / 15) % 15).cast("int").alias("year"), F.concat(F.lit("R"), (F.floor(p / 4) % 400).cast("string")).alias("recall_number"),
    )
    return recalls.recall_lookup(q, registry, "query_id")


def contingent_prices(spark, sf_dir):
    """Pages whose price hangs on financing, of the test tables' pages with a sentence or a script more."""
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(f"concat(html, {_pick(SENTENCES, 'page_id')})").alias("html"))
    out = p.select("page_id", claims.finance_contingent(F.col("html")).alias("c")).where("c is not null")
    return out.select("page_id", F.array_join("c.reasons", "; ").alias("reasons"), F.col("c.evidence").alias("evidence"))


QUERIES = {f.__name__: f for f in (dealer_places, recall_queries, recall_lookups, contingent_prices)}


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _map(table_: dict[str, str]) -> str:
    return f"MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in table_.items())}}}"


HIT = "(regexp_matches({t}, '\\b' || c || '\\b') OR contains({t}, replace(c, ' ', '')))"
UNESCAPED = "regexp_replace(regexp_replace(s[2:-2], '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')"
REASONS = " ".join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN '{reason}' END," for p, reason in claims.CONTINGENT).rstrip(",")
AROUND = " ".join(f"nullif(regexp_extract(t, '(?i)(.{{0,60}}?(?:{p}).{{0,60}})', 1), '')," for p, _ in claims.CONTINGENT).rstrip(",")
ORACLE = {
    "dealer_places": f"""WITH f AS (SELECT c_custkey AS k, unnest(['city', 'address', 'dealer name', 'listing url']) AS field, unnest([1, 2, 3, 4]) AS i,
    unnest([{', '.join(_pick(*v) for v in FIELDS.values())}]) AS raw, {_pick(*FIELDS['city'])} AS city, concat_ws(' ', {_pick(*FIELDS['address'])}, {_pick(*FIELDS['dealer name'])}, {_pick(*FIELDS['listing url'])}) AS others FROM customer),
s AS (SELECT *, lower(coalesce(raw, '')) AS t, list_filter({_list(places.PROVINCE_NAMES)}, lambda n: contains(lower(coalesce(raw, '')), n))[1] AS named, regexp_extract(upper(coalesce(raw, '')), '\\b[A-Z][0-9][A-Z]\\s?[0-9][A-Z][0-9]\\b') AS postal,
  regexp_extract(lower(coalesce(raw, '')), '(?:^|[^0-9])\\(?([2-9][0-9]{{2}})\\)?[\\s.-][0-9]{{3}}[\\s.-][0-9]{{4}}(?:[^0-9]|$)', 1) AS area FROM f),
h AS (SELECT *, list_filter({_list(places.CITY_PROVINCE)}, lambda c: {HIT.format(t='t')})[1] AS town FROM s),
g AS (SELECT *, {_map(places.PROVINCE_NAMES)}[named] AS a, {_map(places.POSTAL_LETTERS)}[postal[1:1]] AS b, {_map(places.AREA_PROVINCE)}[area] AS d, {_map(places.CITY_PROVINCE)}[town] AS e FROM h),
w AS (SELECT * FROM g WHERE coalesce(a, b, d, e) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY i) = 1),
l AS (SELECT DISTINCT k, city, list_filter({_list(sorted(places.CITY_PROVINCE, key=len, reverse=True))}, lambda c: contains(lower(others), c) OR contains(lower(others), replace(c, ' ', '')))[1] AS town FROM g)
SELECT l.k AS c_custkey, coalesce(a, b, d, e) AS code, field, CASE WHEN a IS NOT NULL THEN 'province name' WHEN b IS NOT NULL THEN 'postal code' WHEN d IS NOT NULL THEN 'area code' WHEN e IS NOT NULL THEN 'city' END AS signal,
  CASE WHEN a IS NOT NULL THEN named WHEN b IS NOT NULL THEN postal WHEN d IS NOT NULL THEN area WHEN e IS NOT NULL THEN w.town END AS found, coalesce(a, b, d, e) IN ('AB', 'BC', 'ON', 'QC') AS all_in,
  coalesce(nullif(trim(l.city), ''), array_to_string(list_transform(string_split(l.town, ' '), lambda x: upper(x[1:1]) || x[2:]), ' ')) AS city FROM l LEFT JOIN w USING (k)""",
    "recall_queries": f"""WITH q AS (SELECT c_custkey, list_filter(regexp_split_to_array({_pick(ASKED, 'c_custkey')} || CASE WHEN c_custkey % 3 = 0 THEN ' x-trail é_b' ELSE '' END, '\\s+'), lambda w: w <> '') AS w FROM customer),
y AS (SELECT *, list_filter(w, lambda x: regexp_matches(x, '^[0-9]{{4}}$') AND x BETWEEN '1970' AND '2027')[1] AS year FROM q),
r AS (SELECT *, CASE WHEN year IS NULL THEN w ELSE w[:list_position(w, year) - 1] || w[list_position(w, year) + 1:] END AS r FROM y),
h AS (SELECT *, CASE WHEN len(r) > 1 AND lower(r[1] || ' ' || r[2]) IN ('land rover', 'alfa romeo', 'aston martin', 'general motors', 'mercedes benz', 'mercedes-benz', 'rolls royce') THEN 2 ELSE 1 END AS h FROM r),
p AS (SELECT c_custkey, year, unnest(['make', 'model']) AS part, unnest([array_to_string(r[:h], ' '), array_to_string(r[h + 1:], ' ')]) AS t FROM h),
u AS (SELECT c_custkey, year, part, array_to_string(list_transform(regexp_extract_all(t, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z0-9_]') THEN upper(x[1:1]) || x[2:] ELSE x END), '') AS t FROM p)
SELECT c_custkey, CAST(year AS INT) AS year, nullif(max(t) FILTER (part = 'make'), '') AS make, nullif(max(t) FILTER (part = 'model'), '') AS model FROM u GROUP BY c_custkey, year""",
    "recall_lookups": f"""WITH q AS (SELECT c_custkey AS id, 2015 + c_custkey % 12 AS year, CASE WHEN c_custkey % 17 <> 0 THEN ['HONDA', 'TOYOTA', 'FORD'][c_custkey % 3 + 1] END AS mk, {_pick(MODELS, 'c_custkey')} AS model, {_pick(BASES, 'c_custkey')} AS base FROM customer),
w AS (SELECT *, string_split(trim(model), ' ') AS s FROM q WHERE mk IS NOT NULL AND model IS NOT NULL),
c AS (SELECT id, year, mk, [trim(coalesce(base, '')), trim(model)] || list_transform(range(len(s) - 1, 0, -1), lambda n: array_to_string(s[:n], ' ')) AS names FROM w),
n AS (SELECT id, year, mk, generate_subscripts(names, 1) AS pos, unnest(names) AS name FROM c),
d AS (SELECT * FROM n WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY id, upper(name) ORDER BY pos) = 1),
g AS (SELECT ['HONDA', 'TOYOTA', 'FORD'][p_partkey % 3 + 1] AS mk, ['CIVIC', 'RAV4', 'F-150', 'CIVIC TOURING', 'F-150 LARIAT'][p_partkey % 5 + 1] AS md, 2009 + p_partkey // 15 % 15 AS ry, 'R' || p_partkey // 4 % 400 AS num FROM part),
m AS (SELECT mk, md, ry, count(DISTINCT num) AS n FROM g GROUP BY ALL),
j AS (SELECT d.*, ry, n FROM d LEFT JOIN m ON m.mk = d.mk AND md = upper(name)),
f AS (SELECT id, min_by(n, pos) FILTER (ry = year) AS n, min_by(name, pos) FILTER (ry = year) AS hit, min_by(name, pos) FILTER (ry BETWEEN year - 10 AND year - 1) AS known FROM j GROUP BY id)
SELECT id AS query_id, coalesce(n, 0) AS count, hit AS matched_model, hit IS NOT NULL OR known IS NOT NULL AS confirmed, CASE WHEN hit IS NULL THEN known END AS confirmed_by FROM f""",
    "contingent_prices": f"""WITH p AS (SELECT page_id, html || {_pick(SENTENCES, 'page_id')} AS h FROM pages),
x AS (SELECT page_id, h, list_transform(flatten(list_transform(regexp_extract_all(h, '<script\\b[^>]*>.*?</script>', 0, 'is'), lambda b: regexp_extract_all(b, '"[^"]{{12,400}}"'))), lambda s: trim({UNESCAPED})) AS said FROM p),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '<script\\b[^>]*>.*?</script>', ' ', 'gis'), '<style\\b[^>]*>.*?</style>', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' ', 'g') ||
  CASE WHEN contains(h, '<script') THEN ' . ' || array_to_string(list_filter(said, lambda v: len(list_filter(string_split(v, ' '), lambda w: regexp_matches(w, '[A-Za-z]{{2,}}'))) >= 4), ' . ') ELSE '' END, '[\\s\\x{{a0}}]+', ' ', 'g') AS t FROM x),
r AS (SELECT page_id, list_filter([{REASONS}], lambda y: y IS NOT NULL) AS rs, coalesce({AROUND}) AS around FROM c)
SELECT page_id, array_to_string(list_transform(list_filter(list_zip(rs, range(len(rs))), lambda z: list_position(rs, z[1]) = z[2] + 1), lambda z: z[1]), '; ') AS reasons, left(trim(around), 200) AS evidence FROM r WHERE len(rs) > 0""",
}
