"""Price reads over listings made of the test tables: line items are listings, parts their catalogue, suppliers dealers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketloom.functions import columns as C
from marketloom.functions.windows import interpolated, nearest_ranks
from marketloom.operators import catalog_match, deviation, joins, market_index
from marketloom.session import table

AS_OF = dt.datetime(1998, 12, 1)
#: Prices of the tables are about six times the reference price of a part.
SCALE = 5.0

LISTINGS = """
listings AS (
  SELECT l_suppkey AS dealer_id, p_partkey AS part_id, p_brand AS make, p_type AS model, p_name AS trim_name,
         l_extendedprice / l_quantity AS list_price, CASE WHEN l_discount > 0 THEN l_extendedprice / l_quantity * (1 - l_discount) END AS sale_price,
         p_retailprice * 5.0 AS msrp, CASE WHEN l_returnflag = 'N' THEN 'new' ELSE 'used' END AS condition,
         CASE WHEN l_linestatus = 'F' AND l_returnflag = 'N' THEN CAST(l_shipdate AS DATE) END AS delisted_on, l_shipdate AS updated_at, l_tax, p_size
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("dealer_id"), F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("make"), F.col("p_type").alias("model"), F.col("p_name").alias("trim_name"),
        price.alias("list_price"), F.when(F.col("l_discount") > 0, price * (1 - F.col("l_discount"))).alias("sale_price"), (F.col("p_retailprice") * SCALE).alias("msrp"),
        F.when(F.col("l_returnflag") == "N", "new").otherwise("used").alias("condition"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "N"), F.to_date("l_shipdate")).alias("delisted_on"), F.col("l_shipdate").alias("updated_at"), "l_tax", "p_size",
    )


def deviation_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deviation.deviation_summary(listings(spark, sf_dir))


DEVIATION_SQL = f"""
WITH {LISTINGS},
d AS (SELECT dealer_id, 100.0 * (sale_price - msrp) / msrp AS pct FROM listings WHERE delisted_on IS NULL AND condition = 'new' AND msrp > 0 AND sale_price > 0),
a AS (SELECT count(*) AS n, count(DISTINCT dealer_id) AS dealers, count(*) FILTER (pct > 0.05) AS over_n, count(*) FILTER (pct < -0.05) AS under_n,
             count(*) FILTER (pct BETWEEN -0.05 AND 0.05) AS at_n, quantile_cont(pct, [{", ".join(str(i / 20) for i in range(21))}]) AS c, quantile_cont(pct, 0.5) FILTER (pct < -0.05) AS m FROM d)
SELECT n >= 25 AS enough, n, 25 AS min_n, dealers, round(c[11], 2) AS median_pct, round(c[6], 2) AS p25_pct, round(c[16], 2) AS p75_pct, over_n, under_n, at_n,
       round(100.0::DOUBLE * over_n / n, 1) AS over_share, round(100.0::DOUBLE * under_n / n, 1) AS under_share, round(coalesce(m, 0), 2) AS median_discount_pct,
       array_to_string(list_transform(c, lambda x: CAST(round(x, 1) AS VARCHAR)), '|') AS curve
FROM a
"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live listings with their deviation and the key of a city: the dealer's nation."""
    city = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("dealer_id"), C.city_key(F.initcap("n_name")).alias("city"))
    rows = listings(spark, sf_dir).where("delisted_on is null and list_price > 0 and msrp > 0")
    dollars = F.col("list_price") - F.col("msrp")
    return rows.join(city, "dealer_id").select("city", "dealer_id", (100.0 * dollars / F.col("msrp")).alias("deviation_pct"), dollars.alias("deviation_dollars"), "updated_at")


def city_price_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = market_index.city_index(_matched(spark, sf_dir), AS_OF, stale_days=60)
    return out.select("city", "n_dealers", "n_listings", *[F.round(c, 4).alias(c) for c in ("index_pct", "p25_pct", "p75_pct")], "avg_deviation_dollars", "max_updated_at", "is_publishable")


CITY_SQL = f"""
WITH {LISTINGS},
m AS (SELECT trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS city, dealer_id, 100.0 * (list_price - msrp) / msrp AS pct, list_price - msrp AS dollars, updated_at
      FROM listings JOIN supplier ON dealer_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE delisted_on IS NULL AND list_price > 0 AND msrp > 0),
g AS (SELECT city, count(DISTINCT dealer_id) AS n_dealers, count(*) AS n_listings, list(pct ORDER BY pct) AS p, avg(dollars) AS dollars, max(updated_at) AS max_updated_at FROM m GROUP BY city)
SELECT city, n_dealers, n_listings, round(p[CAST(floor((n_listings - 1) * 0.5 + 0.5) AS INT) + 1], 4) AS index_pct, round(p[CAST(floor((n_listings - 1) * 0.25 + 0.5) AS INT) + 1], 4) AS p25_pct,
       round(p[CAST(floor((n_listings - 1) * 0.75 + 0.5) AS INT) + 1], 4) AS p75_pct, dollars AS avg_deviation_dollars, max_updated_at,
       n_dealers >= 3 AND n_listings >= 12 AND max_updated_at >= TIMESTAMP '1998-10-02' AS is_publishable
FROM g
"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("dealer_id"), F.col("r_name").alias("province"))
    rows = listings(spark, sf_dir).where("delisted_on is null")
    price = C.effective_price(F.col("sale_price"), F.col("list_price"))
    basis = F.when(F.col("p_size") % 3 == 0, "incl_freight").otherwise("excl_freight")
    window = C.reference_window(F.col("msrp"), F.when(F.col("p_size") % 5 == 0, F.col("msrp") + 400.0), basis)
    # exploding one-element arrays keeps filters on their parts from computing the nested expressions anew
    called = rows.select("*", F.explode(F.array(window)).alias("w")).select("*", F.explode(F.array(C.direction(price, F.col("w")))).alias("call")).where("call is not null")
    stated = F.when(F.col("l_tax") > 0.02, F.col("list_price"))
    return called.join(region, "dealer_id").select("province", "dealer_id", "call.dir", "call.floor_pct", F.col("w.exact").alias("exact"), stated.alias("stated_msrp"), C.inflation_floor(stated, F.col("w")).alias("infl_floor_pct"), "updated_at")


def province_market_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market_index.province_read(_calls(spark, sf_dir), AS_OF, stale_days=60)


PROVINCE_SQL = f"""
WITH {LISTINGS},
p AS (SELECT r_name AS province, dealer_id, CASE WHEN sale_price > 0 THEN sale_price WHEN list_price > 0 THEN list_price END AS price, updated_at, list_price, l_tax, p_size,
             CASE WHEN p_size % 5 = 0 THEN msrp + 400 ELSE msrp END AS low, CASE WHEN p_size % 5 = 0 THEN msrp + 400 WHEN p_size % 3 = 0 THEN msrp + 1500 ELSE msrp + 5500 END AS high, p_size % 5 = 0 AS exact
      FROM listings JOIN supplier ON dealer_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE delisted_on IS NULL),
q AS (SELECT *, 100.0 * (price - low) / low AS pl, 100.0 * (price - high) / high AS ph FROM p WHERE price > 0 AND low > 0),
c AS (SELECT province, dealer_id, exact, updated_at, CASE WHEN pl < -0.05 THEN 'under' WHEN ph > 0.05 THEN 'over' WHEN exact THEN 'at' ELSE 'indeterminate' END AS dir,
             CASE WHEN pl < -0.05 THEN pl WHEN ph > 0.05 THEN ph WHEN exact THEN pl END AS f, CASE WHEN l_tax > 0.02 THEN list_price END AS stated,
             CASE WHEN l_tax > 0.02 AND list_price > high THEN 100.0 * (list_price - high) / high END AS infl FROM q),
g AS (SELECT province, count(*) AS n_matched, count(*) FILTER (dir <> 'indeterminate') AS n_directional, count(DISTINCT dealer_id) FILTER (dir <> 'indeterminate') AS n_dealers,
             count(*) FILTER (dir = 'under') AS under_n, count(*) FILTER (dir = 'at') AS at_n, count(*) FILTER (dir = 'over') AS over_n, count(*) FILTER (dir = 'indeterminate') AS indeterminate_n,
             count(*) FILTER (exact) AS all_in_n, count(*) FILTER (stated > 0) AS sticker_stated_n, count(infl) AS sticker_inflated_n, min(updated_at) AS min_updated_at, max(updated_at) AS max_updated_at,
             list(f ORDER BY f) FILTER (dir <> 'indeterminate') AS fs, list(f ORDER BY f) FILTER (dir = 'under') AS us, list(infl ORDER BY infl) FILTER (infl IS NOT NULL) AS ss FROM c GROUP BY province)
SELECT province, n_matched, n_directional, n_dealers, under_n, at_n, over_n, indeterminate_n, all_in_n, sticker_stated_n, sticker_inflated_n, min_updated_at, max_updated_at,
       round(fs[CAST(floor((len(fs) - 1) * 0.5 + 0.5) AS INT) + 1], 2) AS median_pct, round(fs[CAST(floor((len(fs) - 1) * 0.25 + 0.5) AS INT) + 1], 2) AS p25_pct,
       round(fs[CAST(floor((len(fs) - 1) * 0.75 + 0.5) AS INT) + 1], 2) AS p75_pct, round(us[CAST(floor((len(us) - 1) * 0.5 + 0.5) AS INT) + 1], 2) AS median_discount_pct,
       round(ss[CAST(floor((len(ss) - 1) * 0.5 + 0.5) AS INT) + 1], 2) AS sticker_inflated_median_pct,
       CASE WHEN n_directional >= 2 THEN array_to_string(list_transform(range(21), lambda i: CAST(round(fs[CAST(floor((len(fs) - 1) * (i / 20.0::DOUBLE) + 0.5) AS INT) + 1], 1) AS VARCHAR)), '|') END AS curve,
       n_directional >= 25 AND max_updated_at >= TIMESTAMP '1998-10-02' AS is_publishable
FROM g
"""


def published_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = province_market_read(spark, sf_dir)
    return market_index.published(read, AS_OF, 60).select("province", "n_directional", "median_pct", "state")


PUBLISHED_SQL = f"SELECT province, n_directional, median_pct, CASE WHEN max_updated_at >= TIMESTAMP '1998-10-02' THEN 'live' ELSE 'stale' END AS state FROM ({PROVINCE_SQL}) WHERE is_publishable"


def nearest_rank_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_ranks(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


NEAREST_SQL = """
SELECT p_brand, p[CAST(floor((len(p) - 1) * 0.1 + 0.5) AS INT) + 1] AS p10, p[CAST(floor((len(p) - 1) * 0.5 + 0.5) AS INT) + 1] AS p50, p[CAST(floor((len(p) - 1) * 0.9 + 0.5) AS INT) + 1] AS p90
FROM (SELECT p_brand, list(p_retailprice ORDER BY p_retailprice) AS p FROM part GROUP BY p_brand)
"""


def comps_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated percentiles of comparable prices by model, told from five on."""
    part = table(spark, sf_dir, "part")
    g = part.groupBy("p_type").agg(F.count("*").alias("n"), F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi")).join(interpolated(part, ["p_type"], "p_retailprice", {"m": 0.5}), "p_type", "left")
    told = F.col("n") >= 5
    return g.select("p_type", "n", told.alias("enough"), F.when(told, F.round("m", 2)).alias("median_price"), F.when(told, F.col("lo")).alias("low"), F.when(told, F.col("hi")).alias("high"))


COMPS_SQL = """
SELECT p_type, count(*) AS n, count(*) >= 5 AS enough, CASE WHEN count(*) >= 5 THEN round(quantile_cont(p_retailprice, 0.5), 2) END AS median_price,
       CASE WHEN count(*) >= 5 THEN min(p_retailprice) END AS low, CASE WHEN count(*) >= 5 THEN max(p_retailprice) END AS high FROM part GROUP BY p_type
"""


def comparable_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return joins.comparables(part, part, ["p_brand", "p_type"], "p_partkey", "p_size", "p_retailprice")


COMPARABLE_SQL = """
SELECT p_partkey, comp_id, rank FROM (
  SELECT a.p_partkey, b.p_partkey AS comp_id, row_number() OVER (PARTITION BY a.p_partkey ORDER BY abs(a.p_size - b.p_size), b.p_retailprice, b.p_partkey) AS rank
  FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey WHERE b.p_retailprice > 0) WHERE rank <= 3
"""


TRIMS = ["LE", "XLE Premium", "Sport AWD", "Limited Plug-In", "X-Line - Limited", "LE LE FWD"]
ASKED = ["XLE", "sport awd", None, "LE", "Premium Limited 4x4", "x–line"]
DRIVES = [None, "All-wheel", None, "FWD", "Quattro", None, None]
FUELS = [None, "Gas", "PHEV", "Hybrid"]


def catalog_trim_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a listing, matched to the trims of its make and model."""
    part = table(spark, sf_dir, "part").withColumnsRenamed({"p_brand": "make", "p_type": "model"})
    k, size = F.col("p_partkey"), F.col("p_size")
    one_of = lambda values, index: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index % len(values)).cast("int") + 1)
    some = lambda column, when: F.when(when, F.array(F.lit("digitalKey"), F.lit(column)))
    grade = size % 24
    catalog = part.groupBy("make", "model", grade.alias("grade")).agg((F.min("p_retailprice") * 40 + F.min(grade) * 900).alias("msrp"))
    g = F.col("grade")
    catalog = catalog.select(
        "make", "model", F.concat(one_of(TRIMS, g), F.lit(" "), (g % 5).cast("string")).alias("trim"), "msrp", one_of(FUELS, g).alias("fuel_type"), one_of(DRIVES, g).alias("drivetrain"),
        F.when(g % 4 == 0, F.array(F.lit("DigitalKey"), F.lit("tow"))).when(g % 4 == 1, F.array(F.lit("tow"))).alias("attrs"),
    )
    probes = part.select(
        k.alias("listing_id"), "make", "model", one_of(ASKED, k).alias("trim"), F.when(k % 4 != 3, F.col("p_retailprice") * 40 + size * 500).alias("price"), one_of(FUELS, size).alias("fuel_type"),
        F.when(k % 3 == 0, one_of(DRIVES, size)).alias("drivetrain"), F.when(k % 5 == 0, "AWD").alias("vin_drive"), some("sunroof", k % 7 == 0).alias("features"),
    )
    return catalog_match.match_listings(probes, catalog, ["make", "model"])


def _one_of(values: list, index: str) -> str:
    return f"[{', '.join('NULL' if v is None else repr(v) for v in values)}][{index} % {len(values)} + 1]"


def _drive(text: str) -> str:
    t = f"lower({text})"
    return f"CASE WHEN regexp_matches({t}, 'all.?wheel|\\bawd\\b|quattro|\\b4wd\\b|4x4') THEN 'AWD' WHEN regexp_matches({t}, 'front.?wheel|\\bfwd\\b') THEN 'FWD' END"


def _fuel(text: str) -> str:
    return f"CASE WHEN {text} IS NULL THEN 'gas' WHEN {text} ILIKE '%phev%' THEN 'phev' WHEN {text} ILIKE '%hybrid%' THEN 'hybrid' ELSE 'gas' END"


def _words(text: str) -> str:
    bare = f"regexp_replace(replace(lower(coalesce({text}, '')), '–', '-'), '{catalog_match.FUEL_WORDS}', ' ', 'g')"
    return f"list_filter(string_split(regexp_replace(regexp_replace({bare}, '[^a-z0-9]+', ' ', 'g'), '{catalog_match.DRIVE_WORDS}', ' ', 'g'), ' '), lambda w: w <> '')"


TRIM_SQL = f"""
WITH g AS (SELECT p_brand AS make, p_type AS model, p_size % 24 AS g, min(p_retailprice) * 40 + min(p_size % 24) * 900 AS msrp FROM part GROUP BY p_brand, p_type, p_size % 24),
c0 AS (SELECT *, {_one_of(TRIMS, 'g')} || ' ' || g % 5 AS trim, {_one_of(FUELS, 'g')} AS f, {_one_of(DRIVES, 'g')} AS d, CASE WHEN g % 4 = 0 THEN ['digitalkey', 'tow'] WHEN g % 4 = 1 THEN ['tow'] ELSE [] END AS attrs FROM g),
c AS (SELECT make, model, trim AS c_trim, msrp AS c_msrp, {_fuel('f')} AS c_fuel, coalesce({_drive('d')}, {_drive('trim')}) AS c_drive, {_words('trim')} AS c_words, attrs FROM c0),
p0 AS (SELECT p_partkey AS id, p_brand AS make, p_type AS model, {_one_of(ASKED, 'p_partkey')} AS trim, CASE WHEN p_partkey % 4 <> 3 THEN p_retailprice * 40 + p_size * 500 END AS price, {_one_of(FUELS, 'p_size')} AS f,
  CASE WHEN p_partkey % 3 = 0 THEN {_one_of(DRIVES, 'p_size')} END AS d, p_partkey % 5 = 0 AS vin_awd, CASE WHEN p_partkey % 7 = 0 THEN ['digitalkey', 'sunroof'] ELSE [] END AS feats FROM part),
p1 AS (SELECT *, coalesce({_drive('d')}, CASE WHEN vin_awd THEN 'AWD' END) AS want_drive, {_words('trim')} AS words, {_fuel('f')} AS want_fuel FROM p0),
j0 AS (SELECT *, coalesce(want_drive, {_drive('trim')}) AS stated, count(*) OVER (PARTITION BY id) AS n, max(CAST(c_fuel = want_fuel AS INT)) OVER (PARTITION BY id) AS fits FROM p1 JOIN c USING (make, model)),
j AS (SELECT *, [{', '.join(repr(w) for w in catalog_match.KEY_WORDS)}] AS keys, min(abs(c_msrp - price)) OVER (PARTITION BY id) AS nearest FROM j0 WHERE n = 1 OR fits = 0 OR c_fuel = want_fuel),
s AS (SELECT *, CASE WHEN want_drive IS NULL OR c_drive IS NULL THEN 0 WHEN want_drive = c_drive THEN 4 ELSE -6 END + len(list_filter(c_words, lambda w: list_contains(words, w))) + len(list_filter(c_words, lambda w: list_contains(words, w) AND list_contains(keys, w)))
  - CASE WHEN list_has_any(words, keys) AND list_has_any(c_words, keys) AND NOT list_has_any(list_intersect(words, keys), c_words) THEN 5 ELSE 0 END
  + 2 * len(list_intersect(attrs, feats)) - CASE WHEN len(feats) > 0 THEN len(attrs) - len(list_intersect(attrs, feats)) ELSE 0 END
  + CASE WHEN price IS NULL THEN 0 WHEN abs(c_msrp - price) = nearest THEN 2 WHEN abs(c_msrp - price) < 3000 THEN 1 ELSE 0 END AS score FROM j),
o AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS score2, lead(c_msrp) OVER w AS msrp2, first_value(c_msrp) OVER m AS low, first_value(c_trim) OVER m AS low_trim FROM s
  WINDOW w AS (PARTITION BY id ORDER BY score DESC, c_msrp, c_trim), m AS (PARTITION BY id ORDER BY c_msrp, c_trim)),
t AS (SELECT *, (stated IS NULL OR coalesce(c_drive = stated, false)) AND NOT coalesce(price - c_msrp > c_msrp * 0.2 AND price - c_msrp > 6000, false) AS sure,
  n > 1 AND score <= 0 AND len(words) = 0 AND want_drive IS NULL AND len(feats) = 0 AS nothing FROM o WHERE r = 1)
SELECT id AS listing_id, CASE WHEN nothing THEN low ELSE c_msrp END AS matched_msrp, CASE WHEN nothing THEN low_trim ELSE c_trim END AS matched_trim,
  CASE WHEN n = 1 AND sure OR n > 1 AND NOT nothing AND sure AND (score2 IS NULL OR score - score2 >= 2 OR abs(c_msrp - msrp2) < 500) THEN 'exact' ELSE 'starting_at' END AS basis,
  CAST(CASE WHEN n = 1 OR nothing THEN 0 ELSE score END AS INT) AS score
FROM t
"""


QUERIES = {
    "deviation_read": deviation_read, "city_price_index": city_price_index, "province_market_read": province_market_read, "published_read": published_read, "nearest_rank_prices": nearest_rank_prices,
    "comps_summary": comps_summary, "comparable_listings": comparable_listings, "catalog_trim_match": catalog_trim_match,
}
ORACLE = {
    "deviation_read": DEVIATION_SQL, "city_price_index": CITY_SQL, "province_market_read": PROVINCE_SQL, "published_read": PUBLISHED_SQL, "nearest_rank_prices": NEAREST_SQL, "comps_summary": COMPS_SQL,
    "comparable_listings": COMPARABLE_SQL, "catalog_trim_match": TRIM_SQL,
}
