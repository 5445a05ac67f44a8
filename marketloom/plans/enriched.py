"""Listings verified, reports completed and records looked up over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators import enrich, verification as V
from marketloom.session import table

YEAR = 2026
FUELS = ["BEV", "PHEV", "Hybrid", "Gas", "Diesel", None, "Hydrogen"]
NAMES = ["2024 Honda Civic Sport", "Kia", None, "Nice car, Western Union accepted", "Ford F-150 Lariat"]


def _pick(values: list, key: str) -> str:
    spelt = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else f"'{v}'"
    return f"CASE ({key}) % {len(values)} " + " ".join(f"WHEN {i} THEN {spelt(v)}" for i, v in enumerate(values)) + " END"


LISTING = {
    "name": _pick(NAMES, "p_partkey"), "price": "CASE p_partkey % 6 WHEN 0 THEN 9999 WHEN 1 THEN NULL ELSE p_retailprice * (p_partkey % 6) * 12 END", "km": "CASE p_partkey % 7 WHEN 0 THEN -5 WHEN 1 THEN 600000 WHEN 2 THEN NULL ELSE p_size * 2500 END",
    "year": "CASE p_partkey % 9 WHEN 0 THEN 1999 WHEN 1 THEN 2029 WHEN 2 THEN NULL ELSE 2014 + p_partkey % 13 END", "fuel": _pick(FUELS, "p_partkey"), "description": _pick(["clean", None, "Contact me at home"], "p_partkey + 1"),
    "make": _pick(["Honda", "Unknown", "Kia", None, "Ford", "Ford"], "p_partkey"), "model": _pick(["Civic", "", "Soul", "F-150", "F-150", "F-150", "F-150"], "p_partkey"), "external_id": _pick(["x1", "x2", "x3", "x4", ""], "p_partkey"),
    "listing_url": _pick(["u", "u", "u", None], "p_partkey"),
}


def listing_verdicts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", *[F.expr(e).alias(n) for n, e in LISTING.items()])
    return V.verified_listings(rows, YEAR).select("p_partkey", F.array_join("flags", ",").alias("flags"), "score", "action")


FINDINGS = {
    "quoted": "CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 4 END", "reference": "CASE WHEN o_orderkey % 5 <> 0 THEN 30000 + o_custkey % 40 * 500 END", "basis": _pick(["exact", "starting_at", None], "o_orderkey"),
    "ceiling": "60000", "over_ceiling": "CASE WHEN o_totalprice / 4 > 60000 THEN o_totalprice / 4 - 60000 END", "flagged_fees": "CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 899.5 WHEN 2 THEN 2600 END",
    "recalls_checked": "o_orderkey % 2 = 0", "recalls": "CAST(o_custkey % 5 AS INT)", "financing_checked": "o_custkey % 3 = 0", "financing_consistent": "o_custkey % 2 = 0", "days": "CAST(o_custkey % 120 AS INT)",
}
MONEY = ("quoted", "reference", "ceiling", "over_ceiling", "flagged_fees")


def leverage_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *[F.expr(f"cast({e} as double)" if n in MONEY else e).alias(n) for n, e in FINDINGS.items()])
    return V.with_leverage(rows).select("o_orderkey", "leverage", F.array_join("leverage_basis", ",").alias("basis"))


def rescued_reports(spark, sf_dir):
    """Reports by customers, completed where an order was read for them."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    text = lambda n, v: F.when(k % n == 0, v)
    reports = c.select(
        k.alias("report_id"), F.when(k % 3 != 0, F.col("c_acctbal")).alias("quoted_price"), F.lit("page").alias("quoted_price_source"), F.when(k % 4 == 0, 100.0).alias("msrp"), F.lit(None).cast("boolean").alias("gated_recovered"),
        F.lit(None).cast("string").alias("gate_message"), F.when(k % 2 == 0, F.array(F.lit("own"))).otherwise(F.array().cast("array<string>")).alias("add_ons"), F.lit("html").alias("method"),
        text(2, "").alias("trim"), text(5, "v1").alias("vin"), text(3, 7).cast("int").alias("odometer_km"),
    )
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"), F.count("*").alias("n"))
    rescued = o.select(
        F.col("o_custkey").alias("report_id"), F.when(F.col("n") % 4 != 0, F.col("top")).alias("quoted_price"), F.when(F.col("n") % 3 != 0, F.lit("vision")).alias("quoted_price_source"), F.lit(5000.0).alias("msrp"),
        (F.col("n") % 2 == 0).alias("gated_recovered"), F.lit("call us").alias("gate_message"), F.when(F.col("n") % 5 != 0, F.array(F.lit("line"))).alias("add_ons"), F.when(F.col("n") % 3 == 1, "vision2").alias("method"),
        F.lit("LX").alias("trim"), F.lit("v2").alias("vin"), F.col("n").cast("int").alias("odometer_km"),
    )
    out = enrich.merged_rescued(reports, rescued, "report_id", ["trim", "vin", "odometer_km"])
    return out.withColumn("add_ons", F.array_join("add_ons", ","))


def verified_fuels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    catalog = p.where("p_size > 5").select((F.lit(2020) + F.col("p_size") % 9).alias("year"), F.upper("p_brand").alias("make"), "p_type", F.expr(_pick(["Gas", "Hybrid", None, "Gas", "BEV"], "p_partkey")).alias("fuel_type")).withColumnRenamed("p_type", "model")
    reports = p.select(k.alias("report_id"), F.when(k % 8 != 0, F.lit(2020) + F.col("p_size") % 9).alias("year"), F.col("p_brand").alias("make"), F.when(k % 9 != 0, F.lower("p_type")).otherwise("").alias("model"), F.when(k % 2 == 0, "Diesel").alias("fuel_type"))
    return enrich.verified_fuel(reports, catalog).select("report_id", "fuel_type", "fuel_verified")


FEED = (
    """concat('{"hasPrice":', CASE WHEN p_partkey % 5 = 0 THEN 'false' ELSE 'true' END, ',"salePrice":', CASE WHEN p_partkey % 3 = 0 THEN '0' ELSE CAST(p_size * 1000 + 1 AS VARCHAR(20)) END, ',"listPrice":"', CAST(p_size * 2000 AS VARCHAR(20)),"""
    """ '","serialNo":" 1m8gdm9axkp', lpad(CAST(p_partkey % 1000000 AS VARCHAR(20)), 6, '0'), CASE WHEN p_partkey % 4 = 0 THEN 'Q' ELSE '' END, '","odometer":', CAST(p_size - 3 AS VARCHAR(20)),"""
    """ ',"paymentOptions":{"finance":{"term":{"apr":', CASE p_partkey % 4 WHEN 0 THEN '31' WHEN 1 THEN '"4.99"' WHEN 2 THEN '0' ELSE '30' END, ',"term":', CASE WHEN p_partkey % 7 = 0 THEN 'null' ELSE '84' END, ',"payment":', CAST(p_size AS VARCHAR(20)), '.125,"""
    """"aprDetails":{"totalObligation":"', CAST(p_size * 84 AS VARCHAR(20)), '"}}},"addedItems":{"items":[', CASE WHEN p_partkey % 2 = 0 THEN '{"description":" Mats ","retail":"199.5"},{"description":"","retail":5},{"description":"free","retail":0}' ELSE '' END,"""
    """ ']},"bestIncentives":{"dealerRebates":', CASE WHEN p_partkey % 3 = 1 THEN '750' ELSE '-1' END, '}}}')"""
)


def feed_facts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(FEED).alias("json"))
    return enrich.feed_facts(rows, "p_partkey").withColumn("add_ons", F.array_join(F.transform("add_ons", lambda a: F.concat(a["name"], F.lit("="), a["price"].cast("string"))), ";"))


ENTRIES = ["", " AWD", " Hybrid AWD", " FWD", "-ish AWD", " sport front wheel", " 4MATIC", " RWD"]


def pooled_drives(spark, sf_dir):
    """What a registry made of parts says about each catalogue model's drive."""
    p = table(spark, sf_dir, "part")
    models = p.select(F.when(F.col("p_partkey") % 20 == 0, "Mercedes-Benz").otherwise(F.upper("p_type")).alias("make"), F.col("p_name").alias("model"))
    registry = p.where("p_size % 2 = 0").select(F.when(F.col("p_partkey") % 20 == 0, "MERCEDES").otherwise(F.col("p_type")).alias("make"), F.expr(f"concat(p_name, {_pick(ENTRIES, 'p_partkey')})").alias("model"))
    return enrich.pooled_drives(models, registry)


SITES = ["www.dealer{k}.ca/about", "HTTPS://Dealer{k}.com:8080/x?y", "mailto:a@dealer{k}.ca", "http://user@shop{k}.ca", None, "nodomain", " dealer{k}.com "]


def licensed_hosts(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    site = lambda k: f"replace({_pick(SITES, k)}, '{{k}}', CAST({k} % 60 AS VARCHAR(9)))"
    licensees = s.select(F.expr(site("s_suppkey")).alias("website"), F.expr(_pick(["Issued", "Expired", "licence issued", None], "s_suppkey")).alias("status"))
    dealers = c.select("c_custkey", enrich.origin(F.expr(site("c_custkey"))).alias("host"))
    return enrich.licensed_hosts(dealers, licensees).select("c_custkey", "host", "licensed")


def unique_subscriptions(spark, sf_dir):
    """Subscriptions made of orders under a key of expressions: a city that is missing is an empty one."""
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", (F.col("o_custkey") % 100).alias("email"), "o_orderpriority", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")).alias("model"), F.when(F.col("o_custkey") % 3 == 0, F.lit(None)).when(F.col("o_custkey") % 3 == 1, "").otherwise("calgary").alias("city"))
    key = {"email": F.col("email"), "make": F.lower("o_orderpriority"), "model": F.col("model"), "city": F.coalesce("city", F.lit(""))}
    return enrich.unique_by(rows, key, [F.col("o_orderkey")])


def config_objects(spark, sf_dir):
    """Settings of each brand whose names begin with limit_ or baseline_, the underscore being itself."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.expr(f"concat({_pick(['limit_', 'limitx', 'baseline_', 'LIMIT_', 'a_limit_'], 'p_partkey')}, CAST(p_size % 5 AS VARCHAR(9)))").alias("name"), F.col("p_retailprice").cast("string").alias("value"))
    chosen = rows.where(r"name like 'limit\_%' or name like 'baseline\_%'")
    return enrich.object_agg(chosen, ["p_brand"], "name", "value", [F.col("p_partkey")]).select("p_brand", F.to_json("object").alias("object"))


def pack_revenue(spark, sf_dir):
    """Sales of packs a month: a line is a sale of the pack that has its quantity."""
    packs = spark.createDataFrame([(1, 9.99), (5, 39.0), (12, 79.5), (50, 250.0)], "checks int, price double")
    sales = table(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "month").alias("month"), "l_quantity")
    g = sales.join(F.broadcast(packs), F.col("l_quantity") == F.col("checks")).groupBy("month").agg(F.count("*").alias("sales"), F.round(F.sum("price"), 2).alias("revenue"))
    return g.withColumn("month", F.col("month").cast("string"))


MAILS = [
    "Receipt from Anthropic #ABCD1234-0001\nTotal CA$ 1,020.50 paid on 2026-07-01", "Scrapfly invoice US$ 30.00 period 2026-07-01 to 2026-07-31 Payment date: July 5, 2026", "Your plan: $ 99.00 CAD for XK29QWERTY-12345", "Amount due: $12.34, paid August 12 2026", "Hello", "Nimble total - 5.00",
]

MAIL = {
    "subject": f"CASE c_custkey % {len(MAILS)} " + " ".join(f"WHEN {i} THEN '{m.split(chr(10))[0]}'" for i, m in enumerate(MAILS)) + " END",
    "body": f"concat(CASE c_custkey % {len(MAILS)} " + " ".join(f"WHEN {i} THEN '{m.split(chr(10))[1]}'" for i, m in enumerate(MAILS) if chr(10) in m) + " ELSE '' END, ' note ', CAST(c_custkey AS VARCHAR(20)))",
}


def invoices(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", *[F.expr(e).alias(n) for n, e in MAIL.items()])
    return c.select("c_custkey", enrich.parsed_invoice(F.lit("billing@x.example"), F.col("subject"), F.col("body")).alias("i")).select("c_custkey", "i.*")


QUERIES = {
    f.__name__: f
    for f in (listing_verdicts, leverage_scores, rescued_reports, verified_fuels, feed_facts, pooled_drives, licensed_hosts, unique_subscriptions, config_objects, pack_revenue, invoices)
}
FLAGS = [
    "PRICE_TOO_LOW", "PRICE_TOO_HIGH", "PLACEHOLDER_PRICE", "INVALID_YEAR", "KM_TOO_HIGH", "KM_NEGATIVE", "SCAM_KEYWORDS", "NAME_TOO_SHORT", "MISSING_MAKE", "MISSING_MODEL", "MISSING_EXTERNAL_ID", "MISSING_URL",
    "PRICE_ANOMALY", "KM_YEAR_MISMATCH", "OVER_EVAP_CAP",
]
PACKS = "(VALUES (1, 9.99::DOUBLE), (5, 39.0::DOUBLE), (12, 79.5::DOUBLE), (50, 250.0::DOUBLE)) p(checks, price)"
ORACLE = {
    "listing_verdicts": f"""WITH l AS (SELECT p_partkey, {', '.join(f'{e} AS {n}' for n, e in LISTING.items())} FROM part),
z AS (SELECT *, coalesce(price, 0) AS p, coalesce(km, 0) AS k, coalesce(year, 0) AS y, coalesce(fuel, 'Gas') AS f, lower(coalesce(name, '') || ' ' || coalesce(description, '')) AS said FROM l),
b AS (SELECT p_partkey, [p < CASE f WHEN 'BEV' THEN 8000 WHEN 'PHEV' THEN 10000 WHEN 'Hybrid' THEN 5000 WHEN 'Gas' THEN 2000 WHEN 'Diesel' THEN 5000 END OR p = 0, p > CASE f WHEN 'BEV' THEN 150000 WHEN 'PHEV' THEN 120000 WHEN 'Hybrid' THEN 100000 WHEN 'Gas' THEN 150000 WHEN 'Diesel' THEN 100000 END,
  p IN (1, 100, 111, 222, 333, 999, 1000, 1111, 9999, 99999, 100000, 123456), y < 2000 OR y > {YEAR + 2}, k > 500000, k < 0, contains(said, 'western union') OR contains(said, 'contact me at'), length(coalesce(name, '')) < 8, coalesce(make IN ('', 'Unknown'), true), coalesce(model IN ('', 'Unknown'), true),
  coalesce(external_id = '', true), coalesce(listing_url = '', true), y >= {YEAR - 1} AND p < 15000 AND f <> 'Gas', k > greatest(30000, ({YEAR} - y) * 35000) AND {YEAR} - y < 10, f IN ('BEV', 'PHEV') AND p > 50000] AS hit FROM z),
s AS (SELECT p_partkey, list_transform(hit, lambda h: coalesce(h, false)) AS hit FROM b),
t AS (SELECT p_partkey, list_filter(list_zip({FLAGS},
  [50, 20, 60, 40, 15, 50, 80, 30, 20, 20, 50, 10, 25, 15, 0], ['reject', 'review', 'reject', 'reject', 'review', 'reject', 'reject', 'reject', 'review', 'review', 'reject', 'review', 'review', 'review', NULL], hit), lambda x: x[4]) AS f FROM s),
u AS (SELECT p_partkey, f, greatest(0, 100 - coalesce(list_sum(list_transform(f, lambda x: x[2])), 0)) AS score, list_filter(list_transform(f, lambda x: x[3]), lambda a: a IS NOT NULL) AS acts FROM t)
SELECT p_partkey, array_to_string(list_transform(f, lambda x: x[1]), ',') AS flags, CAST(score AS INT) AS score, CASE WHEN score < 30 THEN 'reject' WHEN score < 70 THEN 'review' ELSE coalesce(acts[-1], 'publish') END AS action FROM u""",
    "leverage_scores": f"""WITH f AS (SELECT o_orderkey, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' if n in MONEY else f'{e} AS {n}' for n, e in FINDINGS.items())} FROM orders),
d AS (SELECT *, (quoted - reference) / reference AS d, quoted - reference AS gap, over_ceiling > 0 AS above FROM f),
t AS (SELECT *, CASE WHEN basis = 'exact' AND d > 0.005 THEN least(2.5, d * 100 * 0.3::DOUBLE) END AS a, CASE WHEN basis = 'exact' AND d < -0.02 THEN -1.0::DOUBLE END AS b,
  CASE WHEN basis = 'starting_at' AND gap IS NOT NULL AND above THEN least(2.5, over_ceiling / ceiling * 100 * 0.3::DOUBLE) END AS c, CASE WHEN basis = 'starting_at' AND NOT coalesce(above, false) AND gap > reference * 0.2::DOUBLE AND gap > 6000 THEN least(1.5, gap / reference * 100 * 0.15::DOUBLE) END AS e,
  CASE WHEN flagged_fees > 0 THEN least(2.0, flagged_fees / 1000) END AS g, CASE WHEN recalls_checked AND recalls > 0 THEN least(2.0, recalls * 0.7::DOUBLE) END AS h, CASE WHEN financing_checked AND NOT financing_consistent THEN 1.0::DOUBLE END AS i,
  CASE WHEN days >= 90 THEN 2.5::DOUBLE WHEN days >= 60 THEN 1.5 WHEN days >= 30 THEN 0.75 END AS j FROM d)
SELECT o_orderkey, greatest(0, least(10, floor((2.0::DOUBLE + coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(e, 0) + coalesce(g, 0) + coalesce(h, 0) + coalesce(i, 0) + coalesce(j, 0)) * 10 + 0.5) / 10)) AS leverage,
  concat_ws(',', CASE WHEN a IS NOT NULL THEN 'above_list' END, CASE WHEN b IS NOT NULL THEN 'below_list' END, CASE WHEN c IS NOT NULL THEN 'above_lineup' END, CASE WHEN e IS NOT NULL THEN 'above_trim' END, CASE WHEN g IS NOT NULL THEN 'fees' END, CASE WHEN h IS NOT NULL THEN 'recalls' END,
  CASE WHEN i IS NOT NULL THEN 'financing' END, CASE WHEN j IS NOT NULL THEN 'days' END) AS basis FROM t""",
    "rescued_reports": """WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS q, o.n, top, n IS NOT NULL AS there FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS top, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey),
t AS (SELECT *, coalesce(NOT coalesce(q > 0, false) AND n % 4 <> 0 AND top > 0, false) AS taken FROM r)
SELECT k AS report_id, CASE WHEN taken THEN top ELSE q END AS quoted_price, CASE WHEN taken AND n % 3 <> 0 THEN 'vision' ELSE 'page' END AS quoted_price_source, CASE WHEN k % 4 = 0 THEN 100.0::DOUBLE WHEN there THEN 5000.0::DOUBLE END AS msrp,
  CASE WHEN taken AND n % 2 = 0 THEN true END AS gated_recovered, CASE WHEN taken AND n % 2 = 0 THEN 'call us' END AS gate_message, CASE WHEN k % 2 = 0 THEN 'own' WHEN n % 5 <> 0 THEN 'line' ELSE '' END AS add_ons,
  CASE WHEN NOT there THEN 'html' WHEN n % 3 = 1 THEN 'vision2' ELSE 'scrapfly_render_vision' END AS method, CASE WHEN there THEN 'LX' WHEN k % 2 = 0 THEN '' END AS trim, CASE WHEN k % 5 = 0 THEN 'v1' WHEN there THEN 'v2' END AS vin,
  CAST(CASE WHEN k % 3 = 0 THEN 7 ELSE n END AS INT) AS odometer_km FROM t""",
    "verified_fuels": f"""WITH c AS (SELECT 2020 + p_size % 9 AS year, lower(p_brand) AS mk, lower(p_type) AS md, {_pick(['Gas', 'Hybrid', None, 'Gas', 'BEV'], 'p_partkey')} AS f FROM part WHERE p_size > 5),
o AS (SELECT year, mk, md, f FROM c WHERE f IS NOT NULL GROUP BY year, mk, md, f QUALIFY row_number() OVER (PARTITION BY year, mk, md ORDER BY count(*) DESC, f) = 1),
r AS (SELECT p_partkey AS k, 2020 + p_size % 9 AS year, lower(p_brand) AS mk, lower(p_type) AS md, p_partkey % 8 <> 0 AND p_partkey % 9 <> 0 AS ok FROM part)
SELECT k AS report_id, coalesce(CASE WHEN ok THEN f END, CASE WHEN k % 2 = 0 THEN 'Diesel' END) AS fuel_type, CASE WHEN ok THEN f IS NOT NULL END AS fuel_verified FROM r LEFT JOIN o USING (year, mk, md)""",
    "feed_facts": f"""WITH j AS (SELECT p_partkey, {FEED} AS j FROM part), v AS (SELECT p_partkey, j, CAST(j->>'$.salePrice' AS DOUBLE) AS s, CAST(j->>'$.listPrice' AS DOUBLE) AS l, CAST(j->>'$.paymentOptions.finance.term.apr' AS DOUBLE) AS apr, upper(trim(j->>'$.serialNo')) AS vin FROM j),
w AS (SELECT *, CASE WHEN apr > 0 AND apr <= 30 THEN apr END AS a FROM v)
SELECT p_partkey, CASE WHEN j->>'$.hasPrice' <> 'false' THEN coalesce(CASE WHEN s > 0 THEN s END, CASE WHEN l > 0 THEN l END) END AS price, a AS apr, CASE WHEN a IS NOT NULL THEN CAST(j->>'$.paymentOptions.finance.term.term' AS INT) END AS term_months,
  CASE WHEN a IS NOT NULL THEN floor(CAST(j->>'$.paymentOptions.finance.term.payment' AS DOUBLE) * 100 + 0.5) / 100 END AS payment, CASE WHEN a IS NOT NULL THEN CAST(j->>'$.paymentOptions.finance.term.aprDetails.totalObligation' AS DOUBLE) END AS total_obligation,
  CASE WHEN regexp_matches(vin, '^[A-HJ-NPR-Z0-9]{{17}}$') THEN vin END AS vin, CASE WHEN CAST(j->>'$.odometer' AS DOUBLE) > 0 THEN CAST(j->>'$.odometer' AS DOUBLE) END AS km,
  concat_ws(';', CASE WHEN p_partkey % 2 = 0 THEN 'Mats=199.5' END, CASE WHEN p_partkey % 3 = 1 THEN 'Dealer discount=-750.0' END) AS add_ons FROM w""",
    "pooled_drives": f"""WITH m AS (SELECT DISTINCT CASE WHEN p_partkey % 20 = 0 THEN 'Mercedes-Benz' ELSE upper(p_type) END AS make, p_name AS model, CASE WHEN p_partkey % 20 = 0 THEN 'mercedes' ELSE lower(p_type) END AS mk, lower(p_name) AS md FROM part),
e AS (SELECT DISTINCT CASE WHEN p_partkey % 20 = 0 THEN 'mercedes' ELSE lower(p_type) END AS mk, trim(regexp_replace(lower(p_name || {_pick(ENTRIES, 'p_partkey')}), '[^a-z0-9]+', ' ', 'g')) AS entry FROM part WHERE p_size % 2 = 0),
p AS (SELECT make, model, CASE WHEN regexp_matches(entry[length(md) + 1:], '\\b(awd|4matic)\\b') THEN 'AWD' WHEN regexp_matches(entry[length(md) + 1:], '\\b(fwd|front.?wheel)\\b') THEN 'FWD' WHEN regexp_matches(entry[length(md) + 1:], '\\brwd\\b') THEN 'RWD' END AS d, entry
  FROM m LEFT JOIN e ON e.mk = m.mk AND (entry = md OR starts_with(entry, md || ' ')))
SELECT make, model, CASE WHEN count(d) = count(entry) AND min(d) = max(d) THEN min(d) END AS drive, CASE WHEN count(entry) = 0 THEN 'no entry' WHEN count(d) = 0 THEN 'no entry tells' WHEN count(d) = count(entry) AND min(d) = max(d) THEN 'all agree' ELSE 'sold both ways' END AS reason,
  count(entry) AS entries FROM p GROUP BY make, model""",
    "licensed_hosts": """WITH h AS (SELECT k, CASE k % 7 WHEN 0 THEN 'https://www.dealer' || k % 60 || '.ca' WHEN 1 THEN 'https://dealer' || k % 60 || '.com' WHEN 3 THEN 'https://shop' || k % 60 || '.ca' WHEN 6 THEN 'https://dealer' || k % 60 || '.com' END AS host, kind FROM
    (SELECT c_custkey AS k, 'd' AS kind FROM customer UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 4 IN (0, 2) THEN 'l' END FROM supplier))
SELECT k AS c_custkey, host, coalesce(host IN (SELECT host FROM h WHERE kind = 'l' AND host IS NOT NULL), false) AS licensed FROM h WHERE kind = 'd'""",
    "unique_subscriptions": """WITH r AS (SELECT o_orderkey, o_custkey % 100 AS email, o_orderpriority, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS model, CASE o_custkey % 3 WHEN 1 THEN '' WHEN 2 THEN 'calgary' END AS city FROM orders)
SELECT * FROM r QUALIFY model IS NULL OR row_number() OVER (PARTITION BY email, lower(o_orderpriority), model, coalesce(city, '') ORDER BY o_orderkey) = 1""",
    "config_objects": f"""WITH r AS (SELECT p_brand, p_partkey, {_pick(['limit_', 'limitx', 'baseline_', 'LIMIT_', 'a_limit_'], 'p_partkey')} || p_size % 5 AS name, CAST(p_retailprice AS VARCHAR) AS value FROM part),
l AS (SELECT * FROM r WHERE starts_with(name, 'limit_') OR starts_with(name, 'baseline_') QUALIFY row_number() OVER (PARTITION BY p_brand, name ORDER BY p_partkey DESC) = 1)
SELECT p_brand, '{{' || string_agg('"' || name || '":"' || value || '"', ',' ORDER BY name) || '}}' AS object FROM l GROUP BY p_brand""",
    "pack_revenue": f"SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS month, count(*) AS sales, round(sum(price), 2) AS revenue FROM lineitem JOIN {PACKS} ON l_quantity = checks GROUP BY 1",
    "invoices": f"""WITH h AS (SELECT c_custkey, {MAIL["subject"]} || chr(10) || {MAIL["body"]} AS h FROM customer),
m AS (SELECT *, [regexp_extract(h, '(?i)\\bCA\\$\\s*([\\d,]+\\.\\d{{2}})', 1), regexp_extract(h, '(?i)\\bUS\\$\\s*([\\d,]+\\.\\d{{2}})', 1), regexp_extract(h, '(?i)\\$\\s*([\\d,]+\\.\\d{{2}})\\s*(?:USD|CAD)\\b', 1),
    regexp_extract(h, '(?i)\\b(?:total|amount due|amount paid)\\b[^\\d]{{0,20}}\\$?\\s*([\\d,]+\\.\\d{{2}})', 1)] AS a, regexp_extract(h, '(?i)\\$\\s*[\\d,]+\\.\\d{{2}}\\s*(USD|CAD)\\b', 1) AS c,
  regexp_extract(h, '(\\d{{4}}-\\d{{2}}-\\d{{2}})\\s*(?:-|–|to)\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})', ['a', 'b']) AS per, regexp_extract(h, '(?i)\\b(?:payment date|paid on|paid)\\b[^\\d]{{0,20}}(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS iso,
  regexp_extract(h, '\\b(?i:payment date|paid on|paid)\\b[^A-Za-z]{{0,20}}([A-Z][a-z]+ \\d{{1,2}},? \\d{{4}})', 1) AS long FROM h),
p AS (SELECT c_custkey, CASE WHEN h ILIKE '%anthropic%' THEN 'anthropic' WHEN h ILIKE '%scrapfly%' THEN 'scrapfly' WHEN h ILIKE '%nimble%' THEN 'nimble' ELSE 'other' END AS vendor, nullif(regexp_extract(h, '\\b([A-Z0-9]{{6,10}}-\\d{{3,5}})\\b', 1), '') AS invoice_no,
  CAST(replace(list_filter(a, lambda x: x <> '')[1], ',', '') AS DOUBLE) AS amount, CASE WHEN a[1] <> '' THEN 'CAD' WHEN a[2] <> '' THEN 'USD' WHEN a[3] <> '' THEN upper(c) END AS currency, nullif(per.a, '') AS period_start, nullif(per.b, '') AS period_end,
  coalesce(nullif(iso, ''), CAST(CAST(try_strptime(replace(long, ',', ''), '%B %d %Y') AS DATE) AS VARCHAR)) AS paid_at FROM m)
SELECT *, CASE WHEN vendor = 'other' OR amount IS NULL OR currency IS NULL THEN 'could not parse: ' || concat_ws(', ', CASE WHEN vendor = 'other' THEN 'vendor' END, CASE WHEN amount IS NULL THEN 'amount' END, CASE WHEN currency IS NULL THEN 'currency' END) ELSE 'parsed cleanly' END AS note FROM p""",
}
