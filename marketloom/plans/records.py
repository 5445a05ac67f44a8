"""Record-level rules over the test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window, functions as F

from marketloom.functions import columns as C
from marketloom.operators import finance, scores
from marketloom.session import table


def financing_grid(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", (F.col("p_size") % 12).cast("double").alias("apr"))
    return finance.payment_grid(p, "p_partkey", "p_retailprice", "apr")


def rate_tiers(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(finance.apr_tier(F.round(F.col("l_tax") * 100, 2)).alias("tier")).agg(F.count("*").alias("n"), F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"))


def picked_rates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rates = p.where("p_size <= 12").select(F.col("p_brand").alias("make"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("model"), (F.col("p_size") * 12).alias("term"), (F.col("p_partkey") % 9).cast("double").alias("apr"), (F.col("p_size") % 3 == 0).alias("promo")).groupBy("make", "model", "term", "promo").agg(F.min("apr").alias("apr"))
    return finance.rate_pick(p, rates, "p_partkey", "p_brand", "p_type", 48).select("p_partkey", "term", "apr", "level")


def price_ladder(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    known = p.where("p_size <= 30 and p_type <> 'PROMO'").withColumnRenamed("p_retailprice", "price")
    rungs = [(name, known.groupBy(*keys).agg(F.min("price").alias("price")), keys) for name, keys in (("exact", ["p_brand", "p_type", "p_size"]), ("type", ["p_brand", "p_type"]), ("brand", ["p_brand"]))]
    return finance.ladder(p.select("p_partkey", "p_brand", "p_type", "p_size"), rungs, "p_partkey", [F.col("price")], "price")


def lot_days(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.when(F.col("l_linenumber") == 1, F.col("l_quantity"))).cast("int").alias("feed"), F.min(F.when(F.col("l_returnflag") == "A", F.col("l_shipdate"))).alias("seen"), F.min("l_shipdate").alias("page"))
    d = finance.days_on_lot(F.when(F.col("feed") % 2 == 0, F.col("feed")), F.to_date("seen"), F.to_date("page"), F.to_date(F.lit("2001-06-01")))
    return line.select("l_orderkey", d.alias("d")).select("l_orderkey", "d.*")


def fee_labels(spark, sf_dir):
    """Labels of the fee-like words in documents, read word by word."""
    doc = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return doc.groupBy(C.fee_label(F.col("line")).alias("label")).agg(F.count("*").alias("n"))


def mailboxes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    host = F.when(F.col("c_nationkey") % 3 == 0, "GoogleMail.com").when(F.col("c_nationkey") % 3 == 1, "gmail.com").otherwise("Example.org")
    raw = F.concat(F.lit(" A.b"), (F.col("c_custkey") % 40).cast("string"), F.when(F.col("c_custkey") % 2 == 0, "+ads").otherwise(""), F.lit("@"), host, F.lit(" "))
    return c.groupBy(C.email_identity(raw).alias("mailbox")).agg(F.count("*").alias("n"))


def dealer_ids(spark, sf_dir):
    """Opaque ids of suppliers by name and nation; some have spaces around, some neither name nor nation."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    name = F.when(F.col("s_suppkey") % 5 > 0, F.concat(F.lit("  "), "s_name"))
    return s.select("s_suppkey", C.dealer_id(name, F.when(F.col("s_suppkey") % 10 > 0, F.col("n_name"))).alias("dealer"), F.sha2("s_name", 256).alias("hash"))


CITY = "concat({0}, CASE c_custkey % 7 WHEN 0 THEN 'Albert' WHEN 1 THEN '-Anne' WHEN 2 THEN '  McMurray ' WHEN 3 THEN '. Paul' ELSE lower(c_mktsegment) END, {1})".format(
    "CASE c_custkey % 6 WHEN 0 THEN 'St. ' WHEN 1 THEN 'Saint ' WHEN 2 THEN 'ST ' WHEN 3 THEN 'Sainte-' WHEN 4 THEN 'Fort' ELSE '' END",
    "CASE c_custkey % 5 WHEN 0 THEN ', AB' WHEN 1 THEN ', Alberta' WHEN 2 THEN ', Alta.' ELSE '' END",
)


def city_spellings(spark, sf_dir):
    """The keys of cities spelt in many ways, with how many customers and spellings each has."""
    c = table(spark, sf_dir, "customer").select(F.expr(f"CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 11 = 1 THEN ' ' ELSE {CITY} END").alias("raw"))
    return c.groupBy(C.city_key(F.col("raw")).alias("city")).agg(F.count("*").alias("n"), F.count_distinct("raw").alias("spellings"))


def page_addresses(spark, sf_dir):
    """Pages by address without scheme, www, query and fragment."""
    u = F.regexp_replace(F.regexp_replace(F.lower("url"), r"^[a-z]+://(www\.)?", ""), r"[?#].*$", "")
    u = F.regexp_replace(u, r"/+$", "")
    return table(spark, sf_dir, "pages").groupBy(F.split_part(u, F.lit("/"), F.lit(1)).alias("host")).agg(F.count("*").alias("n"), F.count_distinct(u).alias("paths"))


def listing_scores(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_discount").alias("off"), F.sum("l_quantity").alias("qty"), F.max("l_tax").alias("tax"))
    rules = [("many_lines", F.col("n") > 6, 15), ("deep_discount", F.col("off") >= 0.1, 25), ("bulk", F.col("qty") > 150, 30), ("odd_tax", F.col("tax") == 0, 40)]
    return scores.flagged(line, rules).select("l_orderkey", "flags", "score", "action")


def leverage(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_discount").alias("off"), F.max("l_quantity").alias("qty"), F.count_if(F.col("l_returnflag") == "R").alias("back"))
    return line.select("l_orderkey", scores.capped_sum(2.0, [(F.col("off") * 30, 2.5), (F.col("qty") / 10, 4.0), (F.col("back") * 0.7, 2.8)]).alias("leverage"))


def repaired_lines(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("qty"), F.col("l_discount").alias("off"), F.col("l_extendedprice").alias("price"))
    rules = [("most_off", "off", F.col("off") <= 0.08, F.lit(0.08)), ("bulk_off", "off", (F.col("qty") < 40) | (F.col("off") >= 0.05), F.lit(0.05)), ("price", "price", F.col("price") > 2000, F.lit(2000.0))]
    return scores.repaired(line, rules).where("repairs <> ''").groupBy("repairs").agg(F.count("*").alias("n"), F.min("off").alias("lo"), F.max("off").alias("hi"), F.min("price").alias("least"))


def order_checkpoints(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    out = scores.checkpoints(o, "o_orderkey", {"status": F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "O", "open"), "value": F.when(F.col("o_totalprice") > 300000, "flag").otherwise("pass"), "rush": F.when(F.col("o_orderpriority") == "1-URGENT", "flag")})
    return out.groupBy("checkpoint", "outcome").agg(F.count("*").alias("n"))


def cross_checked(spark, sf_dir):
    """What several lines of one part and dealer say about its price."""
    line = table(spark, sf_dir, "lineitem")
    r = line.select(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("source"), F.floor("l_extendedprice").alias("price"), F.col("l_linestatus").alias("field"))
    one = r.groupBy("part", "field", "source").agg(F.min("price").alias("price"))
    return scores.consensus(one, "part", "field", "price", 20000)


def live_states(spark, sf_dir):
    now = F.lit(dt.datetime(2024, 1, 20))
    ts = F.col("ts")
    state = F.when(ts > now, "unavailable").when(ts >= now - F.expr("interval 2 days"), "live").otherwise("aged")
    return table(spark, sf_dir, "events").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def model_costs(spark, sf_dir):
    """Cost with a price break at a date."""
    units = F.get_json_object("props", "$.k").cast("long")
    cost = units * F.when(F.col("ts") < dt.datetime(2024, 1, 16), 15).otherwise(12)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(cost).alias("micros"))


def powertrain_twins(spark, sf_dir):
    """Each part with the next one of its brand whose drive and fuel words agree."""
    p = table(spark, sf_dir, "part")
    text = F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 3 == 0, "AWD hybrid").when(F.col("p_size") % 3 == 1, "front-wheel plug-in").otherwise("diesel 4x4"))
    f = p.select("p_partkey", "p_brand", C.drive(text).alias("drive"), C.fuel(text).alias("fuel"))
    twin = F.lead("p_partkey").over(Window.partitionBy("p_brand", "drive", "fuel").orderBy("p_partkey"))
    return f.select("p_partkey", twin.alias("other"), "drive", "fuel").where("other is not null")


QUERIES = {
    f.__name__: f
    for f in (
        financing_grid, rate_tiers, picked_rates, price_ladder, lot_days, fee_labels, mailboxes, dealer_ids, city_spellings, page_addresses, listing_scores, leverage, repaired_lines, order_checkpoints, cross_checked, live_states, model_costs,
        powertrain_twins,
    )
}
LABELS = " ".join(f"WHEN regexp_matches(s, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for p, n in C.FEE_LABELS)
ORACLE = {
    "dealer_ids": """WITH k AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 5 > 0 THEN lower(trim(s_name)) ELSE '' END || '|' || CASE WHEN s_suppkey % 10 > 0 THEN lower(trim(coalesce(n_name, ''))) ELSE '' END AS k FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)
        SELECT s_suppkey, CASE WHEN k = '|' THEN 'unknown' ELSE 'd_' || printf('%08x', CAST(list_reduce([2166136261::BIGINT] || list_transform(string_split(k, ''), lambda x: unicode(x)::BIGINT), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS BIGINT)) END AS dealer, sha256(s_name) AS hash FROM k""",
    "financing_grid": """SELECT p_partkey, months, down, floor(100 * (CASE WHEN apr = 0 THEN principal / months ELSE principal * (apr / 1200.0::DOUBLE) * pow(1 + apr / 1200.0::DOUBLE, months) / (pow(1 + apr / 1200.0::DOUBLE, months) - 1) END) + 0.5) / 100 AS monthly FROM (
        SELECT p_partkey, months, down, p_retailprice * (1 - down) AS principal, CAST(p_size % 12 AS DOUBLE) AS apr FROM part, (VALUES (36), (48), (60), (72), (84), (96)) t(months), (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) d(down))""",
    "rate_tiers": "SELECT CASE WHEN t <= 4.99 THEN 'low' WHEN t <= 7.99 THEN 'middle' ELSE 'high' END AS tier, count(*) AS n, min(l_tax) AS lo, max(l_tax) AS hi FROM (SELECT *, round(l_tax * 100, 2) AS t FROM lineitem) GROUP BY 1",
    "picked_rates": """SELECT p_partkey, term, apr, CASE WHEN model IS NULL THEN 'make' ELSE 'model' END AS level FROM (SELECT a.p_partkey, r.*, row_number() OVER (PARTITION BY a.p_partkey ORDER BY model IS NULL, promo, term <> 48, term, apr) AS rn FROM part a JOIN
        (SELECT p_brand AS make, CASE WHEN p_size % 2 = 0 THEN p_type END AS model, p_size * 12 AS term, CAST(p_partkey % 9 AS DOUBLE) AS apr, p_size % 3 = 0 AS promo FROM part WHERE p_size <= 12) r ON a.p_brand = r.make AND (model IS NULL OR model = a.p_type)) WHERE rn = 1""",
    "price_ladder": """WITH f AS (SELECT * FROM part), k AS (SELECT * FROM part WHERE p_size <= 30 AND p_type <> 'PROMO'), h AS (
        SELECT f.p_partkey, 0 AS r, 'exact' AS rung, k.p_retailprice AS price FROM f JOIN k USING (p_brand, p_type, p_size) UNION ALL SELECT f.p_partkey, 1, 'type', k.p_retailprice FROM f JOIN k USING (p_brand, p_type) UNION ALL SELECT f.p_partkey, 2, 'brand', k.p_retailprice FROM f JOIN k USING (p_brand))
        SELECT p_partkey, price, rung FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY r, price) AS rn FROM h) WHERE rn = 1""",
    "lot_days": """WITH g AS (SELECT l_orderkey, CAST(max(l_quantity) FILTER (l_linenumber = 1) AS INT) AS feed, CAST(min(l_shipdate) FILTER (l_returnflag = 'A') AS DATE) AS seen, CAST(min(l_shipdate) AS DATE) AS page FROM lineitem GROUP BY l_orderkey),
        d AS (SELECT l_orderkey, CASE WHEN feed % 2 = 0 AND feed > 0 AND feed <= 3650 THEN feed END AS f, date_diff('day', seen, DATE '2001-06-01') AS o, date_diff('day', page, DATE '2001-06-01') AS p FROM g),
        e AS (SELECT l_orderkey, f, CASE WHEN o > 0 AND o <= 3650 THEN o END AS o, CASE WHEN p > 0 AND p <= 3650 THEN p END AS p FROM d)
        SELECT l_orderkey, CAST(coalesce(f, o, p) AS INT) AS days, CASE WHEN f IS NOT NULL THEN 'feed' WHEN o IS NOT NULL THEN 'own' WHEN p IS NOT NULL THEN 'page' END AS source, f IS NULL AND o IS NOT NULL AS at_least FROM e""",
    "fee_labels": f"SELECT CASE WHEN s = '' THEN 'unlabeled' {LABELS} ELSE 'other' END AS label, count(*) AS n FROM (SELECT lower(trim(unnest(string_split(text, chr(10))))) AS s FROM documents) GROUP BY 1",
    "mailboxes": """WITH r AS (SELECT 'ab' || (c_custkey % 40) AS bare, 'a.b' || (c_custkey % 40) AS dotted, c_nationkey % 3 AS h FROM customer) SELECT CASE WHEN h = 2 THEN dotted || '@example.org' ELSE bare || '@gmail.com' END AS mailbox, count(*) AS n FROM r GROUP BY 1""",
    "city_spellings": f"""WITH c AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 11 = 1 THEN ' ' ELSE {CITY} END AS raw FROM customer),
        k AS (SELECT raw, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(raw), ', *(ab|alberta|alta\\.?)$', ''), '\\bsainte\\b', 'ste', 'g'), '\\bsaint\\b', 'st', 'g'), '[^a-z0-9]+', ' ', 'g')) AS k FROM c)
        SELECT nullif(k, '') AS city, count(*) AS n, count(DISTINCT raw) AS spellings FROM k GROUP BY 1""",
    "page_addresses": r"""SELECT split_part(u, '/', 1) AS host, count(*) AS n, count(DISTINCT u) AS paths FROM (SELECT regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://(www\.)?', ''), '[?#].*$', ''), '/+$', '') AS u FROM pages) GROUP BY 1""",
    "listing_scores": """WITH g AS (SELECT l_orderkey, count(*) > 6 AS a, max(l_discount) >= 0.1 AS b, sum(l_quantity) > 150 AS c, max(l_tax) = 0 AS d FROM lineitem GROUP BY l_orderkey),
        s AS (SELECT l_orderkey, concat_ws(',', CASE WHEN a THEN 'many_lines' END, CASE WHEN b THEN 'deep_discount' END, CASE WHEN c THEN 'bulk' END, CASE WHEN d THEN 'odd_tax' END) AS flags, greatest(0, 100 - 15 * a::INT - 25 * b::INT - 30 * c::INT - 40 * d::INT) AS score FROM g)
        SELECT l_orderkey, flags, score, CASE WHEN score < 30 THEN 'reject' WHEN score < 70 THEN 'review' ELSE 'accept' END AS action FROM s""",
    "leverage": "SELECT l_orderkey, round(greatest(0, least(10, 2.0::DOUBLE + least(max(l_discount) * 30, 2.5) + least(max(l_quantity) / 10, 4.0) + least(count(*) FILTER (l_returnflag = 'R') * 0.7::DOUBLE, 2.8))), 1) AS leverage FROM lineitem GROUP BY l_orderkey",
    "repaired_lines": """WITH a AS (SELECT *, l_discount > 0.08 AS x FROM lineitem), b AS (SELECT *, CASE WHEN x THEN 0.08::DOUBLE ELSE l_discount END AS o FROM a), c AS (SELECT *, l_quantity >= 40 AND o < 0.05 AS y FROM b), d AS (SELECT CASE WHEN y THEN 0.05::DOUBLE ELSE o END AS off, x, y, l_extendedprice <= 2000 AS z, CASE WHEN l_extendedprice <= 2000 THEN 2000.0::DOUBLE ELSE l_extendedprice END AS price FROM c)
        SELECT concat_ws(',', CASE WHEN x THEN 'most_off' END, CASE WHEN y THEN 'bulk_off' END, CASE WHEN z THEN 'price' END) AS repairs, count(*) AS n, min(off) AS lo, max(off) AS hi, min(price) AS least FROM d WHERE x OR y OR z GROUP BY 1""",
    "order_checkpoints": """SELECT checkpoint, outcome, count(*) AS n FROM (SELECT 'status' AS checkpoint, CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'open' END AS outcome FROM orders UNION ALL SELECT 'value', CASE WHEN o_totalprice > 300000 THEN 'flag' ELSE 'pass' END FROM orders
        UNION ALL SELECT 'rush', CASE WHEN o_orderpriority = '1-URGENT' THEN 'flag' END FROM orders) WHERE outcome IS NOT NULL GROUP BY ALL""",
    "cross_checked": """WITH r AS (SELECT l_partkey AS part, l_linestatus AS field, l_returnflag AS source, min(CAST(floor(l_extendedprice) AS BIGINT)) AS price FROM lineitem GROUP BY ALL)
        SELECT part, field, CASE WHEN max(price) - min(price) <= 20000 THEN min(price) END AS value, count(*) AS n, CASE WHEN count(*) = 1 THEN 'structured' WHEN max(price) - min(price) <= 20000 THEN 'cross' ELSE 'conflict' END AS kind FROM r GROUP BY part, field""",
    "live_states": "SELECT CASE WHEN ts > TIMESTAMP '2024-01-20' THEN 'unavailable' WHEN ts >= TIMESTAMP '2024-01-18' THEN 'live' ELSE 'aged' END AS state, count(*) AS n FROM events GROUP BY 1",
    "model_costs": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT) * CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 15 ELSE 12 END) AS BIGINT) AS micros FROM events GROUP BY event_type",
    "powertrain_twins": """WITH f AS (SELECT p_partkey, p_brand, p_size % 3 AS k FROM part) SELECT a.p_partkey, min(b.p_partkey) AS other, CASE a.k WHEN 1 THEN 'FWD' ELSE 'AWD' END AS drive, CASE a.k WHEN 0 THEN 'hybrid' WHEN 1 THEN 'phev' ELSE 'diesel' END AS fuel
        FROM f a JOIN f b ON a.p_brand = b.p_brand AND a.k = b.k AND b.p_partkey > a.p_partkey GROUP BY a.p_partkey, a.k""",
}
