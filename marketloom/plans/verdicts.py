"""Verdicts about listings and quotes over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import verdicts as V
from marketloom.session import table

MONEY = "decimal(18,2)"
YEAR = 2024


def msrp_authorities(spark, sf_dir):
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    price = F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice") / F.col("l_quantity"))
    found = V.msrp_authority(price, F.when(F.col("p_size") > 5, F.col("p_retailprice") * 5), F.col("p_size") > 25)
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(found.alias("v")).select("v.*")
    return rows.groupBy("basis", "source").agg(F.count("*").alias("n"), F.count("over_by").alias("inflated_n"), F.coalesce(F.sum(F.col("over_by").cast("long")), F.lit(0)).alias("over_by"), F.count_if(F.col("msrp") > 5000).alias("dear_n"))


NAMES = ["Freight & PDI", "Paint Protection", "Loyalty rebate", "Admin charge", "Winter mats", "Delivery", "Doc fee"]


def quote_totals(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.col("l_linenumber"))
    price = F.when(F.col("l_linenumber") == 3, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).cast(MONEY)
    verdict = F.when(F.col("l_returnflag") == "R", "standard").when(F.col("l_returnflag") == "A", "flagged")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), name.alias("name"), price.alias("price"), verdict.alias("verdict"))
    quotes = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast(MONEY).alias("selling"))
    out = V.reconcile(lines, "o_orderkey", "name", "price", "verdict", quotes, "selling")
    return out.select("o_orderkey", *[F.col(c).cast("double").alias(c) for c in ("fees", "addons", "discounts", "on_top", "pre_tax")])


def financing_traps(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    months = F.when(F.col("o_orderstatus") == "F", 36).when(F.col("o_orderstatus") == "O", 60)
    trap = V.financing_trap(F.col("o_totalprice") * 0.04 - 1000, F.pmod("o_custkey", F.lit(9)) + 0.99, F.when(F.col("o_orderpriority") != "5-LOW", 1.99).otherwise(4.99), months, F.col("o_totalprice"))
    return o.select(trap.alias("t")).where("t is not null").groupBy("t.mode", "t.is_trap").agg(F.count("*").alias("n"), F.sum(F.col("t.extra_interest").cast("long")).alias("extra"), F.sum(F.col("t.net").cast("long")).alias("net"))


def warranties_left(spark, sf_dir):
    text = F.when(F.col("p_type") == "PROMO", "3-year/60,000 km").when(F.col("p_type") == "LARGE", "6-year/unlimited km").when(F.col("p_type") == "SMALL", "none").otherwise("5 Year / 100,000 km")
    part = table(spark, sf_dir, "part").withColumn("left", V.warranty_left(V.coverage(text), F.lit(2014) + F.pmod("p_size", F.lit(12)), F.when(F.col("p_size") > 4, F.floor(F.col("p_retailprice") * 60).cast("int")), YEAR))
    return part.select("p_partkey", "left.years_left", "left.km_left", "left.active")


def payment_checks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    often = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "weekly").when(F.col("o_orderpriority") == "5-LOW", "monthly").when(F.col("o_orderpriority") == "3-MEDIUM", "biweekly")
    check = V.payment_stream(F.floor(F.col("o_totalprice") / 250), F.lit(60), F.col("o_totalprice"), often)
    return o.select(check.alias("c")).groupBy("c.verdict", "c.payments").agg(F.count("*").alias("n"), F.sum(F.col("c.expected").cast("long")).alias("expected"))


def odometer_checks(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    check = V.odometer_check(F.col("l_extendedprice"), F.when(F.col("l_linestatus") == "F", F.year("l_shipdate")).otherwise(F.year("l_shipdate") + 4), F.col("l_returnflag") == "N", 2005)
    return line.select(check.alias("c")).groupBy("c.kind", "c.flag").agg(F.count("*").alias("n"))


def served_regions(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    country = F.when(F.col("n_regionkey") == 0, " ca").when(F.col("n_regionkey") == 1, "US").when(F.col("n_regionkey") == 2, "CA")
    region = F.when(F.col("c_mktsegment") == "BUILDING", "AB").when(F.col("c_mktsegment") == "MACHINERY", "").otherwise("on")
    return c.select(V.region_gate(country, region, [("CA", "AB")]).alias("g")).groupBy("g.served", "g.reason").agg(F.count("*").alias("n"))


TRACES = {"view": ["HTTP 404", "HTTP 200 empty"], "signup": ["HTTP 403"], "purchase": ["HTTP 503", "TimeoutError"], "error": ["fetch failed"], "click": []}


def fetch_misses(spark, sf_dir):
    """Kinds of the traces that stand for the events of each user's day."""
    trace = F.create_map(*[x for k, v in TRACES.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]).cast("array<string>"))])[F.col("event_type")]
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.flatten(F.collect_list(trace)).alias("trace"))
    return days.groupBy(V.miss_class(F.col("trace")).alias("kind")).agg(F.count("*").alias("n"))


def grades(spark, sf_dir):
    grade = F.when(F.col("l_returnflag") == "N", "not_gradable").when(F.col("l_returnflag") == "A", "correct").when(F.col("l_discount") > 0.09, "false_accusation").otherwise("wrong")
    return V.grade_summary(V.graded(table(spark, sf_dir, "lineitem").select("l_orderkey", grade.alias("grade")), "l_orderkey", "grade"))


QUERIES = {f.__name__: f for f in (msrp_authorities, quote_totals, financing_traps, warranties_left, payment_checks, odometer_checks, served_regions, fetch_misses, grades)}
ORACLE = {
    "msrp_authorities": """WITH a AS (SELECT CASE WHEN l_tax > 0.02 THEN l_extendedprice / l_quantity END AS s, CASE WHEN p_size > 5 THEN p_retailprice * 5 END AS r, p_size > 25 AS e FROM lineitem JOIN part ON l_partkey = p_partkey),
        b AS (SELECT *, e AND r IS NOT NULL AS sure FROM a),
        c AS (SELECT CASE WHEN sure THEN 'exact' WHEN s IS NOT NULL OR r IS NULL THEN 'dealer_stated' ELSE 'starting_at' END AS basis, CASE WHEN NOT sure AND (s IS NOT NULL OR r IS NULL) THEN 'listing' ELSE 'catalog' END AS source,
              CASE WHEN sure AND s > r * 1.03::DOUBLE AND s - r > 800 THEN CAST(floor(s - r + 0.5) AS BIGINT) END AS over_by, CASE WHEN sure THEN r ELSE coalesce(s, r, 0) END AS msrp FROM b)
        SELECT basis, source, count(*) AS n, count(over_by) AS inflated_n, CAST(coalesce(sum(over_by), 0) AS BIGINT) AS over_by, count(*) FILTER (msrp > 5000) AS dear_n FROM c GROUP BY ALL""",
    "quote_totals": """WITH l AS (SELECT l_orderkey, l_linenumber AS k, l_returnflag AS f, CAST(CASE WHEN l_linenumber = 3 THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,2)) AS p FROM lineitem),
        c AS (SELECT l_orderkey, p, CASE WHEN k = 3 THEN CASE WHEN p <= 0 THEN 'd' END WHEN k IN (2, 4) THEN 'a' WHEN k IN (1, 6, 7) THEN 'f' WHEN f = 'R' THEN 'f' ELSE 'a' END AS c FROM l),
        s AS (SELECT l_orderkey, sum(p) FILTER (c = 'f') AS fees, sum(p) FILTER (c = 'a') AS addons, sum(p) FILTER (c = 'd') AS discounts FROM c GROUP BY l_orderkey)
        SELECT o_orderkey, CAST(coalesce(fees, 0) AS DOUBLE) AS fees, CAST(coalesce(addons, 0) AS DOUBLE) AS addons, CAST(coalesce(discounts, 0) AS DOUBLE) AS discounts, CAST(coalesce(fees, 0) + coalesce(addons, 0) AS DOUBLE) AS on_top,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) + coalesce(fees, 0) + coalesce(addons, 0) AS DOUBLE) AS pre_tax FROM orders LEFT JOIN s ON o_orderkey = l_orderkey""",
    "financing_traps": """WITH a AS (SELECT o_totalprice AS loan, o_totalprice * 0.04::DOUBLE - 1000 AS d, (o_custkey % 9) + 0.99::DOUBLE AS x, CASE WHEN o_orderpriority <> '5-LOW' THEN 1.99::DOUBLE ELSE 4.99::DOUBLE END AS y, CASE o_orderstatus WHEN 'F' THEN 36 WHEN 'O' THEN 60 END AS m FROM orders),
        b AS (SELECT *, coalesce(x > y + 0.1::DOUBLE AND m IS NOT NULL, false) AS told, loan * (x / 1200.0::DOUBLE) * m / (1 - pow(1 + x / 1200.0::DOUBLE, -m)) - loan AS i, loan * (y / 1200.0::DOUBLE) * m / (1 - pow(1 + y / 1200.0::DOUBLE, -m)) - loan AS j FROM a WHERE d > 0),
        c AS (SELECT *, CASE WHEN told THEN floor(greatest(0, i) - greatest(0, j) + 0.5) END AS e FROM b)
        SELECT CASE WHEN told THEN 'quantified' ELSE 'awareness' END AS mode, e > d AS is_trap, count(*) AS n, CAST(sum(CAST(e AS BIGINT)) AS BIGINT) AS extra, CAST(sum(CAST(floor(d - e + 0.5) AS BIGINT)) AS BIGINT) AS net FROM c GROUP BY ALL""",
    "warranties_left": f"""WITH a AS (SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 3 WHEN 'LARGE' THEN 6 WHEN 'SMALL' THEN NULL ELSE 5 END AS y, CASE p_type WHEN 'PROMO' THEN 60000 WHEN 'LARGE' THEN NULL WHEN 'SMALL' THEN NULL ELSE 100000 END AS km,
              greatest(0, {YEAR} - (2014 + p_size % 12)) AS age, CASE WHEN p_size > 4 THEN CAST(floor(p_retailprice * 60) AS INT) END AS odo FROM part)
        SELECT p_partkey, y - age AS years_left, km - odo AS km_left, CASE WHEN y IS NOT NULL THEN y > age AND coalesce(km > odo, true) END AS active FROM a""",
    "payment_checks": """WITH a AS (SELECT floor(o_totalprice / 250) AS pay, o_totalprice AS total, CASE o_orderpriority WHEN '1-URGENT' THEN 260 WHEN '2-HIGH' THEN 260 WHEN '3-MEDIUM' THEN 130 WHEN '5-LOW' THEN 60 END AS n FROM orders),
        b AS (SELECT *, CASE WHEN pay > 0 THEN total / (pay * n) END AS q FROM a)
        SELECT CASE WHEN q IS NULL THEN NULL WHEN q BETWEEN 0.98 AND 1.02 THEN 'equal' WHEN q > 1.02 AND q <= 1.16 THEN 'tax' WHEN q < 1 THEN 'short' ELSE 'over' END AS verdict, CASE WHEN q IS NOT NULL THEN n END AS payments, count(*) AS n, CAST(sum(CASE WHEN q IS NOT NULL THEN CAST(pay * n AS BIGINT) END) AS BIGINT) AS expected FROM b GROUP BY 1, 2""",
    "odometer_checks": """WITH a AS (SELECT l_extendedprice AS km, greatest(0, 2005 - (year(l_shipdate) + CASE l_linestatus WHEN 'F' THEN 0 ELSE 4 END)) AS age, l_returnflag = 'N' AS fresh FROM lineitem),
        b AS (SELECT CASE WHEN fresh THEN CASE WHEN km <= 500 THEN 'delivery' ELSE 'not_new' END WHEN age <= 1 THEN 'nearly_new' WHEN km < age * 6000 THEN 'low' WHEN km > age * 30000 THEN 'high' ELSE 'normal' END AS kind FROM a)
        SELECT kind, kind IN ('not_new', 'low') AS flag, count(*) AS n FROM b GROUP BY 1""",
    "served_regions": """WITH a AS (SELECT CASE n_regionkey WHEN 0 THEN 'CA' WHEN 1 THEN 'US' WHEN 2 THEN 'CA' END AS c, CASE c_mktsegment WHEN 'BUILDING' THEN 'AB' WHEN 'MACHINERY' THEN NULL ELSE 'ON' END AS r FROM customer JOIN nation ON c_nationkey = n_nationkey),
        b AS (SELECT CASE WHEN c IS NULL OR r IS NULL THEN 'unknown' WHEN c = 'CA' AND r = 'AB' THEN 'served' WHEN c = 'CA' THEN 'other_province' ELSE 'other_country' END AS reason FROM a)
        SELECT reason IN ('unknown', 'served') AS served, reason, count(*) AS n FROM b GROUP BY ALL""",
    "fetch_misses": """SELECT CASE WHEN v THEN 'responded-no-feed' WHEN s THEN 'blocked' WHEN p THEN 'server-error' WHEN e THEN 'unreachable' ELSE 'no-trace' END AS kind, count(*) AS n FROM (
        SELECT bool_or(event_type = 'view') AS v, bool_or(event_type = 'signup') AS s, bool_or(event_type = 'purchase') AS p, bool_or(event_type = 'error') AS e FROM events GROUP BY user_id, CAST(ts AS DATE)) GROUP BY 1""",
    "grades": """WITH g AS (SELECT l_orderkey, bool_or(l_returnflag = 'R' AND l_discount > 0.09) AS a, bool_or(l_returnflag = 'R') AS w, bool_or(l_returnflag <> 'N') AS k FROM lineitem GROUP BY l_orderkey),
        s AS (SELECT count(*) AS listings, count(*) FILTER (k) AS graded, count(*) FILTER (k AND NOT w) AS passed, count(*) FILTER (a) AS false_accusations FROM g)
        SELECT *, CASE WHEN graded > 0 THEN floor(passed / graded * 1000 + 0.5) / 10 END AS accuracy_pct, CASE WHEN graded > 0 AND passed = graded THEN floor(3.0::DOUBLE / graded * 1000 + 0.5) / 10 END AS bound_pct FROM s""",
}
