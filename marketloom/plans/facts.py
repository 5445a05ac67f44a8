"""Rollups, ledgers and joins over the test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marketloom.functions import columns as C
from marketloom.functions.windows import interpolated
from marketloom.operators import joins, ledger, rollups
from marketloom.session import table

SINCE, AS_OF = dt.datetime(2024, 1, 15), dt.datetime(2024, 1, 24, 12)
MONEY = "decimal(18,2)"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("provider"), (F.col("event_id") % 3).alias("operation"), "ts", "user_id", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("duration_ms"), F.get_json_object("props", "$.k").cast("long").alias("credits"))


CALLS = """calls AS (SELECT event_type AS provider, event_id % 3 AS operation, ts, user_id, event_type <> 'error' AS ok, value AS duration_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS credits FROM events)"""
ROLLUP = """count(*) AS calls, count(*) FILTER (ok) AS ok_n, count(*) FILTER (NOT ok) AS failed, round(100.0::DOUBLE * count(*) FILTER (NOT ok) / greatest(1, count(*)), 1) AS fail_pct,
       CAST(sum(credits) AS BIGINT) AS credits, quantile_disc(duration_ms, 0.5) AS p50_ms, quantile_disc(duration_ms, 0.95) AS p95_ms"""


def provider_costs(spark, sf_dir):
    return rollups.provider_rollup(_calls(spark, sf_dir), ["provider"], SINCE)


def operation_costs(spark, sf_dir):
    return rollups.provider_rollup(_calls(spark, sf_dir), ["provider", "operation"], SINCE)


def worst_users(spark, sf_dir):
    return rollups.worst(_calls(spark, sf_dir), "user_id")


def rolling_windows(spark, sf_dir):
    windows = spark.createDataFrame([("today", dt.datetime(2024, 1, 24)), ("7d", dt.datetime(2024, 1, 17, 12)), ("30d", dt.datetime(2023, 12, 25, 12))], "name string, since timestamp_ntz")
    rows = joins.in_windows(table(spark, sf_dir, "events").where(F.col("ts") <= F.lit(AS_OF)), windows, "ts")
    return rows.groupBy("name", "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sum(F.col("value").cast("decimal(18,4)")).alias("value"))


def periods_to_date(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("amount", F.col("value").cast("decimal(18,4)"))
    return rollups.period_to_date(rows, "ts", "amount", AS_OF)


def type_histogram(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    by = e.groupBy("event_type").agg(F.count("*").alias("n"))
    return by.withColumn("share_pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


def latency_table(spark, sf_dir):
    """Mean, median and greatest value of each kind, and how many lie above a bound."""
    e = table(spark, sf_dir, "events")
    mean = (F.sum(F.col("value").cast("decimal(18,6)")).cast("double") / F.count("*")).alias("mean")
    told = e.groupBy("event_type").agg(mean, F.max("value").alias("top"), F.count_if(F.col("value") > 50).alias("slow_n"))
    return told.join(interpolated(e, ["event_type"], "value", {"median": 0.5}), "event_type", "left")


def return_pivot(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("qty", F.col("l_quantity").cast("long"))
    return rollups.pivot_shares(line, "l_returnflag", "l_linestatus", ["O", "F"], "qty")


def latest_orders(spark, sf_dir):
    """All orders of the last day that has any."""
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    last = o.agg(F.max("day").alias("day"))
    return o.join(F.broadcast(last), "day").select("o_orderkey", "o_custkey", F.col("day").cast("string").alias("day"))


def newest_per_customer(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"), F.max("o_orderdate").alias("last_on"))


def customer_documents(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return rollups.ordered_document(o, "o_custkey", [F.col("o_orderkey").cast("string"), F.col("o_orderstatus")], ["o_orderdate", "o_orderkey"])


def status_sets(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("o_orderstatus", F.lit(1))))).alias("m"))
    return g.select("o_custkey", "priorities", F.array_join(F.map_keys("m"), ",").alias("statuses"))


def brand_spans(spark, sf_dir):
    return rollups.spans(table(spark, sf_dir, "part"), "p_brand", "p_type", "p_size")


def unanimous_statuses(spark, sf_dir):
    return rollups.unanimous(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_orderstatus")


def having_guard(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done")).where("done > 0 and n >= 12").withColumn("done_pct", C.share_of(F.col("done"), F.col("n")))


def sales_by_segment(spark, sf_dir):
    """Joins along the keys, filtered and grouped."""
    c, o, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "nation")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast(MONEY)).alias("total"))


def delivery_status(spark, sf_dir):
    """Orders with what their lines say, orders without lines too."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    ship = lambda f: F.max(F.when(F.col("l_returnflag") == f, F.col("l_shipdate")))
    facts = line.groupBy("l_orderkey").agg(F.count("*").alias("lines"), ship("R").alias("returned_at"), ship("A").alias("accepted_at"), F.max("l_shipdate").alias("last_at"))
    j = o.join(facts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status = F.when(F.col("lines").isNull(), "none").when(F.col("returned_at").isNotNull(), "returned").when(F.col("accepted_at").isNotNull(), "accepted").otherwise("open")
    return j.select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), status.alias("status"), "last_at")


def stalled_orders(spark, sf_dir):
    """Open orders with nothing shipped by a time after they were placed."""
    o, line = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), table(spark, sf_dir, "lineitem")
    early = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where(F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("interval 60 days")).select("o_orderkey")
    return o.join(early, "o_orderkey", "left_anti").select("o_orderkey", "o_orderdate")


def customers_with_returns(spark, sf_dir):
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 45")
    hit = o.join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return table(spark, sf_dir, "customer").join(hit, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


def customers_without_orders(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


def customer_balances(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    sign = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", -1).otherwise(0)
    entries = o.select(F.col("o_custkey"), (F.col("o_totalprice").cast(MONEY) * sign).cast(MONEY).alias("delta"))
    holds = o.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select("o_custkey", F.col("o_totalprice").cast(MONEY).alias("amount"))
    return ledger.balances(entries, "o_custkey", "delta", holds).select("o_custkey", F.col("balance").cast(MONEY).alias("balance"))


def unsettled_months(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    entries = o.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority", (F.col("o_totalprice").cast(MONEY) * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)).cast(MONEY).alias("amount"))
    return ledger.unsettled(entries, ["month", "o_orderpriority"], "amount").select("month", "o_orderpriority", F.col("residual").cast(MONEY).alias("residual"))


SHARES = [("Ana", 3334), ("Ben", 3333), ("Cy", 3333)]


def profit_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast(MONEY).alias("net"))
    return ledger.allocate(o, spark.createDataFrame(SHARES, "name string, bps int"), "o_orderkey", "net")


def accrued_charges(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    lines = o.select(F.col("o_orderkey").alias("line_id"), F.col("o_totalprice").cast(MONEY).alias("cost"), F.when(F.col("o_orderkey") % 4 == 0, "USD").otherwise("CAD").alias("currency"))
    fx = spark.createDataFrame([("USD", "1.36"), ("CAD", "1.00")], "currency string, rate string").withColumn("rate", F.col("rate").cast("decimal(6,4)"))
    people = spark.createDataFrame(SHARES, "name string, bps int")
    charged = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("line_id"), F.lit("Ana").alias("name"))
    return ledger.accrue(lines, people, charged, fx)


def true_ups(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    due = o.select("o_custkey", F.col("o_totalprice").cast(MONEY).alias("amount"))
    paid = o.where("o_orderstatus <> 'O'").select("o_custkey", F.col("o_totalprice").cast(MONEY).alias("amount"))
    return ledger.true_up(due, paid, ["o_custkey"])


def fuzzy_duplicates(spark, sf_dir):
    return joins.near_duplicates(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_partkey", "p_retailprice", "p_size")


def name_matches(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    lot = F.lpad(F.col("p_partkey").cast("string"), 12, "0")
    place = F.when(F.col("p_size") > 40, " of the north").when(F.col("p_size") > 30, " of").otherwise("")
    reg = part.select(F.col("p_partkey").alias("reg_id"), F.concat("p_name", F.lit(" lot"), lot, F.lit(" ltd"), place).alias("reg_name"))
    probe = part.select("p_partkey", F.concat(F.lit("Lot"), lot, F.lit("-"), "p_name").alias("name"))
    return joins.match_names(probe, reg, "p_partkey", "name", "reg_id", "reg_name")


def nearest_city(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (49.0 + F.pmod("c_custkey", F.lit(97)) / 10.0).alias("lat"), (-120.0 + F.pmod("c_custkey", F.lit(101)) / 10.0).alias("lon"))
    s = table(spark, sf_dir, "nation").select(F.col("n_name").alias("centre"), (49.0 + F.pmod(F.col("n_nationkey") * 7, F.lit(10))).alias("lat"), (-120.0 + F.pmod(F.col("n_nationkey") * 3, F.lit(10))).alias("lon"))
    return joins.nearest_point(c, s, "c_custkey")


def base_models(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("line", F.concat_ws(" ", "p_brand", "p_type", F.col("p_size").cast("string")))
    known = part.where("p_size <= 10").select(F.concat_ws(" ", "p_brand", "p_type").alias("base")).unionByName(part.where("p_size <= 3").select(F.col("line").alias("base"))).unionByName(part.select(F.col("p_brand").alias("base")))
    return joins.longest_prefix(part.select("p_partkey", "line"), known, "line", "base")


def nearest_year_prices(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    book = o.where("o_orderstatus = 'F'").groupBy("o_orderpriority", "year").agg(F.max(F.col("o_totalprice").cast(MONEY)).alias("top")).where("year in (1996, 1998, 2000)")
    return joins.prefer(o.select("o_orderkey", "o_orderpriority", "year"), book, ["o_orderpriority"], "year", "o_orderkey", [F.col("top")]).select("o_orderkey", "rung", "top")


PLACED = """SELECT o_orderkey, o_orderpriority, CAST(year(o_orderdate) AS INT) AS year FROM orders"""
QUERIES = {
    f.__name__: f
    for f in (
        provider_costs, operation_costs, worst_users, rolling_windows, periods_to_date, type_histogram, latency_table, return_pivot, latest_orders, newest_per_customer, customer_documents, status_sets, brand_spans, unanimous_statuses, having_guard,
        sales_by_segment, delivery_status, stalled_orders, customers_with_returns, customers_without_orders, customer_balances, unsettled_months, profit_split, accrued_charges, true_ups, fuzzy_duplicates, name_matches, nearest_city, base_models,
        nearest_year_prices,
    )
}
SPLIT = "(VALUES ('Ana', 3334), ('Ben', 3333), ('Cy', 3333)) AS f(name, bps)"
ORACLE = {
    "provider_costs": f"WITH {CALLS} SELECT provider, {ROLLUP} FROM calls WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY provider",
    "operation_costs": f"WITH {CALLS} SELECT provider, operation, {ROLLUP} FROM calls WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY ALL",
    "worst_users": f"WITH {CALLS} SELECT user_id, count(*) AS calls, count(*) FILTER (NOT ok) AS failed FROM calls GROUP BY user_id HAVING count(*) FILTER (NOT ok) > 0 ORDER BY failed DESC, user_id LIMIT 8",
    "rolling_windows": """SELECT name, event_type, count(*) AS n, count(DISTINCT user_id) AS users, sum(CAST(value AS DECIMAL(18,4))) AS value
        FROM events JOIN (VALUES ('today', TIMESTAMP '2024-01-24'), ('7d', TIMESTAMP '2024-01-17 12:00:00'), ('30d', TIMESTAMP '2023-12-25 12:00:00')) AS w(name, since) ON ts >= since WHERE ts <= TIMESTAMP '2024-01-24 12:00:00' GROUP BY name, event_type""",
    "periods_to_date": """SELECT p AS period, count(ts) AS n, coalesce(sum(CAST(value AS DECIMAL(18,4))), 0) AS amount FROM (VALUES ('day', TIMESTAMP '2024-01-24'), ('week', TIMESTAMP '2024-01-22'), ('month', TIMESTAMP '2024-01-01')) AS w(p, since)
        LEFT JOIN events ON ts >= since AND ts <= TIMESTAMP '2024-01-24 12:00:00' GROUP BY p""",
    "type_histogram": "SELECT event_type, n, round(100.0::DOUBLE * n / sum(n) OVER (), 4) AS share_pct FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)",
    "latency_table": "SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS mean, quantile_cont(value, 0.5) AS median, max(value) AS top, count(*) FILTER (value > 50) AS slow_n FROM events GROUP BY event_type",
    "return_pivot": """SELECT l_returnflag, o AS amount_o, f AS amount_f, t AS total, round(100.0::DOUBLE * o / t, 1) AS share_o, round(100.0::DOUBLE * f / t, 1) AS share_f FROM (
        SELECT l_returnflag, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_linestatus = 'O'), 0) AS BIGINT) AS o, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_linestatus = 'F'), 0) AS BIGINT) AS f, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS t FROM lineitem GROUP BY l_returnflag)""",
    "latest_orders": "SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)",
    "newest_per_customer": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, max(o_orderdate) AS last_on FROM orders GROUP BY o_custkey",
    "customer_documents": "SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, '|' ORDER BY o_orderdate, o_orderkey) AS doc FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey",
    "status_sets": "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS priorities, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS statuses FROM orders GROUP BY o_custkey",
    "brand_spans": "SELECT p_brand, string_agg(p_type || ':' || lo || '-' || hi, '|' ORDER BY p_type) AS doc FROM (SELECT p_brand, p_type, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY ALL) GROUP BY p_brand",
    "unanimous_statuses": "SELECT o_custkey, o_orderpriority, min(o_orderstatus) AS o_orderstatus, count(*) AS n FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderstatus) = 1 AND count(*) >= 2",
    "having_guard": "SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, round(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / greatest(1, count(*)), 1) AS done_pct FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'F') > 0 AND count(*) >= 12",
    "sales_by_segment": "SELECT n_name, c_mktsegment, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    "delivery_status": """SELECT o_orderkey, coalesce(lines, 0) AS lines, CASE WHEN lines IS NULL THEN 'none' WHEN r IS NOT NULL THEN 'returned' WHEN a IS NOT NULL THEN 'accepted' ELSE 'open' END AS status, last_at FROM orders LEFT JOIN (
        SELECT l_orderkey, count(*) AS lines, max(l_shipdate) FILTER (l_returnflag = 'R') AS r, max(l_shipdate) FILTER (l_returnflag = 'A') AS a, max(l_shipdate) AS last_at FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
    "stalled_orders": "SELECT o_orderkey, o_orderdate FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_shipdate <= o.o_orderdate + INTERVAL 60 DAY)",
    "customers_with_returns": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45))",
    "customers_without_orders": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "customer_balances": """SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2)) * CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END) - coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'), 0) AS DECIMAL(18,2)) AS balance
        FROM orders GROUP BY o_custkey""",
    "unsettled_months": """SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2)) * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) AS DECIMAL(18,2)) AS residual FROM orders GROUP BY ALL HAVING abs(residual) > 0.005""",
    "profit_split": f"""SELECT o_orderkey, name, CAST(part + CASE WHEN rn = 1 THEN net - total ELSE 0 END AS DECIMAL(18,2)) AS share FROM (SELECT *, sum(part) OVER (PARTITION BY o_orderkey) AS total, row_number() OVER (PARTITION BY o_orderkey ORDER BY bps DESC, name) AS rn FROM (
        SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS net, name, bps, CAST(round(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * bps AS DECIMAL(28,6)) / CAST(10000 AS DECIMAL(6,0)) + 0.0000000001, 2) AS DECIMAL(18,2)) AS part FROM orders, {SPLIT}))""",
    "accrued_charges": f"""SELECT line_id, name, amount FROM (SELECT o_orderkey AS line_id, o_orderpriority, name, CAST(CAST((CAST(round(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderkey % 4 = 0 THEN 13600 ELSE 10000 END * bps + 50000000) // 100000000 AS DECIMAL(18,2)) / 100 AS DECIMAL(18,2)) AS amount FROM orders, {SPLIT})
        WHERE NOT (o_orderpriority = '1-URGENT' AND name = 'Ana')""",
    "true_ups": "SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'O') AS DECIMAL(18,2)) AS adjustment FROM orders GROUP BY o_custkey HAVING abs(adjustment) >= 0.01",
    "fuzzy_duplicates": """WITH c AS (SELECT p_brand, p_type, p_size, p_retailprice AS p, min(p_partkey) AS k, max(p_partkey) AS last FROM part WHERE p_retailprice >= 0 AND p_brand IS NOT NULL AND p_type IS NOT NULL AND p_size IS NOT NULL GROUP BY ALL),
        l AS (SELECT a.k AS a, b.k AS b, abs(a.p - b.p) <= 0.05::DOUBLE * a.p AS up, abs(a.p - b.p) <= 0.05::DOUBLE * b.p AND (b.k < a.last OR abs(a.p - b.p) <= 0.05::DOUBLE * a.p) AS down FROM c a JOIN c b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.k < b.k WHERE abs(a.p_size - b.p_size) <= 5)
        SELECT a, b, CASE WHEN up AND down THEN 'all' WHEN up THEN 'a first' ELSE 'b first' END AS link FROM l WHERE up OR down
        UNION ALL SELECT k, p_partkey, 'copy' FROM part JOIN c ON c.p_brand = part.p_brand AND c.p_type = part.p_type AND c.p_size = part.p_size AND c.p = p_retailprice WHERE k < p_partkey""",
    "name_matches": """WITH p AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ') || ['lot' || lpad(CAST(p_partkey AS VARCHAR), 12, '0')]) AS w FROM part),
        r AS (SELECT p_partkey AS reg_id, list_distinct(string_split(p_name, ' ') || ['lot' || lpad(CAST(p_partkey AS VARCHAR), 12, '0'), 'ltd'] || CASE WHEN p_size > 40 THEN ['of', 'the', 'north'] WHEN p_size > 30 THEN ['of'] ELSE [] END) AS w FROM part),
        l AS (SELECT p_partkey, w, list_sort(list_transform(w, lambda x: (-length(x), x)))[1] AS top FROM p),
        s AS (SELECT l.p_partkey, reg_id, len(list_intersect(l.w, r.w)) AS k, len(l.w) AS a, len(r.w) AS b FROM l JOIN r ON list_contains(r.w, l.top[2])),
        t AS (SELECT p_partkey, reg_id, round(least(1.0, k::DOUBLE / greatest(a, b) + CASE WHEN k > 0 AND k = least(a, b) THEN 0.15 ELSE 0 END), 6) AS score FROM s),
        u AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, reg_id) AS rn, lead(score) OVER (PARTITION BY p_partkey ORDER BY score DESC, reg_id) AS second FROM t WHERE score >= 0.72)
        SELECT p_partkey, reg_id, score FROM u WHERE rn = 1 AND (second IS NULL OR second < score)""",
    "nearest_city": """SELECT c_custkey, centre, round(km, 4) AS km FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY km, centre) AS rn FROM (
        SELECT c_custkey, n_name AS centre, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians((49.0 + (n_nationkey * 7) % 10) - (49.0 + (c_custkey % 97) / 10.0)) / 2), 2) + cos(radians(49.0 + (c_custkey % 97) / 10.0)) * cos(radians(49.0 + (n_nationkey * 7) % 10)) * pow(sin(radians((-120.0 + (n_nationkey * 3) % 10) - (-120.0 + (c_custkey % 101) / 10.0)) / 2), 2)))) AS km
        FROM customer, nation) WHERE km <= 35) WHERE rn = 1""",
    "base_models": """WITH p AS (SELECT p_partkey, p_brand || ' ' || p_type || ' ' || p_size AS line, p_brand, p_type, p_size FROM part),
        k AS (SELECT p_brand || ' ' || p_type AS base FROM p WHERE p_size <= 10 UNION SELECT line FROM p WHERE p_size <= 3 UNION SELECT p_brand FROM p)
        SELECT p_partkey, line, arg_max(base, length(base)) AS base FROM p LEFT JOIN k ON line = base OR starts_with(line, base || ' ') GROUP BY ALL""",
    "nearest_year_prices": f"""WITH o AS ({PLACED}), b AS (SELECT o_orderpriority, CAST(year(o_orderdate) AS INT) AS y, max(CAST(o_totalprice AS DECIMAL(18,2))) AS top FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) IN (1996, 1998, 2000) GROUP BY o_orderpriority, CAST(year(o_orderdate) AS INT))
        SELECT o_orderkey, rung, top FROM (SELECT o_orderkey, top, CASE WHEN y = year THEN 0 WHEN y = year - 1 THEN 1 ELSE 2 END AS rung, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN y = year THEN 0 WHEN y = year - 1 THEN 1 ELSE 2 END, top) AS rn
        FROM o JOIN b USING (o_orderpriority) WHERE y BETWEEN year - 1 AND year + 1) WHERE rn = 1""",
}
