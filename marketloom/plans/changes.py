"""Snapshot maintenance and guards over two snapshots cut from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketloom.functions import columns as C
from marketloom.operators import guards, merge
from marketloom.session import table

DAY = "2024-02-01"
MONEY = "decimal(18,2)"


def _state(spark, sf_dir) -> DataFrame:
    """Yesterday's lots: all sizes but the newest, with a few sold ones."""
    p = table(spark, sf_dir, "part").where("p_size <= 43")
    return p.select(
        F.col("p_partkey").alias("vin"), "p_brand", F.when(F.col("p_partkey") % 4 == 0, F.lit(None)).otherwise(F.col("p_type")).alias("model"), F.col("p_retailprice").cast(MONEY).alias("price"), F.lit(False).alias("demo"),
        F.to_date(F.lit("2024-01-01")).alias("first_seen"), F.to_date(F.lit("2024-01-31")).alias("last_seen"), F.when(F.col("p_partkey") % 13 == 0, F.to_date(F.lit("2024-01-20"))).alias("delisted_on"),
    )


def _seen(spark, sf_dir) -> DataFrame:
    """Today's crawl: all sizes but the smallest; some prices moved or are gone, some descriptions are empty."""
    p = table(spark, sf_dir, "part").where("p_size > 10")
    price = F.when(F.col("p_partkey") % 11 == 0, F.lit(None)).when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice") + 10).otherwise(F.col("p_retailprice"))
    return p.select(F.col("p_partkey").alias("vin"), "p_brand", F.when(F.col("p_partkey") % 2 == 0, F.lit("")).otherwise(F.col("p_type")).alias("model"), price.cast(MONEY).alias("price"), (F.col("p_partkey") % 17 == 0).alias("demo"))


STATE = f"""state AS (SELECT p_partkey AS vin, p_brand, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS model, CAST(p_retailprice AS DECIMAL(18,2)) AS price, false AS demo, '2024-01-01' AS first_seen, '2024-01-31' AS last_seen,
  CASE WHEN p_partkey % 13 = 0 THEN '2024-01-20' END AS delisted_on FROM part WHERE p_size <= 43),
seen AS (SELECT p_partkey AS vin, p_brand, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_type END AS model, CAST(CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_retailprice + 10 ELSE p_retailprice END AS DECIMAL(18,2)) AS price,
  p_partkey % 17 = 0 AS demo FROM part WHERE p_size > 10)"""


def _dates(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def snapshot_upsert(spark, sf_dir):
    out = merge.upsert_snapshot(_state(spark, sf_dir), _seen(spark, sf_dir), ["vin"], ["p_brand", "model"], ["price", "demo"], DAY)
    return _dates(out, "first_seen", "last_seen", "delisted_on")


def price_history(spark, sf_dir):
    """What the day adds to the price history: new rows and moves, once a key."""
    out = merge.upsert_snapshot(_state(spark, sf_dir), _seen(spark, sf_dir), ["vin"], ["p_brand", "model"], ["price"], DAY)
    return out.where("moved").select("vin", F.lit(DAY).alias("observed_on"), "price")


def delisted(spark, sf_dir):
    out = merge.mark_delisted(_state(spark, sf_dir), _seen(spark, sf_dir).where("p_brand <> 'Brand#13' or price > 950"), "p_brand", "vin", DAY)
    return _dates(out.where("delisted_on is not null"), "delisted_on").select("vin", "p_brand", "delisted_on")


def carried_catalog(spark, sf_dir):
    fresh = _seen(spark, sf_dir).withColumn("model", F.nullif("model", F.lit("")))
    return merge.carry_forward(fresh, _state(spark, sf_dir), ["p_brand", "vin"], ["model", "price"])


def insert_or_ignore(spark, sf_dir):
    return merge.keyed_upsert(_state(spark, sf_dir).select("vin", "price"), _seen(spark, sf_dir).select("vin", "price"), ["vin"], ["price"], replace=False)


def insert_or_replace(spark, sf_dir):
    return merge.keyed_upsert(_state(spark, sf_dir).select("vin", "price"), _seen(spark, sf_dir).select("vin", "price"), ["vin"], ["price"], replace=True)


def first_last_seen(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    day = F.to_date(F.lit("2024-01-20"))
    before = merge.seen_spans(e.where(F.col("ts") < day), "user_id", "ts")
    return merge.seen_spans(e.where(F.col("ts") >= day), "user_id", "ts", before)


def audited_columns(spark, sf_dir):
    return merge.column_audit(_state(spark, sf_dir), _seen(spark, sf_dir), "vin", ["model", "price", "demo"])


def unknown_recalls(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    fresh = p.where("p_size > 20").select("p_partkey", F.lower("p_brand").alias("make"), "p_type")
    return merge.new_keys(fresh, p.where("p_size <= 35").select("p_partkey", F.col("p_brand").alias("make")), ["p_partkey", "make"])


def alias_rows(spark, sf_dir):
    """Rows copied under an alias where the alias lacks them, and aliases whose origin is gone."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size", F.col("p_retailprice").cast(MONEY).alias("price"))
    origin = p.where("p_brand = 'Brand#11' and p_size > 12").select("p_type", "price").distinct()
    alias = p.where("p_brand = 'Brand#12'").select("p_type", "price").distinct()
    key = ["p_type", "price"]
    return origin.join(alias, key, "left_anti").withColumn("action", F.lit("insert")).unionByName(alias.join(origin, key, "left_anti").withColumn("action", F.lit("delete")))


def rejected_rows(spark, sf_dir):
    rules = {"price": F.col("price") > 0, "model": F.col("model") != "", "key": F.col("vin").cast("string").rlike("^[0-9]+$")}
    return guards.split_rows(_seen(spark, sf_dir), rules)[1].groupBy("reason").agg(F.count("*").alias("n"))


def kept_rows(spark, sf_dir):
    rules = {"price": F.col("price") > 0, "model": F.col("model") != ""}
    return guards.split_rows(_seen(spark, sf_dir), rules)[0].select("vin", "model", "price")


def collapse_guard(spark, sf_dir):
    return guards.collapse(_state(spark, sf_dir), _seen(spark, sf_dir).where("p_brand <> 'Brand#21' or price > 990"), "p_brand")


def freshness_guard(spark, sf_dir):
    return guards.freshness(_state(spark, sf_dir), _seen(spark, sf_dir).where("p_brand <> 'Brand#22' or price < 940"), "p_brand", "vin")


def k_anonymous_prices(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.max("p_retailprice").alias("top"))
    return g.select("p_brand", "p_type", "n", guards.floor_of(F.col("n"), 12, F.col("top")).alias("top"))


def vin_checks(spark, sf_dir):
    """Numbers made of part keys, with the right check digit on every third."""
    p = table(spark, sf_dir, "part")
    body = F.lpad(F.col("p_partkey").cast("string"), 7, "0")
    vin = F.concat(F.lit("1M8GDM9A"), F.when(F.col("p_partkey") % 3 == 0, "X").otherwise((F.col("p_partkey") % 10).cast("string")), F.lit("K"), body)
    return p.select("p_partkey", C.vin_valid(vin).alias("valid"))


QUERIES = {
    f.__name__: f
    for f in (
        snapshot_upsert, price_history, delisted, carried_catalog, insert_or_ignore, insert_or_replace, first_last_seen, audited_columns, unknown_recalls, alias_rows, rejected_rows, kept_rows, collapse_guard, freshness_guard, k_anonymous_prices,
        vin_checks,
    )
}
DIGITS = " + ".join(f"{w} * CAST(substr(c, {i + 1}, 1) AS INT)" for i, w in enumerate(C.VIN_WEIGHTS) if w)
ORACLE = {
    "snapshot_upsert": f"""WITH {STATE} SELECT coalesce(o.vin, n.vin) AS vin, coalesce(nullif(n.p_brand, ''), o.p_brand) AS p_brand, coalesce(nullif(n.model, ''), o.model) AS model, CASE WHEN n.vin IS NOT NULL THEN n.price ELSE o.price END AS price,
        CASE WHEN n.vin IS NOT NULL THEN n.demo ELSE o.demo END AS demo, coalesce(first_seen, '{DAY}') AS first_seen, CASE WHEN n.vin IS NOT NULL THEN '{DAY}' ELSE last_seen END AS last_seen, CASE WHEN n.vin IS NULL THEN delisted_on END AS delisted_on,
        o.vin IS NULL AS is_new, n.vin IS NOT NULL AND (o.vin IS NULL OR o.price IS DISTINCT FROM n.price OR o.demo IS DISTINCT FROM n.demo) AS moved FROM state o FULL JOIN seen n ON o.vin = n.vin""",
    "price_history": f"WITH {STATE} SELECT n.vin, '{DAY}' AS observed_on, n.price FROM seen n LEFT JOIN state o ON o.vin = n.vin WHERE o.vin IS NULL OR o.price IS DISTINCT FROM n.price",
    "delisted": f"""WITH {STATE}, s AS (SELECT * FROM seen WHERE p_brand <> 'Brand#13' OR price > 950), g AS (SELECT l.p_brand, live > 10 AND coalesce(saw, 0) < live // 2 AS skip FROM (SELECT p_brand, count(*) AS live FROM state WHERE delisted_on IS NULL GROUP BY p_brand) l
        LEFT JOIN (SELECT p_brand, count(*) AS saw FROM s GROUP BY p_brand) w USING (p_brand)) SELECT vin, p_brand, d AS delisted_on FROM (SELECT vin, p_brand, CASE WHEN delisted_on IS NULL AND NOT coalesce(skip, false) AND NOT EXISTS (SELECT 1 FROM s WHERE s.vin = state.vin AND s.p_brand = state.p_brand)
        THEN '{DAY}' ELSE delisted_on END AS d FROM state LEFT JOIN g USING (p_brand)) WHERE d IS NOT NULL""",
    "carried_catalog": f"""WITH {STATE} SELECT n.vin, n.p_brand, coalesce(nullif(n.model, ''), o.model) AS model, coalesce(n.price, o.price) AS price, n.demo,
        CAST(nullif(n.model, '') IS NULL AND o.model IS NOT NULL AS INT) + CAST(n.price IS NULL AND o.price IS NOT NULL AS INT) AS carried FROM seen n LEFT JOIN state o ON n.vin = o.vin AND n.p_brand IS NOT DISTINCT FROM o.p_brand""",
    "insert_or_ignore": f"WITH {STATE} SELECT vin, price FROM state UNION ALL SELECT vin, price FROM seen WHERE vin NOT IN (SELECT vin FROM state)",
    "insert_or_replace": f"WITH {STATE} SELECT vin, price FROM seen UNION ALL SELECT vin, price FROM state WHERE vin NOT IN (SELECT vin FROM seen)",
    "first_last_seen": "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS seen FROM events GROUP BY user_id",
    "audited_columns": f"""WITH {STATE}, j AS (SELECT o.vin, o.model AS om, n.model AS nm, CAST(o.price AS VARCHAR) AS op, CAST(n.price AS VARCHAR) AS np, CAST(o.demo AS VARCHAR) AS od, CAST(n.demo AS VARCHAR) AS nd FROM state o JOIN seen n ON o.vin = n.vin)
        SELECT vin, 'model' AS field, om AS old_value, nm AS new_value FROM j WHERE om IS DISTINCT FROM nm UNION ALL SELECT vin, 'price', op, np FROM j WHERE op IS DISTINCT FROM np UNION ALL SELECT vin, 'demo', od, nd FROM j WHERE od IS DISTINCT FROM nd""",
    "unknown_recalls": "SELECT p_partkey, lower(p_brand) AS make, p_type FROM part WHERE p_size > 35",
    "alias_rows": """WITH o AS (SELECT DISTINCT p_type, CAST(p_retailprice AS DECIMAL(18,2)) AS price FROM part WHERE p_brand = 'Brand#11' AND p_size > 12), a AS (SELECT DISTINCT p_type, CAST(p_retailprice AS DECIMAL(18,2)) AS price FROM part WHERE p_brand = 'Brand#12')
        SELECT p_type, price, 'insert' AS action FROM (FROM o EXCEPT FROM a) UNION ALL SELECT p_type, price, 'delete' FROM (FROM a EXCEPT FROM o)""",
    "rejected_rows": f"WITH {STATE} SELECT CASE WHEN NOT coalesce(price > 0, false) THEN 'price' ELSE 'model' END AS reason, count(*) AS n FROM seen WHERE NOT coalesce(price > 0, false) OR NOT coalesce(model <> '', false) GROUP BY 1",
    "kept_rows": f"WITH {STATE} SELECT vin, model, price FROM seen WHERE price > 0 AND model <> ''",
    "collapse_guard": f"""WITH {STATE}, a AS (SELECT p_brand, count(*) AS prev_n FROM state GROUP BY p_brand), b AS (SELECT p_brand, count(*) AS next_n FROM seen WHERE p_brand <> 'Brand#21' OR price > 990 GROUP BY p_brand)
        SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, coalesce(prev_n, 0) AS prev_n, coalesce(next_n, 0) AS next_n, coalesce(prev_n, 0) >= 10 AND coalesce(next_n, 0) < coalesce(prev_n, 0) * 0.5 AS refused FROM a FULL JOIN b ON a.p_brand = b.p_brand""",
    "freshness_guard": f"""WITH {STATE}, a AS (SELECT p_brand, count(*) AS n0, max(vin) AS m0 FROM state GROUP BY p_brand), b AS (SELECT p_brand, count(*) AS n1, max(vin) AS m1 FROM seen WHERE p_brand <> 'Brand#22' OR price < 940 GROUP BY p_brand),
        r AS (SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, CASE WHEN coalesce(n1, 0) = 0 THEN 'empty' WHEN n0 IS NULL THEN 'new' WHEN n1 * 2 < n0 THEN 'halved' WHEN m1 <= m0 THEN 'not_advanced' ELSE 'ok' END AS reason FROM a FULL JOIN b ON a.p_brand = b.p_brand)
        SELECT p_brand, reason IN ('ok', 'new') AS ok, reason FROM r""",
    "k_anonymous_prices": "SELECT p_brand, p_type, count(*) AS n, CASE WHEN count(*) >= 12 THEN max(p_retailprice) END AS top FROM part GROUP BY ALL",
    "vin_checks": f"""WITH v AS (SELECT p_partkey, '1M8GDM9A' || CASE WHEN p_partkey % 3 = 0 THEN 'X' ELSE CAST(p_partkey % 10 AS VARCHAR) END || 'K' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS vin FROM part), t AS (SELECT *, translate(vin, '{C.VIN_FROM}', '{C.VIN_TO}') AS c FROM v)
        SELECT p_partkey, substr(vin, 9, 1) = CASE WHEN ({DIGITS}) % 11 = 10 THEN 'X' ELSE CAST(({DIGITS}) % 11 AS VARCHAR) END AS valid FROM t""",
}
