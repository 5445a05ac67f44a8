"""Catalogue maintenance: a capture replaces a snapshot, and configurator summaries are judged."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketloom.operators import catalog, summaries
from marketloom.session import table


def _before(spark, sf_dir) -> DataFrame:
    """The catalogue so far; every seventh row was verified by hand, every fifth states no trim."""
    p = table(spark, sf_dir, "part").where("p_size <= 40")
    when = lambda n, value: F.when(F.col("p_partkey") % n == 0, value)
    return p.select(
        (F.lit(2024) + F.col("p_size") % 3).alias("year"), F.col("p_brand").alias("make"), "p_type", when(5, None).otherwise(F.col("p_name")).alias("trim"),
        F.floor("p_retailprice").cast("double").alias("msrp"), when(3, "AWD").alias("drivetrain"), when(4, "{}").alias("attrs"),
        F.lit("excl_freight").alias("price_basis"), when(7, F.concat(F.lit("https://maker.example/"), "p_partkey")).alias("source_url"), when(6, "Hybrid").alias("fuel_type"),
    ).withColumnRenamed("p_type", "model")


def _fresh(spark, sf_dir) -> DataFrame:
    """The capture: makes in capitals, some prices computed, two makes nearly gone and one not captured."""
    p = table(spark, sf_dir, "part").where("p_size > 10 and p_brand <> 'Brand#5' and (p_brand not in ('Brand#3', 'Brand#11') or p_partkey % 9 = 0)")
    price = F.when(F.col("p_partkey") % 11 == 0, F.col("p_retailprice") + 0.25).otherwise(F.floor("p_retailprice") + 100)
    none = F.lit(None).cast("string")
    return p.select(
        (F.lit(2024) + F.col("p_size") % 3).alias("year"), F.upper("p_brand").alias("make"), F.col("p_type").alias("model"),
        F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(F.col("p_name")).alias("trim"), price.alias("msrp"), none.alias("drivetrain"), none.alias("attrs"),
        F.when(F.col("p_partkey") % 2 == 0, "incl_freight").alias("price_basis"), none.alias("source_url"), F.when(F.col("p_partkey") % 8 == 0, "BEV").alias("fuel_type"),
    )


def catalog_replace(spark, sf_dir):
    return catalog.catalog_changes(_before(spark, sf_dir), _fresh(spark, sf_dir), "stamped")


def catalog_verdicts(spark, sf_dir):
    before, batch = catalog._keyed(_before(spark, sf_dir)), catalog.batch_of(_fresh(spark, sf_dir), "stamped")
    return catalog.write_verdicts(before, batch)


def _summaries(spark, sf_dir) -> DataFrame:
    """Builds out of parts: a trim's price by its name, a colour on top of it, lines that sometimes don't add up."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").withColumn("trim", F.concat("p_brand", F.lit(" "), (F.col("p_size") % 7).cast("string")))
    colour = F.when(k % 4 == 0, "White").when(k % 4 == 1, "Ruby Pearl").when(k % 4 == 2, "Oxygen with Black Roof")
    paint = F.when(k % 4 == 1, 350).when(k % 4 == 2, 905).otherwise(0)
    line = F.when(k % 23 != 0, (F.lit(30_000) + F.length("trim") * 100 + F.col("p_size") % 7 * 1_000 + paint).cast("double"))
    package = F.when(k % 9 == 0, "Platinum with Premium Paint ").when(k % 9 == 1, "Premium Paint Protection Package")
    rows = p.select(
        k.alias("summary_id"), F.col("p_type").alias("model"), "trim", line.alias("msrp_line"), package.alias("package_line"),
        F.when(package.isNotNull(), 1_500.0).alias("package_price"), colour.alias("exterior"), F.when(k % 8 == 0, True).alias("no_cost"),
        F.when(k % 5 != 0, 682.0).alias("block_heater"), F.when(k % 17 != 0, F.when(F.length("p_type") > 8, 1_860.0).otherwise(1_930.0)).alias("delivery"),
    )
    printed = F.when(F.col("summary_id") % 13 == 0, summaries.computed_subtotal() + 70).when(F.col("summary_id") % 19 != 0, F.coalesce(summaries.computed_subtotal(), F.lit(1.0)))
    return rows.withColumn("printed_subtotal", printed)


def _lineup(spark, sf_dir) -> DataFrame:
    """Published floors: right for most models, off for some, one from another surface."""
    rows = _summaries(spark, sf_dir).groupBy("model").agg(F.min("msrp_line").alias("low"))
    freight = F.when(F.length("model") > 8, 1_860).otherwise(1_930)
    off = (F.length("model") % 3 - 1) * 34
    surface = F.when(F.col("model") == "PROMO", "trim card").otherwise("lineup")
    return rows.select("model", (F.col("low") + 682 + 1_134 + freight + 18 + off).alias("lineup_from"), surface.alias("surface"))


def price_summaries(spark, sf_dir):
    rows = summaries.with_evidence(_summaries(spark, sf_dir), _lineup(spark, sf_dir))
    return summaries.assessed(rows).select("summary_id", "seedable", "msrp", "all_in", "reason", "base", "premium", "delta", "lineup_verdict")


def solved_bases(spark, sf_dir):
    return summaries.solved_bases(_summaries(spark, sf_dir))


QUERIES = {f.__name__: f for f in (catalog_replace, catalog_verdicts, price_summaries, solved_bases)}

CARRIED = ("drivetrain", "attrs", "price_basis", "source_url", "fuel_type")
SNAPSHOTS = """old AS (
  SELECT 2024 + p_size % 3 AS year, p_brand AS make, p_type AS model, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS trim, CAST(floor(p_retailprice) AS DOUBLE) AS msrp,
    CASE WHEN p_partkey % 3 = 0 THEN 'AWD' END AS drivetrain, CASE WHEN p_partkey % 4 = 0 THEN '{}' END AS attrs, 'excl_freight' AS price_basis,
    CASE WHEN p_partkey % 7 = 0 THEN 'https://maker.example/' || p_partkey END AS source_url, CASE WHEN p_partkey % 6 = 0 THEN 'Hybrid' END AS fuel_type, lower(p_brand) AS mk
  FROM part WHERE p_size <= 40),
capture AS (
  SELECT 2024 + p_size % 3 AS year, upper(p_brand) AS make, p_type AS model, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS trim,
    CASE WHEN p_partkey % 11 = 0 THEN p_retailprice + 0.25 ELSE floor(p_retailprice) + 100 END AS msrp, CAST(NULL AS VARCHAR) AS drivetrain, CAST(NULL AS VARCHAR) AS attrs,
    CASE WHEN p_partkey % 2 = 0 THEN 'incl_freight' ELSE 'stamped' END AS price_basis, CAST(NULL AS VARCHAR) AS source_url, CASE WHEN p_partkey % 8 = 0 THEN 'BEV' END AS fuel_type, lower(p_brand) AS mk
  FROM part WHERE p_size > 10 AND p_brand <> 'Brand#5' AND (p_brand NOT IN ('Brand#3', 'Brand#11') OR p_partkey % 9 = 0)),
batch AS (SELECT * FROM capture WHERE msrp > 0 AND msrp % 1 = 0
  QUALIFY row_number() OVER (PARTITION BY mk, year, model, trim ORDER BY msrp, price_basis, fuel_type NULLS LAST) = 1),
verdicts AS (
  SELECT mk, coalesce(a.n, 0) AS prev_n, coalesce(b.n, 0) AS next_n,
    CASE WHEN coalesce(b.n, 0) = 0 THEN 'untouched' WHEN coalesce(a.n, 0) >= 10 AND 2 * b.n < a.n THEN 'refused' WHEN a.n IS NULL THEN 'new' ELSE 'replaced' END AS verdict
  FROM (SELECT mk, count(*) AS n FROM old GROUP BY mk) a FULL JOIN (SELECT mk, count(*) AS n FROM batch GROUP BY mk) b USING (mk)),
going AS (SELECT mk FROM verdicts WHERE verdict IN ('new', 'replaced'))"""
RICHEST = f"""richest AS (SELECT * FROM old QUALIFY row_number() OVER (PARTITION BY mk, year, model, coalesce(trim, '')
  ORDER BY source_url IS NULL, CAST(year AS VARCHAR), make, model, trim NULLS LAST, CAST(msrp AS VARCHAR), {', '.join(f'{c} NULLS LAST' for c in CARRIED)}) = 1)"""
BUILDS = """builds AS (
  SELECT p_partkey AS k, p_type AS model, p_brand || ' ' || p_size % 7 AS trim,
    CASE WHEN p_partkey % 23 <> 0 THEN CAST(30000 AS DOUBLE) + length(p_brand || ' ' || p_size % 7) * 100 + p_size % 7 * 1000 + CASE p_partkey % 4 WHEN 1 THEN 350 WHEN 2 THEN 905 ELSE 0 END END AS line,
    CASE p_partkey % 9 WHEN 0 THEN 'Platinum with Premium Paint ' WHEN 1 THEN 'Premium Paint Protection Package' END AS pack, CASE WHEN p_partkey % 9 < 2 THEN 1500 ELSE 0 END AS extra,
    CASE p_partkey % 4 WHEN 0 THEN 'White' WHEN 1 THEN 'Ruby Pearl' WHEN 2 THEN 'Oxygen with Black Roof' END AS colour, p_partkey % 8 = 0 AS free,
    CASE WHEN p_partkey % 5 <> 0 THEN 682 ELSE 0 END AS heater, CASE WHEN p_partkey % 17 <> 0 THEN CASE WHEN length(p_type) > 8 THEN 1860 ELSE 1930 END END AS freight
  FROM part),
summed AS (SELECT *, line + extra + heater + freight + 1134 AS total FROM builds),
printed AS (SELECT *, CASE WHEN k % 13 = 0 THEN total + 70 WHEN k % 19 <> 0 THEN coalesce(total, 1) END AS sub FROM summed),
pairs AS (SELECT model, trim, count(line) AS n, min(line) AS low, max(line) AS high FROM builds WHERE pack IS NULL GROUP BY ALL),
floors AS (SELECT model, min(line) + 682 + 1134 + CASE WHEN length(model) > 8 THEN 1860 ELSE 1930 END + 18 + (length(model) % 3 - 1) * 34 AS low_from, CASE WHEN model = 'PROMO' THEN 'trim card' ELSE 'lineup' END AS surface
  FROM builds GROUP BY model)"""
ORACLE = {
    "catalog_replace": f"""WITH {SNAPSHOTS}, {RICHEST}
SELECT b.year, b.make, b.model, b.trim, b.msrp, {', '.join(f'coalesce(b.{c}, r.{c}) AS {c}' for c in CARRIED)}, {' + '.join(f'CAST(b.{c} IS NULL AND r.{c} IS NOT NULL AS INT)' for c in CARRIED)} AS carried, 'written' AS action
FROM batch b JOIN going USING (mk) LEFT JOIN richest r ON r.mk = b.mk AND r.year = b.year AND r.model = b.model AND coalesce(r.trim, '') = b.trim
UNION ALL
SELECT year, make, model, trim, msrp, {', '.join(CARRIED)}, 0, CASE WHEN mk NOT IN (SELECT mk FROM going) THEN 'kept' WHEN source_url IS NULL THEN 'deleted'
  WHEN EXISTS (SELECT 1 FROM batch b WHERE b.mk = old.mk AND b.year = old.year AND b.model = old.model AND (b.trim = coalesce(old.trim, '') OR old.trim IS NULL)) THEN 'superseded' ELSE 'kept' END
FROM old""",
    "catalog_verdicts": f"WITH {SNAPSHOTS} SELECT * FROM verdicts",
    "solved_bases": f"""WITH {BUILDS} SELECT model, trim, n AS builds, CASE WHEN n > 1 AND low < high THEN low END AS base, CASE WHEN n > 1 AND low < high THEN high - low END AS premium,
  CASE WHEN n = 0 THEN 'no list price line' WHEN n = 1 THEN 'one build' WHEN low = high THEN 'same list price line' END AS reason FROM pairs""",
    "price_summaries": f"""WITH {BUILDS}, met AS (
  SELECT p.*, CASE WHEN q.n > 1 AND q.low < q.high THEN q.low END AS base, CASE WHEN q.n > 1 AND q.low < q.high THEN q.high - q.low END AS premium,
    CASE WHEN surface = 'lineup' THEN round(low_from - (line + heater + freight + 1134 + 18), 2) END AS delta, low_from, surface
  FROM printed p LEFT JOIN pairs q USING (model, trim) LEFT JOIN floors USING (model)),
judged AS (SELECT *, CASE WHEN low_from IS NULL THEN 'no published floor' WHEN surface <> 'lineup' THEN 'other surface' WHEN freight IS NULL THEN 'no delivery line' WHEN line IS NULL THEN 'no list price line'
    WHEN delta = 0 THEN 'confirmed' WHEN delta < 0 THEN 'above the floor' ELSE 'below the floor' END AS lineup_verdict FROM met),
reasons AS (SELECT *, CASE WHEN line IS NULL THEN 'no list price line' WHEN sub IS NOT NULL AND freight IS NULL THEN 'no delivery line' WHEN abs(total - sub) >= 0.02 THEN 'does not add up'
    WHEN pack ILIKE '%with premium paint ' THEN 'package holds the colour' WHEN colour LIKE '%with % Roof' THEN 'two-tone exterior'
    WHEN NOT (free OR (pack IS NULL AND (line IS NOT DISTINCT FROM base OR lineup_verdict = 'confirmed'))) THEN 'colour not known to be free' END AS reason FROM judged)
SELECT k AS summary_id, reason IS NULL AS seedable, CASE WHEN reason IS NULL THEN line + extra END AS msrp, CASE WHEN reason IS NULL THEN sub END AS all_in, reason, base, premium, delta, lineup_verdict FROM reasons""",
}
