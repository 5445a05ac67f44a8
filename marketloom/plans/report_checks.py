"""Reports made of parts, judged by the rules and checks that finished reports go through."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketloom.functions import columns as C
from marketloom.operators import reports
from marketloom.plans.changes import DIGITS
from marketloom.session import table

SUMMARIES = [
    "This listing contains no pricing information at all", "There is no price-gating here", "The price was not disclosed; the dealer doesnt say", "They do not disclose the total price",
    "Advertised plainly", "No advertised asking price", "", "They do not disclose. The price is low",
]


def _reports(spark, sf_dir) -> DataFrame:
    """A report a part: every field known, missing or odd by the remainders of the part's key."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    when = lambda n, r, value: F.when(k % n == r, value)
    number = lambda c, n: F.element_at(F.array(*[F.lit(x) for x in n]), (c % len(n)).cast("int") + 1)
    vin = F.concat(F.lit("1M8GDM9A"), F.when(k % 3 == 0, "X").otherwise((k % 10).cast("string")), F.lit("K"), F.lpad(k.cast("string"), 7, "0"))
    price = F.floor("p_retailprice") * 40
    return p.select(
        k.alias("report_id"), number(k, ["listing_url", "quote", "listing_url"]).alias("feature"), F.when(k % 4 != 0, price + 0.5).alias("quoted_price"),
        number(k, ["contact_for_price", "advertised", None, "contact_for_price", "not_shown"]).alias("price_disclosure"), number(k, [True, None, False]).alias("render_checked"),
        (k % 2 == 0).alias("render_confirmed"), number(k, [" 2027 HR-V ", None, " "]).alias("vehicle"), number(k, SUMMARIES).alias("summary"),
        F.when(k % 6 != 5, F.concat(F.lit(" "), F.lower(vin))).alias("vin"),
        F.when(k % 4 < 2, F.struct(F.lit(True).alias("present"), (k % 2 == 0).alias("valid"), F.when(k % 4 == 0, vin).otherwise("OTHER").alias("vin"))).alias("vin_check"),
        number(k, [2024, 2024, None, 2026]).alias("year"), number(k, ["Honda", "Kia", "", None, "Mazda"]).alias("make"), F.when(k % 11 != 0, F.col("p_type")).alias("model"),
        number(k, ["New ", "used", None]).alias("condition"), F.when(k % 5 < 3, price).cast("double").alias("msrp"), number(k, ["catalog", "catalog", None, "listing", ""]).alias("msrp_source"),
        number(k, ["exact", None, "starting_at", "guess"]).alias("msrp_basis"), when(2, 0, "used_original_msrp_not_held").alias("msrp_unavailable"),
        F.when(k % 7 == 1, F.struct((price + 500.4).cast("double").alias("dealer_stated"), price.cast("double").alias("manufacturer"), F.when(k % 2 == 0, 500.0).otherwise(501.0).alias("over_by"))).alias("inflation"),
        F.when(k % 3 != 2, F.struct((k % 5).cast("int").alias("days"), number(k, ["feed", None, ""]).alias("source"), number(k, ["own data", None]).alias("source_label"))).alias("days_on_lot"),
        number(k, [True, False, None, False]).alias("odometer_checked"), when(3, 1, 84000).alias("odometer_km"),
        F.when(k % 8 != 7, F.struct(number(k, [True, True, True, False]).alias("checked"), number(k, [True, None, True, True]).alias("confirmed"), (k % 3).cast("int").alias("count"),
            number(k, ["RAV4", None]).alias("matched_model"), number(k, ["RAV-4", None, "RAV 4"]).alias("queried_model"), when(4, 1, "timeout").alias("error"))).alias("recalls"),
        number(k, [0, 2, None, 0]).alias("add_ons"), when(6, 4, "over_cap").alias("doc_fee_kind"), number(k, ["BEV", " phev", "Gas", "", None, "Hybrid"]).alias("fuel_type"),
        F.when(k % 5 != 4, F.struct(number(k, [True, False, None]).alias("verified"), number(k, ["3yr/60,000km", None]).alias("coverage"))).alias("warranty"),
        number(k, ["", "Honda", None, None]).alias("remaining_make"), number(k, [True, False, None]).alias("financing_disclosed"),
        F.when(k % 4 != 3, F.struct(number(k, [True, False, None, False, None]).alias("checked"), (k % 2 == 0).alias("consistent"))).alias("financing_check"),
        F.when(k % 7 == 3, F.struct(F.lit(4.99).alias("apr"), when(2, 0, 60).alias("term_months"))).alias("reference"),
        F.when(k % 3 != 0, F.struct(number(k, [6.0, 0.0, 6.5]).alias("apr"), number(k, ["sm360_feed", "llm", "page_text", None]).alias("source"))).alias("dealer_apr"),
        number(k, [0.0, None, 3.99]).alias("manufacturer_apr"), number(k, ["Capital", "", None, "South Trail"]).alias("dealer_name"),
        F.when(k % 5 != 0, F.struct((k % 4).cast("int").alias("inputs"), number(k, [7.5, 2.0]).alias("score"))).alias("leverage"),
        F.when(k % 9 != 0, F.struct(number(k, ["licensed", None, ""]).alias("state"), number(k, ["12345", None, "", "7"]).alias("number"))).alias("licence"),
    )


def report_invariants(spark, sf_dir):
    out = reports.asserted(_reports(spark, sf_dir))
    return out.select("report_id", F.array_join("repaired", ",").alias("repaired"), F.array_join("flagged", ",").alias("flagged"), "price_disclosure", "summary", F.col("vin_check.valid").alias("vin_valid"), F.col("vin_check.vin").alias("checked_vin"))


def report_checkpoints(spark, sf_dir):
    return reports.report_checkpoints(_reports(spark, sf_dir), "report_id")


def checkpoint_failures(spark, sf_dir):
    return reports.failure_rates(reports.report_checkpoints(_reports(spark, sf_dir), "report_id"))


QUERIES = {f.__name__: f for f in (report_invariants, report_checkpoints, checkpoint_failures)}


def _pick(values: list, index: str = "k") -> str:
    spelt = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return f"[{', '.join(map(spelt, values))}][{index} % {len(values)} + 1]"


TOLD = lambda x: f"coalesce(regexp_replace(CAST({x} AS VARCHAR), '\\.0$', ''), '?')"
MADE = f"""b AS (SELECT p_partkey AS k, p_type, floor(p_retailprice) * 40 AS price, '1M8GDM9A' || CASE WHEN p_partkey % 3 = 0 THEN 'X' ELSE CAST(p_partkey % 10 AS VARCHAR) END || 'K' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS vin FROM part),
r AS (SELECT *, k % 3 <> 1 AS url, CASE WHEN k % 4 <> 0 THEN price + 0.5 END AS quoted, {_pick(['contact_for_price', 'advertised', None, 'contact_for_price', 'not_shown'])} AS said, k % 3 = 0 AS looked, k % 2 = 0 AS sure,
  {_pick([s for s in SUMMARIES])} AS summary, CASE WHEN k % 6 <> 5 THEN vin END AS v, CASE WHEN k % 4 = 0 THEN vin WHEN k % 4 = 1 THEN 'OTHER' END AS checked, CASE WHEN k % 4 < 2 THEN k % 2 = 0 END AS checked_ok,
  {_pick([2024, 2024, None, 2026])} AS year, {_pick(['Honda', 'Kia', '', None, 'Mazda'])} AS make, CASE WHEN k % 11 <> 0 THEN p_type END AS model, k % 3 = 0 AS isnew, CASE WHEN k % 5 < 3 THEN price END AS msrp,
  {_pick(['catalog', 'catalog', None, 'listing', ''])} AS src, {_pick(['exact', None, 'starting_at', 'guess'])} AS basis, k % 7 = 1 AS inflated, CASE WHEN k % 2 = 0 THEN 500 ELSE 501 END AS over,
  CASE WHEN k % 3 <> 2 THEN k % 5 END AS days, CASE WHEN k % 3 <> 2 THEN {_pick(['feed', None, ''])} END AS dsrc, k % 2 = 0 AS dlabel,
  {_pick([0, 2, None, 0])} AS addons, {_pick(['bev', 'phev', 'gas', '', '', 'hybrid'])} AS fuel, CASE WHEN k % 5 <> 4 THEN {_pick([True, False, None])} END AS warr, k % 3 = 0 AS fin, CASE WHEN k % 4 <> 3 THEN k % 5 = 0 END AS finok,
  CASE WHEN k % 3 <> 0 THEN {_pick([6.0, 0.0, 6.5])} END AS apr, {_pick(['sm360_feed', 'llm', 'page_text', None])} AS aprsrc, {_pick([0.0, None, 3.99])} AS maker, {_pick(['Capital', '', None, 'South Trail'])} AS dealer,
  CASE WHEN k % 5 <> 0 THEN k % 4 END AS inputs, {_pick([7.5, 2.0])} AS score, CASE WHEN k % 9 <> 0 THEN {_pick(['licensed', None, ''])} END AS lic, {_pick(['12345', None, '', '7'])} AS licno FROM b)"""
CHECKS = f"""c AS (
SELECT k AS report_id, 'msrp' AS checkpoint, CASE WHEN msrp > 0 THEN ['verified', coalesce(src, '?') || '/' || coalesce(basis, '?')] WHEN NOT isnew AND k % 2 = 0 THEN ['not_applicable', 'used, its first list price isn''t held']
  WHEN year IS NULL OR coalesce(make, '') = '' OR model IS NULL THEN ['not_attempted', 'year, make or model missing'] ELSE ['error', 'not in the catalogue: ' || year || ' ' || make || ' ' || model] END AS o FROM r
UNION ALL SELECT k, 'odometer', CASE WHEN k % 4 = 0 THEN ['verified', CASE WHEN k % 3 = 1 THEN '84000' ELSE '?' END || ' km'] WHEN isnew THEN ['not_applicable', 'new vehicle'] WHEN k % 3 <> 1 THEN ['not_attempted', 'no odometer published'] ELSE ['not_attempted', 'no year to judge by'] END FROM r
UNION ALL SELECT k, 'recalls', CASE WHEN k % 8 = 7 THEN ['not_attempted', 'year, make or model missing'] WHEN k % 4 = 3 THEN ['error', 'registry not reached'] WHEN k % 4 = 1 THEN ['error', 'model not confirmed: ' || coalesce({_pick(['RAV-4', None, 'RAV 4'])}, '?')]
  WHEN k % 3 > 0 THEN ['verified', k % 3 || ' open'] ELSE ['checked_no_match', 'none open for ' || CASE WHEN k % 2 = 0 THEN 'RAV4' ELSE coalesce({_pick(['RAV-4', None, 'RAV 4'])}, 'model') END] END FROM r
UNION ALL SELECT k, 'fees', CASE WHEN addons > 0 THEN ['verified', addons || ' itemised'] WHEN k % 6 = 4 THEN ['verified', 'document fee over_cap'] WHEN addons = 0 AND quoted > 0 THEN ['checked_no_match', 'priced lines read, none added']
  WHEN addons = 0 THEN ['not_attempted', 'no price read, so no lines prove nothing'] ELSE ['not_attempted', 'no list of lines'] END FROM r
UNION ALL SELECT k, 'ev_rebate', CASE WHEN fuel = '' THEN ['not_attempted', 'fuel not known'] WHEN fuel IN ('bev', 'phev') THEN ['verified', upper(fuel)] ELSE ['not_applicable', fuel || ', no rebate'] END FROM r
UNION ALL SELECT k, 'vin', CASE WHEN checked_ok THEN ['verified', '…' || coalesce(right(lower(v), 6), '')] WHEN checked_ok IS NOT NULL THEN ['error', 'not a valid number'] ELSE ['not_attempted', 'none published'] END FROM r
UNION ALL SELECT k, 'warranty', CASE WHEN warr THEN ['verified', CASE WHEN k % 2 = 0 THEN '3yr/60,000km' ELSE '?' END] WHEN k % 4 = 1 THEN ['verified', 'what remains was computed'] WHEN NOT warr THEN ['error', 'none on file for ' || coalesce(make, 'make')] ELSE ['not_attempted', 'none resolved'] END FROM r
UNION ALL SELECT k, 'financing', CASE WHEN finok THEN ['verified', CASE WHEN k % 2 = 0 THEN 'adds up' ELSE 'doesn''t add up' END] WHEN k % 7 = 3 AND quoted > 0 THEN ['verified', 'from the maker''s 4.99% over ' || CASE WHEN k % 2 = 0 THEN '60' ELSE '?' END || ' months']
  WHEN fin THEN ['not_attempted', 'told in part'] WHEN quoted > 0 THEN ['not_applicable', 'priced, no financing told and no maker''s rate'] ELSE ['not_attempted', 'nothing read'] END FROM r
UNION ALL SELECT k, 'apr', CASE WHEN apr > 0 AND aprsrc IN ('sm360_feed', 'page_text') THEN ['verified', 'dealer ' || {TOLD('apr')} || '%'] WHEN maker > 0 THEN ['verified', 'maker ' || {TOLD('maker')} || '%'] ELSE ['not_attempted', 'no advertised rate and none on file for ' || coalesce(make, 'make')] END FROM r
UNION ALL SELECT k, 'reputation', ['not_attempted', 'no dealer named'] FROM r WHERE coalesce(dealer, '') = ''
UNION ALL SELECT k, 'leverage', CASE WHEN inputs > 0 THEN ['verified', inputs || ' inputs, score ' || {TOLD('score')}] ELSE ['not_attempted', 'no input was verified'] END FROM r
UNION ALL SELECT k, 'days_on_lot', CASE WHEN NOT url THEN ['not_applicable', 'uploaded, no listing to age'] WHEN days > 0 THEN ['verified', days || ' days (' || coalesce(dsrc, '?') || ')'] ELSE ['not_attempted', 'not told by the site'] END FROM r
UNION ALL SELECT k, 'amvic', CASE WHEN lic = 'licensed' THEN ['verified', 'licensed' || CASE WHEN coalesce(licno, '') = '' THEN '' ELSE ' #' || licno END] WHEN NOT url THEN ['not_attempted', 'not looked up for uploads'] WHEN dealer <> '' THEN ['not_attempted', 'no sure match for ' || dealer] ELSE ['not_attempted', 'no dealer named'] END FROM r)"""
ORACLE = {
    "report_invariants": f"""WITH {MADE},
t AS (SELECT *, translate(v, '{C.VIN_FROM}', '{C.VIN_TO}') AS c, quoted > 0 AND said = 'contact_for_price' AS a1, coalesce(looked AND said = 'contact_for_price' AND quoted IS NULL AND NOT sure, false) AS a2, v IS NOT NULL AND checked IS DISTINCT FROM v AS a3,
  coalesce(quoted > 0 AND k % 8 IN (0, 2, 3, 5), false) AS a8, coalesce(src = 'catalog' AND msrp > 0 AND NOT coalesce(basis IN ('exact', 'starting_at'), false), false) AS f4,
  inflated AND NOT coalesce(over = 500 AND msrp = price, false) AS f5, coalesce(msrp > 0, false) AND coalesce(src, '') = '' AS f6, coalesce(days > 0, false) AND NOT (coalesce(dsrc, '') <> '' AND dlabel) AS f7 FROM r)
SELECT k AS report_id, concat_ws(',', CASE WHEN a1 THEN 'PRICE_DISCLOSURE_MATCHES_PRICE' END, CASE WHEN a2 THEN 'PRICE_NOT_ACCUSED_UNCONFIRMED' END, CASE WHEN a3 THEN 'VIN_CHECK_MATCHES_VIN' END, CASE WHEN a8 THEN 'SUMMARY_MATCHES_PRICE' END) AS repaired,
  concat_ws(',', CASE WHEN f4 THEN 'CATALOG_MSRP_BASIS_LABELLED' END, CASE WHEN f5 THEN 'MSRP_INFLATION_ANCHORED' END, CASE WHEN f6 THEN 'MSRP_HAS_PROVENANCE' END, CASE WHEN f7 THEN 'DAYS_ON_LOT_HAS_PROVENANCE' END) AS flagged,
  CASE WHEN a1 THEN 'advertised' WHEN a2 THEN 'not_shown' ELSE said END AS price_disclosure,
  CASE WHEN a8 THEN CASE WHEN k % 3 = 0 THEN '2027 HR-V' ELSE 'This vehicle' END || '{reports.REBUILT[0]}' || format('{{:,}}', CAST(floor(quoted + 0.5) AS BIGINT)) || '{reports.REBUILT[1].replace("'", "''")}' ELSE summary END AS summary,
  CASE WHEN a3 THEN substr(v, 9, 1) = CASE WHEN ({DIGITS}) % 11 = 10 THEN 'X' ELSE CAST(({DIGITS}) % 11 AS VARCHAR) END ELSE checked_ok END AS vin_valid, CASE WHEN a3 THEN v ELSE checked END AS checked_vin FROM t""",
    "report_checkpoints": f"WITH {MADE}, {CHECKS} SELECT report_id, checkpoint, o[1] AS outcome, o[2] AS detail FROM c",
    "checkpoint_failures": f"""WITH {MADE}, {CHECKS} SELECT checkpoint, count(*) AS n, count(*) FILTER (o[1] IN ('error', 'not_attempted')) AS failed, round(count(*) FILTER (o[1] IN ('error', 'not_attempted')) / count(*)::DOUBLE, 4) AS rate
  FROM c WHERE o[1] <> 'not_applicable' GROUP BY checkpoint""",
}
