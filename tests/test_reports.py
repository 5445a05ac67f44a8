"""Rules of finished reports and what their checks come to, case by case."""

import pytest
from pyspark.sql import types as T

from marketloom.operators import reports

GOOD = "1HGCM82633A004352"
CHECKED = {"present": True, "valid": True}


@pytest.fixture(scope="module")
def schema(spark):
    return spark.createDataFrame([], "id int, " + reports.REPORT).schema


def frame(spark, schema, cases):
    def row(values, fields):
        return tuple(row(values.get(f.name), f.dataType.fields) if isinstance(f.dataType, T.StructType) and values.get(f.name) is not None else number(values.get(f.name), f) for f in fields)

    def number(v, f):
        return float(v) if isinstance(f.dataType, T.DoubleType) and v is not None else v

    return spark.createDataFrame([row({"id": i, **c}, schema.fields) for i, c in enumerate(cases)], schema)


INFLATION = {"dealer_stated": 66140, "manufacturer": 59900, "over_by": 6240}
RULES = [
    ({"quoted_price": 112995, "price_disclosure": "contact_for_price"}, ["PRICE_DISCLOSURE_MATCHES_PRICE"], [], {"price_disclosure": "advertised"}),
    ({"quoted_price": 54990, "price_disclosure": "advertised"}, [], [], {}),
    ({"price_disclosure": "contact_for_price", "render_checked": True, "render_confirmed": True}, [], [], {"price_disclosure": "contact_for_price"}),
    ({"price_disclosure": "contact_for_price", "render_checked": True, "render_confirmed": False}, ["PRICE_NOT_ACCUSED_UNCONFIRMED"], [], {"price_disclosure": "not_shown"}),
    ({"price_disclosure": "contact_for_price", "render_checked": True}, ["PRICE_NOT_ACCUSED_UNCONFIRMED"], [], {}),
    ({"price_disclosure": "contact_for_price"}, [], [], {"price_disclosure": "contact_for_price"}),
    ({"quoted_price": 61545, "price_disclosure": "contact_for_price", "render_checked": True, "render_confirmed": False}, ["PRICE_DISCLOSURE_MATCHES_PRICE"], [], {"price_disclosure": "advertised"}),
    (
        {"quoted_price": 43481, "vehicle": " 2027 Honda HR-V EX-L AWD", "summary": "This listing contains no pricing information at all -- no MSRP, no advertised price."}, ["SUMMARY_MATCHES_PRICE"], [],
        {"summary": "2027 Honda HR-V EX-L AWD is advertised at $43,481 on the dealer's own listing page. The figures on this report were read from the page's own data and rendered view. Confirm the out-the-door "
         "total, any add-on fees, and financing details directly with the dealer before signing anything."},
    ),
    ({"quoted_price": 37381, "summary": "There is no advertised selling price on this page."}, ["SUMMARY_MATCHES_PRICE"], [], {}),
    ({"quoted_price": 43481, "summary": "This vehicle is advertised at $43,481; confirm fees with the dealer."}, [], [], {}),
    ({"quoted_price": 43481, "summary": "There is no price-gating on this listing; the figure is published plainly."}, [], [], {}),
    ({"summary": "No advertised selling price is disclosed on this page."}, [], [], {}),
    ({"vin": GOOD}, ["VIN_CHECK_MATCHES_VIN"], [], {"vin_check": (True, True, GOOD)}),
    ({"vin": GOOD, "vin_check": {**CHECKED, "vin": "5YJ3E1EA7KF000316"}}, ["VIN_CHECK_MATCHES_VIN"], [], {}),
    ({"vin": " 1m8gdm9a xkp042788", "vin_check": {**CHECKED, "vin": "1M8GDM9AXKP042788"}}, [], [], {}),
    ({"vin": " "}, [], [], {"vin_check": None}),
    ({"msrp": 59900, "msrp_source": "catalog"}, [], ["CATALOG_MSRP_BASIS_LABELLED"], {}),
    ({"msrp": 59900, "msrp_source": "catalog", "msrp_basis": "starting_at"}, [], [], {}),
    ({"msrp": 66140}, [], ["MSRP_HAS_PROVENANCE"], {}),
    ({"msrp": 59900, "msrp_source": "catalog", "msrp_basis": "exact", "inflation": INFLATION}, [], [], {}),
    ({"msrp": 66140, "msrp_source": "catalog", "msrp_basis": "exact", "inflation": INFLATION}, [], ["MSRP_INFLATION_ANCHORED"], {}),
    ({"msrp": 59900, "msrp_source": "catalog", "msrp_basis": "exact", "inflation": {**INFLATION, "over_by": 1000}}, [], ["MSRP_INFLATION_ANCHORED"], {}),
    ({"inflation": {}}, [], ["MSRP_INFLATION_ANCHORED"], {}),
    ({"days_on_lot": {"days": 94}}, [], ["DAYS_ON_LOT_HAS_PROVENANCE"], {}),
    ({"days_on_lot": {"days": 94, "source": "dealer_platform_page", "source_label": "the dealer's own inventory data"}}, [], [], {}),
    ({"msrp": 5, "days_on_lot": {"days": 1}, "vin": GOOD, "quoted_price": 1, "price_disclosure": "contact_for_price"}, ["PRICE_DISCLOSURE_MATCHES_PRICE", "VIN_CHECK_MATCHES_VIN"],
     ["MSRP_HAS_PROVENANCE", "DAYS_ON_LOT_HAS_PROVENANCE"], {}),
    ({}, [], [], {}),
]


def test_rules(spark, schema):
    got = {r["id"]: r for r in reports.asserted(frame(spark, schema, [c for c, *_ in RULES])).collect()}
    for i, (case, repaired, flagged, after) in enumerate(RULES):
        assert (got[i]["repaired"], got[i]["flagged"]) == (repaired, flagged), case
        for name, value in after.items():
            assert (tuple(got[i][name]) if isinstance(value, tuple) else got[i][name]) == value, case
    assert {r.name for r in reports.report_rules()} == {n for _, a, b, _ in RULES for n in a + b}


RAV4 = {"year": 2026, "make": "Toyota", "model": "RAV4", "condition": "new"}
HELD = {"msrp_unavailable": "used_original_msrp_not_held"}
URL, UPLOAD = {"feature": "listing_url"}, {"feature": "quote"}
CHECKS = [
    ({**RAV4, "msrp": 42000, "msrp_source": "catalog", "msrp_basis": "exact"}, "msrp", "verified"), (RAV4, "msrp", "error"), ({"make": "Toyota"}, "msrp", "not_attempted"),
    ({"year": 2019, "make": "Honda", "model": "Civic", "condition": "used", **HELD}, "msrp", "not_applicable"), ({**RAV4, **HELD}, "msrp", "error"),
    ({"recalls": {"checked": True, "confirmed": True, "count": 2}}, "recalls", "verified"), ({"recalls": {"checked": True, "confirmed": True, "count": 0, "matched_model": "RAV4"}}, "recalls", "checked_no_match"),
    ({"recalls": {"checked": True, "confirmed": False, "count": 0, "queried_model": "RAV-4"}}, "recalls", "error"), ({"recalls": {"checked": False, "error": "registry unreachable"}}, "recalls", "error"),
    ({}, "recalls", "not_attempted"), ({"fuel_type": "BEV"}, "ev_rebate", "verified"), ({**UPLOAD, "fuel_type": "PHEV"}, "ev_rebate", "verified"), ({"fuel_type": "Gas"}, "ev_rebate", "not_applicable"),
    ({**UPLOAD, "fuel_type": "gas"}, "ev_rebate", "not_applicable"), ({"fuel_type": "Hybrid"}, "ev_rebate", "not_applicable"), ({}, "ev_rebate", "not_attempted"), ({"fuel_type": ""}, "ev_rebate", "not_attempted"),
    ({"odometer_checked": True, "odometer_km": 84000}, "odometer", "verified"), ({"condition": "new"}, "odometer", "not_applicable"), ({"condition": "used"}, "odometer", "not_attempted"), ({}, "odometer", "not_attempted"),
    ({"vin_check": CHECKED, "vin": GOOD}, "vin", "verified"), ({"vin_check": {"present": True, "valid": False}}, "vin", "error"), ({"vin_check": {"present": False}}, "vin", "not_attempted"),
    ({"add_ons": 1}, "fees", "verified"), ({"add_ons": 0, "doc_fee_kind": "over_cap"}, "fees", "verified"), ({"add_ons": 0, "quoted_price": 41999}, "fees", "checked_no_match"), ({"add_ons": 0}, "fees", "not_attempted"),
    ({}, "fees", "not_attempted"), ({"financing_disclosed": True, "financing_check": {"checked": True, "consistent": True}}, "financing", "verified"),
    ({"financing_check": {"checked": True, "consistent": False}}, "financing", "verified"), ({"quoted_price": 41999}, "financing", "not_applicable"), ({}, "financing", "not_attempted"),
    ({"financing_disclosed": True}, "financing", "not_attempted"), ({"financing_disclosed": True, "quoted_price": 5, "reference": {"apr": 4.99}}, "financing", "verified"),
    ({"dealer_apr": {"apr": 6.99, "source": "sm360_feed"}}, "apr", "verified"), ({"dealer_apr": {"apr": 6.99, "source": "convertus_vms"}}, "apr", "verified"), ({"dealer_apr": {"apr": 6.99, "source": "page_text"}}, "apr", "verified"),
    ({"manufacturer_apr": 3.99}, "apr", "verified"), ({}, "apr", "not_attempted"), ({"dealer_apr": {"apr": 25, "source": "llm"}}, "apr", "not_attempted"), ({"dealer_apr": {"apr": 25}, "manufacturer_apr": 4.99}, "apr", "verified"),
    ({"leverage": {"inputs": 2, "score": 7.5}}, "leverage", "verified"), ({"leverage": {"inputs": 0, "score": 2.0}}, "leverage", "not_attempted"), (UPLOAD, "days_on_lot", "not_applicable"),
    ({**URL, "days_on_lot": {"days": 91, "source": "dealer_platform_feed"}}, "days_on_lot", "verified"), (URL, "days_on_lot", "not_attempted"), ({**URL, "licence": {"state": "licensed", "number": "12345"}}, "amvic", "verified"),
    ({**URL, "dealer_name": "Capital Chevrolet"}, "amvic", "not_attempted"), ({**UPLOAD, "dealer_name": "Capital Chevrolet"}, "amvic", "not_attempted"), ({"warranty": {"verified": True, "coverage": "3yr/60,000km"}}, "warranty", "verified"),
    ({"remaining_make": "Honda"}, "warranty", "verified"), ({"warranty": {"verified": False}, "make": "Rivian"}, "warranty", "error"), ({}, "warranty", "not_attempted"), ({"dealer_name": "South Trail Kia"}, "reputation", None),
    ({"quoted_price": 30000}, "reputation", "not_attempted"),
]


def test_checks(spark, schema):
    found = reports.report_checkpoints(frame(spark, schema, [c for c, *_ in CHECKS]), "id").collect()
    got = {(r["id"], r["checkpoint"]): r["outcome"] for r in found}
    for i, (case, check, outcome) in enumerate(CHECKS):
        assert got.get((i, check)) == outcome, (case, check)
    # whatever a report lacks, a bad outcome says why, and an empty report has no good one
    assert all(r["detail"] for r in found)
    empty = frame(spark, schema, [URL])
    rows = reports.report_checkpoints(empty, "id").collect()
    assert len(rows) == 13 and {r["outcome"] for r in rows} == {"not_attempted"}
    assert {r["rate"] for r in reports.failure_rates(reports.report_checkpoints(empty, "id")).collect()} == {1.0}
