"""Listings verified, leverage, and records completed from a second source."""

import pytest
from pyspark.sql import functions as F

from marketloom.operators import enrich, verification as V
from marketloom.sources import sinks

GOOD = dict(name="2024 Honda Civic", price=30000.0, km=20000, year=2024, fuel="Gas", description="clean", make="Honda", model="Civic", external_id="x", listing_url="u")
LISTINGS = "name string, price double, km int, year int, fuel string, description string, make string, model string, external_id string, listing_url string"


@pytest.mark.parametrize(
    "change, flags, score, action",
    [
        ({}, [], 100, "publish"),
        ({"price": None}, ["PRICE_TOO_LOW"], 50, "review"),
        ({"price": 999.0}, ["PRICE_TOO_LOW", "PLACEHOLDER_PRICE"], 0, "reject"),
        ({"price": 160000.0}, ["PRICE_TOO_HIGH"], 80, "review"),
        # a grave flag, then a mild one: the later decides while the score allows it
        ({"name": "Kia", "listing_url": ""}, ["NAME_TOO_SHORT", "MISSING_URL"], 60, "review"),
        ({"name": "Kia Sou"}, ["NAME_TOO_SHORT"], 70, "reject"),
        ({"description": "PAYPAL ONLY please"}, ["SCAM_KEYWORDS"], 20, "reject"),
        ({"fuel": "BEV", "price": 60000.0}, ["OVER_EVAP_CAP"], 100, "publish"),
        ({"fuel": "BEV", "price": 14000.0, "year": 2026}, ["PRICE_ANOMALY"], 75, "review"),
        ({"km": 200000}, ["KM_YEAR_MISMATCH"], 85, "review"),
        ({"km": -1, "make": "Unknown", "model": None}, ["KM_NEGATIVE", "MISSING_MAKE", "MISSING_MODEL"], 10, "reject"),
        ({"year": None, "km": None}, ["INVALID_YEAR"], 60, "review"),
        ({"fuel": "Hydrogen", "price": 10.0}, [], 100, "publish"),
    ],
)
def test_listings(spark, change, flags, score, action):
    row = {**GOOD, **change}
    r = V.verified_listings(spark.createDataFrame([tuple(row.values())], LISTINGS), 2026).first()
    assert (r["flags"], r["score"], r["action"]) == (flags, score, action)


def test_leverage(spark):
    schema = "quoted double, reference double, basis string, ceiling double, over_ceiling double, flagged_fees double, recalls_checked boolean, recalls int, financing_checked boolean, financing_consistent boolean, days int"
    none = (None,) * 11
    rows = [
        none, (31000.0, 30000.0, "exact", *none[3:]), (60000.0, 30000.0, "exact", *none[3:]), (20000.0, 30000.0, "exact", *none[3:]), (30100.0, 30000.0, "exact", *none[3:]),
        (83899.0, 64999.0, "starting_at", None, None, *none[5:]), (90000.0, 64999.0, "starting_at", 81499.0, 8501.0, *none[5:]), (None, None, None, None, None, 1500.0, True, 2, True, False, 95),
        (None, None, None, None, None, 9000.0, False, 2, True, True, 29), (90000.0, 30000.0, "exact", None, None, 9000.0, True, 9, True, False, 99),
    ]
    got = [(r["leverage"], r["leverage_basis"]) for r in V.with_leverage(spark.createDataFrame(rows, schema)).collect()]
    assert got == [
        (2.0, []), (3.0, ["above_list"]), (4.5, ["above_list"]), (1.0, ["below_list"]), (2.0, []), (3.5, ["above_trim"]), (4.5, ["above_lineup"]), (8.4, ["fees", "recalls", "financing", "days"]), (4.0, ["fees"]),
        (10.0, ["above_list", "fees", "recalls", "financing", "days"]),
    ]


def test_rescued(spark):
    schema = "id int, quoted_price double, quoted_price_source string, msrp double, gated_recovered boolean, gate_message string, add_ons array<string>, method string, trim string"
    own = [(1, None, "page", None, None, None, [], "html", ""), (2, 5.0, "page", 0.0, None, None, ["a"], "html", "SE"), (3, 0.0, "page", 7.0, None, None, None, "html", None), (4, None, None, None, None, None, None, "html", None)]
    new = [(1, 9.0, "vision", 8.0, True, "call", ["b"], None, "LX"), (2, 9.0, "vision", 8.0, True, "call", ["b"], "m2", "LX"), (3, None, "vision", 8.0, True, "call", None, "", None)]
    got = {r["id"]: tuple(r)[1:] for r in enrich.merged_rescued(spark.createDataFrame(own, schema), spark.createDataFrame(new, schema), "id", ["trim"]).collect()}
    assert got == {
        1: (9.0, "vision", 8.0, True, "call", ["b"], enrich.DEFAULT_METHOD, "LX"), 2: (5.0, "page", 8.0, None, None, ["a"], "m2", "SE"), 3: (0.0, "page", 7.0, None, None, None, enrich.DEFAULT_METHOD, None),
        4: (None, None, None, None, None, None, "html", None),
    }


def test_feed(spark):
    texts = [(1, '{"hasPrice": true, "salePrice": 0, "listPrice": "31000", "paymentOptions": {"finance": {"term": {"apr": 5.99, "term": "83.6", "payment": 411.126, "aprDetails": {"totalObligation": 0}}}}}'), (2, '{"hasPrice": false, "salePrice": 5}'), (3, "broken"), (4, None),
             (5, '{"paymentOptions": {"finance": {"term": {"apr": 30.01, "term": 60}}, "addedItems": {"items": [{"description": "x", "retail": "n/a"}, {"retail": 5}, {"description": " Mats ", "retail": 9}]}, "bestIncentives": {"dealerRebates": 500}}}')]
    got = {r["id"]: r for r in enrich.feed_facts(spark.createDataFrame(texts, "id int, json string"), "id").collect()}
    assert (got[1]["price"], got[1]["apr"], got[1]["term_months"], got[1]["payment"], got[1]["total_obligation"]) == (31000.0, 5.99, 84, 411.13, None)
    assert got[2]["price"] is None and got[3]["price"] is None and got[4]["add_ons"] == []
    assert got[5]["apr"] is None and got[5]["term_months"] is None and [tuple(a) for a in got[5]["add_ons"]] == [("Mats", 9.0), ("Dealer discount", -500.0)]


def test_pools_and_hosts(spark):
    registry = [("Kia", "Soul AWD"), ("KIA", "Soul"), ("Kia", "Seltos AWD"), ("kia", "seltos 4x4"), ("Mercedes", "GLE 4MATIC"), ("Kia", "Souls FWD"), ("Kia", "Rio"), (None, "x")]
    models = [("Kia", "Soul"), ("KIA", "Seltos"), ("Mercedes-Benz", "GLE"), ("Kia", "Rio"), ("Kia", "EV6"), ("Kia", None)]
    got = {(r["make"], r["model"]): (r["drive"], r["reason"], r["entries"]) for r in enrich.pooled_drives(spark.createDataFrame(models, "make string, model string"), spark.createDataFrame(registry, "make string, model string")).collect()}
    assert got == {
        ("Kia", "Soul"): (None, "sold both ways", 2), ("KIA", "Seltos"): ("AWD", "all agree", 2), ("Mercedes-Benz", "GLE"): ("AWD", "all agree", 1), ("Kia", "Rio"): (None, "no entry tells", 1), ("Kia", "EV6"): (None, "no entry", 0),
        ("Kia", None): (None, "no entry", 0),
    }
    sites = ["www.A.ca/x", "HTTPS://b.com:8080", "mailto:x@y.ca", "tel:1", " ", None, "localhost", "http://u:p@c.ca?q", "ftp.d.ca#x"]
    df = spark.createDataFrame([(s,) for s in sites], "s string")
    assert [r[0] for r in df.select(enrich.origin(F.col("s"))).collect()] == ["https://www.a.ca", "https://b.com", None, None, None, None, None, "https://c.ca", "https://ftp.d.ca"]


def test_expression_keys_and_objects(spark):
    rows = [(1, "a", None, "x"), (2, "A", "", "y"), (3, None, "c", "z"), (4, None, "c", "z"), (5, "a", "c", None), (6, "a", "C", "x")]
    df = spark.createDataFrame(rows, "id int, make string, city string, value string")
    kept = enrich.unique_by(df, {"m": F.lower("make"), "c": F.coalesce("city", F.lit(""))}, [F.col("id")])
    assert sorted(r["id"] for r in kept.collect()) == [1, 3, 4, 5, 6] and kept.columns == df.columns
    got = enrich.object_agg(df, ["make"], "city", "value", [F.col("id")]).collect()
    assert {r["make"]: r["object"] for r in got} == {"A": {"": "y"}, "a": {"C": "x", "c": None}, None: {"c": "z"}}


@pytest.mark.parametrize(
    "mail, expected",
    [
        (("billing@scrapfly.io", "Invoice", "US$ 1,030.00\nTotal $99.99 CAD"), ("scrapfly", None, 1030.0, "USD", None, "parsed cleanly")),
        (("x", "Receipt #AB12CD-0001", "Amount paid $20.00 USD. Paid on 2026-08-01"), ("other", "AB12CD-0001", 20.0, "USD", "2026-08-01", "could not parse: vendor")),
        (("nimble", "s", "total 12.00"), ("nimble", None, 12.0, None, None, "could not parse: currency")),
        (("nimble", None, None), ("nimble", None, None, None, None, "could not parse: amount, currency")),
        (("nimble", "", "CA$5.00 payment date: Notamonth 5, 2026"), ("nimble", None, 5.0, "CAD", None, "parsed cleanly")),
    ],
)
def test_invoices(spark, mail, expected):
    df = spark.createDataFrame([mail], "a string, b string, c string")
    r = df.select(enrich.parsed_invoice(F.col("a"), F.col("b"), F.col("c")).alias("i")).first()["i"]
    assert (r["vendor"], r["invoice_no"], r["amount"], r["currency"], r["paid_at"], r["note"]) == expected


def test_dry_run(spark, tmp_path):
    got = sinks.dry_run({"msrp": spark.range(3), "lease": spark.createDataFrame([], "id long")}, f"file://{tmp_path}/out")
    assert got == {"msrp": 3, "lease": 0} and spark.read.json(f"file://{tmp_path}/out/msrp").count() == 3
