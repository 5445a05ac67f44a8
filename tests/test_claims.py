"""Claims on the cases that made them."""

import pytest
from pyspark.sql import functions as F

from marketloom.functions import claims as K
from marketloom.functions import columns as C


def one(spark, value):
    return spark.range(1).select(value.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "page,rate",
    [
        ("Finance at 20.5% APR", 20.5), ("Financing 5.49% or 4.99% O.A.C.", 4.99), ("Finance from 3.99% to 9.99%", None), ("APR 3.99% – 9.99%", None), ("0% purchase financing", 0.0), ("Lease from 2.9% APR", None), ("save 5%", None),
        ("<script>apr = '1.5%'</script>financing", None), ("financing 00%", None), ("APR of 45%", None), ("x" * 300 + " financing 6.25%" + "y" * 300, 6.25), ("financing" + " word" * 20 + " 3.5%", None), ("", None), (None, None),
    ],
)
def test_advertised_rate(spark, page, rate):
    assert one(spark, K.advertised_rate(F.lit(page).cast("string"))) == rate


@pytest.mark.parametrize("place,code", [("Calgary, AB", "AB"), ("Austin, texas", "TX"), (" on ", "ON"), ("Québec", "QC"), ("Victoria, British Columbia", "BC"), ("Somewhere", None), ("", None), (None, None)])
def test_region_code(spark, place, code):
    assert one(spark, K.region_code(F.lit(place).cast("string"))) == code


@pytest.mark.parametrize("fee,place,kind,over", [(499.0, "Calgary, AB", "allin", None), (225.0, "Austin, TX", "within_cap", 0), (300.0, "Austin, TX", "over_cap", 75), (999.0, "Miami, FL", "over_norm", 0), (998.0, "Miami, FL", None, None), (500.0, "Boise, ID", None, None), (None, "Austin, TX", None, None), (0.0, "Austin, TX", None, None)])
def test_doc_fee(spark, fee, place, kind, over):
    got = one(spark, K.doc_fee_claim(F.lit(fee).cast("double"), F.lit(place)))
    assert (got and got["kind"], got and got["over_by"]) == (kind, over)


def test_doc_fees_take_the_dearest(spark):
    rows = [(1, "Doc Fee", 100.0), (1, "ADMINISTRATION", 300.0), (1, "Freight", 900.0), (2, "docfees", 50.0), (3, None, 5.0), (4, "admin", -1.0), (5, "Dealer fee", None)]
    lines = spark.createDataFrame(rows, "q int, name string, price double")
    assert [tuple(r) for r in K.doc_fees(lines, "q", "name", "price").collect()] == [(1, 300.0)]


def claim(spark, **given):
    values = {"msrp": 30000.0, "all_in": None, "basis": "exact", "asking": 32000.0, "all_in_price": False, "region_unknown": None, "verified": None, "top": None, "trims": 0} | given
    kinds = {"basis": "string", "all_in_price": "boolean", "region_unknown": "boolean", "verified": "boolean", "trims": "int"}
    c = {k: F.lit(v).cast(kinds.get(k, "double")) for k, v in values.items()}
    ceiling = K.ceiling_claim(c["asking"], c.pop("top"), c.pop("trims"), c["all_in_price"])
    got = one(spark, K.msrp_claim(**c, ceiling=ceiling))
    return got["comparable"], got["delta"], got["refusal"]


def test_msrp_claim(spark):
    assert claim(spark) == (True, 2000.0, None)
    assert claim(spark, all_in_price=True, all_in=33000.0) == (True, -1000.0, None)
    assert claim(spark, all_in_price=True) == (False, None, "all_in_against_ex_freight")
    assert claim(spark, region_unknown=True) == (False, None, "region_unknown")
    assert claim(spark, verified=False) == (False, None, "price_unverified")
    assert claim(spark, asking=None) == (False, None, None) and claim(spark, msrp=None) == (False, None, None) and claim(spark, msrp=0.0) == (False, None, None)
    assert claim(spark, basis=None) == (False, None, "trim_unconfirmed") and claim(spark, basis="original_when_new")[2] == "original_when_new"
    above = {"basis": "starting_at", "all_in_price": True, "top": 31000.0}
    assert claim(spark, **above, trims=2)[2] == "above_ceiling" and claim(spark, **above, trims=1)[2] == "starting_at"
    assert claim(spark, **above | {"all_in_price": False}, trims=5)[2] == "starting_at"


def test_trade_widget(spark):
    cases = {"accuTrade": "AccuTrade", "snap-offer": "TradePending", "Kelley Blue Book. Trade": "none", "canadian blackbook TRADE": "Canadian Black Book", "Value your trade": None, "": "none"}
    for text, vendor in cases.items():
        got = one(spark, K.trade_widget(F.lit(text)))
        assert (got["vendor"] if got else "none") == vendor
    assert one(spark, K.trade_widget(F.lit(None).cast("string"))) is None


def test_dealer_id(spark):
    made = lambda name, city: one(spark, C.dealer_id(F.lit(name).cast("string"), F.lit(city).cast("string")))
    assert made(None, " ") == made("", None) == "unknown"
    assert made(" Main MOTORS", "Calgary ") == made("main motors", "calgary") != made("main motors", None)
    key, h = "é|x", 2166136261
    for unit in key:
        h = ((h ^ ord(unit)) * 16777619) % (1 << 32)
    assert made("É", "X") == f"d_{h:08x}"


@pytest.mark.parametrize(
    "page,rate",
    [
        ("financing from 5.5% – 7.5%", None),
        ("Finance at 4.99 % APR", 4.99),
        ("Finance at 4.99 % APR", 4.99),
        ("financing 1% - 2% - 3%", 3.0),
        ("financing 3%—4%—5% to 6%", None),
        ("Purchase financing at an annual percentage rate of 4.49%", 4.49),
        ("Financing: 3.99% APR for 36 months, 4.99% APR for 60 months", 3.99),
        ("Purchase financing 00% APR 09% APR", None),
        ("Financing at 99% APR", None),
        ("Apply for our credit card at 19.99% annual interest", None),
        ("<script>var o={opacity:0.09,scale:'00%'};// financing</script><p>Finance your purchase today</p>", None),
    ],
)
def test_advertised_rate_on_raw_characters(spark, page, rate):
    assert one(spark, K.advertised_rate(F.lit(page))) == rate
