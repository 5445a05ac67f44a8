"""Objects and cards inside pages."""

import json

import pytest
from hypothesis import given, settings, strategies as st

from marketloom.sources import pages_feeds as P

GOOD, GOOD_2 = "1M8GDM9AXKP042788", "11111111111111111"


@pytest.mark.parametrize(
    "text, found",
    [
        ('x = {"a": "} ; {", "b": [1, {"c": "\\"}"}]}; y', '{"a": "} ; {", "b": [1, {"c": "\\"}"}]}'),
        ("x = {}; y", "{}"),
        ('x = {"1": {"vin": "X"', None),
        ('x = {"never closed string }', None),
        ('x = {"ends on an escape \\', None),
        ("x = {[}]", None),
        ("y = {}", None),
        ("", None),
        (None, None),
        ("x = [] x = {1}", "{1}"),
    ],
)
def test_balanced(text, found):
    assert P.balanced(text, "x = {") == found


@settings(deadline=None, max_examples=200)
@given(st.recursive(st.text() | st.integers(), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(), v, max_size=3), max_leaves=8), st.text())
def test_any_json_is_found_whole(value, after):
    spelt = json.dumps({"v": value})
    assert P.balanced(f"<script>o = {spelt};{after}", "o = {") == spelt
    assert P.balanced(f"<script>o = {spelt[:-1]}", "o = {") is None


def test_long_scripts_take_linear_time():
    text = 'o = {"a": "' + "\\\\x" * 300_000 + '", "b": [' + "[],".join([""] * 200_000) + "1]}"
    assert len(P.balanced(text, "o = {")) == len(text) - 4
    assert P.balanced(text[:-1], "o = {") is None


def unit(vin, **more):
    return {"vin": vin, "stockNum": "S", "year": "2026", "make": "Ford", "model": "Bronco", "trim": "Big Bend", "OriginalPrice": 44290, "mileage": "10", "condition": "New", "demo": "0", **more}


def vehicles(spark, *objects):
    texts = [(i, o if o is None or isinstance(o, str) else f"<script>var vehicleArray = [];\n vehicleArray = {json.dumps(o)};\nvar b = 1;</script>") for i, o in enumerate(objects)]
    return sorted(P.inline_vehicles(spark.createDataFrame(texts, "page int, html string")).collect())


def test_inline_vehicles(spark):
    first = {"1": unit(GOOD.lower(), note="a stray } and ;"), "2": unit("BADVIN", stockNum="S2"), "3": None, "4": unit(GOOD_2, OriginalPrice="0", demo=True, condition="USED", trim="", mileage=None)}
    got = vehicles(spark, first, None, "no object", {}, "vehicleArray = {not json}", "<script>vehicleArray = {\"1\": {\"vin\":", {"9": unit(GOOD, OriginalPrice="$51,000", year="n/a")})
    assert [(r["page"], r["vin"], r["list_price"], r["year"], r["km"], r["condition"], r["demo"], r["trim"]) for r in got] == [
        (0, GOOD_2, None, 2026, None, "used", True, None), (0, GOOD, 44290.0, 2026, 10, "new", False, "Big Bend"), (6, GOOD, 51000.0, None, 10, "new", False, "Big Bend"),
    ]


def test_an_object_with_a_key_twice_is_read(spark):
    text = f"vehicleArray = {{\"1\": {json.dumps(unit(GOOD))}, \"1\": {json.dumps(unit(GOOD_2))}}}"
    assert {r["vin"] for r in vehicles(spark, text)} <= {GOOD, GOOD_2} and vehicles(spark, text)


def card(label, price, dealer, extra="", stock="| New"):
    heavy = "<img src='x'>" * 4000
    return (
        f'<div><a class="contents" aria-label="{label}" href="/v/1?x=2">{heavy}<script>"Cash Price $1,111"</script><i>{stock}</i> HIGH DEMAND'
        f"<h4>Cash Price</h4><b>Finance</b><b>Lease</b> {price} {extra}<p>{dealer}</p><button>Check Availability</button></a></div>"
    )


def test_cards(spark):
    page = "<a href='/'>x</a>" + "".join([
        card("2026 Hyundai Tucson Hybrid Ultimate", "Call for price", "Southtown Hyundai, Edmonton"), card("2026 Kia K4 LX FWD", "$26,645", "Go Kia South, St. Albert"),
        card("2026 Infiniti QX60 Luxe", "<s>$68,061</s>", "Infiniti South, Red Deer", "was $74,561"), card("no year here", "$11,111", "A B, Calgary"),
        card("2025 Honda CR-V Hybrid Sport", "$ 49,584", "T&amp;T Honda, Calgary", stock="| Used"), card("2025 Honda Civic", "", "", stock=""),
    ]) + "<footer>Call for price, was $1,234,567 | New</footer>"
    got = sorted(P.card_vehicles(spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>no card</p>")], "page int, html string")).collect())
    assert [(r["place"], r["year"], r["make"], r["model_trim"], r["condition"], r["list_price"], r["was_price"], r["withheld"], r["dealer"], r["city"], r["url"]) for r in got] == [
        (0, 2026, "Hyundai", "Tucson Hybrid Ultimate", "new", None, None, True, "Southtown Hyundai", "Edmonton", "/v/1"),
        (1, 2026, "Kia", "K4 LX FWD", "new", 26645.0, None, False, "Go Kia South", "St. Albert", "/v/1"),
        (2, 2026, "Infiniti", "QX60 Luxe", "new", 68061.0, 74561.0, False, "Infiniti South", "Red Deer", "/v/1"),
        (4, 2025, "Honda", "CR-V Hybrid Sport", "used", 49584.0, None, False, "T&T Honda", "Calgary", "/v/1"),
        (5, 2025, "Honda", "Civic", None, None, None, False, None, None, "/v/1"),
    ]
