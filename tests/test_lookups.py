"""Places, recalls and prices that hang on financing, case by case."""

import random

import pytest
from pyspark.sql import functions as F

from marketloom.functions import claims, places
from marketloom.operators import recalls


def rows_of(spark, values, column):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r["x"] for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


FINANCE = [
    ("Price includes $3,000 delivery allowance in lieu of special financing rates.", True), ("MSRP $52,199. Includes $2,500 Finance Cash. See dealer for details.", True),
    ("Total savings $4,750 including finance assist of $1,000.", True), ("Advertised price when financed with us through our lending partners.", True),
    ("To receive this price customer must finance through dealer.", True), ("This discount is only available with approved dealer financing.", True), ("Non-finance price $48,900. Financed price shown above.", True),
    ("Cash price does not include the financed savings shown; financing required.", True), ("O.A.C. Credit approval required to qualify for advertised pricing.", True),
    ("Financing available from 3.99% APR for 84 months. O.A.C.", False), ("Use our payment calculator to estimate your monthly finance payment.", False), ("Contact our finance department for more information.", False),
    ("New 2027 Toyota Land Cruiser 1958. $112,995. Call 403-555-0100.", False), ("<style>.finance-cash{color:rgba(0,0,0,.09)}</style><p>2025 Ford Bronco $64,335</p>", False),
    ("<script>var financeCash = 2500;</script><p>2025 Ford Bronco $64,335</p>", False), ("", False), (None, False),
    ('<script>var d = {"id":"26","description":"<p>APR - Must finance through Ford Credit Canada Company. Subject to Ford Credit Canada Company lending terms.</p>"};</script>', False),
    ('<script>var cfg = {"disclaimer":"Advertised price includes $2,000 Finance Cash and is only available with dealer financing on approved credit."};</script>', True),
    ("<script>var financeCash=2500,financeAssist=0;</script>", False), ("Winter Tires Summer Performance Tires Finance Credit Application Request Current Payout Extended Protection Plan", False),
    ("Visit our finance centre. Finance assist available by appointment.", False), ("in lieu of&nbsp;special financing", True),
]


def test_prices_that_hang_on_financing(spark):
    got = rows_of(spark, [t for t, _ in FINANCE], claims.finance_contingent)
    for (text, expected), r in zip(FINANCE, got):
        assert (r is not None) == expected, (text, r)
        assert r is None or (r["reasons"] and r["evidence"])
    text = "a" * 100 + " in lieu of financing " + "b" * 300
    (r,) = rows_of(spark, [text + " Cash price and financing. In lieu of financing"], claims.finance_contingent)
    assert r["reasons"] == ["in lieu of special financing", "cash price differs from financed price"]
    assert r["evidence"] == ("a" * 59 + " in lieu of financing " + "b" * 59)[:200]


PLACES = [
    ("Sunridge, Alberta", ("AB", "province name")), ("QUÉBEC", ("QC", "province name")), ("12 St, t2p 1j9", ("AB", "postal code")), ("X0X 0X0 T2P1J9", None), ("(905) 555-0100", ("ON", "area code")), ("902-555-0100", ("PE", "area code")),
    ("14035550100", None), ("403-555-01001", None), ("555-555-0100 or 403-555-0100", None), ("https://stampedetoyotacalgary.com", ("AB", "city")), ("grandeprairiecars", ("AB", "city")), ("St Albert", ("AB", "city")),
    ("London Ford, Calgary", ("AB", "city")), ("nowhere", None), ("", None), (None, None),
]


def test_places(spark):
    for (text, expected), r in zip(PLACES, rows_of(spark, [t for t, _ in PLACES], places.scan_place)):
        assert (r and (r["code"], r["signal"])) == expected, text
    df = spark.createDataFrame([(1, None, "Calgary Kia", "416-555-0100"), (2, "", None, None), (3, "Regina, Saskatchewan", "Calgary", None)], "i int, city string, name string, phone string")
    j = places.jurisdiction([("city", F.col("city")), ("phone", F.col("phone")), ("name", F.col("name"))])
    out = df.select("i", j.alias("j"), places.dealer_city(F.col("city"), [F.col("name")]).alias("town")).select("i", "j", places.all_in(F.col("j.code")).alias("a"), "town").orderBy("i").collect()
    assert [(r["j"] and (r["j"]["code"], r["j"]["field"]), r["a"], r["town"]) for r in out] == [(("ON", "phone"), True, "Calgary"), (None, None, None), (("SK", "city"), False, "Regina, Saskatchewan")]


def test_queries_are_read(spark):
    asked = {
        "2022 Honda Civic": (2022, "Honda", "Civic"), "honda civic 2022": (2022, "Honda", "Civic"), "Honda Civic": (None, "Honda", "Civic"), "land rover range rover": (None, "Land Rover", "Range Rover"), "mercedes-benz c 300": (None, "Mercedes-Benz C", "300"),
        "1969 ford": (None, "1969", "Ford"), "2028 kia 2020": (2020, "2028", "Kia"), "2020 2021 kia": (2020, "2021", "Kia"), "kia": (None, "Kia", None), "2024": (2024, None, None), "": (None, None, None), "  a\t b  ": (None, "A", "B"),
        "nissan x-trail": (None, "Nissan", "X-Trail"), "alfa": (None, "Alfa", None),
    }
    got = rows_of(spark, list(asked), lambda c: recalls.parsed_query(c, 2026))
    # a make with a dash is one word, so it takes no second one
    asked["mercedes-benz c 300"] = (None, "Mercedes-Benz", "C 300")
    assert [tuple(r) for r in got] == list(asked.values())
    assert [tuple(r) for r in rows_of(spark, [None], lambda c: recalls.parsed_query(c, 2026))] == [(None, None, None)]


@pytest.mark.parametrize(
    "model, base, expected",
    [("Civic Touring Sedan", None, ["Civic Touring Sedan", "Civic Touring", "Civic"]), ("CIVIC Touring", "Civic", ["Civic", "CIVIC Touring"]), ("RAV4", " ", ["RAV4"]), (" ", "Rav4", ["Rav4"]), (None, None, []), ("a  b", "A B", ["A B", "a  b", "a"])],
)
def test_candidates(spark, model, base, expected):
    df = spark.createDataFrame([(model, base)], "m string, b string")
    assert df.select(recalls.model_candidates(F.col("m"), F.col("b")).alias("x")).first()["x"] == expected


def test_recall_lookup(spark):
    registry = [("HONDA", "CIVIC", 2020, "R1"), ("HONDA", "CIVIC", 2020, "R1"), ("Honda ", "civic", 2020, "R2"), ("HONDA", "CIVIC TOURING", 2019, "R3"), ("HONDA", "FIT", 2014, "R4"), ("HONDA", "FIT", 2020, ""), ("KIA", "SOUL", 2009, "R5")]
    ask = [(1, 2020, "honda", "Civic Touring Sedan", None), (2, 2019, "Honda", "Civic Touring", None), (3, 2024, "Honda", "Fit EX", None), (4, 2025, "Honda", "Fit", None), (5, 2020, "Honda", "Nothing", None), (6, None, "Honda", "Civic", None), (7, 2020, "Honda", "X", "Civic"), (8, 2021, "Honda", "Civic Touring", None)]
    got = recalls.recall_lookup(
        spark.createDataFrame(ask, "id int, year int, make string, model string, base_model string"), spark.createDataFrame(registry, "make string, model string, year int, recall_number string"), "id"
    )
    assert sorted(map(tuple, got.collect())) == [
        (1, 2, "Civic", True, None), (2, 1, "Civic Touring", True, None), (3, 0, None, True, "Fit"), (4, 0, None, False, None), (5, 0, None, False, None), (7, 2, "Civic", True, None), (8, 0, None, True, "Civic Touring"),
    ]


def test_texts_are_read_once(spark):
    """Rows with one text meet what was read out of it; missing texts are texts as well."""
    from pyspark.sql import functions as F

    from marketloom.operators import joins

    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, None), (4, "", "b"), (5, "a", "")], "id int, x string, y string")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(x, y):
        calls.add(1)
        return f"{x}|{y}"

    out = joins.once_a_text(rows, ["x", "y"], [read("x", "y").alias("q")])
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", None, "a|None"), (2, "a", None, "a|None"), (3, None, None, "None|None"), (4, "", "b", "|b"), (5, "a", "", "a|")]
    assert calls.value <= 2 * 4  # once to count the texts, once to read them; a read a row would be one for each of five rows twice
    plain = "distinct" in out._jdf.queryExecution().logical().toString().lower() or "Deduplicate" in out._jdf.queryExecution().analyzed().toString()
    assert plain


def test_evidence_is_what_one_pattern_would_find(spark):
    rng = random.Random(4)
    pieces = ["in lieu of financing", "In  Lieu of special financ", "refinance cash", "finance cash", "$3,000 ", "discount", "if financed with us", "must finance through", "price", "to get", "available when", "financed with dealer", "required", "non-financed price", "cash price", "approval required", "pricing", ".", "\u0085", "\u2028", "\U0001F600", "\n", "word " * 9, "é", "x" * 59, "x" * 60, "x" * 61]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = [F.when(F.col("t").rlike(f"(?i){p}"), F.regexp_extract("t", f"(?i)(.{{0,60}}?(?:{p}).{{0,60}})", 1)) for p, _ in claims.CONTINGENT]
    reasons = F.array_distinct(F.array_compact(F.array(*[F.when(F.col("t").rlike(f"(?i){p}"), reason) for p, reason in claims.CONTINGENT])))
    rows = df.select(claims._contingent(F.col("t")).alias("got"), F.substring(F.trim(F.coalesce(*whole)), 1, 200).alias("evidence"), reasons.alias("reasons")).collect()
    assert len(claims.CONTINGENT_NEEDS) == len(claims.CONTINGENT) and sum(r["got"] is not None for r in rows) > 500
    for t, r in zip(texts, rows):
        assert (r["got"] and (r["got"]["reasons"], r["got"]["evidence"])) == ((r["reasons"], r["evidence"]) if r["reasons"] else None), t
