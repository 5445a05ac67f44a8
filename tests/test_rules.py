"""Record rules on the cases that made them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom.functions import columns as C
from marketloom.functions.windows import nearest_ranks
from marketloom.operators import catalog_match, deviation, finance, guards, joins, ledger, market_index, merge


def one(spark, value):
    return spark.range(1).select(value.alias("x")).first()["x"]


@pytest.mark.parametrize("values,p,expected", [([1, 3, 5, 7], 0.5, 5), ([], 0.5, None), ([4], 0.9, 4), ([2, 1], 0.0, 1), ([1, 2, 3], 1.0, 3)])
def test_nearest_rank_is_observed(spark, values, p, expected):
    assert one(spark, C.nearest_rank(F.array(*[F.lit(v) for v in values]).cast("array<int>"), p)) == expected
    if values:
        df = spark.createDataFrame([("g", v) for v in values], "g string, v int")
        assert nearest_ranks(df, ["g"], "v", {"x": p}).first()["x"] == expected


@pytest.mark.parametrize(
    "price,msrp,all_in,basis,kind",
    [(30000, 31000, None, None, "under"), (33000, 31000, None, "excl_freight", "indeterminate"), (37000, 31000, None, None, "over"), (33000, 31000, None, "incl_freight", "over"), (31000, 1, 31000, None, "at"), (31500, 1, 31000, None, "over"), (0, 31000, None, None, None)],
)
def test_direction(spark, price, msrp, all_in, basis, kind):
    n = lambda v: F.lit(v).cast("double")
    w = C.reference_window(n(msrp), n(all_in), F.lit(basis).cast("string"))
    got = spark.range(1).select(w.alias("w")).select(C.direction(n(price), F.col("w")).alias("d")).first()["d"]
    assert (got["dir"] if got else None) == kind
    if got and kind == "over" and not all_in:
        assert got["floor_pct"] <= 100 * (price - msrp) / msrp


@pytest.mark.parametrize("raw,key", [("St. Albert", "st albert"), ("Saint Albert, AB", "st albert"), ("Ste-Anne", "ste anne"), ("Sainte Anne, Alta.", "ste anne"), ("  ", None), (None, None), ("Red Deer", "red deer")])
def test_city_key(spark, raw, key):
    assert one(spark, C.city_key(F.lit(raw).cast("string"))) == key


@pytest.mark.parametrize("vin,ok", [("1M8GDM9AXKP042788", True), ("1M8GDM9A0KP042788", False), ("1M8GDM9AXKP04278", False), ("1M8GDM9AXKPO42788", False), ("11111111111111111", True), (None, None), ("", None)])
def test_vin(spark, vin, ok):
    assert one(spark, C.vin_valid(F.lit(vin).cast("string"))) is ok


def test_words(spark):
    mail = {" A.B+x@GoogleMail.com": "ab@gmail.com", "a.b@x.org": "a.b@x.org", "nobody": "nobody", "+t@gmail.com": "+t@gmail.com", None: ""}
    for raw, key in mail.items():
        assert one(spark, C.email_identity(F.lit(raw).cast("string"))) == key
    fees = {"Nitrogen tires": "nitrogen", "Doc Fee": "documentation", "Administration": "admin", "AMVIC levy": "regulatory", "Window etch": "theft_protection", "": "unlabeled", "Floor plan": "other"}
    for raw, label in fees.items():
        assert one(spark, C.fee_label(F.lit(raw))) == label
    assert one(spark, C.fnv1a_32(F.lit("a"))) == "e40c292c" and one(spark, C.fnv1a_32(F.lit("foobar"))) == "bf9cf968" and one(spark, C.fnv1a_32(F.lit(""))) == "811c9dc5"
    assert one(spark, C.drive(F.lit("Sport 4MATIC"))) == "AWD" and one(spark, C.fuel(F.lit("Plug-in Hybrid"))) == "phev"


def test_payments(spark):
    pay = lambda p, a, m: one(spark, C.payment(F.lit(float(p)), F.lit(float(a)), F.lit(m)))
    assert pay(12000, 0, 60) == 200.0 and pay(30000, 6, 60) == 579.98
    assert finance.payment_grid(spark.createDataFrame([(1, 100.0, 5.0)], "id int, p double, a double"), "id", "p", "a").count() == 24


def test_few_rows_are_not_told_about(spark):
    row = (1, 100.0, 90.0, "new", None)
    df = spark.createDataFrame([row] * 24, "dealer_id int, msrp double, sale_price double, condition string, delisted_on date")
    few = deviation.deviation_summary(df, 3).first()
    assert not few["enough"] and few["n"] == 24 and few["median_pct"] is None
    assert deviation.deviation_summary(df.union(df)).first()["median_pct"] == -10.0


def test_city_gate(spark):
    now = dt.datetime(2024, 1, 10)
    rows = [("x", i % 3, float(i), 1.0, now) for i in range(12)] + [("y", i % 2, float(i), 1.0, now) for i in range(30)] + [("z", i % 5, 1.0, 1.0, now - dt.timedelta(days=8)) for i in range(30)]
    got = {r["city"]: r["is_publishable"] for r in market_index.city_index(spark.createDataFrame(rows, "city string, dealer_id int, deviation_pct double, deviation_dollars double, updated_at timestamp"), now).collect()}
    assert got == {"x": True, "y": False, "z": False}


def test_province_counts_add_up(spark):
    now = dt.datetime(2024, 1, 10)
    rows = [("p", i, d, f, d == "at", None, None, now) for i, (d, f) in enumerate([("under", -5.0)] * 15 + [("over", 4.0)] * 8 + [("at", 0.0)] * 2 + [("indeterminate", None)] * 10)]
    r = market_index.province_read(spark.createDataFrame(rows, "province string, dealer_id int, dir string, floor_pct double, exact boolean, stated_msrp double, infl_floor_pct double, updated_at timestamp"), now).first()
    assert r["under_n"] + r["over_n"] + r["at_n"] + r["indeterminate_n"] == r["n_matched"] == 35 and r["n_directional"] == 25 and r["is_publishable"] and r["median_discount_pct"] == -5.0


def test_trim_match(spark):
    cat = [("m", "LE", 30000.0, None, None), ("m", "XLE Premium", 36000.0, None, None), ("m", "XLE AWD", 38000.0, None, None), ("n", "Base", 20000.0, None, None), ("h", "LE", 30000.0, None, None), ("h", "LE Hybrid", 33000.0, "hybrid", None)]
    catalog = spark.createDataFrame(cat, "model string, trim string, msrp double, fuel_type string, drivetrain string")
    ask = [(1, "m", "XLE Premium", 36500.0, None, None), (2, "m", "xle", 38200.0, None, "AWD"), (3, "n", "Base", 29000.0, None, None), (4, "n", "Base", 20500.0, None, None), (5, "m", None, None, None, None), (6, "h", "LE Hybrid", 33100.0, None, None), (7, "q", "LE", 1.0, None, None)]
    got = {r["listing_id"]: (r["matched_trim"], r["basis"]) for r in catalog_match.match_listings(spark.createDataFrame(ask, "listing_id int, model string, trim string, price double, fuel_type string, drivetrain string"), catalog, ["model"]).collect()}
    assert got == {1: ("XLE Premium", "exact"), 2: ("XLE AWD", "exact"), 3: ("Base", "starting_at"), 4: ("Base", "exact"), 5: ("LE", "starting_at"), 6: ("LE Hybrid", "exact")}


def test_snapshot_rules(spark):
    day = dt.date(2024, 1, 1)
    old = spark.createDataFrame([(1, "a", 5.0, day, day, None), (2, "b", 6.0, day, day, day), (3, "c", 7.0, day, day, None)], "vin int, model string, price double, first_seen date, last_seen date, delisted_on date")
    seen = spark.createDataFrame([(1, "", None), (2, "bb", 6.0), (4, None, 1.0)], "vin int, model string, price double")
    got = {r["vin"]: r for r in merge.upsert_snapshot(old, seen, ["vin"], ["model"], ["price"], "2024-02-01").collect()}
    assert (got[1]["model"], got[1]["price"], got[1]["moved"]) == ("a", None, True)
    assert (got[2]["delisted_on"], got[2]["moved"]) == (None, False)
    assert not got[3]["moved"] and got[3]["last_seen"] == day
    assert got[4]["is_new"] and got[4]["moved"]


def test_delisting_is_skipped_on_a_thin_crawl(spark):
    state = spark.createDataFrame([("d", i, None) for i in range(12)] + [("e", i, None) for i in range(4)], "dealer string, vin int, delisted_on date")
    seen = spark.createDataFrame([("d", i) for i in range(5)] + [("e", 0)], "dealer string, vin int")
    got = merge.mark_delisted(state, seen, "dealer", "vin", "2024-02-01").where("delisted_on is not null").collect()
    assert sorted((r["dealer"], r["vin"]) for r in got) == [("e", 1), ("e", 2), ("e", 3)]


def test_null_is_a_key_when_values_are_carried(spark):
    old = spark.createDataFrame([("m", None, 9.0), ("m", "LE", 8.0)], "model string, trim string, all_in double")
    new = spark.createDataFrame([("m", None, None), ("m", "LE", 7.0), ("m", "XX", None)], "model string, trim string, all_in double")
    got = {r["trim"]: (r["all_in"], r["carried"]) for r in merge.carry_forward(new, old, ["model", "trim"], ["all_in"]).collect()}
    assert got == {None: (9.0, 1), "LE": (7.0, 0), "XX": (None, 0)}


def test_shares_add_up(spark):
    amounts = spark.sql("select id, cast(id * 0.37 as decimal(18,2)) as net from range(1, 50)")
    people = spark.createDataFrame([("a", 3334), ("b", 3333), ("c", 3333)], "name string, bps int")
    bad = ledger.allocate(amounts, people, "id", "net").groupBy("id").agg(F.sum("share").alias("s")).join(amounts, "id").where("s <> net")
    assert bad.count() == 0


def test_guards(spark):
    a = spark.createDataFrame([("x", i) for i in range(20)] + [("y", 1)], "k string, id int")
    b = spark.createDataFrame([("x", i) for i in range(9)], "k string, id int")
    got = {r["k"]: r["refused"] for r in guards.collapse(a, b, "k").collect()}
    assert got == {"x": True, "y": False}
    kept, bad = guards.split_rows(a, {"small": F.col("id") < 10, "known": F.col("k") == "x"})
    assert kept.count() == 10 and {r["reason"] for r in bad.collect()} == {"small", "known"}


def test_longest_prefix(spark):
    facts = spark.createDataFrame([("rav 4 prime xse",), ("rav 40",), ("civic",)], "t string")
    known = spark.createDataFrame([("rav",), ("rav 4",), ("rav 4 prime",)], "p string")
    assert {r["t"]: r["p"] for r in joins.longest_prefix(facts, known, "t", "p").collect()} == {"rav 4 prime xse": "rav 4 prime", "rav 40": "rav", "civic": None}


def test_verdicts_on_odd_values(spark):
    from marketloom.functions import verdicts as V

    rows = [(1, None, None, None), (2, 30000.0, 28000.0, True), (3, 28100.0, 28000.0, True), (4, None, 28000.0, False), (5, 30000.0, 28000.0, False), (6, 0.0, 28000.0, True)]
    got = spark.createDataFrame(rows, "id int, s double, r double, e boolean").select("id", V.msrp_authority(F.col("s"), F.col("r"), F.col("e")).alias("v")).select("id", "v.*").orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == [(0.0, "dealer_stated", "listing", None), (28000.0, "exact", "catalog", 2000.0), (28000.0, "exact", "catalog", None), (28000.0, "starting_at", "catalog", None), (30000.0, "dealer_stated", "listing", None), (28000.0, "exact", "catalog", None)]
    lines = [("Freight", None, None, "fee"), ("Paint shield", 5.0, "good", "addon"), ("?", -1.0, None, "discount"), (None, 9.0, "standard", "fee"), ("Loyalty cash", None, None, "discount"), ("Loyalty fee", 3.0, None, "addon")]
    df = spark.createDataFrame(lines, "n string, p double, v string, want string")
    assert df.where(V.line_class(F.col("n"), F.col("p"), F.col("v")) != F.col("want")).count() == 0
    covers = spark.createDataFrame([("3-year/60,000 km",), ("6 Year/Unlimited km",), ("none",), (None,)], "t string").select(V.coverage(F.col("t")).alias("c")).collect()
    assert [tuple(r["c"]) if r["c"] else None for r in covers] == [(3, 60000), (6, None), None, None]
    trap = spark.range(1).select(V.financing_trap(F.lit(1000.0), F.lit(7.99), F.lit(0.0), F.lit(60), F.lit(30000.0)).alias("t"), V.financing_trap(F.lit(0.0), F.lit(7.99), F.lit(0.0), F.lit(60), F.lit(1.0)).alias("none")).first()
    assert trap["t"]["mode"] == "quantified" and trap["t"]["is_trap"] and trap["t"]["extra_interest"] == 6489 and trap["none"] is None
    traces = spark.createDataFrame([([],), (None,), (["HTTP 429", "HTTP 404"],), (["AbortError"],), (["HTTP 404"],)], "t array<string>").select(V.miss_class(F.col("t")).alias("k")).collect()
    assert [r["k"] for r in traces] == ["no-trace", "no-trace", "blocked", "timeout", "responded-no-feed"]
    gates = spark.createDataFrame([(None, "AB"), ("ca", " ab "), ("CA", "ON"), ("US", "TX")], "c string, r string").select(V.region_gate(F.col("c"), F.col("r"), [("CA", "AB")]).alias("g")).collect()
    assert [r["g"]["reason"] for r in gates] == ["unknown", "served", "other_province", "other_country"]
    empty = V.grade_summary(V.graded(spark.createDataFrame([], "id int, g string"), "id", "g")).first()
    assert tuple(empty) == (0, 0, 0, 0, None, None)


def test_name_matches_against_brute_force(spark):
    import random

    from marketloom.operators.joins import match_names

    rng = random.Random(4)
    pool = ["alpha", "beta", "longword", "motors", "auto", "sales", "city", "ltd", "group", "north"]
    entries = [(i, " ".join(rng.sample(pool, rng.randrange(1, 5)))) for i in range(40)] + [(90, "Alpha Beta"), (91, None)]
    probes = [(i, " ".join(rng.sample(pool + ["extra", "other"], rng.randrange(1, 6)))) for i in range(60)] + [(100, "Alpha Beta Longword"), (101, ""), (102, None)]

    def words(x):
        return set((x or "").lower().split())

    exp = {}
    for i, p in probes:
        found = []
        for j, r in entries:
            a, b = words(p), words(r)
            s = len(a & b)
            score = min(1.0, s / max(len(a), len(b), 1) + (0.15 if s and s == min(len(a), len(b)) else 0))
            if round(score, 6) >= 0.72:
                found.append((-round(score, 6), j))
        found.sort()
        if found and (len(found) == 1 or found[1][0] > found[0][0]):
            exp[i] = (found[0][1], -found[0][0])
    got = match_names(spark.createDataFrame(probes, "p long, name string"), spark.createDataFrame(entries, "r long, title string"), "p", "name", "r", "title")
    assert {x["p"]: (x["r"], x["score"]) for x in got.collect()} == exp and exp


def test_city_key_folds_compatibility_letters(spark):
    from pyspark.sql import functions as F

    from marketloom.functions.columns import city_key

    df = spark.createDataFrame([("Ｌｅｄｕｃ, AB",), ("Leduc",), ("Saint Albert",), ("St. Albert",)], "c string")
    assert [r[0] for r in df.select(city_key(F.col("c"))).collect()] == ["leduc", "leduc", "st albert", "st albert"]


def test_fees_and_addons(spark):
    from pyspark.sql import functions as F

    from marketloom.functions.verdicts import ADDON_WORDS, FEE_WORDS

    df = spark.createDataFrame([("a/c levy",), ("air conditioning",), ("undercoat",), ("lojack",), ("addendum",)], "c string")
    assert [tuple(r) for r in df.select(F.col("c").rlike(FEE_WORDS), F.col("c").rlike(ADDON_WORDS)).collect()] == [(True, False)] * 2 + [(False, True)] * 3


def test_names_of_common_words_are_not_paired(spark):
    """300 names share both their common words: only an entry that also has a probe's own word can match, so no others are joined."""
    from pyspark.sql import functions as F

    from marketloom.operators.joins import match_names, name_pairs, name_words

    probe = spark.range(300).select("id", F.format_string("red bolt lot%d", "id").alias("name"))
    entries = spark.range(300).select(F.col("id").alias("r"), F.format_string("lot%d red bolt ltd", "id").alias("title"))
    out = match_names(probe, entries, "id", "name", "r", "title")
    got = out.collect()
    assert sorted((x["id"], x["r"], x["score"]) for x in got) == [(i, i, 0.9) for i in range(300)]
    words = lambda df, k, name, names: df.select(F.col(k).alias(name), name_words(df.columns[1]).alias(names))
    assert name_pairs(words(probe, "id", "p", "pw"), words(entries, "r", "r", "rw"), 0.72).count() == 300


def test_near_duplicates_as_classes(spark):
    """Every pair of items can be told from links of classes; 200 copies give 199 rows and no pairs of theirs."""
    import random

    from marketloom.operators.joins import near_duplicates

    rng = random.Random(7)
    rows = [(i, "m", rng.choice([100.0, 103.0, 105.0, 105.2, 110.0, None, -5.0]), rng.choice([1, 4, 6, 11, None])) for i in rng.sample(range(300), 120)]
    exp = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and None not in a + b and abs(a[3] - b[3]) <= 5 and abs(a[2] - b[2]) <= 0.05 * a[2]}
    got = near_duplicates(spark.createDataFrame(rows, "id long, k string, p double, z int"), ["k"], "id", "p", "z").collect()
    assert len({(r["a"], r["b"]) for r in got}) == len(got) and all(r["a"] < r["b"] for r in got)
    members = {r[0]: {r[0]} for r in rows}
    for r in got:
        if r["link"] == "copy":
            members[r["a"]].add(r["b"])
    told = {(x, y) for m in members.values() for x in m for y in m if x < y}
    for r in got:
        pairs = [(x, y) for x in members[r["a"]] for y in members[r["b"]]] if r["link"] != "copy" else []
        mine = {(min(x, y), max(x, y)) for x, y in pairs if r["link"] == "all" or (x < y) == (r["link"] == "a first")}
        assert mine or r["link"] == "copy"
        told |= mine
    assert told == exp
    copies = near_duplicates(spark.range(200).selectExpr("id", "'m' AS k", "9.0D AS p", "1 AS z"), ["k"], "id", "p", "z").collect()
    assert sorted(tuple(r) for r in copies) == [(0, i, "copy") for i in range(1, 200)]


def test_probes_alike_share_their_comparables(spark):
    """Against brute force, with items without size; the ranking is over sizes and not over probes."""
    import random

    from marketloom.operators.joins import comparables

    rng = random.Random(3)
    rows = [(i, rng.choice("xyz"), rng.choice([1, 2, 2, 5, 9, None]), rng.choice([0.0, 5.0, 7.5, 9.0])) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, k string, z int, p double")
    out = comparables(df, df, ["k"], "id", "z", "p")
    exp = set()
    for i, k, z, _ in rows:
        far = lambda r: (0, 0) if z is None or r[2] is None else (1, abs(r[2] - z))  # noqa: B023, E731
        found = sorted((r for r in rows if r[1] == k and r[0] != i and r[3] > 0), key=lambda r: (far(r), r[3], r[0]))[:3]
        exp |= {(i, r[0], n + 1) for n, r in enumerate(found)}
    assert {tuple(r) for r in out.collect()} == exp
    assert "windowspecdefinition(id" not in out._jdf.queryExecution().analyzed().toString()


def test_listings_meet_one_rate(spark):
    """Of 300 rates of a make only the best meets its 300 listings."""
    from marketloom.operators.finance import rate_pick

    listings = spark.range(300).selectExpr("id", "'m' AS make", "if(id % 3 = 0, 'a', if(id % 3 = 1, 'b', null)) AS model")
    rates = spark.range(300).selectExpr("'m' AS make", "if(id % 2 = 0, 'a', null) AS model", "cast(id % 5 * 12 + 24 AS int) AS term", "cast(id AS double) AS apr", "id % 7 = 0 AS promo")
    out = rate_pick(listings, rates, "id", "make", "model", 48)
    exp = {True: (48, 2.0, "model"), False: (48, 17.0, "make")}
    assert {r["id"]: (r["term"], r["apr"], r["level"]) for r in out.collect()} == {i: exp[i % 3 == 0] for i in range(300)}
    assert "windowspecdefinition(id" not in out._jdf.queryExecution().analyzed().toString()


def test_recall_candidates_meet_their_model_once(spark):
    """Queries of one model are no more rows for its many years, and few models are broadcast."""
    from marketloom.operators.recalls import recall_lookup

    queries = spark.range(50).selectExpr("id", "cast(2001 + id % 12 AS int) AS year", "'Ford' AS make", "'F-150 XL' AS model", "cast(null AS string) AS base_model")
    registry = spark.range(60).selectExpr("'FORD' AS make", "'F-150' AS model", "cast(1990 + id % 20 AS int) AS year", "concat('R', id) AS recall_number")
    out = recall_lookup(queries, registry, "id")
    got = {r["id"]: tuple(r)[1:] for r in out.collect()}
    assert got == {i: (3, "F-150", True, None) if 2001 + i % 12 <= 2009 else (0, None, True, "F-150") for i in range(50)}
    assert "rightHint=(strategy=broadcast)" in out._jdf.queryExecution().optimizedPlan().toString()


def test_fee_patterns_are_tried_where_they_can_match(spark):
    """The pieces change no label, and a pattern stands behind them."""
    import random

    from pyspark.sql import functions as F

    from marketloom.functions.columns import FEE_LABELS, fee_label

    rng = random.Random(1)
    words = "nitrogen n2 market value adjustment additional dealer mark-up adm recondition recon doc documentation fee admin charge paint ceramic rust tire & wheel and rim road hazard vin etch anti-theft window gap guaranteed asset extended warranty vsc pdi pre-delivery amvic licence levy tax a/c air conditioning luxury green block heater lock mats accessory delivery prep recycl x".split()
    df = spark.createDataFrame([(" ".join(rng.sample(words, rng.randrange(1, 4))),) for _ in range(3000)] + [(w,) for w in words] + [("",), (None,)], "t string")
    s = F.lower(F.trim(F.coalesce("t", F.lit(""))))
    plain = F.when(s == "", "unlabeled")
    for pattern, label in FEE_LABELS:
        plain = plain.when(s.rlike(pattern), label)
    out = df.select(fee_label(F.col("t")).alias("a"), plain.otherwise("other").alias("b"))
    assert out.where("a <> b").count() == 0 and out.select("a").distinct().count() > 14
    assert "Contains" in out.select("a")._jdf.queryExecution().optimizedPlan().toString()
