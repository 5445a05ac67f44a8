"""Listings matched to trims: line-ups with gaps, drives that rows don't state, and features that mark a trim."""

from marketloom.operators import catalog_match

B, H, G = "BEV", "Hybrid", "Gas"
LINEUPS = {
    "bz": [("XLE FWD", 49063, B, "FWD"), ("XLE AWD", 56463, B, "AWD"), ("Limited AWD", 64763, B, "AWD"), ("Woodland", 59900, B, "AWD")],
    "camry": [("SE", 38792, H, "FWD"), ("SE Upgrade", 40842, H, "FWD"), ("SE Upgrade", 42487, H, "AWD"), ("SE Upgrade Nightshade", 43614, H, "AWD"), ("XLE", 49442, H, "AWD", "digitalKey2"), ("XSE", 49547, H, "AWD", "digitalKey2")],
    "rogue": [("S", 34598, G, "AWD"), ("SV", 38498, G, "AWD"), ("Dark Armor", 40798, G, "AWD"), ("Rock Creek", 41798, G, "AWD"), ("Platinum", 46298, G, "AWD")],
    "cruiser": [("1958", 75450, H, None), ("Cruiser", 84240, H, None), ("Premium Package", 90615, H, None)],
    "mache": [("Select", 44990, B, None), ("Premium", 49990, B, None), ("GT", 69990, B, None)],
    "mache awd": [("Premium", 49990, B, "RWD"), ("Premium", 56990, B, "AWD"), ("GT", 69990, B, "AWD")],
    "mache mixed": [("Select", 44990, B, None), ("Premium", 49990, B, None), ("GT AWD", 69990, B, None)],
    "ioniq": [("Essential RWD", 59999, B, None), ("Preferred AWD", 64999, B, None), ("Preferred AWD+", 64999, B, None)],
    "seltos": [("LX FWD", 28495, G, None), ("LX", 30495, G, None), ("EX", 33495, G, None), ("EX Premium", 36795, G, None), ("X-Line", 39295, G, "AWD"), ("X-Line Limited", 41295, G, "AWD")],
    "hrv": [("LX 2WD", 30800, G, None), ("LX AWD", 33100, G, None), ("SPORT", 36400, G, None), ("EX-L", 39200, G, None)],
    "compass": [(None, 34700, G, None)],
    "unpriced": [("SE", 0, G, None), ("LE", None, G, None)],
}
LINEUPS["ioniq full"] = LINEUPS["ioniq"] + [("Preferred AWD with Luxury Package", 76499, B, None), ("Preferred AWD+ with Ultimate Calligraphy Package", 81499, B, None)]
# model, trim, drive, fuel, price, drive by number, features, list price, basis
CASES = [
    ("bz", "AWD XLE", "AWD", B, 54888, None, None, 56463, None), ("bz", "XLE AWD", "AWD", B, None, None, None, 56463, "exact"), ("bz", "XLE FWD", "FWD", B, None, None, None, 49063, "exact"),
    ("bz", "Limited AWD", "AWD", B, None, None, None, 64763, "exact"), ("bz", "Woodland", "AWD", B, None, None, None, 59900, "exact"), ("bz", None, "AWD", B, 55000, None, None, 56463, None),
    ("camry", "XLE AWD", "AWD", H, 49442, None, None, 49442, None), ("camry", "XSE AWD", "AWD", H, None, None, None, 49547, None), ("camry", "SE", "FWD", H, 38792, None, None, 38792, None),
    ("camry", "SE Upgrade", "AWD", H, None, None, None, 42487, None), ("camry", None, "AWD", H, 49500, None, ["DigitalKey2"], 49547, None), ("camry", None, None, H, None, None, ["digitalKey2"], 49442, "exact"),
    ("rogue", "Rock Creek Intelligent AWD", None, G, None, None, None, 41798, None), ("rogue", "Platinum AWD", None, G, None, None, None, 46298, None), ("rogue", None, None, G, None, None, None, 34598, "starting_at"),
    ("cruiser", "1958", None, H, None, None, None, 75450, None), ("cruiser", "Cruiser", None, H, None, None, None, 84240, None), ("cruiser", None, None, H, None, None, None, 75450, "starting_at"),
    ("cruiser", "Premium Package", None, H, None, None, None, 90615, None), ("mache", "Premium", "AWD", B, None, None, None, 49990, "starting_at"), ("mache", "Premium", "AWD", B, 52990, None, None, 49990, "starting_at"),
    ("mache", "Premium", None, B, None, "AWD", None, 49990, "starting_at"), ("mache", "Premium AWD", None, B, None, None, None, 49990, "starting_at"), ("mache", "Premium", "AWD", B, 66015, "AWD", None, 49990, "starting_at"),
    ("mache", "Premium", None, B, None, None, None, 49990, "exact"), ("mache awd", "Premium", "AWD", B, None, None, None, 56990, "exact"), ("mache mixed", "Premium", "AWD", B, None, None, None, 49990, "starting_at"),
    ("mache mixed", "GT", "AWD", B, None, None, None, 69990, "exact"), ("ioniq", "Preferred AWD", "AWD", B, 83899, None, None, 64999, "starting_at"), ("ioniq", "Preferred AWD", "AWD", B, 66500, None, None, 64999, "exact"),
    ("ioniq full", "Preferred AWD+ with Ultimate Calligraphy Package", "AWD", B, 83899, None, None, 81499, "exact"), ("seltos", "X-Line Limited AWD", "AWD", G, 47509, None, None, 41295, "exact"),
    ("seltos", "X-Line", "AWD", G, None, None, None, 39295, "starting_at"), ("seltos", "LX", None, G, None, None, None, 28495, "starting_at"), ("hrv", "EX-L AWD", "AWD", G, 43481, None, None, 39200, "starting_at"),
    ("hrv", "LX AWD", "AWD", G, 37381, None, None, 33100, "exact"), ("compass", "Sport", None, G, None, None, None, 34700, "starting_at"), ("unpriced", "SE", None, G, None, None, None, None, None),
]


def test_lineups(spark):
    rows = [(m, r[0], None if r[1] is None else float(r[1]), r[2], r[3], list(r[4:])) for m, trims in LINEUPS.items() for r in trims]
    catalog = spark.createDataFrame(rows, "model string, trim string, msrp double, fuel_type string, drivetrain string, attrs array<string>")
    ask = [(i, m, t, None if p is None else float(p), f, d, v, x) for i, (m, t, d, f, p, v, x, _, _) in enumerate(CASES)]
    listings = spark.createDataFrame(ask, "listing_id int, model string, trim string, price double, fuel_type string, drivetrain string, vin_drive string, features array<string>")
    got = {r["listing_id"]: (r["matched_msrp"], r["basis"]) for r in catalog_match.match_listings(listings, catalog, ["model"]).collect()}
    for i, case in enumerate(CASES):
        msrp, basis = got.get(i, (None, None))
        assert msrp == case[-2] and (case[-1] is None or basis == case[-1]), (case, msrp, basis)


def test_words_are_counted_as_often_as_a_trim_has_them(spark):
    catalog = spark.createDataFrame([("m", "Sport Sport", 1000.0, None, None), ("m", "Sport GT", 9000.0, None, None)], "model string, trim string, msrp double, fuel_type string, drivetrain string")
    ask = spark.createDataFrame([(1, "m", "sport", None, None, None)], "listing_id int, model string, trim string, price double, fuel_type string, drivetrain string")
    r = catalog_match.match_listings(ask, catalog, ["model"]).first()
    assert (r["matched_trim"], r["score"], r["basis"]) == ("Sport Sport", 4, "exact")
