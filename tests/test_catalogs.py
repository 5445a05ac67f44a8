"""Catalogue replacement and configurator summaries, case by case."""

import pytest

from marketloom.operators import catalog, summaries

COLUMNS = "year int, make string, model string, trim string, msrp double, drivetrain string, attrs string, price_basis string, source_url string, fuel_type string"
VERIFIED = (2027, "Toyota", "Land Cruiser", "Land Cruiser", 80460.0, "4WD", "AB", "excl_freight", "https://maker.example/lc", None)
PLAIN = (2026, "Toyota", "Camry", "SE", 38792.0, "FWD", None, None, None, None)


def row(year, model, trim, msrp, make="Toyota", **more):
    return (year, make, model, trim, msrp, *[more.get(c) for c in catalog.CARRIED])


def changes(spark, old, new, **options):
    frame = lambda rows: spark.createDataFrame(rows, COLUMNS)
    found = {}
    for r in catalog.catalog_changes(frame(old), frame(new), **options).collect():
        found.setdefault(r["action"], []).append(r)
    return found


def test_a_superseded_row_hands_on_what_the_capture_does_not_know(spark):
    got = changes(spark, [VERIFIED, PLAIN], [row(2027, "Land Cruiser", "Land Cruiser", 81990.0, fuel_type="Hybrid")])
    (new,) = got["written"]
    assert (new["msrp"], new["drivetrain"], new["attrs"], new["price_basis"], new["source_url"], new["fuel_type"], new["carried"]) == (
        81990.0, "4WD", "AB", "excl_freight", "https://maker.example/lc", "Hybrid", 4,
    )
    assert [r["model"] for r in got["superseded"]] == ["Land Cruiser"] and [r["model"] for r in got["deleted"]] == ["Camry"]


def test_a_verified_row_without_a_new_price_stays(spark):
    got = changes(spark, [VERIFIED, PLAIN], [row(2026, "Camry", "SE", 39500.0)])
    assert [r["model"] for r in got["kept"]] == ["Land Cruiser"] and "superseded" not in got
    assert got["written"][0]["drivetrain"] == "FWD"


def test_a_verified_summary_without_trim_goes_once_its_trims_are_captured(spark):
    floor = row(2026, "Mach-E", None, 45778.0, source_url="u")
    other_year = row(2025, "Mach-E", None, 44000.0, source_url="u")
    got = changes(spark, [floor, other_year], [row(2026, "Mach-E", "Premium", 49990.0)])
    assert [r["year"] for r in got["superseded"]] == [2026] and [r["year"] for r in got["kept"]] == [2025]


def test_fractions_are_gated_and_the_cheapest_of_a_key_is_written(spark):
    rows = [row(2026, "A", "x", 30000.5), row(2026, "A", "y", 31000.0), row(2026, "A", "y", 30500.0), row(2026, "B", None, 0.0), row(2026, "B", "", 20000.0), row(2026, "C", "z", None)]
    got = changes(spark, [], rows, basis="excl_freight")
    assert sorted((r["model"], r["trim"], r["msrp"], r["price_basis"]) for r in got["written"]) == [("A", "y", 30500.0, "excl_freight"), ("B", "", 20000.0, "excl_freight")]


def test_a_collapse_is_refused_unless_allowed_and_a_stated_basis_stands(spark):
    old = [row(2026, f"M{i}", "t", 1000.0 + i) for i in range(44)]
    few = [row(2026, f"M{i}", "t", 2000.0, make="TOYOTA", price_basis="own") for i in range(7)]
    assert {k: len(v) for k, v in changes(spark, old, few, basis="stamped").items()} == {"kept": 44}
    got = changes(spark, old, few, basis="stamped", allow_collapse=True)
    assert {k: len(v) for k, v in got.items()} == {"deleted": 44, "written": 7} and {r["price_basis"] for r in got["written"]} == {"own"}
    half = [row(2026, f"M{i}", "t", 2000.0) for i in range(22)]
    assert len(changes(spark, old, half)["written"]) == 22
    assert len(changes(spark, old[:3], half[:1])["written"]) == 1


def test_makes_that_were_not_captured_or_gated_away_stay(spark):
    old = [VERIFIED, row(2026, "Civic", "LX", 30000.0, make="Honda")]
    got = changes(spark, old, [row(2026, "Civic", "LX", 30000.92, make="Honda")])
    assert {k: len(v) for k, v in got.items()} == {"kept": 2}
    assert changes(spark, [], []) == {}


def test_the_catalogue_that_follows_has_one_row_a_key(spark):
    frame = spark.createDataFrame([VERIFIED, PLAIN], COLUMNS)
    after = catalog.catalog_after(catalog.catalog_changes(frame, spark.createDataFrame([row(2027, "Land Cruiser", "Land Cruiser", 81990.0)], COLUMNS)))
    assert sorted((r["model"], r["msrp"]) for r in after.collect()) == [("Land Cruiser", 81990.0)]
    assert after.columns == frame.columns


def judged(spark, **line):
    names = ["summary_id", "model", "trim", "msrp_line", "package_line", "package_price", "exterior", "no_cost", "block_heater", "delivery", "printed_subtotal"]
    floats = {"msrp_line", "package_price", "block_heater", "delivery", "printed_subtotal"}
    values = [float(line[n]) if n in floats and line.get(n) is not None else line.get(n) for n in names]
    r = summaries.assessed(spark.createDataFrame([tuple(values)], summaries.SUMMARY)).first()
    return r["msrp"], r["reason"]


@pytest.mark.parametrize(
    "line, msrp, reason",
    [
        (dict(msrp_line=55520, exterior="White", no_cost=True, block_heater=682, delivery=1930, printed_subtotal=59266), 55520, None),
        (dict(msrp_line=69207, exterior="Black", no_cost=True, block_heater=682, delivery=1930, printed_subtotal=72953), 69207, None),
        (dict(msrp_line=69207, package_line="Trailhunter", package_price=16447, exterior="Everest", no_cost=True, block_heater=682, delivery=1930, printed_subtotal=89400), 85654, None),
        (dict(msrp_line=69207, package_line="Platinum", package_price=5922, no_cost=True, block_heater=682, delivery=1930, printed_subtotal=78875), 75129, None),
        (dict(msrp_line=80460, package_line="Land Cruiser Premium Package", package_price=6375, no_cost=True, block_heater=702, delivery=1930, printed_subtotal=90601), 86835, None),
        (dict(msrp_line=64660, exterior="no-cost", no_cost=True, block_heater=679, delivery=1860, printed_subtotal=68333), 64660, None),
        (dict(msrp_line=64660, exterior="no-cost", no_cost=True, block_heater=709, delivery=1860, printed_subtotal=68333), None, "does not add up"),
        (dict(msrp_line=69207, package_line="Platinum with Premium Paint", package_price=6272, no_cost=True), None, "package holds the colour"),
        (dict(msrp_line=69207, package_line="TRD PRO WITH premium  paint ", package_price=13501, no_cost=True), None, "package holds the colour"),
        (dict(msrp_line=50000, package_line="Premium Paint Protection Package", no_cost=True), 50000, None),
        (dict(msrp_line=59460, exterior="Oxygen White with Black Roof", block_heater=717, delivery=1930, printed_subtotal=63241), None, "two-tone exterior"),
        (dict(msrp_line=80850, exterior="Heritage Blue with Light Grey Roof", no_cost=True), None, "two-tone exterior"),
        (dict(msrp_line=52350, exterior="Ruby Flare Pearl"), None, "colour not known to be free"),
        (dict(msrp_line=50000), None, "colour not known to be free"),
        (dict(msrp_line=55520, exterior="White", no_cost=True, block_heater=682, delivery=1930, printed_subtotal=60000), None, "does not add up"),
        (dict(msrp_line=55227, no_cost=True, block_heater=709, delivery=1930, printed_subtotal=58930), None, "does not add up"),
        (dict(msrp_line=55227, no_cost=True, block_heater=709, delivery=1860, printed_subtotal=58930), 55227, None),
        (dict(msrp_line=55227, no_cost=True, block_heater=709, printed_subtotal=58930), None, "no delivery line"),
        (dict(exterior="White", no_cost=True), None, "no list price line"),
    ],
)
def test_summaries(spark, line, msrp, reason):
    assert judged(spark, **line) == (msrp, reason)


def test_pairs_of_builds_tell_the_base_from_the_colour(spark):
    def build(i, trim, line, package=None):
        return (i, "M", trim, line, package, None, None, None, None, None, None)

    lines = [build(1, "Signia", 59460.0), build(2, "Signia", 58555.0), build(3, "Cruiser", 80850.0), build(4, "Cruiser", 80460.0), build(5, "Same", 69207.0), build(6, "Same", 69207.0)]
    lines += [build(7, "One", 5.0), build(8, "None", None), build(9, "Signia", 50000.0, "package"), build(10, "Signia", 58800.0)]
    got = {r["trim"]: (r["base"], r["premium"], r["reason"]) for r in summaries.solved_bases(spark.createDataFrame(lines, summaries.SUMMARY)).collect()}
    assert got == {
        "Signia": (58555.0, 905.0, None), "Cruiser": (80460.0, 390.0, None), "Same": (None, None, "same list price line"), "One": (None, None, "one build"),
        "None": (None, None, "no list price line"),
    }


@pytest.mark.parametrize(
    "base, heater, delivery, floor, surface, delta, verdict",
    [
        (58555, 717, 1930, 62354, "lineup", 0.0, "confirmed"),
        (71670, 702, 1930, 75454, "lineup", 0.0, "confirmed"),
        (59460, 717, 1930, 62354, "lineup", -905.0, "above the floor"),
        (80460, 702, 1930, 75454, "lineup", -8790.0, "above the floor"),
        (58000, 717, 1930, 62354, "lineup", 555.0, "below the floor"),
        (55227, 709, 1860, 58914, "trim card", None, "other surface"),
        (55227, 709, None, 58914, "lineup", None, "no delivery line"),
        (55227, 709, 1860, None, "lineup", None, "no published floor"),
    ],
)
def test_the_published_floor_checks_a_base(spark, base, heater, delivery, floor, surface, delta, verdict):
    number = lambda x: None if x is None else float(x)
    bases = spark.createDataFrame([("M", float(base), float(heater), number(delivery))], "model string, msrp_line double, block_heater double, delivery double")
    got = summaries.corroborated(bases, spark.createDataFrame([("M", number(floor), surface)], "model string, lineup_from double, surface string")).first()
    assert (got["delta"], got["lineup_verdict"]) == (delta, verdict)


def test_evidence_of_a_free_colour(spark):
    """The cheaper of two builds and a build that makes the floor are released; a two-tone stays refused."""
    lines = [
        (1, "M", "A", 59460.0, None, None, "Red", None, 717.0, 1930.0, None), (2, "M", "A", 58555.0, None, None, "Grey", None, 717.0, 1930.0, None),
        (3, "N", "B", 71670.0, None, None, "Any", None, 702.0, 1930.0, None), (4, "N", "C", 71700.0, None, None, "Any", None, 702.0, 1930.0, None),
        (5, "N", "D", 71670.0, None, None, "Blue with Grey Roof", None, 702.0, 1930.0, None),
    ]
    lineup = spark.createDataFrame([("N", 75454.0, "lineup")], "model string, lineup_from double, surface string")
    rows = summaries.assessed(summaries.with_evidence(spark.createDataFrame(lines, summaries.SUMMARY), lineup)).collect()
    assert {r["summary_id"]: r["msrp"] for r in rows} == {1: None, 2: 58555.0, 3: 71670.0, 4: None, 5: None}
