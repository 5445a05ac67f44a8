"""Settled claims, bands, and cash incentives."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from marketloom.functions import bands, texts
from marketloom.functions.windows import cell_of, nearest_ranks
from marketloom.sources import pages_feeds as P

REBATE = re.compile(r"(rebate|eligib|izev|evap)[^.]{0,160}?\b(confirm|verif|check|ask|worth|should be treated|may qualify|might qualify)\b|\b(confirm|verif|check|ask|worth)\b[^.]{0,160}?(rebate|eligib|izev|evap)", re.I)
RECALL = re.compile(r"recall[^.]{0,160}?\b(confirm|verif|check with|ask the dealer)\b|\b(confirm|verif|check with|ask the dealer)\b[^.]{0,160}?recall", re.I)


def brute(text, eligible, reason, checked, confirmed, count):
    topics = []
    if eligible or reason:
        topics.append(("rebate", REBATE, texts.REBATE_YES if eligible else texts.REBATE_NO))
    if checked and confirmed is not False:
        topics.append(("recalls", RECALL, f"{texts.RECALLS_OPEN[0]}{count or 0}{texts.RECALLS_OPEN[1]}"))
    if not topics or not text:
        return text or "", []
    kept, removed = [], []
    for s in filter(None, re.split(r"(?<=[.!?])\s+", text)):
        hit = next((t for t in topics if t[1].search(s)), None)
        (removed.append((hit[0], s.strip())) if hit else kept.append(s))
    for name in dict.fromkeys(n for n, _ in removed):
        kept.append(next(t[2] for t in topics if t[0] == name))
    return re.sub(r"\s+", " ", " ".join(kept)).strip(), removed


def test_settled_claims_against_brute_force(spark):
    rng = random.Random(2)
    parts = [
        "It should be treated as a PHEV for rebate-eligibility purposes", "worth confirming the charging specs with the dealer", "The rebate may apply; ask about it", "Please ask the dealer about recalls",
        "Recall status: confirm", "A nice car indeed", "iZEV" + " x" * 90 + " check", "Check the tires. Rebate", "confirm the rebate and the recall", "Verify the recall",
    ]
    rows = []
    for i in range(300):
        text = rng.choice([None, "", "  "]) if i % 30 == 0 else "".join(rng.choice(parts) + rng.choice([". ", "! ", "?\n\n", ". ", ".", " "]) for _ in range(rng.randrange(1, 7)))
        rows.append((i, text, rng.choice([None, True, False]), rng.choice([None, "", "price cap"]), rng.choice([None, True, False]), rng.choice([None, True, False]), rng.choice([None, 0, 3])))
    df = spark.createDataFrame(rows, "i int, text string, eligible boolean, reason string, checked boolean, confirmed boolean, n int")
    c = F.col
    out = df.select("i", texts.without_settled(c("text"), [texts.rebate_topic(c("eligible"), c("reason")), texts.recall_topic(c("checked"), c("confirmed"), c("n"))]).alias("r")).collect()
    got = {r["i"]: (r["r"]["text"], [tuple(x) for x in r["r"]["removed"]]) for r in out}
    assert got == {i: brute(*rest) for i, *rest in rows}
    assert sum(bool(r[1]) for r in got.values()) > 50


def counts(spark, curve, total, edges, at):
    df = spark.createDataFrame([(curve, total)], "curve array<double>, n long")
    return bands.with_band_counts(df, "curve", "n", edges, at).first()["bands"]


@pytest.mark.parametrize(
    "curve, total, edges, at, expected",
    [
        ([0.0, 10.0], 10, [5.0], 0, [5, 5]),
        ([0.0, 9.0], 10, [3.0, 6.0], 0, [4, 3, 3]),
        ([0.0, 9.0], 11, [3.0, 6.0], 0, [4, 4, 3]),
        ([2.0, 2.0, 2.0], 7, [2.0, 3.0], 0, [0, 7, 0]),
        ([0.0, 5.0, 5.0, 10.0], 9, [5.0], 0, [3, 6]),
        ([1.0], 4, [0.0, 2.0], 0, [0, 4, 0]),
        ([], 4, [0.0, 2.0], 1, [0, 4, 0]),
        ([0.0, 1.0], 0, [0.5], 0, [0, 0]),
    ],
)
def test_bands(spark, curve, total, edges, at, expected):
    assert counts(spark, curve, total, edges, at) == expected


def test_bands_always_add_up(spark):
    rng = random.Random(6)
    rows = [(sorted(rng.gauss(0, 8) for _ in range(rng.randrange(1, 22))), rng.randrange(10**rng.randrange(1, 12))) for _ in range(100)]
    df = spark.createDataFrame(rows, "curve array<double>, n long")
    for r in bands.with_band_counts(df, "curve", "n", [-5.0, -0.05, 0.05, 5.0], 2).collect():
        assert sum(r["bands"]) == r["n"] and min(r["bands"]) >= 0


def test_cells_never_fall(spark):
    rng = random.Random(1)
    values = sorted([s * m * 10.0**e for s in (-1, 1) for e in range(-8, 9) for m in (1.0, 1.0000001, rng.random())] + [0.0, -0.0, float("inf"), float("-inf"), 5e-324, 1.7e308, float("nan")])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    cells = [r["c"] for r in df.orderBy("v").select(cell_of(F.col("v")).alias("c")).collect()]
    assert cells == sorted(cells)
    got = nearest_ranks(df.withColumn("g", F.lit(1)), ["g"], "v", {f"p{i}": i / (len(values) - 1) for i in range(len(values))}).first()
    assert [str(got[f"p{i}"]).replace("-0.0", "0.0") for i in range(len(values))] == [str(r["v"]).replace("-0.0", "0.0") for r in df.orderBy("v").collect()]


def incentives(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page int, html string")
    found = P.cash_incentives(df, "page")
    return found, {r["page"]: (r["price_after"], r["total"], [tuple(o) for o in r["offers"]]) for r in found.collect()}


def block(*entries):
    return f'<script>var x={{"cash_incentives" : {json.dumps(list(entries))}, "y": 1}};</script>'


def entry(*offers, **more):
    return {"stackable_offers": list(offers), **more}


def test_cash_incentives(spark):
    evap = {"name": "Federal EVAP Rebate (Potential)", "cash_value": "$4,762", "payee": "CUSTOMER", "expiryDate": "2026-08-31"}
    nscda = {"name": " Non-Stackable Cash Delivery Allowance ", "cash_value": 2300, "payee": "DEALER"}
    rich = block(entry(evap), entry(evap, nscda, amount="43,246", totalAmount="$7,062"), entry({"name": "big", "cash_value": 99999}))
    found, got = incentives(
        spark, rich, block(entry(evap, amount=1)) + rich, None, "", "<html>no offers here</html>", '<script>var x={"cash_incentives":[{"amount":1', block(entry({"name": "", "cash_value": 5})),
        block(entry({"name": "free", "cash_value": "call"})), block(3, "x", None, {"stackable_offers": "no"}, entry(None, 7, {"name": "odd ] }", "cash_value": 10.5})), '"cash_incentives": {"a": 1}',
        block(entry({"name": "a", "cash_value": 5})) + block(entry({"name": "b", "cash_value": 9})) + block(entry({"name": "c", "cash_value": 9})), '"msrp":46755 39,765',
    )
    best = (43246.0, 7062.0, [("Federal EVAP Rebate (Potential)", 4762.0, "CUSTOMER", "2026-08-31"), ("Non-Stackable Cash Delivery Allowance", 2300.0, "DEALER", None)])
    assert got == {0: best, 1: best, 8: (None, 10.5, [("odd ] }", 10.5, None, None)]), 10: (None, 9.0, [("b", 9.0, None, None)])}
    lines = sorted(tuple(r) for r in P.incentive_lines(found.where("page = 0"), "page").collect())
    assert lines == [
        (0, 0, "Federal EVAP Rebate (Potential)", -4762.0, True, False, "watch", "2026-08-31"),
        (0, 1, "Non-Stackable Cash Delivery Allowance", -2300.0, False, True, "watch", None),
    ]


def test_percentiles_against_sorted_lists(spark):
    from marketloom.functions.windows import discrete, interpolated

    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, round(rng.gauss(0, 50), 2), -0.5, 0.0, rng.randrange(3) * 1.0])) for _ in range(800)] + [("one", 4.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    points = {f"p{i}": i / 20 for i in range(21)}
    groups = {g: sorted(v for k, v in rows if k == g and v is not None) for g in {k for k, _ in rows}}
    got = {r["g"]: r for r in interpolated(df, ["g"], "v", points).collect()}
    assert set(got) == {g for g, vs in groups.items() if vs}
    for g, r in got.items():
        vs = groups[g]
        for name, p in points.items():
            at = (len(vs) - 1) * p
            low, high = vs[int(at)], vs[min(int(at) + 1, len(vs) - 1)]
            assert r[name] == pytest.approx(low + (high - low) * (at - int(at)), abs=1e-9)
    every = sorted(v for _, v in rows if v is not None)
    assert interpolated(df, [], "v", {"m": 0.5}).first()["m"] == pytest.approx((every[(len(every) - 1) // 2] + every[len(every) // 2]) / 2)
    assert tuple(interpolated(df.where("false"), [], "v", {"m": 0.5}).first()) == (None,)
    for g, r in {r["g"]: r for r in discrete(df, ["g"], "v", {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}).collect()}.items():
        vs = groups[g]
        assert [r["a"], r["b"], r["c"], r["d"]] == [vs[max(-int(-p * len(vs) // 1), 1) - 1] for p in (0.0, 0.5, 0.95, 1.0)]
