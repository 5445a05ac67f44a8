"""Holds with timers, legality between versions, alerts and spans of validity."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import legality, matching
from marketloom.streaming import events, holds


def minute(m):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)


def stream_of(spark, folder, batches):
    """One file a micro-batch, in order."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(h, k, minute(m)) for h, k, m in rows], "hold_id string, kind string, at timestamp")
        df.coalesce(1).write.parquet(f"{folder}/w{i}")
        (part,) = [n for n in os.listdir(f"{folder}/w{i}") if n.endswith(".parquet")]
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(f"{folder}/w{i}/{part}", f"{folder}/in/{i}.parquet")
        os.utime(f"{folder}/in/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    source = spark.readStream.schema("hold_id string, kind string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/in")
    out = events.drain(holds.holds(source)).collect()
    return sorted((r["hold_id"], r["outcome"], (r["at"] - dt.datetime(2024, 1, 1)).total_seconds() / 60) for r in out)


def test_holds_over_batches(spark, tmp_path):
    got = stream_of(spark, str(tmp_path), [
        [("a", "hold", 0), ("b", "hold", 0), ("x", "capture", 1)],
        [("a", "capture", 5), ("a", "hold", 6), ("a", "capture", 7), ("b", "hold", 8)],
        [("z", "hold", 30)],
        # b has expired and is captured after that, once; c's time was over before it came; d ends in time
        [("b", "capture", 31), ("b", "capture", 32), ("c", "hold", 1), ("d", "hold", 22), ("d", "release", 25)],
        # g is later than the watermark; f is released after its time, which says nothing more than that it expired
        [("g", "hold", 2), ("e", "hold", 24), ("f", "hold", 23), ("f", "release", 45), ("y", "hold", 60)],
    ])
    assert got == [
        ("a", "captured", 5.0), ("b", "captured", 31.0), ("b", "expired", 10.0), ("c", "expired", 11.0), ("d", "released", 25.0), ("e", "expired", 34.0), ("f", "expired", 33.0), ("z", "expired", 40.0),
    ]


def test_stream_and_log_agree(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"h{i}", k, i + m) for i in range(60) for k, m in [("hold", 0)] + [(rng.choice(["hold", "capture", "release"]), rng.randrange(25)) for _ in range(rng.randrange(4))]]
    rows.append(("end", "hold", 500))
    log = spark.createDataFrame([(h, k, minute(m)) for h, k, m in rows], "hold_id string, kind string, at timestamp")
    batch = holds.holds_batch(log, F.lit(minute(490)))
    expected = sorted((r["hold_id"], r["outcome"], (r["at"] - dt.datetime(2024, 1, 1)).total_seconds() / 60) for r in batch.collect())
    assert stream_of(spark, str(tmp_path), [rows]) == expected and {o for _, o, _ in expected} == {"captured", "released", "expired"}


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_statuses(spark):
    as_of = dt.datetime(2024, 3, 1)
    new, old = dt.datetime(2024, 2, 20), dt.datetime(2024, 1, 1)
    before = [(1, "pending_approval", new, 5.0), (2, "approved", new, 5.0), (3, "sent", new, 5.0), (4, "pending_approval", new, 5.0), (5, "pending_approval", old, 5.0), (6, "pending_approval", new, 5.0), (7, "approved", new, None), (8, "pending_approval", old, 5.0), (9, None, new, 5.0), (10, "cancelled", new, 1.0)]
    after = [(1, "approved", new, 6.0), (2, "sent", new, 6.0), (3, "approved", new, 5.0), (4, "expired", new, 5.0), (5, "expired", old, 5.0), (7, "approved", new, 5.0), (8, "pending_approval", old, 5.0), (9, "sent", new, 5.0), (10, "cancelled", new, 1.0), (11, "pending_approval", new, 1.0), (12, "sent", new, 1.0)]
    schema = "run_id int, status string, created_at timestamp, total double"
    got = legality.status_violations(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema), "run_id", ["total"], F.lit(as_of))
    assert found(got) == sorted([
        (2, "snapshot changed"), (3, "illegal step: sent -> approved"), (4, "expired early"), (6, "deleted"), (7, "snapshot changed"), (8, "not expired"),
        (9, "illegal step: none -> sent"), (12, "starts as sent"),
    ], key=str)


def test_ledgers_and_seals(spark):
    schema = "id int, kind string, holder string, line string, amount double, sealed_on date"
    day, next_day = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    before = [(1, "charge", "a", "x", 1.0, day), (2, "charge", "a", "y", 2.0, None), (3, "payment", "a", None, 3.0, day), (4, "payment", "a", None, 3.0, day), (5, "payment", "b", None, None, day)]
    after = [(1, "charge", "a", "x", 1.0, day), (2, "charge", "a", "y", 2.5, day), (4, "payment", "a", "z", 4.0, next_day), (5, "payment", "b", None, None, None), (6, "charge", "a", "x", 9.0, None), (7, "charge", "a", None, 1.0, None), (8, "charge", "a", None, 1.0, None), (9, "payment", "a", "x", 1.0, None)]
    a, b = spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)
    got = legality.ledger_violations(a, b, "id", ["kind", "line", "amount"], ["holder", "line"], F.col("kind") == "charge")
    assert found(got) == [(2, "edited: amount"), (3, "deleted"), (4, "edited: line, amount"), (6, "charged twice")]
    got = legality.sealed_violations(a, b, "id", "sealed_on", ["line", "amount"])
    assert found(got) == [(3, "sealed row deleted"), (4, "sealed again"), (4, "sealed row changed: line, amount"), (5, "unsealed")]
    none = spark.createDataFrame([], schema)
    assert found(legality.ledger_violations(none, none, "id", ["kind"], ["line"])) == []


def test_alerts_against_all_pairs(spark):
    rng = random.Random(9)
    pick = lambda *xs: rng.choice(xs)
    models = ("CR", "CR-V", "cr-v hybrid", "Cr_V", "C%", "", None, "RAV4", "rav", "RAV4 Prime")
    subs = [(i, pick("confirmed", "confirmed", "pending", None), pick("Honda", "HONDA", "Toyota", None), pick("Calgary", "calgary", None, ""), pick(*models)) for i in range(150)]
    cands = [(i, pick("honda", "Toyota", None), pick("Calgary", "", None), pick(*models)) for i in range(80)]
    sent = [(i, i % 80) for i in range(0, 150, 3)] * 2 + [(None, 1)]
    low = lambda x: None if x is None else x.lower()
    expected = [
        (s, c)
        for s, status, mk, city, m in subs
        for c, cmk, ccity, cm in cands
        if status == "confirmed" and mk and low(mk) == low(cmk) and ccity is not None and (low(city) or "") == low(ccity) and (s, c) not in sent
        and (cm is None or (m is not None and (low(m).startswith(low(cm)) or low(cm).startswith(low(m)))))
    ]
    got = matching.alert_matches(
        spark.createDataFrame(subs, "subscription_id int, status string, make string, city string, model string"),
        spark.createDataFrame(cands, "candidate_id int, make string, city string, model string"),
        spark.createDataFrame(sent, "subscription_id int, candidate_id int"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(expected) and expected
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("bucket", [1, 32, 5000])
def test_spans_in_force(spark, bucket):
    rng = random.Random(bucket)
    day = lambda n: None if n is None else dt.date(2020, 1, 1) + dt.timedelta(days=n)
    spans = []
    for i in range(40):
        a = rng.choice([None, rng.randrange(-500, 600)])
        spans.append((i, rng.choice(["x", "y", None]), a, rng.choice([None, (a or 0) + rng.randrange(-20, 300)]), float(i)))
    facts = [(i, rng.choice(["x", "y", "z", None]), rng.choice([None, rng.randrange(0, 500)])) for i in range(200)]

    def best(key, at):
        held = [(a is not None, a, i) for i, k, a, b, _ in spans if key is not None and k == key and at is not None and (a is None or a <= at) and (b is None or b >= at)]
        return max(held, key=lambda h: (h[0], h[1] or 0, h[2]))[2] if held else None

    got = matching.in_force(
        spark.createDataFrame([(i, k, day(d)) for i, k, d in facts], "id int, key string, at date"),
        spark.createDataFrame([(i, k, day(a), day(b), v) for i, k, a, b, v in spans], "span int, key string, since date, until date, rate double"),
        ["key"], "at", "id", "span", bucket_days=bucket,
    )
    assert {r["id"]: r["span"] for r in got.collect()} == {i: best(k, d) for i, k, d in facts}


def test_no_facts_and_no_spans(spark):
    facts, spans = "id int, key string, at date", "span int, key string, since date, until date, rate double"
    none = matching.in_force(spark.createDataFrame([], facts), spark.createDataFrame([(1, "x", None, None, 1.0)], spans), ["key"], "at", "id", "span")
    assert none.collect() == []
    got = matching.in_force(spark.createDataFrame([(1, "x", dt.date(2020, 1, 1))], facts), spark.createDataFrame([], spans), ["key"], "at", "id", "span").collect()
    assert [(r["id"], r["rate"]) for r in got] == [(1, None)]


def test_spans_that_lose_meet_no_fact(spark):
    """2,000 spans of one key cover 2,000 facts of it on one day: no join gives their product, and the facts' own rows aren't dealt by key."""
    spans = spark.range(2000).select(F.col("id").alias("span"), F.lit("x").alias("key"), F.expr("date '2020-01-01' + cast(id % 50 as int)").alias("since"), F.lit(None).cast("date").alias("until"), F.col("id").cast("double").alias("rate"))
    facts = spark.range(2000).select("id", F.lit("x").alias("key"), F.lit(dt.date(2020, 3, 1)).alias("at"))
    out = matching.in_force(facts, spans, ["key"], "at", "id", "span")
    assert [tuple(r) for r in out.groupBy("span", "rate").count().collect()] == [(1999, 1999.0, 2000)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "rightHint=(strategy=broadcast)" in plan


def test_alerts_broadcast_nothing(spark):
    """Exploded beginnings of 500 long models look small and aren't: no join of theirs sends a side to the driver."""
    subs = spark.range(500).selectExpr("id AS subscription_id", "'confirmed' AS status", "'M' AS make", "'c' AS city", "if(id % 5 = 0, null, concat('model ', id % 7)) AS model")
    cands = spark.range(500).selectExpr("id AS candidate_id", "'m' AS make", "'C' AS city", "if(id % 11 = 0, null, concat('Model ', id % 7, ' with a long name')) AS model")
    sent = spark.range(100).selectExpr("if(id < 0, id, 7L) AS subscription_id", "id AS candidate_id")
    out = matching.alert_matches(subs, cands, sent)
    exp = {(s, c) for s in range(500) for c in range(500) if (c % 11 == 0 or (s % 5 and s % 7 == c % 7)) and not (s == 7 and c < 100)}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(exp) and set(got) == exp
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def shuffled_rows(df):
    """Rows that the plan's exchanges have written; one that is used twice counts once."""
    found, stack = {}, [df._jdf.queryExecution().executedPlan()]
    while stack:
        p = stack.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            stack.append(p.plan())
        elif name == "ShuffleExchangeExec":
            found[p.id()] = p.metrics().apply("shuffleRecordsWritten").value()
        stack += [p.children().apply(i) for i in range(p.children().size())]
    return sum(found.values())


def test_pairs_of_alerts_are_not_shuffled(spark):
    """600 candidates with models of their own fit 600 subscriptions, a third of which were sent most: 360,000 pairs, none of which is shuffled."""
    subs = spark.range(600).selectExpr("id AS subscription_id", "'confirmed' AS status", "'M' AS make", "'c' AS city", "if(id % 2 = 0, 'Model', 'model ') AS model")
    cands = spark.range(600).selectExpr("id AS candidate_id", "'m' AS make", "'C' AS city", "concat('Model ', id) AS model")
    sent = spark.range(200).crossJoin(spark.range(5).withColumnRenamed("id", "c")).selectExpr("id AS subscription_id", "c * 7 AS candidate_id")
    out = matching.alert_matches(subs, cands, sent)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == 360_000 - 1000 and set(got) == {(s, c) for s in range(600) for c in range(600) if s >= 200 or c % 7 or c > 28}
    assert shuffled_rows(out) < 60_000


def test_alerts_dealt_to_many_parts(spark, monkeypatch):
    """Ids that occur twice or are missing keep their rows, whichever parts they come to."""
    for name, n in (("SUBSCRIPTIONS", 7), ("CANDIDATES", 5), ("RUN", 2)):
        monkeypatch.setattr(matching, name, n)
    models = ("CR", "cr-v", "CR-V Hybrid", "", None, "C%")
    subs = [(i % 40 if i else None, "confirmed", "Honda", None, models[i % 6]) for i in range(60)]
    cands = [(i % 33 if i else None, "honda", "", models[i * 5 % 6]) for i in range(50)]
    sent = [(i, c) for i in range(0, 40, 3) for c in range(i % 5, 33, 4)] + [(3, None), (None, 4), (99, 1)]
    begins = lambda s, c: c is None or (s is not None and (s.lower().startswith(c.lower()) or c.lower().startswith(s.lower())))
    expected = [(s, c) for s, *_, sm in subs for c, *_, cm in cands if begins(sm, cm) and (s is None or c is None or (s, c) not in sent)]
    got = matching.alert_matches(
        spark.createDataFrame(subs, "subscription_id int, status string, make string, city string, model string"),
        spark.createDataFrame(cands, "candidate_id int, make string, city string, model string"),
        spark.createDataFrame(sent, "subscription_id int, candidate_id int"),
    )
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
