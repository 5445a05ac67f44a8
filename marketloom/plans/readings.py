"""Readings of texts and curves over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import bands, texts
from marketloom.functions.windows import nearest_ranks
from marketloom.plans import market
from marketloom.session import table

#: Sentences that are added to the documents, one of these a document.
SAID = [
    " Worth a check: the rebate may apply!  Please ask the dealer about the recall status. Nice car.", " The rebate is worth a look. Confirm the rebate; then confirm the recall.",
    " It is a plug-in, and for rebate purposes it should be treated as a hybrid. Ask away.", " Recall work: confirm it with the maker? Verify the recall!\nVerif the recall.",
    " No question here. The rebate applies. Confirm the price. The recall is done.", " Eligible buyers may qualify. Check with us about an open recall.",
]
EDGES = [-20.0, -10.0, -5.0, -0.05, 0.05, 5.0, 10.0, 20.0]
AT_BAND, LEAST_ROWS = 4, 5
CURVE = {f"p{i}": i / 20 for i in range(21)}


def settled_claims(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    said = F.element_at(F.array(*map(F.lit, SAID)), (k % len(SAID)).cast("int") + 1)
    topics = [
        texts.rebate_topic(k % 3 == 0, F.when(k % 3 == 1, "price cap")),
        texts.recall_topic(k % 4 != 3, F.when(k % 8 == 4, False), k % 5),
    ]
    out = d.select("doc_id", texts.without_settled(F.concat("text", said), topics).alias("c"))
    topic = F.array_join(F.transform("c.removed", lambda r: r["topic"]), ",")
    return out.select("doc_id", F.sha2(F.col("c.text").cast("binary"), 256).alias("text_sha256"), F.size("c.removed").alias("removed"), topic.alias("topics"))


def price_bands(spark, sf_dir):
    """Each make's listings by how far they are off their list price, from its curve of percentiles; small makes are left out."""
    rows = market.listings(spark, sf_dir).where("msrp > 0 and list_price > 0").select("make", (100.0 * (F.col("list_price") - F.col("msrp")) / F.col("msrp")).alias("pct"))
    curves = nearest_ranks(rows, ["make"], "pct", CURVE).select("make", F.array(*CURVE).alias("curve"))
    counts = rows.groupBy("make").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS)
    return bands.with_band_counts(counts.join(curves, "make"), "curve", "n", EDGES, AT_BAND).select("make", "n", F.posexplode("bands").alias("band", "listings"))


QUERIES = {f.__name__: f for f in (settled_claims, price_bands)}
SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
REOPENS = {
    "rebate": r"(?i)(rebate|eligib|izev|evap)[^.]{0,160}?\b(confirm|verif|check|ask|worth|should be treated|may qualify|might qualify)\b|\b(confirm|verif|check|ask|worth)\b[^.]{0,160}?(rebate|eligib|izev|evap)",
    "recalls": r"(?i)recall[^.]{0,160}?\b(confirm|verif|check with|ask the dealer)\b|\b(confirm|verif|check with|ask the dealer)\b[^.]{0,160}?recall",
}
TEXTS = ", ".join("'" + s.replace("'", "''") + "'" for s in SAID)
ORACLE = {
    "settled_claims": f"""WITH d AS (SELECT doc_id, text || [{TEXTS}][doc_id % 6 + 1] AS t, doc_id % 3 < 2 AS rebate, doc_id % 4 <> 3 AND doc_id % 8 <> 4 AS recalls FROM documents),
s AS (SELECT doc_id, rebate, recalls, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM (SELECT *, string_split(regexp_replace(t, '([.!?]){SPACE}+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM d)),
j AS (SELECT *, CASE WHEN rebate AND regexp_matches(s, '{REOPENS["rebate"]}') THEN 'rebate' WHEN recalls AND regexp_matches(s, '{REOPENS["recalls"]}') THEN 'recalls' END AS topic FROM s WHERE s <> ''),
a AS (SELECT doc_id, coalesce(string_agg(s, ' ' ORDER BY i) FILTER (topic IS NULL), '') AS kept, count(topic) AS removed, coalesce(string_agg(topic, ',' ORDER BY i) FILTER (topic IS NOT NULL), '') AS topics,
  min(i) FILTER (topic = 'rebate') AS b, min(i) FILTER (topic = 'recalls') AS c FROM j GROUP BY doc_id),
v AS (SELECT *, CASE WHEN b IS NULL THEN '' WHEN doc_id % 3 = 0 THEN ' {texts.REBATE_YES.replace("'", "''")}' ELSE ' {texts.REBATE_NO}' END AS x,
  CASE WHEN c IS NULL THEN '' ELSE ' {texts.RECALLS_OPEN[0]}' || doc_id % 5 || '{texts.RECALLS_OPEN[1]}' END AS y FROM a)
SELECT doc_id, sha256(CASE WHEN rebate OR recalls THEN regexp_replace(regexp_replace(kept || CASE WHEN b > c THEN y || x ELSE x || y END, '{SPACE}+', ' ', 'g'), '^ | $', '', 'g') ELSE t END) AS text_sha256,
  CAST(removed AS INT) AS removed, topics FROM v JOIN d USING (doc_id)""",
    "price_bands": f"""WITH {market.LISTINGS},
d AS (SELECT make, 100.0 * (list_price - msrp) / msrp AS pct FROM listings WHERE msrp > 0 AND list_price > 0),
c AS (SELECT make, count(*) AS n, list(pct ORDER BY pct) AS v FROM d GROUP BY make HAVING count(*) >= {LEAST_ROWS}),
g AS (SELECT make, n, list_transform(range(21), lambda i: v[CAST(floor((n - 1) * (i / 20.0::DOUBLE) + 0.5) AS BIGINT) + 1]) AS p FROM c),
e AS (SELECT unnest(range({len(EDGES) + 1})) AS band, unnest(['-inf'::DOUBLE, {", ".join(map(str, EDGES))}]) AS lo, unnest([{", ".join(map(str, EDGES))}, 'inf'::DOUBLE]) AS hi),
q AS (SELECT make, n, band, lo, hi, i, p[i] AS x, p[i + 1] AS y FROM g, e, range(1, 21) r(i)),
s AS (SELECT make, n, band, CAST(floor(sum(CASE WHEN x = y THEN CASE WHEN x >= lo AND x < hi THEN 1.0::DOUBLE ELSE 0 END ELSE greatest(0.0::DOUBLE, least(y, hi) - greatest(x, lo)) / (y - x) END ORDER BY i) / 20 * {bands.PARTS} + 0.5) AS BIGINT) AS u FROM q GROUP BY ALL),
w AS (SELECT *, CAST(sum(u) OVER (PARTITION BY make) AS BIGINT) AS whole FROM s),
z AS (SELECT *, n * u // whole AS quota, row_number() OVER (PARTITION BY make ORDER BY n * u % whole DESC, band) AS place FROM w)
SELECT make, n, CAST(band AS INT) AS band, CAST(quota + CASE WHEN place <= n - sum(quota) OVER (PARTITION BY make) THEN 1 ELSE 0 END AS BIGINT) AS listings FROM z""",
}
