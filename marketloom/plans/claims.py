"""Claims about listings, quotes and pages over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import claims as K
from marketloom.session import table

LINES = ["Documentation", "Freight", "Doc-Fee", "Administration", "Dealer fee", "Docfees", "Paint"]
PLACES = ["Calgary, AB", "Austin, texas", "Miami, FL ", "Québec", "Boise, ID", "Ontario", ""]
#: What is added to the pages of the test tables, one of these a page; RATE stands for a rate of the page's own, NB for a no-break space.
OFFERS = [
    "<p>Finance from RATE% APR for 60 months</p>", "Lease at RATE%, O.A.C.", "<style>a{width:9%}</style>financing at 6.5NB%, or RATE% O.A.C.",
    "Purchase rates from RATE%NB–NB9.99% APR", "0% down payment, RATE% APR", "purchase&nbsp;financing RATE%", "1% - 2% - RATE% APR", "Rebate of RATE%",
    "APR RATE% with a lot of words after it until the other one is told, which is for the lease 0.5% alone. Financing 44% and 00% APR", "",
]
WIDGETS = [
    "Get an <b>AccuTrade</b> offer", "SnapOffer", "Kelley Blue Book. Trade now", "kelley blue book: your trade", "Canadian BlackBook value", "Canadian Black Book. No value",
    "What's my car worth?", "Value Your Trade", "trade",
]
RATE_TEXT = "concat(CAST(page_id % 13 AS VARCHAR(9)), CASE WHEN page_id % 3 = 0 THEN '.49' WHEN page_id % 3 = 1 THEN '.9' ELSE '' END)"


def _one_of(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def msrp_claims(spark, sf_dir):
    """The claim of each line, its part's price being the list price."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    asking, msrp = F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice")), F.when(F.col("p_size") > 3, F.col("p_retailprice") * 20)
    all_in, whole = F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice") * 22), F.col("l_returnflag") != "R"
    basis = F.when(F.col("l_linenumber") == 1, "starting_at").when(F.col("l_linenumber") == 2, "dealer_stated").when(F.col("l_linenumber") != 3, "exact")
    ceiling = K.ceiling_claim(asking, F.col("p_retailprice") * 25, F.col("p_size"), whole)
    claim = K.msrp_claim(msrp, all_in, basis, asking, whole, F.col("l_linestatus") == "F", F.when(F.col("l_discount") > 0.08, False), ceiling)
    return rows.select("l_orderkey", "l_linenumber", claim.alias("c"), ceiling["over"].alias("over_ceiling")).select("l_orderkey", "l_linenumber", "c.comparable", "c.delta", "c.over", "c.against", "c.refusal", "over_ceiling")


def doc_fee_claims(spark, sf_dir):
    """The claim about the document fee of each order that has one in a region with a benchmark."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), _one_of(LINES, F.col("l_linenumber") - 1).alias("name"), (F.col("l_extendedprice") / 50).alias("price"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", _one_of(PLACES, F.pmod("o_custkey", F.lit(len(PLACES)))).alias("place"))
    claims = orders.join(K.doc_fees(lines, "o_orderkey", "name", "price"), "o_orderkey").select("o_orderkey", "doc_fee", K.doc_fee_claim(F.col("doc_fee"), F.col("place")).alias("c"))
    return claims.where("c is not null").select("o_orderkey", "doc_fee", "c.region", "c.kind", "c.benchmark", "c.over_by")


def _said(values: list[str], index: str) -> str:
    """SQL, for Spark and the twin alike, for one of the values by a number."""
    spelt = lambda v: "'" + v.replace("'", "’").replace("NB", "\u00a0") + "'"
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {spelt(v)}" for i, v in enumerate(values)) + " END"


OFFERED = f"concat(html, '<br>', replace({_said(OFFERS, f'page_id % {len(OFFERS)}')}, 'RATE', {RATE_TEXT}))"
MARKED = f"concat(html, '<br>', {_said(WIDGETS, f'page_id % {len(WIDGETS) + 1}')})"


def advertised_rates(spark, sf_dir):
    """The rate that each page advertises."""
    return table(spark, sf_dir, "pages").select("page_id", F.expr(OFFERED).alias("page")).select("page_id", K.advertised_rate(F.col("page")).alias("rate"))


def trade_widgets(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.expr(MARKED).alias("page")).select("page_id", K.trade_widget(F.col("page")).alias("w"))
    return found.select("page_id", F.col("w").isNotNull().alias("detected"), F.col("w.vendor").alias("vendor"))


QUERIES = {f.__name__: f for f in (msrp_claims, doc_fee_claims, advertised_rates, trade_widgets)}
ORACLE = {
    "msrp_claims": """WITH a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.01 THEN l_extendedprice END AS ask, CASE WHEN p_size > 3 THEN p_retailprice * 20 END AS m, CASE WHEN p_size % 2 = 0 THEN p_retailprice * 22 END AS f,
              l_returnflag <> 'R' AS whole, l_linestatus = 'F' AS lost, l_discount > 0.08 AS unsure, p_retailprice * 25 AS top, p_size AS trims FROM lineitem JOIN part ON l_partkey = p_partkey),
        b AS (SELECT *, coalesce(whole AND trims >= 2 AND ask > top, false) AS above, CASE WHEN whole AND f IS NOT NULL THEN f ELSE m END AS ref FROM a),
        c AS (SELECT *, CASE WHEN m IS NULL THEN NULL WHEN l_linenumber = 1 AND above THEN 'above_ceiling' WHEN l_linenumber = 1 THEN 'starting_at' WHEN l_linenumber = 2 THEN 'dealer_stated' WHEN l_linenumber = 3 THEN 'trim_unconfirmed'
              WHEN ask IS NULL THEN NULL WHEN unsure THEN 'price_unverified' WHEN f IS NULL AND lost THEN 'region_unknown' WHEN f IS NULL AND whole THEN 'all_in_against_ex_freight' END AS refusal FROM b),
        d AS (SELECT *, m IS NOT NULL AND ask IS NOT NULL AND refusal IS NULL AS ok FROM c)
        SELECT l_orderkey, l_linenumber, ok AS comparable, CASE WHEN ok THEN ask - ref END AS delta, ok AND ask > ref AS over, CASE WHEN m IS NULL THEN NULL WHEN whole AND f IS NOT NULL THEN 'all_in' ELSE 'ex_freight' END AS against,
               refusal, CASE WHEN above THEN ask - top END AS over_ceiling FROM d""",
    "doc_fee_claims": """WITH f AS (SELECT l_orderkey, max(l_extendedprice / 50) AS fee FROM lineitem WHERE l_linenumber IN (1, 3, 4, 5) GROUP BY l_orderkey),
        o AS (SELECT o_orderkey, fee, CASE o_custkey % 7 WHEN 0 THEN 'AB' WHEN 1 THEN 'TX' WHEN 2 THEN 'FL' WHEN 3 THEN 'QC' WHEN 5 THEN 'ON' END AS region FROM orders JOIN f ON o_orderkey = l_orderkey WHERE fee > 0)
        SELECT o_orderkey, fee AS doc_fee, region, CASE WHEN region = 'TX' THEN CASE WHEN fee > 225 THEN 'over_cap' ELSE 'within_cap' END WHEN region = 'FL' THEN 'over_norm' ELSE 'allin' END AS kind,
               CASE region WHEN 'TX' THEN 225 WHEN 'FL' THEN 999 END AS benchmark, CASE WHEN region IN ('TX', 'FL') THEN CAST(floor(greatest(0, fee - CASE region WHEN 'TX' THEN 225 ELSE 999 END) + 0.5) AS BIGINT) END AS over_by
        FROM o WHERE region IS NOT NULL AND (region <> 'FL' OR fee >= 999)""",
    "advertised_rates": f"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({OFFERED}, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]*>', ' ', 'g'),
    '(&nbsp;|[\\s\\x{{a0}}])+', ' ', 'g') AS t FROM pages),
r AS (SELECT page_id, regexp_replace(t, '([0-9]{{1,2}}([.][0-9]{{1,2}})? ?)%( ?(to|-|–|—) ?[0-9]{{1,2}}([.][0-9]{{1,2}})? ?)%', '\\1٪\\3٪', 'gi') AS t FROM c),
p AS (SELECT page_id, string_split(regexp_replace(t, '\\b((0|0[.][0-9]{{1,2}}|[1-9][0-9]?([.][0-9]{{1,2}})?) ?%)', chr(1) || '\\1', 'g'), chr(1)) AS p FROM r),
w AS (SELECT page_id, CAST(regexp_extract(p[i + 1], '^[0-9.]+') AS DOUBLE) AS rate, right(array_to_string(p[:i], ''), 70) || left(array_to_string(p[i + 1:], ''), 70) AS words FROM p, LATERAL (SELECT unnest(range(1, len(p))) AS i)),
g AS (SELECT page_id, min(rate) AS rate FROM w WHERE rate <= 30 AND regexp_matches(words, 'financ|apr|annual\\s+percentage\\s+rate|o[.]?a[.]?c', 'i')
  AND NOT regexp_matches(words, 'lease|leasing|cash\\s*back|line\\s+of\\s+credit|credit\\s+card|deposit|down\\s*payment|trade|insurance|gst|tax', 'i') GROUP BY page_id)
SELECT page_id, rate FROM pages LEFT JOIN g USING (page_id)""",
    "trade_widgets": f"""WITH m AS (SELECT page_id, lower({MARKED}) AS t FROM pages), v AS (SELECT page_id, CASE WHEN regexp_matches(t, 'accu-?trade') THEN 1 WHEN regexp_matches(t, 'trade-?pending|snap.?offer') THEN 2
    WHEN t LIKE '%instant cash offer%' OR regexp_matches(t, 'kelley blue book[^.]{{0,40}}trade') THEN 3 WHEN regexp_matches(t, 'canadian ?black ?book[^.]{{0,40}}(trade|value)') THEN 4
    WHEN regexp_matches(t, 'value your trade|trade-?in value|what''?s my (car|vehicle|trade) worth|appraise my (car|vehicle|trade)') THEN 5 END AS v FROM m)
SELECT page_id, v IS NOT NULL AS detected, CASE v WHEN 1 THEN 'AccuTrade' WHEN 2 THEN 'TradePending' WHEN 3 THEN 'Kelley Blue Book Instant Cash Offer' WHEN 4 THEN 'Canadian Black Book' END AS vendor FROM v""",
}
