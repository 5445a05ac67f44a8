"""Inventories read out of whole pages; scripts and cards are added to the pages of the test tables, which have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketloom.plans.changes import DIGITS
from marketloom.functions import columns as C
from marketloom.session import table
from marketloom.sources import pages_feeds

#: A unit of page K: every string with a stray bracket and an escaped quote before it, numbers partly quoted.
UNIT = (
    """concat('"', {k}, '":{{"note":"a stray }}; and {{ ', chr(92), '"{{","vin":"1M8GDM9A', {check}, 'K', lpad({k}, 7, '0'), '","stockNum":"S', {k}, '","year":"20', {y},"""
    """ '","make":"Ford","model":"Bronco","trim":"', {trim}, '","OriginalPrice":', {price}, ',"mileage":"', {k}, ' km","condition":"', {cond}, '","demo":"', {demo}, '"}}')"""
)


def _unit(k: str) -> str:
    """The same text in Spark's and in the twin's SQL."""
    text = lambda x: f"CAST({x} AS VARCHAR(20))"
    return UNIT.format(
        k=text(k), check=f"CASE WHEN ({k}) % 3 = 0 THEN 'X' ELSE {text(f'({k}) % 10')} END", y=text(f"20 + ({k}) % 7"), trim=f"CASE WHEN ({k}) % 4 = 0 THEN '' ELSE 'Big Bend' END",
        price=text(f"({k}) % 5 * 10000 + 29"), cond=f"CASE WHEN ({k}) % 2 = 0 THEN 'Used - certified' ELSE 'New' END", demo=text(f"({k}) % 3 % 2"),
    )


def _script() -> str:
    """A list first, then the object, closed on all pages but those cut off, then a string that looks like an end."""
    units = f"concat({_unit('page_id * 3')}, ',', {_unit('page_id * 3 + 1')}, ',', {_unit('page_id * 3 + 2')})"
    end = "concat('};', chr(10), 'var after = \"};\";</script>')"
    return f"concat(html, '<script>var vehicleArray = [];', chr(10), 'vehicleArray = {{', {units}, CASE WHEN page_id % 10 = 3 THEN '' ELSE {end} END)"


def inline_inventory(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(_script()).alias("html"))
    return pages_feeds.inline_vehicles(pages)


def _card(i: int) -> str:
    k = f"(page_id + {i})"
    price = f"CASE {k} % 4 WHEN 0 THEN 'Call for price' WHEN 1 THEN concat('$', CAST(20 + {k} % 60 AS VARCHAR(9)), ',645') WHEN 2 THEN '$ 68,061</b> <s>was $74,561</s>' ELSE '' END"
    dealer = f"CASE {k} % 3 WHEN 0 THEN 'T&amp;T Honda, Calgary' WHEN 1 THEN 'Southtown Hyundai, St. Albert' ELSE 'Infiniti&nbsp;South,  Red Deer' END"
    stock = f"CASE WHEN {k} % 5 = 0 THEN '| Used' WHEN {k} % 5 = 1 THEN '' ELSE '| New' END"
    return (
        f"concat('<div><a class=\"contents\" aria-label=\"', CAST(2019 + {k} % 8 AS VARCHAR(9)), ' Kia K', CAST({k} % 9 AS VARCHAR(9)), ' LX FWD\" href=\"/v/', CAST(page_id AS VARCHAR(9)), '-{i}?ref=card\">',"
        f" '<img src=\"x.png\"><script>var p = \"Cash Price $9,999\";</script><i>', {stock}, '</i> HIGH DEMAND <h4>Cash Price</h4><u>Finance</u> <u>Lease</u> <b>', {price}, '</b> <p>', {dealer}, '</p> <button>Check Availability</button></a></div>')"
    )


CARDS = f"concat(html, {_card(0)}, {_card(1)}, {_card(2)}, '<footer>Call for price: was $99,999 | Used</footer>')"


def card_inventory(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(CARDS).alias("html"))
    return pages_feeds.card_vehicles(pages)


def _entry(k: str) -> str:
    """An entry of page and place K: two offers, one without a name, or none; the total stated, left to be summed, or unreadable."""
    text = lambda x: f"CAST({x} AS VARCHAR(20))"
    total = f"""CASE {k} % 3 WHEN 0 THEN concat('"totalAmount":"$', {text(f'{k} % 4 + 1')}, ',062.50",') WHEN 1 THEN '' ELSE '"totalAmount":"n/a",' END"""
    rebate = f"""concat('{{"name":" Federal Rebate (if eligible) ","cash_value":"', {text(f'{k} * 7 % 5000')}, '","payee":"CUSTOMER","expiryDate":"2026-08-31"}}')"""
    allowance = """'{"name":"Delivery ] Allowance","cash_value":2300,"payee":"dealer"}'"""
    offers = f"""CASE {k} % 4 WHEN 0 THEN concat({rebate}, ',', {allowance}) WHEN 1 THEN {rebate} WHEN 2 THEN '{{"name":" ","cash_value":"$9"}}' ELSE '' END"""
    return f"""concat('{{"amount":', {text(f'{k} * 100')}, ',', {total}, '"stackable_offers":[', {offers}, ']}}')"""


def _incentives() -> str:
    """A block of two entries, on every third page a second block, on every fifth one cut off."""
    block = lambda a, b: f"""concat('<script>x = {{"cash_incentives": [', {_entry(a)}, ',', {_entry(b)}, ']}};</script>')"""
    cut = """'<script>x = {"cash_incentives": [{"amount":1'"""
    return f"concat(html, {block('page_id', '(page_id + 1)')}, CASE WHEN page_id % 3 = 0 THEN {block('(page_id + 2)', '(page_id + 4)')} ELSE '' END, CASE WHEN page_id % 5 = 0 THEN {cut} ELSE '' END)"


def _with_incentives(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_incentives()).alias("html"))


def page_incentives(spark, sf_dir) -> DataFrame:
    found = pages_feeds.cash_incentives(_with_incentives(spark, sf_dir), "page_id")
    return found.select("page_id", "price_after", "total", F.size("offers").alias("offers"))


def incentive_lines(spark, sf_dir) -> DataFrame:
    return pages_feeds.incentive_lines(pages_feeds.cash_incentives(_with_incentives(spark, sf_dir), "page_id"), "page_id")


QUERIES = {f.__name__: f for f in (inline_inventory, card_inventory, page_incentives, incentive_lines)}
STRIPPED = "regexp_replace(regexp_replace(card, '<script.*?</script>', ' ', 'gs'), '<[^>]+>', ' ', 'g')"
SETS = f"""b AS (SELECT page_id, generate_subscripts(blocks, 1) AS bi, unnest(blocks) AS block FROM (SELECT page_id, regexp_extract_all({_incentives()}, '"cash_incentives": (\\[.*?\\])\\}};</script>', 1) AS blocks FROM pages)),
e AS (SELECT page_id, bi, generate_subscripts(es, 1) AS ei, unnest(es) AS e FROM (SELECT page_id, bi, json_extract(block, '$[*]') AS es FROM b)),
o AS (SELECT page_id, bi, ei, e, generate_subscripts(os, 1) AS oi, unnest(os) AS o FROM (SELECT *, json_extract(e, '$.stackable_offers[*]') AS os FROM e)),
n AS (SELECT page_id, bi, ei, oi, CAST(e->>'amount' AS DOUBLE) AS amount, e->>'totalAmount' AS stated, trim(o->>'name') AS name, CAST(nullif(o->>'cash_value', '0') AS DOUBLE) AS value, o->>'payee' AS payee, o->>'expiryDate' AS expiry
  FROM o WHERE trim(o->>'name') <> ''),
s AS (SELECT page_id, bi, ei, max(amount) AS amount, count(*) AS offers, coalesce(CAST(replace(replace(nullif(max(stated), 'n/a'), '$', ''), ',', '') AS DOUBLE), sum(value)) AS total FROM n GROUP BY ALL),
best AS (SELECT * FROM s WHERE total > 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY offers DESC, total DESC, bi, ei) = 1)"""
ORACLE = {
    "page_incentives": f"WITH {SETS} SELECT page_id, nullif(amount, 0) AS price_after, total, CAST(offers AS INT) AS offers FROM best",
    "incentive_lines": f"""WITH {SETS} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY oi) - 1 AS INT) AS place, name, -value AS price, name LIKE '%eligible%' AS conditional, upper(payee) = 'DEALER' AS to_dealer,
  CASE WHEN name LIKE '%eligible%' OR upper(payee) = 'DEALER' THEN 'watch' ELSE 'good' END AS verdict, expiry FROM best JOIN n USING (page_id, bi, ei)""",
    "inline_inventory": f"""WITH p AS (SELECT page_id, {_script()} AS html FROM pages),
o AS (SELECT page_id, unnest(json_extract(regexp_extract(html, 'vehicleArray = (\\{{.*\\}});\\nvar after', 1, 's'), '$.*')) AS v FROM p WHERE regexp_matches(html, 'vehicleArray = (\\{{.*\\}});\\nvar after', 's')),
f AS (SELECT *, v->>'vin' AS vin, translate(v->>'vin', '{C.VIN_FROM}', '{C.VIN_TO}') AS c, CAST(v->>'OriginalPrice' AS DOUBLE) AS price FROM o)
SELECT page_id, vin, v->>'stockNum' AS stock_no, CAST(v->>'year' AS INT) AS year, v->>'make' AS make, v->>'model' AS model, nullif(v->>'trim', '') AS trim, CASE WHEN v->>'condition' ILIKE '%used%' THEN 'used' ELSE 'new' END AS condition,
  CAST(replace(v->>'mileage', ' km', '') AS INT) AS km, CASE WHEN price > 0 THEN price END AS list_price, v->>'demo' = '1' AS demo
FROM f WHERE substr(vin, 9, 1) = CASE WHEN ({DIGITS}) % 11 = 10 THEN 'X' ELSE CAST(({DIGITS}) % 11 AS VARCHAR) END""",
    "card_inventory": f"""WITH c AS (SELECT page_id, generate_subscripts(cards, 1) - 1 AS place, unnest(cards) AS card
    FROM (SELECT page_id, regexp_extract_all({CARDS}, '<a class="contents" aria-label="[^"]+" href="[^"?]+.*?Check Availability', 0, 's') AS cards FROM pages)),
t AS (SELECT *, trim(regexp_replace(replace(replace({STRIPPED}, '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS text, regexp_extract(card, 'aria-label="([^"]+)"', 1) AS label FROM c)
SELECT page_id, CAST(place AS INT) AS place, CAST(label[1:4] AS INT) AS year, split_part(label, ' ', 2) AS make, regexp_extract(label, '^\\S+ \\S+ (.*)$', 1) AS model_trim,
  CASE WHEN text LIKE '%| New %' THEN 'new' WHEN text LIKE '%| Used %' THEN 'used' END AS condition, text LIKE '%Call for price%' AS withheld,
  CAST(replace(nullif(regexp_extract(text, 'Cash Price Finance Lease \\$ ?([0-9,]+)', 1), ''), ',', '') AS DOUBLE) AS list_price,
  CAST(replace(nullif(regexp_extract(text, 'was \\$([0-9,]+)', 1), ''), ',', '') AS DOUBLE) AS was_price,
  regexp_extract(text, '(T&T Honda|Southtown Hyundai|Infiniti South), (Calgary|St. Albert|Red Deer) Check', 1) AS dealer,
  regexp_extract(text, '(T&T Honda|Southtown Hyundai|Infiniti South), (Calgary|St. Albert|Red Deer) Check', 2) AS city, regexp_extract(card, 'href="([^"?]+)', 1) AS url
FROM t""",
}
