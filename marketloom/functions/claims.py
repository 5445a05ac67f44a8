"""What may be claimed about a listing, as Column expressions: price against list price, document fee, rate, trade-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketloom.functions.columns import half_up, let
from marketloom.functions.texts import BLANK

# Names of a document fee, and what each province or state allows: all-in prices, a cap, or a norm.
DOC_FEE = r"\b(documentation|doc(\s|-)?fee|admin(istration)?|dealer fee)\b"
BENCHMARKS = {"AB": ("allin", None), "ON": ("allin", None), "BC": ("allin", None), "QC": ("allin", None), "TX": ("cap", 225), "FL": ("norm", 999)}
REGION_NAMES = {"alberta": "AB", "ontario": "ON", "british columbia": "BC", "quebec": "QC", "québec": "QC", "texas": "TX", "florida": "FL"}
# Words that tie a rate to financing, and words that tie it to something else.
FINANCE_WORDS = r"(?i)(financ\w*|purchase\s+financ\w*|apr|annual\s+percentage\s+rate|o\.?a\.?c\.?)"
OTHER_RATE_WORDS = r"(?i)(lease|leasing|cash\s*back|line\s+of\s+credit|credit\s+card|deposit|down\s*payment|trade|insurance|gst|tax)"
# Marks of trade-in widgets with their vendor, the first that is found; the last names none.
TRADE_WIDGETS = [
    (r"accu-?trade", "AccuTrade"),
    (r"trade-?pending|snap.?offer", "TradePending"),
    (r"instant cash offer|kelley blue book[^.]{0,40}trade", "Kelley Blue Book Instant Cash Offer"),
    (r"canadian ?black ?book[^.]{0,40}(trade|value)", "Canadian Black Book"),
    (r"value your trade|trade-?in value|what'?s my (car|vehicle|trade) worth|appraise my (car|vehicle|trade)", None),
]

# How a rate is written, how a range of rates is, and what of a page is no text.
RATE = r"(?:0|0\.\d{1,2}|[1-9]\d?(?:\.\d{1,2})?)"
RANGE = r"(\d{1,2}(?:\.\d{1,2})?\s*)%(\s*(?:to|-|–|—)\s*\d{1,2}(?:\.\d{1,2})?\s*)%"
NO_TEXT = (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"<[^>]*>", "&nbsp;", rf"{BLANK}+")
#: A rate with up to 70 characters before it (group 1 near the start of the text, else 2) and after its start (group 3).
RATE_SEEN = rf"(?s)\b(?={RATE}\s*%)(?:(?<=^(.{{0,69}}))|(?<=(.{{70}})))(?=(.{{0,70}}))({RATE})\s*%"

# What makes a price depend on financing, each with its reason, and how long a text inside a script is prose.
CONTINGENT = [
    (r"in\s+lieu\s+of\s+(?:special\s+)?financ\w*", "in lieu of special financing"),
    (r"(?:\$[\d,]{3,}|includes?|price|savings|discount|\boff\b)[^.]{0,60}\bfinance\s+(?:assist|cash|bonus|incentive|discount)\b", "finance-gated discount"),
    (r"\bfinance\s+(?:assist|cash|bonus|incentive|discount)\b[^.]{0,60}(?:\$[\d,]{3,}|\bincluded\b|\boff\b|discount)", "finance-gated discount"),
    (r"(?:when|if|once)\s+financ\w+\s+(?:with|through)\s+(?:us|the\s+dealer|dealer)", "conditional on financing with the dealer"),
    (r"(?:price|discount|savings|offer)[^.]{0,70}must\s+financ\w+\s+(?:with|through)", "financing required"),
    (r"must\s+financ\w+\s+(?:with|through)[^.]{0,70}to\s+(?:get|receive|qualify\s+for)[^.]{0,20}(?:price|discount|savings)", "financing required"),
    (r"(?:price|discount|offer)\s+(?:is\s+)?(?:only\s+)?(?:available|valid)\s+(?:with|when)\s+[^.]{0,40}financ", "price only with financing"),
    (r"financ\w+\s+(?:with|through)\s+(?:us|dealer)[^.]{0,30}(?:required|to\s+(?:qualify|receive|get))", "financing required to qualify"),
    (r"\bnon-?finance[d]?\s+price\b", "separate non-financed price"),
    (r"\bcash\s+price\b[^.]{0,60}\bfinanc", "cash price differs from financed price"),
    (r"(?:credit\s+)?approval\s+required[^.]{0,40}(?:advertised\s+)?pric(?:e|ing)", "advertised price conditional on credit approval"),
]
#: A cheap part of each of these that any text with the whole has too.
CONTINGENT_NEEDS = [
    r"in\s+lieu", r"\bfinance\s+(?:assist|cash|bonus|incentive|discount)", r"\bfinance\s+(?:assist|cash|bonus|incentive|discount)", r"(?:when|if|once)\s+financ", r"must\s+financ", r"must\s+financ",
    r"(?:available|valid)\s+(?:with|when)", r"financ\w+\s+(?:with|through)", r"\bnon-?finance", r"\bcash\s+price", r"approval\s+required",
]
#: Characters that a dot leaves out.
LINE_ENDS = "\n\r\u0085\u2028\u2029"
SCRIPT, SCRIPT_TEXT, PROSE_WORDS = r"(?is)<script\b[^>]*>.*?</script>", r'"(?:[^"\\]|\\.){12,400}"', 4


def ceiling_claim(asking: Column, ceiling: Column, trims: Column, all_in_price: Column) -> Column:
    """struct(exceeds, over): is an all-in price above the dearest of two or more trims?"""
    exceeds = F.coalesce(all_in_price & (ceiling > 0) & (asking > ceiling) & (trims >= 2), F.lit(False))
    return F.struct(exceeds.alias("exceeds"), F.when(exceeds, asking - ceiling).alias("over"))


def msrp_claim(msrp: Column, all_in: Column, basis: Column, asking: Column, all_in_price: Column, region_unknown: Column, verified: Column, ceiling: Column) -> Column:
    """struct(comparable, delta, over, against, reference, refusal): the one gate before a price is held against a list price.

    Only an exact list price is compared, an all-in price only with an all-in figure. refusal names why there is no claim, null
    where there is nothing to claim from; ceiling is a ceiling_claim. An unset `verified` counts as given by the asking price.
    """
    known = lambda c: F.coalesce(c > 0, F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    full = yes(all_in_price) & known(all_in)
    reference = F.when(known(msrp), F.when(full, all_in).otherwise(msrp))
    state = (
        F.when(~known(msrp), "nothing")
        .when((basis == "starting_at") & ceiling["exceeds"], "above_ceiling")
        .when(basis.isin("starting_at", "original_when_new", "dealer_stated"), basis)
        .when(basis.isNull() | (basis != "exact"), "trim_unconfirmed")
        .when(~known(asking), "nothing")
        .when(~F.coalesce(verified, F.lit(True)), "price_unverified")
        .when(yes(region_unknown) & ~known(all_in), "region_unknown")
        .when(yes(all_in_price) & ~known(all_in), "all_in_against_ex_freight")
        .otherwise("compared")
    )
    compared = state == "compared"
    return F.struct(
        compared.alias("comparable"),
        F.when(compared, asking - reference).alias("delta"),
        (compared & (asking > reference)).alias("over"),
        F.when(known(msrp), F.when(full, "all_in").otherwise("ex_freight")).alias("against"),
        reference.alias("reference"),
        F.when(~state.isin("compared", "nothing"), state).alias("refusal"),
    )


def region_code(place: Column) -> Column:
    """Two-letter code at the end of "City, XX" or "City, Province", null where none is known."""
    text = F.regexp_replace(place, r"^\s+|\s+$", "")
    tail = F.coalesce(F.nullif(F.regexp_extract(text, r",\s*([A-Za-z][A-Za-z .]+?)\s*$", 1), F.lit("")), text)
    names = F.create_map(*[F.lit(x) for pair in REGION_NAMES.items() for x in pair])
    return F.when(tail.rlike("^[A-Za-z]{2}$"), F.upper(tail)).otherwise(names[F.lower(tail)])


def doc_fee_claim(fee: Column, place: Column) -> Column:
    """struct(region, kind, benchmark, over_by), null without a fee or a benchmark: is a fee above what its region allows?"""
    code = region_code(place)
    lookup = lambda i: F.create_map(*[x for k, v in BENCHMARKS.items() for x in (F.lit(k), F.lit(v[i]).cast("string" if i == 0 else "int"))])[code]
    rule, limit = lookup(0), lookup(1)
    kind = F.when(rule == "allin", "allin").when((rule == "cap") & (fee > limit), "over_cap").when(rule == "cap", "within_cap").when(fee >= limit, "over_norm")
    over = F.when(kind == "within_cap", F.lit(0)).when(rule != "allin", half_up(fee - limit)).cast("long")
    return F.when((fee > 0) & kind.isNotNull(), F.struct(code.alias("region"), kind.alias("kind"), limit.alias("benchmark"), over.alias("over_by")))


def doc_fees(lines: DataFrame, quote_id: str, name: str, price: str) -> DataFrame:
    """(quote_id, doc_fee): the dearest line of a quote that is called a document fee; quotes without one have no row."""
    found = lines.where(F.lower(name).rlike(DOC_FEE) & (F.col(price) > 0))
    return found.groupBy(quote_id).agg(F.max(price).alias("doc_fee"))


def advertised_rate(page: Column) -> Column:
    """The lowest rate of at most 30 % that a page ties to financing; null without one. Both ends of a range are left out: ranges are found
    from the start of the text on, so of three rates in a row the third stands alone."""
    text = page
    for pattern in NO_TEXT:
        text = F.regexp_replace(text, pattern, " ")
    # another sign for the per cent of a range: no text moves, and no rate is seen there
    return let(F.regexp_replace(text, f"(?i){RANGE}", "$1\u066a$2\u066a"), _lowest_rate)


def _lowest_rate(text: Column) -> Column:
    group = lambda i: F.regexp_extract_all(text, F.lit(RATE_SEEN), F.lit(i))
    around = F.zip_with(F.zip_with(group(1), group(2), lambda near, far: F.concat(near, far)), group(3), lambda before, after: F.concat(before, after))
    seen = F.zip_with(group(4), around, lambda n, w: F.struct(n.cast("double").alias("rate"), w.alias("words")))
    told = lambda s: (s["rate"] <= 30) & s["words"].rlike(FINANCE_WORDS) & ~s["words"].rlike(OTHER_RATE_WORDS)
    return F.array_min(F.transform(F.filter(seen, told), lambda s: s["rate"]))


def script_prose(page: Column) -> Column:
    """The texts of four words or more inside a page's scripts, where disclaimers hide; names and numbers are no text."""
    strings = F.flatten(F.transform(F.regexp_extract_all(page, F.lit(SCRIPT), F.lit(0)), lambda b: F.regexp_extract_all(b, F.lit(SCRIPT_TEXT), F.lit(0))))

    def plain(raw: Column) -> Column:
        v = F.substring(raw, F.lit(2), F.length(raw) - 2)
        for pattern, by in ((r"\\[nrt]", " "), (r"(?i)\\u003c", "<"), (r"(?i)\\u003e", ">"), (r"\\(.)", "$1"), (r"<[^>]*>", " "), (rf"{BLANK}+", " ")):
            v = F.regexp_replace(v, pattern, by)
        return F.trim(v)

    worded = lambda v: F.size(F.filter(F.split(v, " "), lambda w: w.rlike("[A-Za-z]{2,}"))) >= PROSE_WORDS
    return F.array_join(F.filter(F.transform(strings, plain), worded), " . ")


def finance_contingent(page: Column) -> Column:
    """struct(reasons, evidence), null where no price hangs on financing: the reasons in their order, each once, and the words around the
    first one's first place. A rate that needs the maker's lender is no such price."""
    text = page
    for pattern in NO_TEXT[:-1]:
        text = F.regexp_replace(text, pattern, " ")
    hidden = F.when(F.contains(page, F.lit("<script")), F.concat(F.lit(" . "), script_prose(page))).otherwise("")
    return let(F.regexp_replace(F.concat(text, hidden), NO_TEXT[-1], " "), _contingent)


def _contingent(text: Column) -> Column:
    hits = F.array(*[F.when(text.rlike(f"(?i){need}") & text.rlike(f"(?i){p}"), F.struct(F.lit(reason).alias("reason"), F.lit(i).alias("at"))) for i, ((p, reason), need) in enumerate(zip(CONTINGENT, CONTINGENT_NEEDS))])

    def around(p: str) -> Column:
        # the first place is looked for once; 60 characters before it are taken of what lies before, not tried at each place
        before = F.right(F.regexp_extract(text, f"(?is)^(.*?)(?:{p})", 1), F.lit(60))
        return F.concat(F.regexp_replace(before, f"(?s)^.*[{LINE_ENDS}]", ""), F.regexp_extract(text, f"(?is)^.*?((?:{p})(?-s:.{{0,60}}))", 1))

    def evidence(first: Column) -> Column:
        found = F.when(first == 0, around(CONTINGENT[0][0]))
        for i, (p, _) in enumerate(CONTINGENT[1:], 1):
            found = found.when(first == i, around(p))
        return F.substring(F.trim(found), 1, 200)

    def told(found: Column) -> Column:
        reasons = F.array_distinct(F.transform(found, lambda h: h["reason"]))
        return F.when(F.size(found) > 0, F.struct(reasons.alias("reasons"), evidence(F.get(found, 0)["at"]).alias("evidence")))

    return let(F.array_compact(hits), told)


def trade_widget(page: Column) -> Column:
    """struct(vendor), null where no trade-in widget is marked; vendor is null where the marks name none."""
    found = None
    for pattern, vendor in TRADE_WIDGETS:
        hit, value = page.rlike(f"(?i){pattern}"), F.struct(F.lit(vendor).cast("string").alias("vendor"))
        found = F.when(hit, value) if found is None else found.when(hit, value)
    return found
