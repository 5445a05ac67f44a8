"""Sentences of generated texts that raise what is settled already."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

#: White space as browsers count it; Java's own class leaves out the no-break space.
BLANK = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
# What the two topics are called, the words that make a sentence an open question when they follow or precede the topic,
# how far off, and the sentences that state the answer.
REBATE, REBATE_AFTER, REBATE_BEFORE = "rebate|eligib|izev|evap", "confirm|verif|check|ask|worth|should be treated|may qualify|might qualify", "confirm|verif|check|ask|worth"
RECALL, RECALL_WORDS = "recall", "confirm|verif|check with|ask the dealer"
REACH = 160
REBATE_YES = "This vehicle's rebate eligibility is confirmed in the EV / PHEV rebate section above."
REBATE_NO = "This vehicle is not rebate-eligible - see the EV / PHEV rebate section above. There is nothing to confirm with the dealer."
RECALLS_OPEN = ("Recalls were checked against Transport Canada - ", " open. See the recall section above.")


@dataclass(frozen=True)
class Topic:
    """A question with an answer: when it is settled, what a sentence that reopens it looks like, and the sentence for the answer."""

    name: str
    settled: Column
    pattern: str
    verdict: Column


def near(subject: str, after: str, before: str, reach: int = REACH) -> str:
    """A pattern for a subject with one of the words after it or before it in the same sentence."""
    gap = rf"[^.]{{0,{reach}}}?"
    return rf"(?i)({subject}){gap}\b({after})\b|\b({before})\b{gap}({subject})"


def rebate_topic(eligible: Column, reason: Column) -> Topic:
    yes = F.coalesce(eligible, F.lit(False))
    settled = yes | F.coalesce(reason != "", F.lit(False))
    return Topic("rebate", settled, near(REBATE, REBATE_AFTER, REBATE_BEFORE), F.when(yes, REBATE_YES).otherwise(REBATE_NO))


def recall_topic(checked: Column, confirmed: Column, count: Column) -> Topic:
    """Settled once the check ran, unless its result is expressly unconfirmed."""
    settled = F.coalesce(checked, F.lit(False)) & F.coalesce(confirmed, F.lit(True))
    said = F.concat(F.lit(RECALLS_OPEN[0]), F.coalesce(count, F.lit(0)).cast("string"), F.lit(RECALLS_OPEN[1]))
    return Topic("recalls", settled, near(RECALL, RECALL_WORDS, RECALL_WORDS), said)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, rf"(?<=[.!?]){BLANK}+"), lambda s: s != "")


def without_settled(summary: Column, topics: Sequence[Topic]) -> Column:
    """struct(text, removed): the sentences that reopen no settled topic, then one verdict for each topic that was reopened, in order;
    removed are (topic, sentence). A sentence goes for the first topic that it reopens. Without a settled topic or a text nothing changes."""
    text = F.coalesce(summary, F.lit(""))

    def topic_of(sentence: Column) -> Column:
        found = F.lit(None).cast("string")
        for t in reversed(topics):
            found = F.when(t.settled & sentence.rlike(t.pattern), t.name).otherwise(found)
        return found

    def verdict_of(name: Column) -> Column:
        said = F.lit(None).cast("string")
        for t in topics:
            said = F.when(name == t.name, t.verdict).otherwise(said)
        return said

    judged = F.transform(sentences(text), lambda s: F.struct(topic_of(s).alias("topic"), s.alias("sentence")))
    strip = lambda c: F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")
    removed = F.transform(F.filter(judged, lambda j: j["topic"].isNotNull()), lambda j: F.struct(j["topic"].alias("topic"), strip(j["sentence"]).alias("sentence")))
    kept = F.transform(F.filter(judged, lambda j: j["topic"].isNull()), lambda j: j["sentence"])
    said = F.transform(F.array_distinct(F.transform(removed, lambda r: r["topic"])), verdict_of)
    whole = strip(F.regexp_replace(F.array_join(F.concat(kept, said), " "), rf"{BLANK}+", " "))
    any_settled = F.lit(False)
    for t in topics:
        any_settled = any_settled | t.settled
    return F.struct(F.when(any_settled & (text != ""), whole).otherwise(text).alias("text"), removed.alias("removed"))
