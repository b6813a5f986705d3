"""Ticket triage as Column expressions: rules, fallbacks, routes and badges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ANSWERED_TOPICS, CLASSIFICATION, FALLBACK
from .text import or_default

#: Keywords by topic, first match wins, with the sentiment and
#: priority that the topic sets (None: the default stays).
RULES = [
    ("Login Issue", ["login", "password", "access"], None, "High"),
    ("Feature Request", ["feature", "request", "suggest"], "Positive", "Low"),
    ("Data Export", ["export", "download", "data"], None, None),
    ("Billing Question", ["bill", "payment", "price"], None, None),
    ("Performance Issue", ["slow", "performance", "lag"], "Negative", "High"),
    ("Integration Help", ["api", "integration", "connect"], None, None),
    ("Account Setup", ["setup", "account", "new"], "Positive", None),
    ("Data Security", ["security", "privacy", "safe"], None, "High"),
]
GOOD_WORDS = ["great", "love", "awesome", "thank"]
BAD_WORDS = ["issue", "problem", "error", "wrong"]
DEFAULT = ("General Inquiry", "Neutral", "Medium")

#: Own short replies by rule topic; callers may pass others.
REPLIES = {
    "Login Issue": "Please clear the browser cache, check the address you sign in with, and reset your password if that does not help.",
    "Feature Request": "Thank you for the idea. It has been passed to the product team for review.",
    "Data Export": "Open the export settings, choose data types and a format, and start the export. You will be told when it is ready.",
    "Billing Question": "Your plan, charges and payment methods are listed in the billing settings.",
    "Performance Issue": "We are sorry for the slow responses. Please reload, try another network, and simplify the query meanwhile.",
    "Integration Help": "Create an access key in the developer settings and follow the integration guide for your tool.",
    "Account Setup": "Welcome. Invite your team, connect a first source, and set up your standards next.",
    "Data Security": "Data is encrypted at rest and in transit, and access is controlled by roles.",
    "General Inquiry": "Thank you for reaching out. Please tell us a little more about what you need.",
}


def _any(low: Column, keys: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in keys])


def classify_rules(text: Column) -> Column:
    """struct<topic, sentiment, priority> by keywords; null text counts as empty."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def chain(pick, default):
        out = None
        for rule in RULES:
            value = F.lit(pick(rule) or default)
            out = F.when(_any(low, rule[1]), value) if out is None else out.when(_any(low, rule[1]), value)
        return out.otherwise(F.lit(default))

    sentiment = F.when(_any(low, GOOD_WORDS), F.lit("Positive")).when(_any(low, BAD_WORDS), F.lit("Negative")).otherwise(chain(lambda r: r[2], DEFAULT[1]))
    return F.struct(chain(lambda r: r[0], DEFAULT[0]).alias("topic"), sentiment.alias("sentiment"), chain(lambda r: r[3], DEFAULT[2]).alias("priority"))


#: The sentence around topic and sentiment.
DETAILS = (
    "Query analyzed using natural language processing. Classified as ", " with ",
    " sentiment. Priority determined based on urgency indicators and topic classification.",
)


def describe(c: Column) -> Column:
    """The sentence that tells a classification."""
    return F.concat(F.lit(DETAILS[0]), F.lower(c["topic"]), F.lit(DETAILS[1]), F.lower(c["sentiment"]), F.lit(DETAILS[2]))


def demo_confidence(seed: int) -> Column:
    """A made-up confidence of 85 to 99 per cent, fixed by the seed and the rows'
    places."""
    return (F.floor(F.rand(seed) * 15) + 85).cast("int")


def demo_duration(seed: int) -> Column:
    """A made-up processing time of 200 to 699 milliseconds."""
    return (F.floor(F.rand(seed) * 500) + 200).cast("int")


def reply(topic: Column, replies: dict[str, str] | None = None) -> Column:
    table = replies or REPLIES
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, topic), F.lit(table[DEFAULT[0]]))


def parse_classification(answer: Column) -> Column:
    """A model's JSON answer; anything that isn't JSON gives the fallback."""
    bad = F.try_parse_json(answer).isNull()
    fallback = F.struct(*[F.lit(v).alias(k) for k, v in FALLBACK.items()])
    return F.when(bad, fallback).otherwise(F.from_json(answer, CLASSIFICATION))


def urgent(priority: Column, prefix: bool = False) -> Column:
    """Exactly ``P0``; with ``prefix`` also forms such as ``P0 (High)``."""
    return F.coalesce(priority.rlike(r"^P0\b") if prefix else priority == "P0", F.lit(False))


#: The answers of the ways that need no retrieval.
ESCALATED = "⚠️ This ticket has been marked HIGH PRIORITY (P0). Redirecting to a human support agent immediately."
UNCLEAR = "❌ Sorry, I couldn’t understand your request. Please refine your question."


ROUTED = ("This ticket has been classified as '", "' and routed to the appropriate team.")


def route(topic: Column, priority: Column, prefix: bool = False, clarify: bool = False) -> Column:
    """escalate, team or rag; with ``clarify`` an unknown topic is asked back."""
    first = F.when(urgent(priority, prefix), F.lit("escalate"))
    if clarify:
        first = first.when(F.lower(topic) == "unknown", F.lit("clarify"))
    return first.when(F.coalesce(topic.isin(ANSWERED_TOPICS), F.lit(False)), F.lit("rag")).otherwise(F.lit("team"))


def routed_answer(way: Column, topic: Column) -> Column:
    """The answer of every way but ``rag``, whose answer is null here."""
    team = F.concat(F.lit(ROUTED[0]), topic, F.lit(ROUTED[1]))
    return F.when(way == "escalate", F.lit(ESCALATED)).when(way == "clarify", F.lit(UNCLEAR)).when(way == "team", team)


def _bucket(x: Column, table: dict[str, str], default: str) -> Column:
    lookup = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(F.try_element_at(lookup, x), F.lit(default))


# Colour buckets.
def table_priority_colour(p: Column) -> Column:
    return _bucket(F.lower(p), {"p0": "red", "high": "red", "p1": "yellow", "medium": "yellow", "p2": "green", "p3": "green", "low": "green"}, "gray")


def table_sentiment_colour(s: Column) -> Column:
    return _bucket(F.lower(s), {"positive": "green", "negative": "red", "neutral": "gray"}, "gray")


def card_priority_colour(p: Column) -> Column:
    return _bucket(p, {"P0": "red", "P1": "orange", "P2": "yellow"}, "green")


def card_sentiment_colour(s: Column) -> Column:
    return _bucket(s, {"Positive": "green", "Negative": "red"}, "gray")


def log_level_colour(level: Column) -> Column:
    return _bucket(level, {"ERROR": "red", "WARN": "yellow", "INFO": "green"}, "gray")


def log_type_colour(kind: Column) -> Column:
    return _bucket(kind, {"user": "blue", "system": "cyan", "api": "green", "error": "red", "escalation": "orange", "response": "purple"}, "gray")


def attachment_mark(status: Column) -> Column:
    return _bucket(status, {"uploading": "spinner", "success": "green", "error": "red"}, "gray")


def attachment_icon(kind: Column) -> Column:
    return F.when(F.startswith(kind, F.lit("image/")), F.lit("image")).otherwise(F.lit("file"))


def card_defaults(topic: Column, sentiment: Column, priority: Column) -> list[Column]:
    return [or_default(topic, "Unknown").alias("topic"), or_default(sentiment, "Neutral").alias("sentiment"), or_default(priority, "P3").alias("priority")]
