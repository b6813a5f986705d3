"""The bounded log and the events of one processed query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview
from .tickets import last_n

#: The log keeps the last 50 before each new event, so 51 with it.
KEPT = 51


def tail(logs: DataFrame, time_col: str = "ts", id_col: str = "id", keep: int = KEPT) -> DataFrame:
    return last_n(logs, keep, F.desc(time_col), F.desc(id_col))


def of_type(logs: DataFrame, kind: str) -> DataFrame:
    return logs if kind == "all" else logs.where(F.col("type") == kind)


def query_events() -> Column:
    """The events that processing one query leaves, in order, from the columns
    query, topic, sentiment, priority, answer and ticket_number; blank queries
    leave none."""
    def event(message: Column, level: str, kind: str) -> Column:
        return F.struct(message.alias("message"), F.lit(level).alias("level"), F.lit(kind).alias("type"))

    named = F.to_json(F.struct("topic", "sentiment", "priority"))
    urgent = F.coalesce(F.col("priority") == "P0", F.lit(False))
    # fixed values: the messages
    every = F.array(
        event(F.concat(F.lit('Processing query: "'), F.col("query"), F.lit('"')), "INFO", "user"),
        event(F.lit("Starting ticket classification..."), "INFO", "system"),
        event(F.concat(F.lit("Classification completed: "), named), "INFO", "system"),
        event(F.lit("Generating RAG response..."), "INFO", "system"),
        event(F.lit("RAG response generated successfully"), "INFO", "system"),
        event(F.concat(F.lit("Response: "), preview(F.col("answer"))), "INFO", "response"),
        F.when(urgent, event(F.lit("HIGH PRIORITY ticket detected - escalating to human agent"), "WARN", "escalation")),
        event(F.concat(F.lit("Ticket created: "), F.col("ticket_number")), "INFO", "system"),
    )
    return F.when(F.length(F.trim("query")) > 0, F.filter(every, lambda e: e.isNotNull()))


def emit(processed: DataFrame, key: str = "id") -> DataFrame:
    """(key, step, message, level, type) of every processed query."""
    return processed.select(key, F.posexplode(query_events()).alias("step", "e")).select(key, F.col("step").cast("long").alias("step"), "e.message", "e.level", "e.type")
