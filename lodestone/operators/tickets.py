"""The ticket table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import or_default
from ..functions.triage import reply
from .corpus import number


def ticket_number(n: Column, year: Column) -> Column:
    """TKT-year-n with at least three digits; more are kept."""
    return F.format_string("TKT-%d-%03d", year.cast("int"), n.cast("long"))


def create(requests: DataFrame, created: str = "created_at", *order: str) -> DataFrame:
    """``requests``: (id, query, topic, sentiment, priority, answer, sources, a
    timestamp).  Tickets numbered from 1 in the given order, with the defaults
    for empty fields; every ticket starts as Resolved."""
    rows = number(requests, *(order or (created, "id")), name="__n")
    return rows.select(
        "id", ticket_number(F.col("__n") + 1, F.year(created)).alias("ticket_number"), "query",
        or_default(F.col("topic"), "General Inquiry").alias("topic"), or_default(F.col("sentiment"), "Neutral").alias("sentiment"),
        or_default(F.col("priority"), "P3").alias("priority"), or_default(F.col("answer"), "No response generated").alias("response"),
        F.to_json(F.struct("query", "answer", F.struct("topic", "sentiment", "priority").alias("analysis"), "sources")).alias("full_response"),
        F.col(created).cast("timestamp").alias("created_at"), F.lit("Resolved").alias("status"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
    )


def by_id(tickets: DataFrame, key) -> DataFrame:
    return tickets.where(F.col("id") == key).limit(1)


def by_status(tickets: DataFrame, status: str) -> DataFrame:
    return tickets.where(F.col("status") == status)


def by_priority(tickets: DataFrame, priority: str) -> DataFrame:
    return tickets.where(F.col("priority") == priority)


def delete(tickets: DataFrame, keys: DataFrame | int) -> DataFrame:
    return tickets.join(keys.select("id"), "id", "left_anti") if isinstance(keys, DataFrame) else tickets.where(~F.col("id").eqNullSafe(keys))


def update(tickets: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """Rows of ``changes`` (id and any ticket columns) over those of the same id; a
    null leaves the old value.  Several changes of one id are folded field by field,
    the last in ``order`` that is not null; without an order they are an error."""
    fields = [c for c in changes.columns if c not in ("id", order)]
    if order is None:
        many = F.raise_error(F.concat(F.lit("several changes of ticket "), F.col("id").cast("string")))
        one = changes.groupBy("id").agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in fields])
        one = one.withColumn("id", F.when(F.col("__n") > 1, many.cast("long")).otherwise(F.col("id"))).drop("__n")
    else:
        one = changes.groupBy("id").agg(*[_last(F.col(c), F.col(order)).alias(c) for c in fields])
    new = {c: F.col(f"__new.{c}") for c in fields}
    joined = tickets.alias("t").join(one.alias("__new"), F.col("t.id") == F.col("__new.id"), "left")
    return joined.select(*[(F.coalesce(new[c], F.col(f"t.{c}")) if c in new else F.col(f"t.{c}")).alias(c) for c in tickets.columns])


def _last(value: Column, order: Column) -> Column:
    """The last value in order that is not null."""
    return F.max_by(value, F.when(value.isNotNull(), order))


def replay(log: DataFrame, order: str = "seq") -> DataFrame:
    """Tickets after an ordered log of (id, kind, ``order``, ticket columns).  ``add``
    makes a ticket anew; ``update`` sets the fields that are not null; ``delete`` ends
    the ticket of its id and ``clear`` all of them; changes to a ticket that is not
    there do nothing.  Of equal order values the result is any of theirs.

    Three aggregations that combine before any shuffle: the last clear, the life of
    each id after it, and each field's last value within that life.  No id's changes
    are brought together in one task, however many there are."""
    fields = [c for c in log.columns if c not in ("id", "kind", order)]
    cleared = log.where("kind = 'clear'").agg(F.max(order).alias("__cleared"))  # one row
    rows = log.where("kind <> 'clear'").join(F.broadcast(cleared)).where(F.col("__cleared").isNull() | (F.col(order) > F.col("__cleared"))).drop("__cleared")

    def last(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(order)))

    lives = rows.groupBy("id").agg(last("add").alias("__born"), last("delete").alias("__dead")).where("__born IS NOT NULL AND (__dead IS NULL OR __dead < __born)")
    changed = rows.where("kind IN ('add', 'update')").join(lives.select("id", "__born"), "id").where(F.col(order) >= F.col("__born"))
    return changed.groupBy("id").agg(*[_last(F.col(c), F.col(order)).alias(c) for c in fields])


def clear(tickets: DataFrame) -> DataFrame:
    """No tickets, in the same columns; numbers start from 1 again."""
    return tickets.where(F.lit(False))


#: Topic, sentiment and priority of the demo tickets, in order.
DEMO = [
    ("Login Issue", "Negative", "High"), ("Feature Request", "Positive", "Low"), ("Data Export", "Neutral", "Medium"), ("Billing Question", "Neutral", "Medium"),
    ("Performance Issue", "Negative", "High"), ("Integration Help", "Neutral", "Medium"), ("Account Setup", "Positive", "Low"), ("Data Security", "Neutral", "High"),
]


def demo(spark, year: int = 2024) -> DataFrame:
    """The demo tickets; their responses are this project's canned replies."""
    rows = spark.createDataFrame([(i, *row) for i, row in enumerate(DEMO, 1)], "id long, topic string, sentiment string, priority string")
    return rows.select("id", ticket_number(F.col("id"), F.lit(year)).alias("ticket_number"), "topic", "sentiment", "priority", reply(F.col("topic")).alias("response"))


def newest_first(tickets: DataFrame) -> DataFrame:
    """With the display number: 1 for the newest."""
    total = tickets.count()
    rows = number(tickets, "created_at", "id", name="__n")
    return rows.withColumn("serial", (F.lit(total) - F.col("__n")).cast("long")).drop("__n")


def stats(tickets: DataFrame) -> DataFrame:
    """(dimension, value, n): the total and the counts by status, priority and
    sentiment, from one pass of grouping sets."""
    rows = tickets.groupingSets([["status"], ["priority"], ["sentiment"], []], "status", "priority", "sentiment").agg(
        F.count("*").alias("n"), F.grouping("status").alias("gs"), F.grouping("priority").alias("gp"), F.grouping("sentiment").alias("gm")
    )
    dim = F.when(F.col("gs") == 0, "status").when(F.col("gp") == 0, "priority").when(F.col("gm") == 0, "sentiment").otherwise("total")
    value = F.when(F.col("gs") == 0, F.col("status")).when(F.col("gp") == 0, F.col("priority")).when(F.col("gm") == 0, F.col("sentiment"))
    return rows.select(dim.alias("dimension"), value.alias("value"), "n")


def last_n(rows: DataFrame, n: int, *order: Column, partition: list[str] | None = None) -> DataFrame:
    """The last n rows, overall or of each partition, in the order given (newest
    first): a top-n, never a sort of everything in one task."""
    if not partition:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("__r") <= n).drop("__r")
