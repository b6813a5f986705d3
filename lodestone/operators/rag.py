"""Context, prompt and answers from retrieved rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Own instructions; callers may pass others.
SYSTEM = "You are a support assistant. Use only the context provided. Always cite sources. If the context does not hold the answer, say so."
#: The answers without an index and without a hit.
NOT_AVAILABLE = "Sorry, the knowledge base is not available. Please try again later."
NOT_FOUND = "I couldn't find relevant information in the knowledge base to answer your question."
FAILED = "Sorry, I encountered an error while processing your question: "


def context(hits: DataFrame, query_col: str = "query_id") -> DataFrame:
    """(query, context, sources): the retrieved texts with their sources in rank
    order, and the distinct sources sorted.  A query has at most k hits, so its
    list is bounded."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text", "source"))), lambda h: F.concat(h["text"], F.lit("\n[source: "), h["source"], F.lit("]")))
    return hits.groupBy(query_col).agg(F.array_join(parts, "\n\n").alias("context"), F.array_sort(F.collect_set("source")).alias("sources"))


def user_prompt(context: Column, query: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), query)


def messages(context: Column, query: Column, system: str = SYSTEM) -> Column:
    """array<struct<role, content>> for a chat model."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user_prompt(context, query).alias("content"))
    )


def extractive(context: Column, sources: Column) -> Column:
    """The default generator: the context's head and its sources."""
    return F.concat(F.substring(context, 1, 300), F.lit("\n\nSources: "), F.array_join(sources, ", "))


def guarded(generate: Callable[[str, list[str]], str]) -> Callable[[Column, Column], Column]:
    """A generator made of a Python function (a model client, say) of context and
    sources.  Where it raises, the row's answer is the fixed error text, and
    ``answer`` gives it no sources; the job goes on."""

    @F.pandas_udf("string")
    def run(context: pd.Series, sources: pd.Series) -> pd.Series:
        out = []
        for c, s in zip(context, sources):
            try:
                out.append(None if c is None else generate(c, list(s)))
            except Exception as e:  # noqa: BLE001  the message is the answer
                out.append(f"{FAILED}{e}")
        return pd.Series(out)

    return run


def answer(queries: DataFrame, contexts: DataFrame | None, generate: Callable[[Column, Column], Column] = extractive, query_col: str = "query_id") -> DataFrame:
    """``queries`` with answer and sources: from the index's context, or the two
    fixed answers for no index and for no hit.  A failed generation has no sources."""
    none = F.array().cast("array<string>")
    if contexts is None:
        return queries.withColumn("answer", F.lit(NOT_AVAILABLE)).withColumn("sources", none)
    out = queries.join(contexts, query_col, "left")
    made = F.when(F.col("context").isNull(), F.lit(NOT_FOUND)).otherwise(generate(F.col("context"), F.col("sources")))
    out = out.withColumn("answer", made)
    given = F.when(F.startswith("answer", F.lit(FAILED)), none).otherwise(F.coalesce("sources", none))
    return out.withColumn("sources", given).drop("context")
