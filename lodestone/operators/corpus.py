"""One corpus of many sources: union, rendering and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def union_documents(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _filled(x: Column) -> Column:
    return x.isNotNull() & (x != "")


def render() -> Column:
    """A document as one text: title, content, sections, code blocks and source,
    parted by blank lines; empty parts are left out."""
    sections = F.transform(
        F.filter("sections", lambda s: _filled(s["text"])),
        lambda s: F.concat(F.repeat(F.lit("#"), F.coalesce(s["level"], F.lit(1))), F.lit(" "), s["text"]),
    )
    code = F.transform("code_blocks", lambda x, i: F.concat(F.lit("Code Block "), (i + 1).cast("string"), F.lit(":\n```\n"), x, F.lit("\n```")))
    return F.concat_ws(
        "\n\n",
        F.when(_filled(F.col("title")), F.concat(F.lit("Title: "), F.col("title"))),
        F.when(_filled(F.col("content")), F.concat(F.lit("Content: "), F.col("content"))),
        F.when(F.size(sections) > 0, F.concat(F.lit("Sections:\n"), F.array_join(sections, "\n"))),
        F.when(F.size("code_blocks") > 0, F.concat(F.lit("Code Examples:\n"), F.array_join(code, "\n"))),
        F.concat(F.lit("Source: "), F.col("source"), F.lit(" (Type: "), F.col("type"), F.lit(")")),
    )


def rendered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text``; documents whose text is blank are left out."""
    return docs.withColumn("text", render()).where(F.length(F.trim("text")) > 0)


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: total_documents and total_content_length in code points."""
    return docs.agg(F.count("*").alias("total_documents"), F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("long").alias("total_content_length"))


def corpus_by_type(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


def corpus_sources(docs: DataFrame) -> DataFrame:
    """The named sources of each type in order, one row a source: a list of all
    of them in one cell would grow with the corpus."""
    named = docs.where(_filled(F.col("source")))
    return named.select(F.coalesce("type", F.lit("unknown")).alias("type"), "source")


def rank_by(rows: DataFrame, value: str, name: str = "place") -> DataFrame:
    """The rank of each row by a whole number, largest first, equal ones alike.
    Ranks come from the rows of each value, so only distinct values meet in one
    task: counts that add up to n have at most about sqrt(2 n)."""
    values = rows.groupBy(value).agg(F.count("*").alias("__n"))
    above = F.sum("__n").over(Window.orderBy(F.desc(value))) - F.col("__n")
    return rows.join(values.select(value, (above + 1).cast("long").alias(name)), value)


#: Characters of a text that take part in dealing rows out by ranges.
_HEAD = 64


def _range_key(rows: DataFrame, order: tuple[str, ...]) -> list[Column]:
    """Keys that sort as ``order`` does, or put rows in one range where they can't tell:
    of a text only its head, since the bounds of ranges are sampled on the driver.
    What follows a text counts only where the head is all of it."""
    keys, whole, kinds = [], None, dict(rows.dtypes)
    for name in order:
        given = lambda c, w=whole: c if w is None else F.when(w, c)
        if kinds[name] != "string":
            keys.append(given(F.col(name)))
            continue
        longer = F.coalesce(F.length(name) > _HEAD, F.lit(False))
        keys += [given(F.substring(name, 1, _HEAD)), given(longer)]
        whole = ~longer if whole is None else whole & ~longer
    return keys


def number(rows: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """Consecutive numbers from 0 in a given order, without one task for all: a
    range partitioning, counts of its partitions, and a number in each.  The
    partitioning is written down, since its bounds are sampled and both uses
    must see the same."""
    spread = rows.repartitionByRange(*_range_key(rows, order)).sortWithinPartitions(*order)
    spread = spread.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    spread = settle(spread)
    counts = spread.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__m").alias("__first"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).drop("__n")
    out = spread.join(F.broadcast(before), "__p")
    return out.withColumn(name, (F.col("__before") + F.col("__m") - F.col("__first")).cast("long")).drop("__p", "__m", "__before", "__first")
