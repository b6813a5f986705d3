"""Chat messages and attachments as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_default
from ..schemas import UPLOAD_LIMIT, UPLOAD_TYPES
from ..sources.uploads import reject_reason


def default_query(query: Column) -> Column:
    """What is asked when only files were sent."""
    return or_default(query, "File upload analysis")


def append(rows: DataFrame, new: DataFrame) -> DataFrame:
    return rows.unionByName(new, allowMissingColumns=True)


def settle_messages(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """Pending messages with their answers: content and is_error come from
    ``answers`` (id, content, is_error) and is_thinking ends; other messages and
    messages without an answer stay."""
    new = answers.select("id", F.col("content").alias("__content"), F.coalesce("is_error", F.lit(False)).alias("__error"), F.lit(True).alias("__has"))
    joined = messages.join(new, "id", "left")
    has = F.coalesce("__has", F.lit(False)) & F.coalesce("is_thinking", F.lit(False))
    changed = {"content": F.col("__content"), "is_error": F.col("__error"), "is_thinking": F.lit(False)}
    return joined.select(*[F.when(has, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in messages.columns])


def attach(files: DataFrame) -> DataFrame:
    """Accepted files as pending attachments without progress; others are left
    out (``reject_reason`` tells why)."""
    ok = reject_reason(F.col("size"), F.col("type"), UPLOAD_LIMIT).isNull() & F.col("type").isin(UPLOAD_TYPES)
    return files.where(ok).withColumn("status", F.lit("pending")).withColumn("upload_progress", F.lit(0))


def remove_attachment(files: DataFrame, key) -> DataFrame:
    return files.where(~F.col("id").eqNullSafe(key))
