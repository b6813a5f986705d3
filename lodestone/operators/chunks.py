"""Overlapping word windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


def chunk(docs: DataFrame, text_col: str = "text", source_col: str = "source", size: int = 40, overlap: int = 10) -> DataFrame:
    """The other columns of ``docs`` with chunk_ix, chunk_id and the chunk's
    text: a window of ``size`` words every ``size - overlap`` words, as long as
    a window has a first word.  A text without words has no chunk."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    rest = [c for c in docs.columns if c not in (text_col, "chunk_ix", "chunk_id")]
    parts = docs.withColumn("__w", words(F.col(text_col))).where(F.size("__w") > 0)
    parts = parts.select(*rest, "__w", F.posexplode(F.sequence(F.lit(0), F.size("__w") - 1, F.lit(step))).alias("chunk_ix", "__at"))
    return parts.select(
        *rest, "chunk_ix", F.concat(F.col(source_col).cast("string"), F.lit("#"), F.col("chunk_ix")).alias("chunk_id"),
        F.array_join(F.slice("__w", F.col("__at") + 1, size), " ").alias(text_col),
    )
