"""Folder shared by driver and executors, and lineage cuts through Parquet."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir

#: Characters of text that a Python function works on at a time.
PART_CHARS = 4 << 20


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: later jobs
    reread files instead of recomputing, and lost executors lose nothing.
    ``by`` names a last column to lay the files out by."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut`` wrote and nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._written_to)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a superseded folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the actions inside only."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def parts(texts: list, most: int = PART_CHARS, rows: int = 1000) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive rows with at most ``most`` characters unless a
    single text is longer.  Arrow batches are bounded by
    spark.sql.execution.arrow.maxBytesPerBatch; this bounds what is made of them."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and (size + n > most or i - first >= rows):
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def quoted(name: str) -> Column:
    """A column by its name alone, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_text(column: Column) -> Column:
    """An id on its way through pandas: as text, since a long column with a null
    would become floats there and lose digits."""
    return column.cast("long").cast("string")


def id_longs(ids) -> list:
    return [None if x is None else int(x) for x in ids]


def id_array(ids):
    import pandas as pd

    return pd.array(id_longs(ids), dtype="Int64")
