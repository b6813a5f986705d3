"""Readers and writers of the support corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import rule_line
from ..schemas import DOCUMENT, PAGE
from . import versions
from .json_sink import register


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_text_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(source, text): each matching file of a folder as one row."""
    if not exists(spark, f"{folder}/{pattern}"):
        return spark.createDataFrame([], "source string, text string")
    rows = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))


def read_existing(spark: SparkSession, path: str) -> DataFrame:
    """One static text file as a document; a missing file gives no rows."""
    if not exists(spark, path):
        return empty(spark, DOCUMENT)
    rows = spark.read.text(path, wholetext=True)
    return as_documents(rows, source=F.col("_metadata.file_name"), content=F.col("value"), kind="existing_data")


def read_scraped(spark: SparkSession, path: str, kind: str, lines: bool = False) -> DataFrame:
    """Pages saved as a JSON array, or as JSON lines; their source is the kind and
    the URL."""
    if not exists(spark, path):
        return empty(spark, DOCUMENT)
    rows = spark.read.schema(PAGE).json(path, multiLine=not lines)
    return as_documents(
        rows, source=F.concat(F.lit(kind + "/"), F.col("url")), content=F.col("content"), kind=kind, title=F.col("title"),
        sections=F.coalesce("sections", F.array()), code_blocks=F.coalesce("code_blocks", F.array()),
    )


def read_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Every readable UTF-8 file of a folder as a document; others are skipped."""
    if not exists(spark, f"{folder}/*"):
        return empty(spark, DOCUMENT)
    rows = spark.read.format("binaryFile").load(folder)
    rows = rows.select("path", F.expr("try_validate_utf8(cast(content as string))").alias("text")).where("text IS NOT NULL")
    return as_documents(rows, source=F.concat(F.lit("uploaded_files/"), F.element_at(F.split("path", "/"), -1)), content=F.col("text"), kind="uploaded_file")


def as_documents(rows: DataFrame, source: Column, content: Column, kind: str | Column, title: Column | None = None, sections: Column | None = None, code_blocks: Column | None = None) -> DataFrame:
    kinds = {f.name: f.dataType for f in DOCUMENT.fields}
    given = {"source": source, "content": content, "type": F.lit(kind) if isinstance(kind, str) else kind, "title": title, "sections": sections, "code_blocks": code_blocks}
    return rows.select(*[(F.lit(None) if c is None else c).cast(kinds[n]).alias(n) for n, c in given.items()])


def write_pages(pages: DataFrame, json_path: str, text_path: str, order: str = "position") -> None:
    """Crawled pages as JSON arrays (see ``json_sink``) and as readable text, in crawl
    order."""
    register(pages.sparkSession)
    columns = [f.name for f in PAGE.fields]
    dealt = pages.repartitionByRange(order).sortWithinPartitions(order)
    dealt.select(*columns).write.format("json_array").mode("overwrite").save(json_path)
    block = F.concat(
        F.lit("URL: "), F.col("url"), F.lit("\nTitle: "), F.col("title"), F.lit("\nContent: "), F.col("content"), F.lit("\n"), rule_line(80), F.lit("\n")
    )
    dealt.select(block.alias("value")).write.mode("overwrite").text(text_path)


def _checked(rows: DataFrame, dimension: int) -> DataFrame:
    fine = F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(F.raise_error(F.lit(f"an embedding is not of dimension {dimension}")).cast("array<float>"))
    return rows.withColumn("embedding", fine)


def _ids(rows: DataFrame) -> int:
    """How many numbers the rows take, gaps of missing ones included."""
    found = rows.agg(F.max("index") - F.min("index") + 1).first()[0] if "index" in rows.columns else rows.count()
    return found or 0


def write_index(rows: DataFrame, path: str, dimension: int | None = None) -> None:
    """Vectors and their rows as a table that replaces the one before at once (see
    ``versions``).  An embedding of another dimension stops it, and what was there
    before stays."""
    d = dimension if dimension is not None else rows.select(F.size("embedding")).first()
    d = d[0] if isinstance(d, tuple) else d
    versions.commit(rows.sparkSession, path, lambda first: rows if d is None else _checked(rows, d), count=_ids, replaces=True)
    versions.tidy(rows.sparkSession, path)


def append_index(spark: SparkSession, path: str, make: Callable[[int], DataFrame], taken: Callable[[], int], key: str | None = None) -> dict:
    """Add ``make(first id)`` to an index; ``taken`` tells how many ids it takes, rows
    without an embedding included.  A key that is there already adds nothing."""
    def checked(first: int) -> DataFrame:
        rows, old = make(first), versions.read(spark, path)
        d = None if old is None else old.select(F.size("embedding")).first()
        return rows if d is None else _checked(rows, d[0])

    return versions.commit(spark, path, checked, count=lambda rows: taken(), replaces=False, key=key)


def read_index(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The index table, or None where there is none."""
    return versions.read(spark, path, version)


def write_index_pair(rows: DataFrame, vectors: str, texts: str) -> None:
    """The older form of an index: vectors by id, and a list of (id, text) apart."""
    rows.select("index", "embedding").write.mode("overwrite").parquet(vectors)
    rows.select("index", "text").write.mode("overwrite").json(texts)


def read_index_pair(spark: SparkSession, vectors: str, texts: str) -> DataFrame | None:
    """The older form as one table without sources; None unless both are there."""
    if not exists(spark, vectors) or not exists(spark, texts):
        return None
    named = spark.read.schema("index long, text string").json(texts)
    return spark.read.parquet(vectors).join(named, "index").withColumn("source", F.lit(None).cast("string"))
