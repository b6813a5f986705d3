"""Uploads: checks, stored names and text extraction."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import suffix
from ..schemas import UPLOAD_LIMIT, UPLOAD_TYPES
from ..session import discard, settle


def reject_reason(size: Column, kind: Column, limit: int | None = UPLOAD_LIMIT) -> Column:
    """too_large, unsupported_type, or null for an acceptable file."""
    out = F.when(F.lit(False), F.lit(""))
    if limit is not None:
        out = F.when(size > limit, F.lit("too_large"))
    return out.when(~F.coalesce(kind.isin(UPLOAD_TYPES), F.lit(False)), F.lit("unsupported_type"))


def extraction_path(kind: Column) -> Column:
    """How a file's text is got: text, json, pdf, image or other."""
    return (
        F.when(F.startswith(kind, F.lit("text/")), F.lit("text")).when(kind == "application/json", F.lit("json"))
        .when(kind == "application/pdf", F.lit("pdf")).when(F.startswith(kind, F.lit("image/")), F.lit("image")).otherwise(F.lit("other"))
    )


#: What stands for the text of files that aren't read.
NO_PDF = "PDF processing not available. Please install PyPDF2."
IMAGE = ("Image file: ", " (OCR processing not implemented yet)")
OTHER = ("File uploaded: ", " (Content extraction not implemented for this file type)")
FAILED = "Error processing file: "


def _pdf(data: bytes) -> str:
    try:
        import io

        from pypdf import PdfReader
    except ImportError:
        return NO_PDF
    return "".join(page.extract_text() + "\n" for page in PdfReader(io.BytesIO(data)).pages)


@F.pandas_udf(StringType())
def _opaque_text(way: pd.Series, content: pd.Series, name: pd.Series) -> pd.Series:
    out = []
    for w, c, n in zip(way, content, name):
        try:
            if w == "json":
                out.append(json.dumps(json.loads(bytes(c).decode("utf-8")), indent=2))
            elif w == "pdf":
                out.append(_pdf(bytes(c)))
            else:
                out.append(bytes(c).decode("utf-8"))
        except Exception as e:  # noqa: BLE001  the message is the result
            out.append(f"{FAILED}{e}")
    return pd.Series(out)


def placeholder(way: Column, name: Column) -> Column:
    return F.when(way == "image", F.concat(F.lit(IMAGE[0]), name, F.lit(IMAGE[1]))).when(
        way == "other", F.concat(F.lit(OTHER[0]), name, F.lit(OTHER[1]))
    )


def ingest(files: DataFrame, limit: int | None = None) -> DataFrame:
    """``files``: (name, content_type, content binary).  Adds file_id (by content
    and name, so that a rerun gives the same), stored_name, size, reject_reason
    and the extracted text of accepted files.  JSON, PDF and undecodable text go
    through Python; all else stays in the engine."""
    way = extraction_path(F.col("content_type"))
    out = files.withColumn("size", F.octet_length("content").cast("long")).withColumn("reject_reason", reject_reason(F.col("size"), F.col("content_type"), limit))
    out = out.withColumn("file_id", F.sha2(F.concat(F.col("name").cast("binary"), F.coalesce("content", F.lit(b""))), 256))
    out = out.withColumn("stored_name", F.concat("file_id", suffix(F.col("name")))).withColumn("__way", way)
    plain = F.expr("is_valid_utf8(cast(content as string))")
    built_in = F.col("__way").isin("image", "other") | ((F.col("__way") == "text") & plain)
    easy = F.when(F.col("__way") == "text", F.expr("try_validate_utf8(cast(content as string))")).otherwise(placeholder(F.col("__way"), F.col("stored_name")))
    accepted = out.where("reject_reason IS NULL")
    done = accepted.where(built_in).withColumn("text", easy)
    hard = accepted.where(~built_in).withColumn("text", _opaque_text("__way", "content", "stored_name"))
    rejected = out.where("reject_reason IS NOT NULL").withColumn("text", F.lit(None).cast("string"))
    return done.unionByName(hard).unionByName(rejected).drop("__way")


_FILES = "path string, modificationTime timestamp, length long, content binary"
#: Content types by the end of a name.
TYPES = {".txt": "text/plain", ".md": "text/markdown", ".csv": "text/csv", ".json": "application/json", ".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif"}


def type_of(name: Column) -> Column:
    """The content type that a name stands for."""
    out = F.when(F.lit(False), F.lit(""))
    for end, kind in TYPES.items():
        out = out.when(F.endswith(F.lower(name), F.lit(end)), F.lit(kind))
    return out.otherwise(F.lit("application/octet-stream"))


def pack(files: DataFrame, folder: str) -> None:
    """Files (path, content) as they come, many to a Parquet file, with the columns that
    Spark's reader of binary files gives."""
    rows = files.select("path", F.current_timestamp().alias("modificationTime"), F.octet_length("content").cast("long").alias("length"), "content")
    rows.write.mode("append").parquet(folder)


def ingest_stream(spark: SparkSession, folder: str, path: str, checkpoint: str, limit: int | None = None, late: str = "1 day", packed: bool = False) -> DataFrame:
    """Files as they come into a folder, each content once.  A file whose content came
    within ``late`` before (by the files' times) is a copy and adds nothing; what is
    remembered of contents goes after that time.  ``packed``: the folder holds Parquet
    packs of files (``pack``) instead of the files themselves, since a stream lists
    every file on the driver.  Batches are folders that a repeated batch overwrites.  Returns what ``ingest`` gives, with the content's hash."""
    files = spark.readStream.format("parquet" if packed else "binaryFile").schema(_FILES).option("recursiveFileLookup", "true").load(folder)
    fresh = files.withColumn("hash", F.sha2("content", 256)).withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["hash"])
    name = F.element_at(F.split("path", "/"), -1)

    def put(batch: DataFrame, n: int) -> None:
        # written once: the ways of extraction must not each run the stream's state
        rows = settle(batch.select(name.alias("name"), type_of(name).alias("content_type"), "content", "hash"))
        ingest(rows, limit).drop("content").write.mode("overwrite").parquet(f"{path}/batch={n}")
        discard(rows)

    fresh.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).drop("batch")
