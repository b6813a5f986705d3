"""Corpus pipeline: documents through five stages, each written and read again.

quality rules (rejected documents go), line dedup (lines go), near dedup (one
document of each group stays, the one with the smallest id), benchmark
decontamination (documents that hold an item go), SentencePiece encoding and
decoding (digests of what is left).  All but the last return the columns of
documents, whatever other columns those are called; only text and n_chars change,
in line dedup.

Every row is judged by its own text.  Null and empty texts fail the quality rules;
a row with a null id takes no part in line and near dedup and stays; rows that
repeat an id with different texts each stay or go by their own text, while of rows
equal in id and text each stays that is the kept one of its group; an empty table
gives an empty table, and an empty benchmark takes nothing away."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, line_dedup, minhash, quality_rules, sentencepiece_bpe
from lodestone.llm._shared import cut, discard, quoted
from lodestone.llm.queries import vocabulary
from lodestone.session import ship


def _own(name: str) -> str:
    return f"document__{name}"


def _renamed(docs: DataFrame) -> DataFrame:
    """The columns under names that no operator's result takes."""
    return docs.toDF(*[_own(c) for c in docs.columns])


def _restored(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[quoted(_own(c)).alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    judged = quality_rules.quality_rules(_renamed(docs), vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json"), text_col=_own("text"))
    return _restored(judged.where("kept"), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    out = line_dedup.line_dedup(_renamed(docs), id_col=_own("doc_id"), text_col=_own("text"), min_chars=40, min_docs=5)
    changed = out.withColumn(_own("text"), F.col("kept_text")).withColumn(_own("n_chars"), F.length("kept_text").cast("long"))
    return _restored(changed, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.without_near_duplicates(docs, shingle=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return sentencepiece_bpe.digests(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", encode),
]

#: Fertility, min-max hashing, edit windows and BPE are beyond SQL: the tests
#: hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = None
    for name, stage in STAGES:
        made = cut(stage(spark, docs if held is None else held, sf_dir), f"stage-{name}")
        if held is not None:
            discard(held)
        held = made
    return held
