"""Whole jobs: building an index, answering queries, crawling sites."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.triage import classify_rules, parse_classification, route, routed_answer
from ..operators import rag
from ..operators.chunks import chunk
from ..operators.corpus import number, rendered, union_documents
from ..operators.crawl import crawl_many
from ..operators.retrieval import look_up, normalize, top_k
from ..session import discard, settle
from ..sources.readers import as_documents, read_index, write_index

DIMENSION = 64
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@F.udf(ArrayType(FloatType()), useArrow=False)
def hash_embedding(text: str | None) -> list[float]:
    """The default embedder, deterministic and without a model: words are hashed
    into ``DIMENSION`` signed counts, scaled to unit length.  Where these are all zero
    they are counted without signs, so that only a blank text has no direction.  A text
    at a time, so that memory doesn't grow with the rows of a batch."""
    import zlib

    v = [0] * DIMENSION
    for w in (text or "").lower().split():
        h = zlib.crc32(w.encode())
        v[h % DIMENSION] += 1 if h >> 31 else -1
    if not any(v):
        for w in _WORD.findall((text or "").lower()):
            v[zlib.crc32(w.encode()) % DIMENSION] += 1
    v = np.array(v, np.float32)
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def loading_embedder(load: Callable[[], Callable[[str], list[float]]]) -> Callable[[Column], Column]:
    """An embedder around a model that is slow to load: ``load`` runs once a task, not
    once a batch, and only where there are rows.  A row that the model fails for is null,
    which leaves it out of an index and a gap in the numbers; a model that can't be
    loaded ends the job."""
    models: list = []  # each task unpickles its own

    @F.udf(ArrayType(FloatType()), useArrow=False)
    def embed(text: str | None) -> list[float] | None:
        if not models:
            models.append(load())
        try:
            return None if text is None else [float(x) for x in models[0](text)]
        except Exception:  # noqa: BLE001  the row has no embedding
            return None

    return embed


def build_index(documents: DataFrame, path: str, embed: Callable[[Column], Column] = hash_embedding, force: bool = False, chunked: bool = False) -> dict:
    """Render, optionally chunk, number, embed, normalise and write.  Without
    ``force`` an index that is there stays.  Documents that ``embed`` gives null
    for are left out and keep a gap in the numbers."""
    spark = documents.sparkSession
    if not force and (old := read_index(spark, path)) is not None:
        return {"total_documents": old.count(), "built": False}
    rows = rendered(documents)
    if chunked:
        rows = chunk(rows.select("source", "text"))
    rows = number(rows.select("source", "text"), "source", "text")
    rows = rows.withColumn("embedding", embed(F.col("text"))).where("embedding IS NOT NULL")
    rows = rows.withColumn("embedding", normalize(F.col("embedding")).cast("array<float>")).withColumn("alias", F.concat(F.lit("document_"), F.col("index")))
    write_index(rows, path)
    return {"total_documents": read_index(spark, path).count(), "built": True}


def retrieve(spark: SparkSession, path: str, queries: DataFrame, k: int = 3, embed: Callable[[Column], Column] = hash_embedding) -> DataFrame | None:
    """Hits with text and source for (query_id, query); None without an index."""
    index = read_index(spark, path)
    if index is None:
        return None
    vectors = queries.select("query_id", embed(F.col("query")).alias("embedding"))
    hits = top_k(index, vectors, k, id_col="index")
    return look_up(hits, index.select(F.col("index").alias("vec_id"), "source", "text"))


def answer_queries(spark: SparkSession, path: str, queries: DataFrame, classify: Callable[[Column], Column] | None = None, k: int = 3,
                   embed: Callable[[Column], Column] = hash_embedding, generate: Callable[[Column, Column], Column] = rag.extractive) -> DataFrame:
    """(query_id, query, analysis, answer, sources).  Only queries routed to
    retrieval are embedded and searched.  ``classify`` gives a model's JSON
    answer; the default is the keyword rules."""
    analysis = parse_classification(classify(F.col("query"))) if classify else classify_rules(F.col("query"))
    seen = queries.where(F.length(F.trim("query")) > 0).withColumn("analysis", analysis)
    seen = seen.withColumn("way", route(F.col("analysis.topic"), F.col("analysis.priority")))
    direct = seen.where("way <> 'rag'").withColumn("answer", routed_answer(F.col("way"), F.col("analysis.topic"))).withColumn("sources", F.array().cast("array<string>"))
    wanted = seen.where("way = 'rag'")
    hits = retrieve(spark, path, wanted.select("query_id", "query"), k, embed)
    found = rag.answer(wanted, None if hits is None else rag.context(hits), generate)
    columns = ["query_id", "query", "analysis", "answer", "sources"]
    return direct.select(*columns).unionByName(found.select(*columns))


def crawl_sites(starts: DataFrame, fetch: Callable[[DataFrame], DataFrame], max_pages: int = 30) -> DataFrame:
    """Pages of all sites of ``starts`` (kind, site, url), with their kind; counts by
    kind are ``groupBy('kind').count()``."""
    return crawl_many(starts.select("site", "url"), fetch, max_pages).join(starts.select("kind", "site"), "site")


def scrape(starts: DataFrame, fetch: Callable[[DataFrame], DataFrame], path: str, others: DataFrame, embed: Callable[[Column], Column] = hash_embedding, max_pages: int = 30) -> dict:
    """The scrape action: crawl, join the pages to the ``others`` documents and build
    the index anew.  Pages by kind, and what the build says."""
    pages = settle(crawl_sites(starts, fetch, max_pages))
    docs = as_documents(pages, source=F.concat("kind", F.lit("/"), "url"), content=F.col("content"), kind=F.col("kind"), title=F.col("title"), sections=F.col("sections"), code_blocks=F.col("code_blocks"))
    built = build_index(union_documents(others, docs), path, embed, force=True)
    kinds = {r.kind: r["count"] for r in pages.groupBy("kind").count().collect()}  # a row a kind
    discard(pages)
    return built | {"pages": kinds}
