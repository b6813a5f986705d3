"""Exact top-k retrieval over a table of vectors.

Queries come in blocks of bounded size; each block runs once over the whole
table as a matrix product per Arrow batch.  A partition keeps the best k of every
query over all its batches, and the survivors are ranked by a window.  So what is
shuffled is at most k rows a query and partition, and the table itself never
moves.  With several blocks each one's survivors are written before the next, so
that neither a plan nor the driver holds more than one block of queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, settle

QUERY_BLOCK = 4096


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    # the norm as the one element of an array: inside the inner function it would be worked out for every element
    return F.element_at(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, F.try_divide(x.cast("double"), n)).otherwise(x.cast("double")))), 1)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def _score(m: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """(queries, rows); larger is better."""
    if metric == "cosine":
        a, b = np.linalg.norm(m, axis=1), np.linalg.norm(q, axis=1)
        return (q / np.where(b > 0, b, 1)[:, None]) @ (m / np.where(a > 0, a, 1)[:, None]).T
    # differences, not the expanded square: exact for equal vectors
    return -np.concatenate([((m[None] - q[a : a + 8, None]) ** 2).sum(2) for a in range(0, len(q), 8)])


def _keep(score: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, keys) of the best k columns of each row, ties by key."""
    if score.shape[1] > k:
        # all that reach the k-th best score, then in order
        least = np.partition(score, -k, axis=1)[:, -k]
        row, col = np.nonzero(score >= least[:, None])
    else:
        row, col = (x.ravel() for x in np.indices(score.shape))
    s, key = score[row, col], keys[row, col] if keys.ndim == 2 else keys[col]
    order = np.lexsort((key, -s, row))
    row, s, key = row[order], s[order], key[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    take = place < k
    n = min(k, score.shape[1])
    return s[take].reshape(-1, n), key[take].reshape(-1, n)


def top_k(index: DataFrame, queries: DataFrame, k: int = 3, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding", query_col: str = "query_id") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the best min(k, n) rows of each
    query; cosine descending or squared L2 (``l2``) ascending, ties by id.
    Null vectors match nothing; vectors of another dimension are an error."""
    rows = index.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    # written once: an embedder runs once, and every block sees the same vectors
    wanted = settle(queries.where(F.col(vector_col).isNotNull()).select(F.col(query_col).cast("long").alias("query_id"), F.col(vector_col).alias("v")))
    n = wanted.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").collect()
        ids = np.array([r.query_id for r in part], np.int64)
        q = np.array([r.v for r in part], np.float64)
        got = rows.mapInPandas(_best(ids, q, k, metric), "query_id long, vec_id long, score double")
        got = got if blocks == 1 else settle(got)
        found = got if found is None else found.unionByName(got)
    discard(wanted)
    # what is left of each partition, ranked
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", (F.col("score") if metric == "cosine" else -F.col("score")).alias("score"))


def _best(ids: np.ndarray, q: np.ndarray, k: int, metric: str):
    def run(batches):
        import pandas as pd

        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            keys = pdf["vec_id"].to_numpy()
            for at in range(0, len(pdf), 4096):
                m, own = np.array(pdf["v"].iloc[at : at + 4096].tolist(), np.float64), keys[at : at + 4096]
                for lo in range(0, len(ids), 256):
                    s, best = _keep(_score(m, q[lo : lo + 256], metric), own, k)
                    if lo in held:
                        s, best = _keep(np.concatenate([held[lo][0], s], 1), np.concatenate([held[lo][1], best], 1), k)
                    held[lo] = s, best
        for lo, (s, best) in held.items():
            yield pd.DataFrame({"query_id": np.repeat(ids[lo : lo + 256], s.shape[1]), "vec_id": best.ravel(), "score": s.ravel()})

    return run


def nearest(index: DataFrame, query: list[float], k: int = 3, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One query in the engine alone: scored by expressions, top k by a heap."""
    q = F.array(*[F.lit(float(x)) for x in query])
    if metric == "cosine":
        score = inner_product(normalize(F.col(vector_col)), normalize(q))
        return index.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(k)
    return index.select(id_col, squared_distance(F.col(vector_col), q).alias("score")).orderBy("score", id_col).limit(k)


def look_up(hits: DataFrame, meta: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Hits with the rows they stand for; hits outside the table fall out."""
    return hits.where(F.col(id_col) >= 0).join(meta, id_col)


def index_summary(index: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """One row: total_documents, dimension and index_loaded."""
    return index.agg(F.count("*").alias("total_documents"), F.max(F.size(vector_col)).cast("long").alias("dimension"), (F.count("*") > 0).alias("index_loaded"))


def index_stats(index: DataFrame | None, path: str = "") -> dict:
    n = 0 if index is None else index.count()
    return {"total_documents": n, "index_loaded": index is not None, "vectorstore_dir": path}
