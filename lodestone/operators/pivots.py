"""Exact top-k that leaves out what can't be near.

Vectors are laid out by the nearest of a few pivots, one folder a pivot, with the
smallest and largest distance of a group's vectors to it.  By the triangle inequality
no vector of a group is nearer to a query than the gap between the query's distance to
the pivot and that range.  A query is first compared with the group of its nearest
pivot; the k-th best distance found bounds it, and only groups whose gap is within the
bound are read for it.  Cosine is searched as Euclidean distance of unit vectors.

What is skipped depends on the vectors: clustered ones read few groups, vectors spread
evenly over many dimensions read most.  The result equals the full scan's either way.
Queries go in blocks, as in ``retrieval``; the driver holds one block, the pivots and
the ranges, and which query needs which group."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, settle
from .retrieval import QUERY_BLOCK, _keep, _score

#: Room for rounding of distances, as a share of the larger.
_SLACK = 1e-9


def _unit(m: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return m
    n = np.linalg.norm(m, axis=1)
    return m / np.where(n > 0, n, 1)[:, None]


def _distances(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(rows, pivots), by differences: exact for equal vectors."""
    return np.sqrt(np.stack([((m - x) ** 2).sum(1) for x in p], 1))


def lay_out(index: DataFrame, path: str, pivots: int = 64, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> None:
    """Write an index by pivots.  They are ``pivots`` of its vectors, chosen by a hash
    of the id; the choice bears on how much is skipped and not on the result."""
    spark = index.sparkSession
    rows = index.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).orderBy("vec_id").collect()  # bounded by ``pivots``
    p = _unit(np.array([r.v for r in chosen], np.float64), metric) if chosen else np.zeros((0, 1))

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                d = _distances(_unit(np.array(pdf["v"].tolist(), np.float64), metric), p)
                yield pdf.assign(d=d.min(1), pivot=d.argmin(1).astype(np.int32))

    made = rows.mapInPandas(assign, "vec_id long, v array<double>, d double, pivot int")
    made.write.partitionBy("pivot").parquet(f"{path}/rows")
    ranges = spark.read.schema(made.schema).parquet(f"{path}/rows").groupBy("pivot").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("n"))
    named = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(p)], "pivot int, v array<double>")
    ranges.join(named, "pivot").write.parquet(f"{path}/pivots")


def top_k(spark: SparkSession, path: str, queries: DataFrame, k: int = 3, metric: str = "cosine", vector_col: str = "embedding", query_col: str = "query_id", read: list | None = None) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) as ``retrieval.top_k`` gives them, from an
    index that ``lay_out`` wrote for the same metric.  ``read`` gets the number of
    (query, vector) pairs compared and of all there are, block by block."""
    groups = sorted(spark.read.parquet(f"{path}/pivots").collect(), key=lambda r: r.pivot)  # bounded by the pivots
    rows = spark.read.schema("vec_id long, v array<double>, d double, pivot int").parquet(f"{path}/rows")
    wanted = settle(queries.where(F.col(vector_col).isNotNull()).select(F.col(query_col).cast("long").alias("query_id"), F.col(vector_col).alias("v")))
    names, p = np.array([g.pivot for g in groups], np.int64), np.array([g.v for g in groups], np.float64)
    low, high, size = (np.array([g[c] for g in groups], np.float64) for c in ("low", "high", "n"))
    blocks, found = max(1, -(-wanted.count() // QUERY_BLOCK)), []
    for b in range(blocks if groups else 0):
        part = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").collect()
        if not part:
            continue
        ids, q = np.array([r.query_id for r in part], np.int64), np.array([r.v for r in part], np.float64)
        gap = _distances(_unit(q, metric), p)
        # groups in order of distance, as many as hold k vectors
        order = np.argsort(gap, 1, kind="stable")
        before = np.cumsum(size[order], 1) - size[order]
        first = np.zeros(gap.shape, bool)
        np.put_along_axis(first, order, before < k, 1)
        near = settle(_search(rows, names, first, ids, q, k, metric))
        bound = np.full(len(ids), np.inf)
        at = {i: j for j, i in enumerate(ids)}
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        for r in near.withColumn("r", rank).where(F.col("r") == k).collect():  # a row a query of the block
            bound[at[r.query_id]] = np.sqrt(max(0.0, 2 - 2 * r.score if metric == "cosine" else -r.score))
        least = np.maximum(0, np.maximum(gap - high, low - gap))
        rest = ~first & (least <= bound[:, None] * (1 + _SLACK) + 1e-7)
        if read is not None:
            read.append((int(((first | rest) * size).sum()), int(size.sum() * len(ids))))
        found += [near, settle(_search(rows, names, rest, ids, q, k, metric))]
    discard(wanted)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = every.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", (F.col("score") if metric == "cosine" else -F.col("score")).alias("score"))


def _search(rows: DataFrame, names: np.ndarray, needs: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, metric: str) -> DataFrame:
    """The best k of each query and task among the groups that it needs; folders of
    groups that none needs are not read."""
    asked = {int(g): np.flatnonzero(needs[:, j]) for j, g in enumerate(names) if needs[:, j].any()}

    def run(batches):
        import pandas as pd

        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for g, own in pdf.groupby("pivot"):
                for at in range(0, len(own), 4096):
                    some = own.iloc[at : at + 4096]
                    keys, m = some["vec_id"].to_numpy(), np.array(some["v"].tolist(), np.float64)
                    for lo in range(0, len(asked[g]), 256):
                        which = asked[g][lo : lo + 256]
                        s, best = _keep(_score(m, q[which], metric), keys, k)
                        for j, x, y in zip(which.tolist(), s, best):
                            if j in held:
                                x, y = (z[0] for z in _keep(np.concatenate([held[j][0], x])[None], np.concatenate([held[j][1], y])[None], k))
                            held[j] = x, y
        if held:
            n = [len(x) for x, _ in held.values()]
            yield pd.DataFrame({"query_id": np.repeat(ids[list(held)], n), "vec_id": np.concatenate([y for _, y in held.values()]), "score": np.concatenate([x for x, _ in held.values()])})

    return rows.where(F.col("pivot").isin(list(asked))).select("vec_id", "v", "pivot").mapInPandas(run, "query_id long, vec_id long, score double")
