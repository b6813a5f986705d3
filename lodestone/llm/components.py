"""Connected components of a link table, by contraction.

Each round gives every node its smallest neighbour as parent (if smaller than
itself), maps the links through the parents and drops those that became loops or
repeats.  The links shrink from round to round; each round is written to the
shared folder, so a lost executor repeats one round at most, and superseded ones
are deleted.  Nothing but a flag reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, discard


def components(links: DataFrame) -> DataFrame:
    """``links``: (a long, b long) without nulls.  Returns (node, label): the
    smallest node reachable, for every node that is in a link."""
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = cut(nodes.withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        # a local minimum keeps itself; all others move to their least neighbour
        up = cut(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "parents")
        a, b = up.toDF("a", "up_a"), up.toDF("b", "up_b")
        moved = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("up_a", "a").alias("x"), F.coalesce("up_b", "b").alias("y"))
        fewer = cut(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        sent = cut(labels.join(up.toDF("label", "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        discard(edges, labels, up)
        edges, labels = fewer, sent
    discard(edges)
    return labels


def follow(labels: DataFrame, upper: DataFrame) -> DataFrame:
    """Labels sent on through the labels of a later, coarser table."""
    return labels.join(upper.toDF("label", "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
