"""Filter interaction audit: what each filter takes under every order of filters.

Failure conditions over a whole text (words are maximal runs without ASCII white
space, case-sensitive):

- A: fewer than 200 words
- B: 100 * distinct words < 50 * words
- C: 100 * capitals A-Z > 3 * code points
- D: any of ``#$%&*|``
- E: the text equals that of a row with a smaller id, in any part

Duplicates come from a sort: rows are dealt by range of (text fingerprint, id), so
that the copies of one text spread over as many tasks as they fill, and each task
sorts its rows by fingerprint, whole text and id and compares neighbours.  A task's
first text of its first fingerprint may go on from an earlier task; such *heads*,
about one a task, are compared in whole with the *tails*, the texts under each
task's last fingerprint.  What is compared is always the text; a fingerprint that two
texts share only makes a head or tail of each.

The failures of a row are a mask of five bits.  Rows are counted by (part, mask,
labels); those counts are additive, so they are all that the 120 orders are worked
out from: a fixed table of 32 masks x 120 orders x 5 steps is joined on the mask.

Null texts count as empty ones.  A null id is no smaller and no larger than another,
so such a row never fails E and makes no other fail.  Rows that repeat an id with
the same text are no duplicates of each other.  A null part is the empty string.
An id with several labels counts as good, or toxic, if any says so; ids without
labels count as neither.  Other columns are not read, so their names can't clash.
An empty table gives no rows."""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, discard, quoted

FILTERS = "ABCDE"
_SPACE = "[ \\x09-\\x0D]+"
_E = 1 << FILTERS.index("E")


def own_failures(text: Column) -> Column:
    """The mask of A to D, each from the text alone."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    seen = F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("k"))
    chars = F.length(text)
    capitals = chars - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    # one struct, so that the words are made once
    return F.transform(
        F.array(seen),
        lambda s: F.when(s["n"] < 200, 1).otherwise(0) + F.when(s["k"] * F.lit(100) < s["n"] * F.lit(50), 2).otherwise(0),
    )[0] + F.when(capitals * F.lit(100) > chars * F.lit(3), 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def _compare(batches):
    """Sorted rows of one task -> (part, id, mask, kind, fp, text); the text is kept
    only where another task has to see it."""
    import pandas as pd

    first = fp_before = text_before = least_before = None
    tails: list = []  # (text, its least id) under the fingerprint at hand
    for pdf in batches:
        if not len(pdf):
            continue
        fp, own, texts = pdf["fp"].to_numpy(), pdf["id"].to_numpy(), pdf["text"].to_numpy(object)
        first = fp[0] if first is None else first
        start = np.append(fp_before is None or fp[0] != fp_before, fp[1:] != fp[:-1])
        # rows of one fingerprint have their texts compared
        for i in np.flatnonzero(~start):
            start[i] = texts[i] != (texts[i - 1] if i else text_before)
        opened = np.maximum.accumulate(np.where(start, np.arange(len(own)), -1))
        least = np.where(opened < 0, least_before if least_before is not None else 0, own[np.maximum(opened, 0)])
        head = (fp == first) & (own == least)
        if fp[-1] != fp_before:
            tails = []
        tails += [(texts[i], own[i]) for i in np.flatnonzero(start & (fp == fp[-1]))]
        fp_before, text_before, least_before = fp[-1], texts[-1], least[-1]
        mask = pdf["mask"].to_numpy() | np.where(own > least, _E, 0)
        yield pd.DataFrame({"part": pdf["part"], "id": own, "mask": mask, "kind": np.where(head, "head", "row"), "fp": fp, "text": np.where(head, texts, None)})
    if tails:
        text, least = zip(*tails)
        yield pd.DataFrame({"part": None, "id": least, "mask": 0, "kind": "tail", "fp": fp_before, "text": text})


def failure_masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> tuple[DataFrame, list[DataFrame]]:
    """(part, id, mask) of every row, and the tables it stands on, to be deleted
    once it has been used."""
    rows = docs.select(
        quoted(id_col).cast("long").alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"), F.coalesce(quoted(part_col).cast("string"), F.lit("")).alias("part")
    )
    named = rows.where("id IS NOT NULL").withColumn("fp", F.xxhash64("text"))
    dealt = named.repartitionByRange("fp", "id").sortWithinPartitions("fp", "text", "id")
    # the masks are made after the exchange: what is before it runs twice, for the bounds too
    dealt = dealt.select("part", "id", "fp", "text", own_failures(F.col("text")).alias("mask"))
    made = cut(dealt.mapInPandas(_compare, "part string, id long, mask int, kind string, fp long, text string"), "audit-rows")
    tails = made.where("kind = 'tail'").groupBy("fp", "text").agg(F.min("id").alias("least"))
    heads = made.where("kind = 'head'").select("part", "id", "mask", "fp", "text")
    earlier = heads.join(tails, ["fp", "text"], "left")
    settled = earlier.select("part", "id", F.when(F.col("least") < F.col("id"), F.col("mask").bitwiseOR(F.lit(_E))).otherwise(F.col("mask")).alias("mask"))
    unnamed = rows.where("id IS NULL").select("part", "id", own_failures(F.col("text")).alias("mask"))
    return made.where("kind = 'row'").select("part", "id", "mask").unionByName(settled).unionByName(unnamed), [made]


def _steps(spark: SparkSession) -> DataFrame:
    """A row for each mask, order and step: 32 x 120 x 5 at every size."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        bits = [1 << FILTERS.index(f) for f in order]
        for mask in range(1 << len(FILTERS)):
            gone = next((k for k, b in enumerate(bits) if mask & b), len(bits))
            for k, b in enumerate(bits):
                fails = bool(mask & b)
                out.append((mask, order, k + 1, int(gone > k), int(gone == k), int(fails and gone < k), int(mask == b), 120 // mask.bit_count() if fails else 0))
    return spark.createDataFrame(out, "mask int, filter_order string, step int, stays int, goes int, late int, alone int, share int")


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley), a row for each part, order and step."""
    masks, tables = failure_masks(docs, id_col=id_col, text_col=text_col, part_col=part_col)
    known = labels.where(quoted(id_col).isNotNull()).groupBy(quoted(id_col).cast("long").alias("id")).agg(
        F.coalesce(F.max(quoted(good_col) == 1), F.lit(False)).alias("good"), F.coalesce(F.max(quoted(toxic_col) == 1), F.lit(False)).alias("toxic")
    )
    # counts add up: by part, mask and labels first, and only those meet the orders
    counts = masks.join(known, "id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(F.col("toxic"), 1)).alias("toxic")
    )
    counts = cut(counts, "audit-counts")
    discard(*tables)

    def total(of: Column, name: str) -> Column:
        return F.sum(of).cast("long").alias(name)

    met = counts.join(F.broadcast(_steps(docs.sparkSession)), "mask")
    return met.groupBy("part", "filter_order", "step").agg(
        total(F.col("n") * F.col("stays"), "kept"), total(F.col("n") * F.col("goes"), "removed"), total(F.col("n") * F.col("late"), "redundant"),
        total(F.col("n") * F.col("alone"), "unique_fails"), total(F.col("good") * F.col("goes"), "good_lost"), total(F.col("toxic") * F.col("goes"), "toxic_lost"),
        total(F.col("n") * F.col("share"), "shapley"),
    )
