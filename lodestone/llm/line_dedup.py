"""Line deduplication over levelled sorted runs of line hashes.

Every text is split at ``\\n``.  A line's key is the line without the white
space ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased.  Only keys of
at least ``min_chars`` code points take part.  Keys are handled as 128 bits of
two differently seeded hashes.

The documents are taken in batches of descending ids, cut at approximate
quantiles of the ids.  A store of *runs*, each sorted and bucketed by key, holds
what earlier batches brought: (key, documents holding it).  Each new batch is
written as a run of its own and merge-anti-joined with the runs before it: keys
found in none of them are first seen here, so their largest id in the batch is
the largest of all and becomes the *keeper*.  ``fanout`` runs of one level are
merged into one of the next.  All runs have the same buckets, so the anti-joins
and merges need neither an exchange nor a sort.  Everything is DataFrame
operations; nothing is collected but the bounds of the batches.

Defined cases: a null or empty text is one empty line; a null id takes no part
(its text stays as it is and counts for no key); rows that repeat an id count
as one document for a key; ids may be any longs; a text of any length is split to
its end, in time linear in its lines; an empty table gives an empty result; a
result column replaces an input column of the same name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, discard, fresh_path, quoted, remove, setting

_BLANK = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_BLANK)), string.ascii_uppercase, string.ascii_lowercase)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levelled runs (h1, h2, n_docs) and the keepers (h1, h2, keeper), as tables
    in the shared folder, bucketed and sorted by (h1, h2)."""

    keys = ("h1", "h2")

    def __init__(self, spark, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.keepers: list[str] = []
        self.paths: dict[str, str] = {}

    def _write(self, df: DataFrame, kind: str) -> str:
        path = fresh_path(self.spark, kind)
        name = f"lodestone_{path.rsplit('-', 1)[1]}"
        # files of a bucketed table are known to be sorted only under this setting
        with setting(self.spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true"):
            df.write.option("path", path).bucketBy(self.buckets, *self.keys).sortBy(*self.keys).saveAsTable(name)
        self.paths[name] = path
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, self.paths.pop(name))

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs merged by key, bucket by bucket."""
        out = self.spark.table(names[0]).select(*self.keys, "n_docs")
        for name in names[1:]:
            more = self.spark.table(name).select(*self.keys, F.col("n_docs").alias("more")).hint("merge")
            out = out.join(more, [*self.keys], "full").select(*self.keys, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"))
        return out

    def _push(self, name: str) -> None:
        """Add a run to level 0; a level that is full is merged into the next, and
        levels that fill up in turn go in one merge."""
        old, level = [name], 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout - 1:
            old, self.levels[level], level = self.levels[level] + old, [], level + 1
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(self._write(self._merged(old), f"line-run-{level}") if level else name)
        if level:
            self._drop([x for x in old if x not in self.keepers])

    def add(self, batch: DataFrame) -> None:
        """``batch``: (h1, h2, doc), one row for each document and key."""
        counted = batch.groupBy(*self.keys).agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper"))
        own = self._write(counted, "line-batch")
        runs = [r for level in self.levels for r in level]
        first = self.spark.table(own).select(*self.keys, "keeper")
        for run in runs:
            first = first.join(self.spark.table(run).select(*self.keys).hint("merge"), [*self.keys], "left_anti")
        # the first batch's keys are all new
        self.keepers.append(self._write(first, "line-keepers") if runs else own)
        self._push(own)

    def table(self) -> DataFrame:
        """(h1, h2, n_docs, keeper): one row for each key."""
        runs = [r for level in self.levels for r in level]
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, n_docs long, keeper long")
        out = self._merged(runs)
        for k, name in enumerate(self.keepers):
            more = self.spark.table(name).select(*self.keys, F.col("keeper").alias(f"keeper{k}")).hint("merge")
            out = out.join(more, [*self.keys], "left")
        return out.select(*self.keys, "n_docs", F.coalesce(*[f"keeper{k}" for k in range(len(self.keepers))]).alias("keeper"))

    def discard(self) -> None:
        """Delete every table of the store."""
        self._drop(list(self.paths))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
               min_docs: int = 5, batches: int = 4, fanout: int = 2, salts: int = 8) -> DataFrame:
    """All columns of ``docs`` plus n_lines, n_dropped and kept_text.

    A key found in at least ``min_docs`` documents loses all its lines except
    those in the largest id that holds it.  A key's lines are spread over
    ``salts`` tasks where they meet its keeper."""
    spark = docs.sparkSession
    row = F.xxhash64(F.col(text_col))
    shares = [k / batches for k in range(1, batches)]
    bounds = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), shares, 1000)).first()[0] if shares else None
    # whole numbers compared: exact for ids however far apart
    batch = sum(((F.col("doc") <= F.lit(b)).cast("int") for b in set(bounds or [])), F.lit(0))
    lines = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("doc"), row.alias("row"), F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"))
        .withColumn("key", F.btrim("line", F.lit(_BLANK)))
        .where(F.length("key") >= min_chars)
        .withColumn("key", line_key(F.col("key")))
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc", "row", "pos", batch.alias("batch"))
    )
    lines = cut(lines, "line-keys", by="batch")
    runs = LineRuns(spark, fanout)
    for b in range(len(set(bounds or [])) + 1):
        runs.add(lines.where(F.col("batch") == b).select("h1", "h2", "doc").distinct())
    common = runs.table().where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")
    common = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    drops = (
        lines.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int")).join(common, ["h1", "h2", "salt"])
        .where(F.col("doc") != F.col("keeper"))
        .groupBy(F.col("doc").alias("__doc"), F.col("row").alias("__row")).agg(F.collect_set("pos").alias("__drop"))
    )
    with setting(spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true"):
        drops = cut(drops, "line-drops")
    runs.discard()
    discard(lines)
    plain = docs.drop("n_lines", "n_dropped", "kept_text") if {"n_lines", "n_dropped", "kept_text"} & set(docs.columns) else docs
    out = plain.join(drops, (F.col(id_col).cast("long") == F.col("__doc")) & (row == F.col("__row")), "left")
    # the lines once a row: they are referred to twice, so that no lambda splits anew
    out = out.withColumn("__lines", split_lines(F.col(text_col)))
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    kept = F.transform(places, lambda p: F.get("__lines", p))
    return out.select(
        *[quoted(c) for c in plain.columns],
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("__drop").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
