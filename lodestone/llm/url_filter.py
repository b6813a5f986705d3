"""URL filters by a temporal list join.

A list is dated entries (kind, value, since, action): kind ``url``, ``prefix``
(host and leading path segments), ``host`` or ``domain`` (the host and all hosts
below it); action ``block``, ``allow`` or ``remove``.  Entries of one kind and
value are validity intervals: each holds from its date until the next one's;
``remove`` only ends what was before.  Of entries with the same kind, value and
date, block outranks allow, and allow outranks remove.

Every capture is split into the values it could match (its URL, each path prefix,
its host and each parent domain) and joined as of its fetch time: a value's history is
cut into blocks of at most ``fan`` entries in order of date, a capture meets the one row
that says when its value's blocks begin, then the one block that holds its time, and in
it the entry.  So captures times entries are never joined, and work grows with the
captures plus the entries, however many a value has.  The most specific match decides: url,
then the longest prefix, then host, then the longest domain.

Hosts and paths are compared in lower case on both sides, so an entry for ``/en``
holds for ``/EN`` too.

Only DataFrame operations.  The blocks are broadcast while they are measured
to take at most ``broadcast_bytes``; beyond, both sides are shuffled by value
and salt, the captures spread over ``salts`` salts so that a host with a third
of all captures does not land in one task.  Each URL and time is looked up once,
however often it was captured; captures without either go past that join, where
they would be one key.

Defined cases: a null, empty or unparsable URL matches nothing (verdict none,
host null); a null fetch time matches nothing; list rows with a null field or an
unknown kind or action are void; repeated captures each get their verdict; a URL of any length is split to its end; an
empty list gives ``none`` throughout; an empty capture table gives no rows.  All
columns of the captures are kept; a result column replaces one of its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.corpus import number
from ._shared import cut, quoted

#: Entries of one value in a block.
FAN = 256

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"
RANKS = {"domain": 1, "host": 2, "prefix": 3, "url": 4}
RESULT = ["host", "verdict", "entry_kind", "entry_value", "entry_since"]


def url_host(url: Column) -> Column:
    """The lower-cased host without user, port and final dots; null if none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", ""), F.lit(""))


def plain_url(url: Column) -> Column:
    """Host and path without scheme, port, query, fragment and final slashes."""
    return F.concat(url_host(url), F.regexp_replace(F.regexp_extract(url, _PATH, 1), "/+$", ""))


def url_values(url: Column) -> Column:
    """array<struct<kind, value>>: all list values that the URL could match."""
    host, whole = url_host(url), plain_url(url)
    labels, parts = F.split(host, r"\."), F.split(whole, "/")

    def several(kind, array):
        return F.transform(array, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    n, m = F.size(labels), F.size(parts)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    every = F.concat(several("url", F.array(whole)), several("prefix", prefixes), several("host", F.array(host)), several("domain", domains))
    return F.when(host.isNotNull(), every)


def dated(entries: DataFrame) -> DataFrame:
    """(kind, value, since, action): the valid entries, one a value and date."""
    order = {"remove": 0, "allow": 1, "block": 2}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    valid = entries.where(F.col("kind").isin(*RANKS) & F.col("action").isin(*order) & F.col("value").isNotNull() & F.col("since").isNotNull())
    return valid.groupBy("kind", F.lower("value").alias("value"), F.col("since").cast("timestamp").alias("since")).agg(F.max_by("action", rank[F.col("action")]).alias("action"))


def histories(entries: DataFrame, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(blocks, index): ``blocks`` (kind, value, block, dated) holds each value's entries
    in order, at most ``fan`` a row; ``index`` (kind, value, starts) says when each block
    of a value begins.  An entry is in force from its date to the next one's, so the last
    one up to a time is the one that holds then.  Blocks come from numbers over a range
    partitioning: no value's history is brought together in one task."""
    rows = number(dated(entries), "kind", "value", "since", name="n")
    rows = rows.groupBy("kind", "value", F.expr(f"n div {int(fan)}").alias("block"))
    blocks = cut(rows.agg(F.array_sort(F.collect_list(F.struct("since", "action"))).alias("dated")), "list-blocks")
    starts = F.array_sort(F.collect_list(F.struct(F.col("dated")[0]["since"].alias("since"), "block")))
    return blocks, blocks.groupBy("kind", "value").agg(starts.alias("starts"))


def _as_of(array: Column, time: Column, field: str) -> Column:
    """The last element of a sorted array that began by a time."""
    return F.try_element_at(F.filter(array, lambda x: x["since"] <= time), F.lit(-1))[field]


def filter_urls(captures: DataFrame, entries: DataFrame, *, url_col: str = "url", time_col: str = "fetched",
                broadcast_bytes: int = 16 << 20, salts: int = 16, fan: int = FAN) -> DataFrame:
    """All columns of ``captures`` plus ``RESULT``."""
    blocks, index = histories(entries, fan)
    own = captures.drop(*[c for c in RESULT if c in captures.columns and c not in (url_col, time_col)])
    key = own.select(F.col(url_col).alias("__url"), F.col(time_col).cast("timestamp").alias("__time")).where("__url IS NOT NULL AND __time IS NOT NULL").distinct()
    wanted = key.select("__url", "__time", F.inline(url_values(F.col("__url")))).withColumn("value", F.lower("value"))
    size = blocks.agg(F.sum(F.octet_length("kind") + F.octet_length("value") + 64 + F.size("dated") * 32)).first()[0] or 0
    salt = F.pmod(F.xxhash64("__url", "__time"), F.lit(salts)).cast("int")

    def met(rows: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
        """One row of ``side`` at most for each of ``rows``."""
        if size <= broadcast_bytes:
            return rows.join(F.broadcast(side), on)
        return rows.withColumn("salt", salt).join(side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*on, "salt"]).drop("salt")

    # the block as of the time, then the entry: one row a value at every step
    pairs = met(wanted, index, ["kind", "value"]).withColumn("block", _as_of(F.col("starts"), F.col("__time"), "block")).drop("starts")
    pairs = met(pairs.where("block IS NOT NULL"), blocks, ["kind", "value", "block"])
    pairs = pairs.select("__url", "__time", "kind", "value", *[_as_of(F.col("dated"), F.col("__time"), c).alias(c) for c in ("since", "action")]).where("action <> 'remove'")
    rank = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])
    best = pairs.groupBy("__url", "__time").agg(
        F.max(F.struct(rank[F.col("kind")].alias("rank"), F.length("value").alias("size"), "value", "kind", "since", "action")).alias("__best")
    )
    known = F.col(url_col).isNotNull() & F.col(time_col).cast("timestamp").isNotNull()
    out = own.where(known).join(best, (F.col(url_col) == F.col("__url")) & (F.col(time_col).cast("timestamp") == F.col("__time")), "left")
    nothing = best.schema["__best"].dataType
    out = out.drop("__url", "__time").unionByName(own.where(~known).withColumn("__best", F.lit(None).cast(nothing)))
    return out.select(
        *[quoted(c) for c in own.columns],
        *([] if "host" in own.columns else [url_host(F.col(url_col)).alias("host")]),
        F.coalesce("__best.action", F.lit("none")).alias("verdict"),
        F.col("__best.kind").alias("entry_kind"),
        F.col("__best.value").alias("entry_value"),
        F.col("__best.since").alias("entry_since"),
    )
