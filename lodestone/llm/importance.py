"""Target-distribution importance resampling with overlap chunks for long texts.

Words are runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are
lower-cased; features are all runs of 1 to ``n`` consecutive words joined by a
space, repeats counted, hashed into ``buckets`` by the crc32 of their UTF-8 bytes.
With S features of the corpus and T of the target, s and t of them in a bucket, the
bucket's gain is floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))).  A
document's weight is the floored mean of its features' gains, its score the weight
plus Gumbel noise from a hash of seed and id, and the documents of the highest scores
are drawn: sampling without replacement in proportion to the weights.

Texts of more than ``chunk`` characters are cut at word boundaries into chunks that
own ``chunk // 8`` word starts each and carry the next n-1 words, so that every
feature has one owner, the chunk in which it starts.  Chunks are dealt over all tasks
by hash of document and number; counts and sums of gains add up by document.  Shorter
texts are a chunk of their own and stay where they were read.  Texts are read twice,
for the counts and for the weights, and whole both times.

Only ``buckets`` counts leave the tasks; they are also all that is sent to them.  The
draw counts the documents of each score (whole numbers within a fixed range), takes
the scores down to the one in which the last place falls, and numbers those
documents by a range partitioning.

Null and empty texts have no features and weight 0.  A null id gets no score and is
never drawn.  Rows that repeat an id each count, in the corpus and in the draw, where
rows equal in score and id are ordered by their text.  Ties go to the smaller id.
An empty target or corpus has a total of 0.  Other columns are not read, so their
names can't clash.  An empty table gives no rows."""

from __future__ import annotations

import functools
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.corpus import number
from ._shared import cut, discard, id_array, id_text, parts, quoted

CHUNK = 1 << 16
_SHORT = 48  # bytes of a word up to which all words are hashed side by side


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(byte -> itself lower-cased, or 0 where it parts words; the crc32 table)."""
    low = np.zeros(256, np.uint8)
    low[0x30:0x3A] = np.arange(0x30, 0x3A)
    low[0x41:0x5B] = low[0x61:0x7B] = np.arange(0x61, 0x7B)
    low[0x80:] = np.arange(0x80, 0x100)
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
    return low, crc


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, and starts and ends of the words."""
    low = _tables()[0][np.frombuffer(text, np.uint8)]
    edge = np.flatnonzero(np.diff((low != 0).view(np.int8), prepend=0, append=0))
    return low, edge[::2], edge[1::2]


def crc_words(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """crc32 of each span, one byte of all spans at a time; long spans alone."""
    table, size = _tables()[1], e - s
    order = np.argsort(-np.minimum(size, _SHORT + 1), kind="stable")
    own, left = s[order], size[order]
    crc = np.full(len(s), 0xFFFFFFFF, np.uint32)
    for k in range(min(_SHORT, int(left[0]) if len(left) else 0)):
        live = int(np.searchsorted(-left, -k, "left"))  # spans longer than k
        c = crc[:live]
        crc[:live] = table[(c ^ low[own[:live] + k]) & np.uint32(255)] ^ (c >> np.uint32(8))
    out = np.empty(len(s), np.uint32)
    out[order] = ~crc
    for i in np.flatnonzero(size > _SHORT):
        out[i] = zlib.crc32(low[s[i] : e[i]].tobytes())
    return out


@functools.lru_cache(4096)
def _shift(size: int) -> np.ndarray:
    """What ``size`` further bytes do to a crc32: (4, 256), by byte of the crc."""
    m = 1 << np.arange(32, dtype=np.uint64)
    base = np.array([zlib.crc32(bytes(size), int(b) ^ 0xFFFFFFFF) ^ zlib.crc32(bytes(size), 0xFFFFFFFF) for b in m], np.uint32)
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte, (np.arange(256) >> bit & 1) == 1] ^= base[8 * byte + bit]
    return out


def joined(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of two strings put together, from those of both and the second's size."""
    out = right.copy()
    for n in np.unique(size):
        at, t = np.flatnonzero(size == n), _shift(int(n))
        for byte in range(4):
            out[at] ^= t[byte][(left[at] >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


def feature_buckets(texts: list, own: list, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, text it belongs to, words of each text).  Features
    start within the first ``own`` words of a text (None: all of them)."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    low, s, e = word_spans(b"\n".join(data))
    first = np.searchsorted(s, np.cumsum([0, *[len(d) + 1 for d in data]]))
    words = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), words)
    place = np.arange(len(s)) - first[doc]
    limit = np.array([w if o is None else min(w, o) for w, o in zip(words.tolist(), own)], np.int64)
    crc = crc_words(low, s, e)
    starts = place < limit[doc]
    found, whose = [crc[starts]], [doc[starts]]
    if n > 1 and len(s):
        space = np.full(len(s), zlib.crc32(b" "), np.uint32)
        spaced, run = joined(space, crc, e - s), crc
        for k in range(1, n):
            # the run of k words from each start, with the word after it
            run = joined(run[: len(s) - k], spaced[k:], e[k:] - s[k:] + 1)
            ok = starts[: len(run)] & (doc[: len(run)] == doc[k:])
            found.append(run[ok])
            whose.append(doc[: len(run)][ok])
    return (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.concatenate(whose), limit


def chunks(text: str, most: int, n: int):
    """(chunk, words it owns) of one text, cut before words."""
    data = text.encode("utf-8", "surrogatepass")
    _, s, e = word_spans(data)
    for a in range(0, max(1, len(s)), most):
        if not len(s):
            yield "", 0
            break
        last = min(a + most + n - 1, len(s)) - 1
        yield data[s[a] : e[last]].decode("utf-8", "surrogatepass"), min(most, len(s) - a)


def _pieces(docs: DataFrame, id_col: str, text_col: str, n: int, chunk: int) -> DataFrame:
    """(id, h, own, piece, k, text): a row for each chunk; h tells the texts of
    one id apart, own is null where a chunk is a whole text."""
    rows = docs.select(id_text(quoted(id_col)).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.when(F.length("text") > chunk, F.xxhash64("text")))

    def split(batches):
        import pandas as pd

        for pdf in batches:
            for i, h, t in zip(pdf["id"], pdf["h"], pdf["text"]):
                for k, (piece, own) in enumerate(chunks(t, max(n, chunk // 8), n)):
                    yield pd.DataFrame({"id": [i], "h": [int(h)], "own": [own], "k": [k], "text": [piece]})

    short = rows.where("h IS NULL").select("id", "h", F.lit(None).cast("long").alias("own"), F.lit(0).alias("k"), "text")
    # a hash of int type leaves pandas exact only without nulls, which these lack
    long = rows.where("h IS NOT NULL").mapInPandas(split, "id string, h long, own long, k int, text string")
    return short.unionByName(long.repartition("id", "h", "k"))


def bucket_counts(docs: DataFrame, *, id_col: str, text_col: str = "text", n: int = 1, buckets: int = 10000, chunk: int = CHUNK) -> np.ndarray:
    """Features of a whole table by bucket."""
    def count(batches):
        import pandas as pd

        total = np.zeros(buckets, np.int64)
        for own, texts in _batches(batches):
            total += np.bincount(feature_buckets(texts, own, n, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    pieces = _pieces(docs, id_col, text_col, n, chunk).select("own", "text")
    found = pieces.mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # ``buckets`` rows at most
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def _owned(column) -> list:
    return [None if x is None or x != x else int(x) for x in column]


def _batches(batches):
    for pdf in batches:
        texts, own = pdf["text"].tolist(), _owned(pdf["own"])
        for a, b in parts(texts, 1 << 20):
            yield own[a:b], texts[a:b]


def gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whole gains by bucket, from counts of the corpus and of the target."""
    b = len(s)
    above, below = (t + 1).astype(np.float64) * float(s.sum() + b), (s + 1).astype(np.float64) * float(t.sum() + b)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def _sums(pieces: DataFrame, gain: np.ndarray, n: int) -> DataFrame:
    """(id, h, k, words, features, gained) of every chunk."""
    def run(batches):
        import pandas as pd

        for pdf in batches:
            texts, own = pdf["text"].tolist(), _owned(pdf["own"])
            out = []
            for a, b in parts(texts, 1 << 20):
                bucket, doc, words = feature_buckets(texts[a:b], own[a:b], n, len(gain))
                total = np.zeros(b - a, np.int64)
                np.add.at(total, doc, gain[bucket])
                out.append(np.stack([words, np.bincount(doc, minlength=b - a), total]))
            words, features, gained = np.concatenate(out, 1) if out else np.zeros((3, 0), np.int64)
            yield pd.DataFrame({"id": pdf["id"], "h": pdf["h"], "k": pdf["k"], "words": words, "features": features, "gained": gained})

    made = pieces.withColumn("h", F.col("h").cast("string")).mapInPandas(run, "id string, h string, k int, words long, features long, gained long")
    return made.withColumn("id", F.col("id").cast("long"))


def noise(key: Column) -> Column:
    """Gumbel noise in thousandths from a text: floor(-1000 ln(-ln((h + 0.5) / 2^32))),
    h the first 32 bits of its sha256."""
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", n: int = 1, buckets: int = 10000,
             least_words: int = 20, percent: int = 10, seed: int = 2024, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) of every row of ``docs``;
    rank from 1 for the floor(percent * N / 100) drawn of the N rows with at least
    ``least_words`` words."""
    s = bucket_counts(docs, id_col=id_col, text_col=text_col, n=n, buckets=buckets, chunk=chunk)
    t = bucket_counts(target, id_col=target_id, text_col=text_col, n=n, buckets=buckets, chunk=chunk)
    made = _sums(_pieces(docs, id_col, text_col, n, chunk), gains(s, t), n)
    # chunks add up by document; rows equal in id and text are that many times the same
    many = made.where("h IS NOT NULL").groupBy("id", "h").agg(*[F.sum(c).alias(c) for c in ("words", "features", "gained")], F.count(F.when(F.col("k") == 0, 1)).alias("times"))
    each = [F.expr(f"{c} div times").alias(c) for c in ("words", "features", "gained")]
    many = many.select("id", "h", *each, F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("__i")).drop("__i")
    rows = made.where("h IS NULL").select("id", "h", "words", "features", "gained").unionByName(many)
    weight = F.when(F.col("features") > 0, F.expr("(gained - pmod(gained, features)) div features")).otherwise(F.lit(0)).cast("long")
    rows = rows.select(F.col("id").alias("doc_id"), F.col("features").alias("n_features"), weight.alias("weight"), F.col("words").alias("n_words"), "h")
    rows = rows.withColumn("score", F.col("weight") + noise(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))))
    scored = cut(rows, "importance-scored")
    return drawn(scored, least_words, percent)


def drawn(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """``scored`` with the rank of what is drawn."""
    able = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    # scores are whole numbers of a fixed range, whatever the input's size
    by_score = scored.where(able).groupBy("score").agg(F.count("*").alias("n"))
    down = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = by_score.withColumn("down", down)
    total = scored.where(F.col("n_words") >= least_words).count()
    places = percent * total // 100
    last = ranked.where(F.col("down") >= places).agg(F.max("score")).first()[0] if places else None
    lowest = ranked.agg(F.min("score")).first()[0] if places and last is None else last
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    if lowest is None:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(*columns)
    inside = able & (F.col("score") >= F.lit(lowest))
    order = scored.where(inside).withColumn("__down", -F.col("score"))
    placed = number(order, "__down", "doc_id", "n_features", "weight", "h", name="__n")
    rank = F.when(F.col("__n") < places, F.col("__n") + 1)
    rest = scored.where(~inside).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", rank.cast("long")).select(*columns).unionByName(rest.select(*columns))
