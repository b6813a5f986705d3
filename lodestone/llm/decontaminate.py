"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

Words are runs of letters and digits, lower-cased.  A document holds an item if
some stretch of its words is within ``floor((100 - percent) / 100 * n)`` word
edits (insertions, deletions, substitutions) of the item's n words.

1. Items of equal words are one *class*.  Classes fall into sizes: every length
   up to ``EXACT`` words by itself, longer ones in steps of a tenth.  A size's
   windows are as long as its shortest item; a longer item is embedded by its
   first words.
2. The CGK embedding walks over a window: at each step it copies the current word
   and a random function of step and word decides whether to move on, so few
   edits leave the walks of two windows at the same words for most steps.
   ``WALKS`` walks are taken, and of each ``SAMPLES`` random samples of ``PICKS``
   steps; the words at a sample's steps are hashed into a key.
3. Every position of every whole text starts a window of every size.  Keys of
   windows and items are joined, and only items that share a key with a window
   are compared with it.  Two filters, both without loss, keep windows and keys
   that can meet no item out of the shuffle: a window within k edits of w words
   has at least w - 1 - 2k of the benchmark's word pairs, and a key that no item
   has is not in the benchmark's key bitmap.  Both bitmaps are of fixed size; the
   larger the benchmark, the more they let through, and nothing else changes.
4. Windows of one text that lie close are one *region*; the exact edit distance of
   the item to the best stretch of the region decides.

Items are never collected; only the two bitmaps and the sizes go to the driver.
Keys of windows are spread over ``salts`` where the items are too large to be
broadcast, so that a passage in a third of all documents is no single task.

Recall: a stretch at the largest allowed distance shares no key with probability
under 1 in 100 (tested, figures in the README); closer ones less, equal ones never.

Defined cases: null or empty texts hold nothing; an item without words is found
nowhere; items of equal text are all reported; an item or a document with a null
id takes part and is reported as null; a text of any length is searched to its
end; an empty table on either side gives no rows.  Rows that repeat an id are
reported once for each text.  Other columns are not read, so their names can't
clash."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, discard, id_longs, parts
from ._text import flat, mix, slabs, span_hashes, spans
from .token_store import _Classes

WALKS, SAMPLES, PICKS = 5, 32, 3
EXACT = 16  # lengths beyond share a size with those up to a tenth longer
PAIR_BITS, KEY_BITS = 1 << 22, 1 << 25  # of the bitmaps
STEPS = 1 << 22  # walk steps or table cells that are held at a time
_ALL = (1 << 64) - 1


class _Lower:
    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            t = np.arange(0x110000, dtype=np.uint32)
            # dotted capital I becomes two characters, so it stays; sigma depends on its place
            c = np.concatenate([t[:0x130], t[0x131:0x3A3], t[0x3A4:0xD800], t[0xE000:]])
            t[c] = np.frombuffer(c.tobytes().decode("utf-32-le").lower().encode("utf-32-le"), np.uint32)
            t[0x3A3] = 0x3C3
            cls.table = t
        return cls.table


def _constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def word_hashes(texts: list[str]):
    """(hash, start, end) of all words, the number of each text's first word, and the texts' starts."""
    cp, starts = flat(texts)
    kind = _Classes.get()[cp]
    s, e = spans((kind == 2) | (kind == 3))
    return span_hashes(_Lower.get()[cp], s, e), s, e, np.searchsorted(s, starts), starts


def allowed(n, percent: int):
    """Word edits that a stretch may differ by from an item of n words."""
    return n * (100 - percent) // 100


def size_of(n: int) -> int:
    """The window size of items of n words."""
    w = EXACT
    while n >= (up := w + max(1, w // 10)):
        w = up
    return n if n <= EXACT else w


def longest_of(w: int) -> int:
    """The most words that an item of window size w has."""
    n = w
    while size_of(n + 1) == w:
        n += 1
    return n


def _pairs(h: np.ndarray) -> np.ndarray:
    """A hash of each word and the next one."""
    return mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])


def _of_size(pairs: np.ndarray, w: int) -> np.ndarray:
    """The pairs' hashes as those of items of window size w."""
    return mix(pairs + np.uint64(w * 0xA0761D6478BD642F & _ALL))


def _crowded(at: np.ndarray, width: int, least: int, n: int) -> np.ndarray:
    """The starts below n of all stretches of ``width`` places that hold at least
    ``least`` of the places ``at``."""
    if len(at) < least:
        return at[:0]
    first, last = at[: len(at) - least + 1], at[least - 1 :]
    close = last - first < width
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.maximum(last[close] - width + 1, 0), 1)
    np.add.at(step, first[close] + 1, -1)
    return np.flatnonzero(np.cumsum(step[:-1]))


class Sampler:
    """Keys of windows of ``w`` words."""

    def __init__(self, w: int, seed: int = 1, walks: int = WALKS, samples: int = SAMPLES, picks: int = PICKS):
        self.w, self.most, self.steps, self.walks = w, longest_of(w), 2 * w, walks
        self.salt = _constants(walks, seed)
        rng = np.random.default_rng([seed, w])
        picks = min(picks, w)
        self.places = np.sort(np.stack([[rng.choice(self.steps, picks, replace=False) for _ in range(samples)] for _ in range(walks)]), axis=2)
        self.factor = _constants(picks, 606) | np.uint64(1)
        self.offset = _constants(walks * samples, 707 + w).reshape(walks, samples)

    def walk(self, rows: np.ndarray) -> np.ndarray:
        """(step, walk, row): the words that the walks copy; 0 after a window's end."""
        n, width = rows.shape
        padded = np.concatenate([rows, np.zeros((n, self.steps + 1), np.uint64)], 1).ravel()
        at = np.tile(np.arange(n) * (width + self.steps + 1), self.walks)
        salt = np.repeat(self.salt, n)
        out = np.empty((self.steps, self.walks * n), np.uint64)
        for j in range(self.steps):
            x = np.take(padded, at, out=out[j])
            coin = (x ^ salt) * np.uint64((2 * j + 3) * 0x9E3779B97F4A7C15 & _ALL)
            at += (coin >> np.uint64(63)).view(np.int64)
        return out.reshape(self.steps, self.walks, n)

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """(row, walks * samples): the keys; 0 where a sample is past the end."""
        out = np.empty((len(rows), self.offset.size), np.uint64)
        some = max(1, STEPS // (2 * self.walks * self.w))
        for at in range(0, len(rows), some):
            walked, got = self.walk(rows[at : at + some]), []
            for r in range(self.walks):
                words = walked[:, r][self.places[r]]  # sample, pick, row
                key = mix((words * self.factor[None, :, None]).sum(1, dtype=np.uint64) + self.offset[r][:, None])
                got.append(np.where((words > 0).all(1), key, np.uint64(0)))
            out[at : at + some] = np.concatenate(got).T
        return out


def _bit(h: np.ndarray, bits: int) -> np.ndarray:
    return (h & np.uint64(bits - 1)).astype(np.int64)


class Search:
    """Windows of texts that may hold an item, by the benchmark's bitmaps."""

    def __init__(self, sizes: list[int], pair_map: bytes, key_map: bytes, percent: int):
        self.samplers = [Sampler(w) for w in sorted(sizes)]
        self.percent = percent
        self.pair_map = np.unpackbits(np.frombuffer(pair_map, np.uint8), bitorder="little").view(bool)
        self.key_map = np.frombuffer(key_map, np.uint8)

    def _known(self, keys: np.ndarray) -> np.ndarray:
        # two bits a key
        out = keys > 0
        for x in (keys, keys >> np.uint64(32)):
            some = np.nonzero(out)
            at = _bit(x[some], KEY_BITS)
            out[some] = self.key_map[at >> 3] >> (at & 7).astype(np.uint8) & 1
        return out

    def regions(self, texts: list):
        """(text, size, keys, words, first and end characters of the words) of each
        region whose windows have a key that some item has."""
        for base, part in slabs(texts):
            h, s, e, first, starts = word_hashes(part)
            if not len(h):
                continue
            text = np.repeat(np.arange(len(part)), np.diff(first))
            stop = first[text + 1]
            pairs = _pairs(h)
            some = np.flatnonzero(self.pair_map[_bit(pairs, PAIR_BITS)])
            for sampler in self.samplers:
                w, n, k = sampler.w, sampler.most, allowed(sampler.most, self.percent)
                if w == 1:
                    at = np.flatnonzero(self.pair_map[_bit(mix(h), PAIR_BITS)])
                else:
                    # pairs across texts may count: that lets through more, never less
                    own = some[self.pair_map[_bit(_of_size(pairs[some], w), PAIR_BITS)]]
                    at = _crowded(own, w - 1, w - 1 - 2 * k, len(h))
                found = []
                for lo in range(0, len(at), max(1, STEPS // (8 * w))):
                    p = at[lo : lo + max(1, STEPS // (8 * w))]
                    place = p[:, None] + np.arange(w)[None, :]
                    rows = np.where(place < stop[p][:, None], h[np.minimum(place, len(h) - 1)], np.uint64(0))
                    keys = sampler.keys(rows)
                    row, col = np.nonzero(self._known(keys))
                    found.append((p[row], keys[row, col]))
                if not found:
                    continue
                where, keys = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
                if not len(where):
                    continue
                # windows of one text that overlap are one region
                new = np.flatnonzero((np.diff(where, prepend=-1 << 40) > w) | (np.diff(text[where], prepend=-1) != 0))
                for a, b in zip(new.tolist(), [*new[1:].tolist(), len(where)]):
                    t = int(text[where[a]])
                    left, right = max(int(where[a]) - 2 * k - 1, int(first[t])), min(int(where[b - 1]) + n + 2 * k + 1, int(first[t + 1]))
                    home = int(starts[t])
                    yield base + t, w, np.unique(keys[a:b]), h[left:right], s[left:right] - home, e[left:right] - home


def distances(rows: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between an item and any stretch of each row, and the stretch's
    first end.  Rows are padded with 0, which equals no word."""
    m = rows.shape[1]
    place = np.arange(m + 1, dtype=np.int32)
    d = np.zeros((len(rows), m + 1), np.int32)
    for i, x in enumerate(item):
        new = np.empty_like(d)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(d[:, :-1] + (rows != x), d[:, 1:] + 1)
        d = np.minimum.accumulate(new - place, axis=1) + place
    return d.min(1), d.argmin(1)


def _back(row: np.ndarray, item: np.ndarray) -> int:
    """Words of the best stretch that ends with ``row``."""
    d = np.arange(len(row) + 1)
    for i, x in enumerate(item[::-1]):
        new = np.empty_like(d)
        new[0] = i + 1
        new[1:] = np.minimum(d[:-1] + (row[::-1] != x), d[1:] + 1)
        d = np.minimum.accumulate(new - np.arange(len(d))) + np.arange(len(d))
    return int(d.argmin())


def verify(item: np.ndarray, regions: list[np.ndarray], percent: int):
    """(region, distance, first word, end word) of the regions that hold the item,
    so many at a time that their tables stay small."""
    most = allowed(len(item), percent)
    order = sorted(range(len(regions)), key=lambda k: len(regions[k]))
    at = 0
    while at < len(order):
        width, n = len(regions[order[at]]), 0
        while at + n < len(order) and (n == 0 or (n + 1) * len(regions[order[at + n]]) <= STEPS):
            width, n = len(regions[order[at + n]]), n + 1
        mine = order[at : at + n]
        rows = np.zeros((n, width), np.uint64)
        for r, k in enumerate(mine):
            rows[r, : len(regions[k])] = regions[k]
        d, end = distances(rows, item)
        for r in np.flatnonzero(d <= most).tolist():
            stop = min(max(int(end[r]), 1), len(regions[mine[r]]))
            first = min(stop - 1, max(0, int(end[r]) - _back(regions[mine[r]][: int(end[r])], item)))
            yield mine[r], int(d[r]), first, stop
        at += n


_CLASS = "class long, n int, w int, words array<long>, keys array<long>, pairs array<long>"


def _classes(items: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(class, n, w, words, keys, pairs) of each distinct word sequence, and (class,
    item) of all items."""

    def run(batches):
        import pandas as pd

        samplers: dict[int, Sampler] = {}
        for pdf in batches:
            held = pdf["__text"].tolist()
            for a, b in parts(held):
                out = []
                h, _, _, first, _ = word_hashes([t or "" for t in held[a:b]])
                for x, lo, hi in zip(pdf["__item"].iloc[a:b], first[:-1].tolist(), first[1:].tolist()):
                    words = h[lo:hi]
                    if not len(words):
                        continue
                    w = size_of(len(words))
                    keys = samplers.setdefault(w, Sampler(w)).keys(words[None, :w])[0]
                    name = int(mix(words * _constants(len(words), 909)).sum(dtype=np.uint64).view(np.int64))
                    pairs = _pairs(words[:w]) if w > 1 else mix(words[:w])
                    pairs = np.concatenate([pairs, _of_size(pairs, w)])
                    out.append((x, name, len(words), w, words.view(np.int64), np.unique(keys[keys > 0]).view(np.int64), pairs.view(np.int64)))
                yield pd.DataFrame(out, columns=["item", "class", "n", "w", "words", "keys", "pairs"])

    rows = items.select(F.col(item_col).cast("long").cast("string").alias("__item"), F.col(text_col).alias("__text")).where("__text IS NOT NULL")
    every = cut(rows.mapInPandas(run, f"item string, {_CLASS}"), "benchmark-items")
    return every, every.select("class", F.col("item").cast("long").alias("item"))


def _bitmap(hashes: DataFrame, bits: int) -> bytes:
    """The bitmap of a column ``h`` of hashes: at most bits / 64 rows reach the driver."""
    slot = F.col("h").bitwiseAND(F.lit(bits - 1))
    rows = hashes.select(F.shiftright(slot, 6).cast("int").alias("slot"), F.expr("shiftleft(1L, CAST(h & 63 AS INT))").alias("one"))
    got = rows.groupBy("slot").agg(F.bit_or("one").alias("word")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got["slot"].to_numpy()] = got["word"].to_numpy()
    return out.view(np.uint64).astype("<u8").tobytes()


def _found(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, percent: int,
           broadcast_bytes: int, salts: int) -> DataFrame:
    """(doc, row, class, distance, n, first_char, end_char): the best stretch of
    each text (doc, row) and class that it holds; row is a hash of the text."""
    every, _ = items
    classes = every.dropDuplicates(["class"])
    sizes = [r.w for r in classes.select("w").distinct().collect()]  # one for each window size
    pair_map = _bitmap(classes.select(F.explode("pairs").alias("h")), PAIR_BITS)
    key_map = _bitmap(classes.select(F.explode("keys").alias("k")).select(F.explode(F.array("k", F.shiftrightunsigned("k", 32))).alias("h")), KEY_BITS)
    context = docs.sparkSession.sparkContext
    maps = context.broadcast((pair_map, key_map))

    def search(batches):
        import pandas as pd

        look = Search(sizes, *maps.value, percent)
        for pdf in batches:
            held = pdf["__text"].tolist()
            for a, b in parts(held):
                out = []
                for k, (t, w, keys, words, s, e) in enumerate(look.regions(held[a:b])):
                    row = pdf.iloc[a + t]
                    out.append((row["__id"], row["__row"], k, w, keys.view(np.int64), words.view(np.int64), s.astype(np.int64), e.astype(np.int64)))
                yield pd.DataFrame(out, columns=["doc", "row", "number", "w", "keys", "words", "first", "end"])

    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("__id"), F.xxhash64(F.col(text_col)).alias("__row"), F.col(text_col).alias("__text"))
    schema = "doc string, row long, number long, w int, keys array<long>, words array<long>, first array<long>, end array<long>"
    regions = cut(rows.where("__text IS NOT NULL").mapInPandas(search, schema).withColumn("region", F.xxhash64("doc", "row", "number", "w", "words")), "windows")

    # windows meet items on their keys
    mine = regions.select("region", F.explode("keys").alias("key"))
    theirs = classes.select("class", F.explode("keys").alias("key"))
    size = classes.agg(F.sum(F.size("keys") * 16 + F.size("words") * 8 + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        met = mine.join(F.broadcast(theirs), "key").select("region", "class").distinct()
    else:
        theirs = theirs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = mine.withColumn("salt", F.pmod("region", F.lit(salts)).cast("int")).join(theirs, ["key", "salt"]).select("region", "class").distinct()
    words = classes.select("class", "n", F.col("words").alias("item_words"))
    near = met.join(F.broadcast(words) if size <= broadcast_bytes else words, "class").join(regions, "region")
    near = near.select("doc", "row", "class", "n", "item_words", "words", "first", "end")

    def check(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            # equal regions are checked once
            for name, group in pdf.groupby("class", sort=False):
                item = np.asarray(group["item_words"].iloc[0], np.int64).view(np.uint64)
                held = [np.asarray(x, np.int64).view(np.uint64) for x in group["words"]]
                for k, d, a, b in verify(item, held, percent):
                    r = group.iloc[k]
                    out.append((r["doc"], r["row"], name, d, len(item), int(r["first"][a]), int(r["end"][b - 1])))
            yield pd.DataFrame(out, columns=["doc", "row", "class", "distance", "n", "first_char", "end_char"])

    found = near.mapInPandas(check, "doc string, row long, class long, distance long, n long, first_char long, end_char long")
    best = found.groupBy("doc", "row", "class").agg(F.min(F.struct("distance", "first_char", "end_char", "n")).alias("b"))
    best = cut(best.select(F.col("doc").cast("long").alias("doc"), "row", "class", "b.distance", "b.n", "b.first_char", "b.end_char"), "contaminations")
    discard(regions)
    return best


def contaminations(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", percent: int = 80, broadcast_bytes: int = 32 << 20, salts: int = 16) -> DataFrame:
    """(doc_id, item_id, distance, n_words, first_char, end_char): one row for
    each document and item it holds; the span of the best stretch."""
    known = _classes(items, item_col, item_text_col)
    found = _found(docs, known, id_col, text_col, item_col, item_text_col, percent, broadcast_bytes, salts)
    out = found.join(known[1], "class")
    return out.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "distance", F.col("n").alias("n_words"), "first_char", "end_char")


def without_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                         item_text_col: str = "text", percent: int = 80, broadcast_bytes: int = 32 << 20, salts: int = 16) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, unchanged."""
    known = _classes(items, item_col, item_text_col)
    found = _found(docs, known, id_col, text_col, item_col, item_text_col, percent, broadcast_bytes, salts)
    discard(known[0])
    gone = found.select(F.col("row").alias("__row"), F.col("n").alias("__n")).dropDuplicates(["__row"])
    # 64 bytes a row, measured; beyond the bound both sides are shuffled
    gone = F.broadcast(gone) if 64 * gone.count() <= broadcast_bytes else gone.hint("merge")
    return docs.join(gone, F.xxhash64(F.col(text_col)) == F.col("__row"), "left_anti")
