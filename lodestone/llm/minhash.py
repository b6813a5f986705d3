"""Near duplicates by min-max hashing.

A document's set holds its distinct shingles of ``shingle`` words (A-Z lowered;
a shorter text is one shingle).  Under each permutation both the smallest and
the largest value are kept, so ``rows`` signature values cost half as many hash
evaluations.  ``rows`` values (half minima, half maxima) make a band; documents
that share a band are candidates.  With 45 bands of 6 values a pair at the
threshold 0.8 is missed with probability (1 - 0.8^6)^45, about 1e-6.

Documents of equal sets are one class with its smallest id as representative;
only representatives go on.  No bucket is expanded into pairs:

1. In each bucket the smallest id is the *hub*; every other member is compared
   with it on full sets.  Links found so are contracted to components.
2. Members left outside their hub's component go on within the hub's *ball* (the
   members of all its buckets): each is compared with all members of other
   components, in blocks, unless the distances to the hub already rule the pair
   out (1 - Jaccard is a metric, so distances to the hub that differ by more
   than 1 - threshold exclude a link).  So no candidate pair is lost, and a large
   group of near copies, mostly one component after step 1, is not quadratic.

Hubs of many members are salted: their text is sent to as many places as there
are chunks of members.  Chunks and blocks are bounded by members and by shingles,
so that neither many nor long texts gather in one place.

Defined cases: null text and text without words have an empty set and link with
nothing; a null id links with nothing, its component is null and it is kept;
rows that repeat an id each take the component of their own text, and texts whose
smallest holder is the same id are one node; a text of any length is shingled
whole; other columns are not read, so their names can't clash; an empty table
gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, discard, id_array, id_text, parts
from ._text import flat, lower_ascii, mix, slabs, span_hashes, words
from .components import components, follow

BANDS, ROWS = 45, 6
CHUNK = 400  # members of a hub that are compared with it in one place
BLOCK = 128  # members on each side of a block
SHINGLES = 1 << 18  # shingles of such members, at most as many as one text has beyond


def _constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def shingle_sets(texts: list, shingle: int = 2) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    factor = _constants(shingle, 11) | np.uint64(1)
    for _, part in slabs(texts):
        cp, starts = flat(part)
        cp = lower_ascii(cp)
        s, e, first = words(cp, starts)
        h = span_hashes(cp, s, e)
        m = max(0, len(h) - shingle + 1)
        total = np.zeros(m, np.uint64)
        for j in range(shingle):
            total += h[j : j + m] * factor[j]
        total = mix(total)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= shingle:
                x = np.sort(total[a : b - shingle + 1])
                yield x[np.concatenate([[True], x[1:] != x[:-1]])]
            elif b > a:  # the whole sequence as one
                yield mix((h[a:b] * factor[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield h[:0]


class MinMax:
    """Signatures: minima and maxima under ``bands * rows / 2`` permutations."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        if rows % 2:
            raise ValueError("rows must be even: minima and maxima of rows / 2 permutations")
        self.bands, self.rows = bands, rows
        n = bands * rows // 2
        self.a = ((_constants(n, 101) >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]
        self.b = (_constants(n, 202) >> np.uint64(32)).astype(np.uint32)[:, None]
        self.factor = _constants(rows, 303) | np.uint64(1)
        self.offset = _constants(bands, 404)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """(permutations, 2): smallest and largest value of each."""
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        low = high = None
        for k in range(0, len(x), 2048):
            y = self.a * x[k : k + 2048] + self.b
            lo, hi = y.min(1), y.max(1)
            low = lo if low is None else np.minimum(low, lo)
            high = hi if high is None else np.maximum(high, hi)
        return np.stack([low, high], 1)

    def band_keys(self, hashes: np.ndarray) -> np.ndarray:
        sig = self.signature(hashes).astype(np.uint64).reshape(self.bands, self.rows)
        return mix((sig * self.factor).sum(1) + self.offset).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc, row, n_shingles, k1, k2, bands): row is a hash of the text, k1, k2
    identify the set."""

    def run(batches):
        import pandas as pd

        hasher = MinMax(bands, rows)
        s1, s2 = _constants(2, 505)
        for pdf in batches:
            held = pdf["__text"].tolist()
            for a, b in parts(held):
                n, k1, k2, keys = [], [], [], []
                for x in shingle_sets(held[a:b], shingle):
                    n.append(len(x))
                    k1.append(mix(x ^ s1).sum().view(np.int64))
                    k2.append(mix(x ^ s2).sum().view(np.int64))
                    keys.append(hasher.band_keys(x) if len(x) else np.empty(0, np.int64))
                yield pd.DataFrame({
                    "doc": id_array(pdf["__id"].iloc[a:b]), "row": pdf["__row"].iloc[a:b].to_numpy(), "n_shingles": n,
                    "k1": np.array(k1, np.int64), "k2": np.array(k2, np.int64), "bands": keys,
                })

    rows_ = docs.select(id_text(F.col(id_col)).alias("__id"), F.xxhash64(F.col(text_col)).alias("__row"), F.col(text_col).alias("__text"))
    return rows_.mapInPandas(run, "doc long, row long, n_shingles long, k1 long, k2 long, bands array<long>")


def _groups(batches, keys: list[str]):
    """Row groups of a partition sorted by ``keys``, whole, one at a time."""
    import pandas as pd

    held, last = [], None
    for pdf in batches:
        if not len(pdf):
            continue
        change = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        heads = np.flatnonzero(change).tolist()
        if not heads or heads[0] != 0:
            heads = [0, *heads]
        for a, b in zip(heads, [*heads[1:], len(pdf)]):
            part = pdf.iloc[a:b]
            key = tuple(part[keys].iloc[0])
            if held and key != last:
                yield last, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            held.append(part)
            last = key
    if held:
        yield last, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    if not len(x) or not len(y):
        return 0
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return int(np.count_nonzero(x[at] == y))


def _linked(both, x, y, percent: int):
    return 100 * both >= percent * (x + y - both)


def _star(shingle: int, percent: int):
    """Compare the members of a (hub, salt) group, hub row first, with the hub."""

    def run(batches):
        import pandas as pd

        hub, sets = None, []
        for pdf in batches:
            out = []
            for key, head, node, x in zip(pdf["hub"].tolist(), pdf["kind"].tolist(), pdf["node"].tolist(), shingle_sets(pdf["text"].tolist(), shingle)):
                if head == 0:
                    if key != hub:
                        hub, sets = key, []
                    sets.append(x)  # rows that repeat an id give several sets
                    continue
                best, far = False, 1.0
                for y in sets if key == hub else []:
                    both = _overlap(x, y)
                    union = len(x) + len(y) - both
                    best = best or bool(len(x) and _linked(both, len(x), len(y), percent))
                    far = min(far, 1 - both / union if union else 1.0)
                out.append((key, node, best, far, len(x)))
            yield pd.DataFrame(out, columns=["hub", "node", "linked", "far", "size"])

    return run


def _blocks(shingle: int, percent: int):
    """Compare the stray members of a block with the other block's members."""

    def run(batches):
        import pandas as pd

        for _, g in _groups(batches, ["hub", "i", "j"]):
            stray, comp, far = g["stray"].to_numpy(bool), g["comp"].to_numpy(), g["far"].to_numpy()
            left, right = np.flatnonzero(stray), np.flatnonzero(~stray)
            node = g["node"].to_numpy()
            near = np.abs(far[left][:, None] - far[right][None, :]) <= 1 - percent / 100 + 1e-9
            test = near & (comp[left][:, None] != comp[right][None, :])
            left, right, test = left[test.any(1)], right[test.any(0)], test[test.any(1)][:, test.any(0)]
            if not len(left):
                continue
            sets = list(shingle_sets(g["text"].iloc[np.concatenate([left, right])].tolist(), shingle))
            size = np.array([len(x) for x in sets])
            vocab, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            number = np.cumsum(df > 1) - 1  # only shared shingles count
            shared = df[inverse] > 1
            doc, col = np.repeat(np.arange(len(sets)), size)[shared], number[inverse[shared]]
            n = len(left)
            both = np.zeros((n, len(right)), np.float32)
            order = np.argsort(col, kind="stable")
            doc, col = doc[order], col[order]
            for lo in range(0, int(number[-1]) + 1 if len(number) else 0, 2048):
                a, b = np.searchsorted(col, [lo, lo + 2048])
                m = np.zeros((len(sets), 2048), np.float32)
                m[doc[a:b], col[a:b] - lo] = 1
                both += m[:n] @ m[n:].T
            both = np.rint(both).astype(np.int64)
            a, b = np.nonzero(test & _linked(both, size[:n, None], size[None, n:], percent) & (both > 0))
            # one link for each stray and component is enough
            found = pd.DataFrame({"a": comp[left[a]], "b": comp[right[b]]}).drop_duplicates()
            yield found

    return run


def _chunks(rows, most: int, shingles):
    """Into how many chunks so many rows with so many shingles are dealt."""
    return F.ceil(F.greatest(rows / F.lit(most), shingles / F.lit(SHINGLES), F.lit(1.0))).cast("int")


def _dealt(n):
    return F.pmod(F.xxhash64("node"), n).cast("int")


def _labelled(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(doc, row, n_shingles, component) of every row; row is a hash of its text."""
    sig = cut(signatures(docs, id_col, text_col, shingle, bands, rows), "signatures")
    full = sig.where("doc IS NOT NULL AND n_shingles > 0")
    classes = cut(full.groupBy("k1", "k2").agg(F.min("doc").alias("rep")), "classes")
    reps = full.join(classes.withColumnRenamed("rep", "doc"), ["k1", "k2", "doc"], "left_semi")
    keyed = reps.select("doc", "n_shingles", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("doc").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    # tables that meet a hot key are written first: only then can its join be split
    hubs = cut(hubs, "hubs")
    pairs = keyed.join(hubs, "key").where("doc <> hub").groupBy("hub", F.col("doc").alias("node")).agg(F.max("n_shingles").alias("size"))
    pairs = cut(pairs, "star-pairs")

    # texts of candidates only
    need = pairs.select("node").union(pairs.select(F.col("hub").alias("node"))).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    # candidates grow with the input: never broadcast
    texts = cut(texts.where("text IS NOT NULL").join(need.hint("merge"), "node", "left_semi").distinct(), "candidate-texts")

    # 1. members against their hub, hot hubs salted
    spread = pairs.groupBy("hub").agg(_chunks(F.count("*"), CHUNK, F.sum("size")).alias("salts"))
    spread = cut(spread, "hub-salts")
    head = spread.hint("merge").join(texts.withColumnRenamed("node", "hub"), "hub").select(
        "hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("hub").alias("node"), "text"
    )
    member = pairs.join(spread, "hub").withColumn("salt", _dealt(F.col("salts"))).hint("merge").join(texts, "node")
    member = member.select("hub", "salt", F.lit(1).alias("kind"), "node", "text")
    laid = head.union(member).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind", "node")
    star = laid.mapInPandas(_star(shingle, percent), "hub long, node long, linked boolean, far double, size long")
    star = cut(star.groupBy("hub", "node").agg(F.max("linked").alias("linked"), F.min("far").alias("far"), F.max("size").alias("size")), "star")
    labels = components(star.where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b")))

    # 2. members outside their hub's component, within the hub's ball
    lab = labels.withColumnRenamed("label", "comp")
    ball = star.join(lab, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    ball = ball.join(labels.toDF("hub", "hub_comp"), "hub", "left").withColumn("stray", F.col("comp") != F.coalesce("hub_comp", "hub"))
    # written before it is counted by hub, so that a hot hub's join can be split
    found = cut(ball.select("hub", "node", "comp", "far", "size", "stray"), "ball-members")
    # a lone stray that can reach nobody needs no comparison
    stray = F.col("stray").cast("int")
    many = found.groupBy("hub").agg(F.sum(stray).alias("strays"), F.sum(stray * F.col("size")).alias("own"), F.count("*").alias("n"), F.sum("size").alias("all"))
    many = many.where("strays > 0 AND n > 1").select(
        "hub", _chunks(F.col("strays"), BLOCK, F.col("own")).alias("ni"), _chunks(F.col("n"), BLOCK, F.col("all")).alias("nj")
    )
    many = cut(many, "ball-sizes")
    ball = cut(found.drop("size").join(many, "hub"), "balls")
    discard(found, many)
    cell = ball.withColumn("i", _dealt(F.col("ni"))).withColumn("j", _dealt(F.col("nj")))
    left = cell.where("stray").select("hub", "i", F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), "stray", "node", "comp", "far")
    right = cell.select("hub", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), "j", F.lit(False).alias("stray"), "node", "comp", "far")
    laid = left.union(right).join(texts, "node").select("hub", "i", "j", "stray", "node", "comp", "far", "text")
    laid = laid.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    more = laid.mapInPandas(_blocks(shingle, percent), "a long, b long")
    upper = components(more)
    ends = follow(labels.unionByName(need.join(labels, "node", "left_anti").withColumn("label", F.col("node"))), upper)
    ends = cut(ends, "near-labels")
    discard(hubs, spread, pairs, texts, star, labels, ball, upper)

    found = classes.join(ends.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("label", "rep").alias("component"))
    # rows without a set go past the join, where they would be one key
    alone = sig.where("doc IS NULL OR n_shingles = 0").select("doc", "row", "n_shingles", F.col("doc").alias("component"))
    return full.join(found, ["k1", "k2"]).select("doc", "row", "n_shingles", "component").unionByName(alone)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    out = _labelled(docs, id_col, text_col, shingle, percent, bands, rows)
    kept = F.coalesce(F.col("doc") == F.col("component"), F.lit(True))
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
                            bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The kept rows of ``docs``, unchanged.  Each row is judged by its own text: of
    two rows with one id the one may stay and the other go."""
    out = _labelled(docs, id_col, text_col, shingle, percent, bands, rows)
    gone = out.where("doc <> component").select(F.col("doc").alias("__doc"), F.col("row").alias("__row")).distinct()
    # their number grows with the input: never broadcast
    same = (F.col(id_col).cast("long") == F.col("__doc")) & (F.xxhash64(F.col(text_col)) == F.col("__row"))
    return docs.join(gone.hint("merge"), same, "left_anti")
