"""Quality classifier: random-indexing word vectors, a two-layer network and
temperature calibration.

Words are runs of letters (lower-cased; written all in capitals they are another
word), runs of digits (one word for all) and runs of other signs.  Words fall
into ``BUCKETS`` by hash.  Every bucket has a fixed sparse ternary *index
vector*; the *word vector* of a bucket is the normalised sum of the index
vectors of its neighbours within ``SPAN`` words over all documents, labelled or
not, or its own index vector where they hold it fewer than ``LEAST`` times.  A
document is the mean of its words' vectors with the mean's length, the log of
the word count and the share of distinct words.

A network with one hidden layer of tanh units and a logistic output is fitted in
numpy; its logit is divided by a temperature chosen on training rows kept out of
the fit.  The sample has at most ``sample`` labelled rows (the smallest by a hash
of the id), all of them rows that are not held out; it serves the network and the
temperature alone, and everything else covers all rows and whole texts.

Held out are rows whose crc32 of the id as text is 0 modulo 5.  Scores take the
text only.  Null and empty texts have a zero vector and still get a score.  A
null id is not held out and never trained on.  Without labels of both kinds
every score is the share of label 1, or 0.5.  A document with several labels
counts as 1 if any is.  Rows that repeat an id each get their score; the sample
takes one of them.  A text of any length is read whole.  Other
columns are not read, so their names can't clash.  An empty table gives no
rows."""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, discard, id_array, id_text, parts
from ._text import flat, mix, slabs, span_hashes, spans
from .decontaminate import _Lower
from .token_store import _Classes

DIM, BUCKETS, SPAN, LEAST = 64, 1 << 14, 2, 5
SAMPLE = 8000


def _entries(nonzero: int = 8):
    """(place, +1 or -1) of each entry of all buckets' index vectors, from hashes."""
    for j in range(nonzero):
        h = mix(np.arange(BUCKETS).astype(np.uint64) * np.uint64(nonzero) + np.uint64(j + 1))
        yield (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1)


def index_vectors() -> np.ndarray:
    """A sparse vector of +1 and -1 for each bucket."""
    out = np.zeros((BUCKETS, DIM), np.float32)
    for place, sign in _entries():
        out[np.arange(BUCKETS), place] += sign
    return out


def word_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word, and the number of each text's first word."""
    cp, starts = flat(texts)
    kind = _Classes.get()[cp]
    edge = np.flatnonzero(np.diff(kind, prepend=255) != 0)
    s, e = edge, np.append(edge[1:], len(cp))
    word = kind[s] >= 2
    s, e = s[word], e[word]
    low = _Lower.get()[cp]
    upper = np.concatenate([[0], np.cumsum(low != cp)])
    h = span_hashes(low, s, e)
    h[(upper[e] - upper[s] == e - s) & (e - s > 1)] ^= np.uint64(0x5BD1E995)
    h[kind[s] == 3] = np.uint64(77)
    return (mix(h) % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(s, starts)


def contexts(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(count, summed index vectors of neighbours) of each bucket over texts."""
    entries = list(_entries())
    count, total = np.zeros(BUCKETS, np.int64), np.zeros((BUCKETS, DIM), np.float64)
    for _, part in slabs(texts, 1 << 20):
        b, first = word_buckets(part)
        doc = np.repeat(np.arange(len(part)), np.diff(first))
        count += np.bincount(b, minlength=BUCKETS)
        pairs = []
        for step in range(1, SPAN + 1):
            same = np.flatnonzero(doc[:-step] == doc[step:]) if len(b) > step else np.empty(0, int)
            pairs += [b[same] * BUCKETS + b[same + step], b[same + step] * BUCKETS + b[same]]
        # each pair of buckets once, with its times; sorted by the first
        key = np.sort(np.concatenate(pairs))
        at = np.flatnonzero(np.diff(key, prepend=-1))
        times, x, y = np.diff(np.append(at, len(key))), key[at] // BUCKETS, key[at] % BUCKETS
        for place, sign in entries:
            total += np.bincount(x * DIM + place[y], weights=sign[y] * times, minlength=BUCKETS * DIM).reshape(BUCKETS, DIM)
    return count, total


def vectors(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    def unit(x):
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    return np.where((count >= LEAST)[:, None], unit(total), unit(index_vectors())).astype(np.float32)


def features(texts: list, table: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), DIM + 3))
    for base, part in slabs(texts, 1 << 19):
        b, first = word_buckets(part)
        n = np.diff(first)
        key, counts = np.unique(np.repeat(np.arange(len(part)), n) * BUCKETS + b, return_counts=True)
        doc, bucket = key // BUCKETS, key % BUCKETS
        heads = np.flatnonzero(np.diff(doc, prepend=-1))
        rows = base + doc[heads]
        if len(heads):
            out[rows, :DIM] = np.add.reduceat(table[bucket] * counts[:, None].astype(np.float32), heads, axis=0) / n[doc[heads]][:, None]
            out[rows, DIM + 2] = np.diff(np.append(heads, len(doc))) / n[doc[heads]]
        out[base : base + len(part), DIM + 1] = np.log1p(n)
    out[:, DIM] = np.linalg.norm(out[:, :DIM], axis=1)
    return out


@dataclasses.dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, aside: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 7) -> Network:
    """Adam on the cross entropy of rows not ``aside``; the temperature is the
    best of a grid on the rows ``aside``."""
    share = float(y.mean()) if len(y) else 0.5
    d = x.shape[1]
    net = Network(x.mean(0) if len(x) else np.zeros(d), x.std(0) + 1e-6 if len(x) else np.ones(d), np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    if share in (0.0, 1.0) or not len(y):
        net.b2 = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return net
    rng = np.random.default_rng(seed)
    net.w1, net.w2 = rng.normal(0, d**-0.5, (d, hidden)), rng.normal(0, hidden**-0.5, hidden)
    net.b2 = float(np.log(share / (1 - share)))
    own = np.flatnonzero(~aside) if (~aside).any() else np.arange(len(y))
    z = (x - net.mean) / net.scale
    p = [net.w1, net.b1, net.w2, np.array(net.b2)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(own), max(1, len(own) // 64)):
            a = np.tanh(z[batch] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -40, 40))) - y[batch]) / len(batch)
            back = g[:, None] * p[2] * (1 - a * a)
            grads = [z[batch].T @ back + 1e-3 * p[0], back.sum(0), a.T @ g + 1e-3 * p[2], g.sum()]
            t += 1
            for k, gr in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * gr
                v[k] = 0.999 * v[k] + 0.001 * gr * gr
                p[k] = p[k] - 2e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3])
    if aside.any():
        logit, target = net.logits(x[aside]), y[aside]
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.logaddexp(0, -np.where(target == 1, 1, -1) * logit / g).mean() for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    bucket = F.crc32(F.col("__id").cast("string").cast("binary")) % 5
    # at most ``sample`` rows: bounded, so both the join side and what is collected are
    known = known.where(bucket != 0).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    # written once: one scan of the documents, one row an id, so at most ``sample`` rows
    train = texts.join(F.broadcast(known), "__id").groupBy("__id", "__y").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))
    train = cut(train, "labelled-sample")

    # every text counts here, labelled or not: sums of whole numbers by bucket
    sums = [f"v{k}" for k in range(DIM)]

    def gather(batches):
        import pandas as pd

        count, total = np.zeros(BUCKETS, np.int64), np.zeros((BUCKETS, DIM))
        for pdf in batches:
            held = pdf["__text"].tolist()
            for a, b in parts(held):
                c, t = contexts(held[a:b])
                count, total = count + c, total + t
        at = np.flatnonzero(count)
        yield pd.DataFrame(np.column_stack([at, count[at], total[at].astype(np.int64)]), columns=["b", "n", *sums])

    found = (
        texts.select("__text").mapInPandas(gather, ", ".join(f"{c} long" for c in ["b", "n", *sums]))
        .groupBy("b").agg(*[F.sum(c).alias(c) for c in ["n", *sums]]).toArrow()
    )
    count, total = np.zeros(BUCKETS, np.int64), np.zeros((BUCKETS, DIM))
    at = found["b"].to_numpy()
    count[at] = found["n"].to_numpy()
    for k, c in enumerate(sums):
        total[at, k] = found[c].to_numpy()
    table = vectors(count, total)

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            x = features(pdf["__text"].tolist(), table)
            yield pd.DataFrame({"id": pdf["__id"], "y": pdf["__y"], "x": list(x)})

    got = sorted(train.mapInPandas(rows, "id long, y int, x array<double>").collect(), key=lambda r: (r.id, r.x))
    x, y = np.array([r.x for r in got]).reshape(-1, DIM + 3), np.array([r.y for r in got], float)
    discard(train)
    aside = mix(np.array([r.id for r in got], np.int64).view(np.uint64)) % np.uint64(5) == 0
    net = fit(x, y, aside)

    def score(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"doc_id": id_array(pdf["__id"]), "score": net.scores(features(pdf["__text"].tolist(), table))})

    out = texts.withColumn("__id", id_text(F.col("__id"))).mapInPandas(score, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
