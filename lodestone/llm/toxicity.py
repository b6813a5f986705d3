"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

Words are runs without ASCII white space, lower-cased and stripped of signs at both
ends.  Two lexicons are looked up: ``SEEDS``, insults of four languages, and *stems*,
beginnings of 3 to 8 letters (or whole words) that labelled toxic documents hold more
often than others by a z score of the smoothed log odds.  The features of a text:
densities of both lexicons, the densest window of 50 words, the strongest stem, the share of hits within
five words of a second-person pronoun, shares of capitals and of words all in
capitals, exclamation and question marks, other signs, and obfuscation: digits or
signs among letters, letters stretched or spelled out, words that are hits only once
that is undone.

Of labelled near copies, which share the least values of two hashes of five words, one is kept.
The stems are learned by five folds: a training row's features use stems learned from
the other folds, so the trees see densities as unseen texts have them.  The trees
(depth 3, logistic loss, histograms) are fitted on the rows of all folds; isotonic
regression maps raw scores to probabilities, fitted on scores that each fold gets from
trees grown on the others.

The sample has at most ``sample`` labelled rows (the smallest by a hash of the id),
none of them held out, and at most ``stems`` stems are kept, the strongest.  All else
covers all rows and whole texts.  Held out are rows whose crc32 of the id as text is
0 modulo 5.  Scores take the text only.

Null and empty texts have no words and still get a score.  A null id is not held out
and never trained on.  Without labels of both kinds every score is the share of label
1, or 0.5.  A document with several labels counts as 1 if any is.  Rows that repeat an
id each get their score; the sample takes one of them.  Texts of any length are read
whole.  Other columns are not read, so their names can't clash.  An empty table gives
no rows."""

from __future__ import annotations

import dataclasses
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, discard, id_array, id_text, parts, quoted
from ._text import IdCache, flat, is_space, mix, slabs, span_hashes, words
from .decontaminate import _Lower
from .token_store import _Classes

SAMPLE, STEMS, FOLDS, WINDOW, NEAR = 16_000, 20_000, 5, 50, 5

#: Insults by language, and second-person words.
SEEDS = {
    "en": "idiot moron loser scum worthless trash stupid pathetic disgusting clown dumb dumbass jerk asshole bastard bitch crap garbage vermin filth ugly "
    "retard pig coward liar freak creep hag fool imbecile cretin halfwit dimwit nitwit scumbag douchebag bullshit shit fuck fucking fucker hate kill",
    "de": "idiot dummkopf trottel arschloch scheiße abschaum versager depp vollidiot mistkerl schwachkopf wichser hurensohn drecksau widerlich erbärmlich wertlos "
    "dumm blöd hässlich abschaum gesindel",
    "fr": "idiot imbécile crétin connard connasse salaud salope merde débile abruti ordure raclure minable dégoûtant pathétique stupide nul pourriture enfoiré clown",
    "es": "idiota imbécil estúpido estúpida gilipollas cabrón mierda basura escoria patético asqueroso inútil payaso perdedor tonto maldito hijueputa puta cerdo",
}
YOU = (
    "you your yours yourself u ur youre you're you've du dich dir dein deine deiner deinen euch euer ihr tu te toi ton ta tes vous votre vos t'es tú ti tus usted ustedes vosotros vuestro contigo"
).split()
_PLAIN = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "|": "l", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t"})
_ENDS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$*") + "«»“”„‘’¿¡…–—"
_FEATURES = 23


class Lexicon:
    """What is known of a word: (seed, hidden hit, stem weight in 1/100, second
    person, obfuscated, stretched)."""

    def __init__(self, stems: dict[str, int]):
        self.stems = stems
        self.seeds = {w for ws in SEEDS.values() for w in ws.split()}
        self.masked: dict[tuple[int, str], list[str]] = {}
        for w in sorted(self.seeds):
            self.masked.setdefault((len(w), w[0]), []).append(w)

    def weight(self, word: str) -> int:
        get = self.stems.get
        return max([get(word[:k], 0) for k in range(3, 9) if k <= len(word)] + [get("=" + word, 0)])

    def _seed(self, word: str) -> bool:
        return word in self.seeds or (word.endswith("s") and word[:-1] in self.seeds)

    def __call__(self, found: list[str]) -> list[tuple]:
        return [self.word(w.strip(_ENDS)) for w in found]

    def word(self, w: str) -> tuple:
        if w.isalpha() and not re.search(r"(.)\1\1", w):
            return (int(self._seed(w)), 0, self.weight(w), int(w in YOU), 0, 0)
        plain = "".join(c for c in w if c.isalpha())
        opened = "".join(c for c in w.translate(_PLAIN) if c.isalpha())
        stretched = int(re.search(r"([^\W\d_])\1\1", w) is not None)
        odd = int(bool(plain) and re.search(r"[^\W\d_][\d@$*!|+._\-]+[^\W\d_]", w) is not None)
        seed, weight = self._seed(w), self.weight(w)
        forms = {opened, re.sub(r"(.)\1\1+", r"\1", opened), re.sub(r"(.)\1\1+", r"\1\1", opened), plain} - {w}
        hidden = any(self._seed(f) for f in forms) or (
            "*" in w[1:] and any(all(a in ("*", b) for a, b in zip(w, s)) for s in self.masked.get((len(w), w[0]), ()))
        )
        return (int(seed), int(hidden and not seed), max([weight, *(self.weight(f) for f in forms)]), int(w in YOU), odd, stretched)


def features(texts: list, cache: IdCache) -> np.ndarray:
    """(texts, ``_FEATURES``)."""
    out = np.zeros((len(texts), _FEATURES))
    for base, part in slabs(texts, 1 << 19):
        cp, starts = flat(part)
        low = _Lower.get()[cp]
        s, e, first = words(low, starts)
        n, rows = np.diff(first), np.arange(base, base + len(part))
        doc = np.repeat(np.arange(len(part)), n)
        slot = cache.rows(low, s, e, span_hashes(low, s, e))
        # six entries a word
        seed, hidden, weight, you, odd, stretched = (cache.ids[cache.offsets[slot] + k].astype(np.int64) for k in range(6))

        def each(x):
            return np.bincount(doc, weights=x, minlength=len(part))

        def share(x, of):
            return x / np.maximum(of, 1)

        hit = (seed + hidden > 0) | (weight >= 400)
        upto = np.concatenate([[0], np.cumsum(hit)])
        # hits in the window that starts at each word, cut at its text's end
        window = upto[np.minimum(np.arange(len(s)) + WINDOW, first[doc + 1])] - upto[:-1]
        most = np.zeros(len(part))
        np.maximum.at(most, doc, window)
        peak = np.zeros(len(part))
        np.maximum.at(peak, doc, weight)
        spoken = np.concatenate([[0], np.cumsum(you)])
        at = np.arange(len(s))
        near = spoken[np.minimum(at + NEAR + 1, first[doc + 1])] - spoken[np.maximum(at - NEAR, first[doc])] > 0
        kind = _Classes.get()[cp]
        upper, letter = np.concatenate([[0], np.cumsum(low != cp)]), np.concatenate([[0], np.cumsum(kind == 2)])
        shout = (upper[e] - upper[s] == e - s) & (e - s > 1) | (upper[e] - upper[s] > 2) & (upper[e] - upper[s] == letter[e] - letter[s])
        single = (letter[e] - letter[s] == 1) & (e - s <= 2)
        run = np.concatenate([[0], np.cumsum(single)])
        spelled = single & (at >= first[doc] + 3) & (run[at + 1] - run[np.maximum(at - 3, 0)] == 4)

        def signs(what):
            c = np.concatenate([[0], np.cumsum(what)])
            return (c[starts[1:] - 1] - c[starts[:-1]]).astype(float)

        chars, letters = np.diff(starts) - 1, signs(kind == 2)
        out[rows] = np.column_stack([
            np.log1p(n), share(each(seed), n), np.log1p(each(seed)), share(each(weight >= 300), n), share(each(weight >= 500), n), share(each(weight) / 100, n),
            np.log1p(each(weight >= 400)), most / WINDOW, share(each(hit & near), n), share(each(you), n), share(signs(low != cp), letters), share(each(shout), n),
            share(signs(cp == 33), chars), share(signs(cp == 63), chars), share(signs((kind == 4) & ~is_space(cp)), chars), share(signs(kind == 3), chars),
            share(each(odd), n), share(each(stretched), n), share(each(hidden), n), share(each(spelled), n),
            share(each(weight >= 800), n), np.log1p(each(weight >= 800)), peak / 100,
        ])
    return out


def signatures(texts: list) -> np.ndarray:
    """The least values of each text's runs of five words (or of fewer, if it has no
    more) under two hashes; near copies mostly have the same."""
    out = np.zeros((2, len(texts)), np.int64)
    for base, part in slabs(texts, 1 << 19):
        cp, starts = flat(part)
        low = _Lower.get()[cp]
        s, e, first = words(low, starts)
        h = span_hashes(low, s, e)
        for i in range(len(part)):
            own = h[first[i] : first[i + 1]]
            if len(own):
                k = min(5, len(own))
                run = sum(own[j : len(own) - k + 1 + j] * np.uint64(2 * j + 3) for j in range(k))
                for j, other in enumerate((run, run ^ np.uint64(0x9E3779B97F4A7C15))):
                    out[j, base + i] = (mix(other).min() >> np.uint64(1)).astype(np.int64)
    return out


def stem_counts(texts: list) -> Counter:
    """Texts that hold each beginning, and each whole word (marked by =)."""
    found: Counter = Counter()
    for t in texts:
        own = {w for w in (x.strip(_ENDS) for x in (t or "").lower().split()) if len(w) > 2 and w.isalpha()}
        found.update({w[:k] for w in own for k in range(3, min(8, len(w)) + 1)} | {"=" + w for w in own})
    return found


def _z(toxic, clean, n_toxic, n_clean):
    """z score of the smoothed log odds that a toxic text holds a stem."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return odds / np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


@dataclasses.dataclass
class Trees:
    """Boosted trees of depth 3 on binned features: 7 splits and 8 leaves each."""

    cuts: list[np.ndarray]
    base: float = 0.0
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = dataclasses.field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(self.cuts)]).astype(np.int64).reshape(len(x), len(self.cuts))

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.full(len(x), self.base)
        for feature, cut_at, leaf in self.nodes:
            out += leaf[_leaf(b, feature, cut_at)]
        return out


def _leaf(b: np.ndarray, feature: np.ndarray, cut_at: np.ndarray) -> np.ndarray:
    node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
    for level in range(3):
        at = (1 << level) - 1 + node
        node = 2 * node + (b[rows, feature[at]] > cut_at[at])
    return node


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.15, bins: int = 32, ridge: float = 1.0, least: float = 1.0) -> Trees:
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    # rare non-zero values have cuts of their own
    cuts = [np.unique(np.concatenate([c, np.quantile(v[v > 0], np.linspace(0, 1, 9)[:-1]) * (1 - 1e-9)])) if (v > 0).any() else c for c, v in zip(cuts, x.T)]
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Trees(cuts, math.log(share / (1 - share)))
    b, d, width = model.binned(x), x.shape[1], max(map(len, cuts)) + 1
    raw = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, cut_at = np.zeros(7, np.int64), np.full(7, width, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(3):
            k = 1 << level
            key = ((node[:, None] * d + np.arange(d)) * width + b).ravel()
            sums = [np.bincount(key, np.repeat(v, d), k * d * width).reshape(k, d, width) for v in (g, h)]
            left = [np.cumsum(v, 2) for v in sums]
            right = [v[:, :, -1:] - v for v in left]
            gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge)
            gain[(left[1] < least) | (right[1] < least)] = -1
            best = gain.reshape(k, -1).argmax(1)
            ok = gain.reshape(k, -1)[np.arange(k), best] > 0
            feature[k - 1 : 2 * k - 1] = np.where(ok, best // width, 0)
            cut_at[k - 1 : 2 * k - 1] = np.where(ok, best % width, width)
            at = k - 1 + node
            node = 2 * node + (b[np.arange(len(y)), feature[at]] > cut_at[at])
        leaf = rate * np.bincount(node, g, 8) / (np.bincount(node, h, 8) + ridge)
        model.nodes.append((feature, cut_at, leaf))
        raw += leaf[node]
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean raw score and probability of each pool."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # sum of y, rows, sum of raw
    for r, v in zip(raw[order], y[order]):
        pools.append([v, 1, r])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    at = np.array([p[2] / p[1] for p in pools])
    edge = 1 / (len(y) + 2)
    return at, np.clip([p[0] / p[1] for p in pools], edge, 1 - edge)


@dataclasses.dataclass
class Model:
    stems: dict[str, int]
    trees: Trees | None
    at: np.ndarray
    probability: np.ndarray
    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        raw = self.trees.raw(x)
        # a thousandth of the raw score keeps the order inside a pool
        return 0.999 * np.interp(raw, self.at, self.probability) + 0.001 / (1 + np.exp(-raw))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE, stems: int = STEMS) -> Model:
    known = labels.where(quoted(label_col).isin(0, 1) & quoted(id_col).isNotNull()).groupBy(quoted(id_col).cast("long").alias("__id")).agg(F.max(quoted(label_col)).cast("int").alias("__y"))
    bucket = F.crc32(F.col("__id").cast("string").cast("binary")) % 5
    # at most ``sample`` rows: bounded, so both the join side and what is collected are
    known = known.where(bucket != 0).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    texts = docs.select(quoted(id_col).cast("long").alias("__id"), quoted(text_col).alias("__text"))
    rows = texts.join(F.broadcast(known), "__id").groupBy("__id", "__y").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))

    def sign(batches):
        for pdf in batches:
            a, b = signatures(pdf["__text"].tolist())
            yield pdf.assign(__sign=a, __more=b)

    # near copies have one signature: one of them is enough, and none may be in two folds
    rows = rows.mapInPandas(sign, "__id long, __y int, __text string, __sign long, __more long").groupBy("__sign", "__more", "__y").agg(F.min_by(F.struct("__id", "__text"), "__id").alias("r"))
    rows = cut(rows.select("r.*", "__y", F.pmod("__sign", F.lit(FOLDS)).cast("int").alias("__fold")), "labelled-sample")
    cells = {(r["__fold"], r["__y"]): r["count"] for r in rows.groupBy("__fold", "__y").count().collect()}
    per = np.array([[cells.get((f, y), 0) for f in range(FOLDS)] for y in (0, 1)], float)
    total = per.sum()
    if not per.sum(1).all():
        discard(rows)
        return Model({}, None, np.zeros(1), np.zeros(1), float(per[1].sum() / total) if total else 0.5)

    names = [f"n{y}{f}" for y in (0, 1) for f in range(FOLDS)]

    def count(batches):
        import pandas as pd

        for pdf in batches:
            for (y, f), own in pdf.groupby(["__y", "__fold"]):
                held = own["__text"].tolist()
                for a, b in parts(held):
                    c = stem_counts(held[a:b])
                    yield pd.DataFrame({"stem": list(c), "y": y, "f": f, "n": list(c.values())})

    found = rows.mapInPandas(count, "stem string, y int, f int, n long")
    found = found.groupBy("stem").agg(*[F.sum(F.when((F.col("y") == int(c[1])) & (F.col("f") == int(c[2:])), F.col("n")).otherwise(0)).alias(c) for c in names])
    toxic, clean = (sum(F.col(f"n{y}{f}") for f in range(FOLDS)) for y in (1, 0))
    odds = F.ln((toxic + 0.5) / (per[1].sum() + 1)) - F.ln((clean + 0.5) / (per[0].sum() + 1))
    z = odds / F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    # the strongest ``stems``: a bounded table
    top = found.where(toxic >= 3).withColumn("z", z).where("z > 2").orderBy(F.desc("z"), "stem").limit(stems).toArrow()
    word, n = top["stem"].to_pylist(), np.array([top[c].to_numpy() for c in names], float).reshape(2, FOLDS, -1)

    def model(without: int | None) -> dict[str, int]:
        use = [f for f in range(FOLDS) if f != without]
        t, c = n[1, use].sum(0), n[0, use].sum(0)
        score = _z(t, c, per[1, use].sum(), per[0, use].sum())
        return {w: int(v * 100) for w, v in zip(word, score) if v > 2}

    folded = [model(f) for f in range(FOLDS)]

    def measure(batches):
        import pandas as pd

        caches: dict[int, IdCache] = {}
        for pdf in batches:
            for f, own in pdf.groupby("__fold"):
                cache = caches.setdefault(f, IdCache(Lexicon(folded[f]), 200_000))
                yield pd.DataFrame({"id": own["__id"], "y": own["__y"], "fold": own["__fold"], "x": list(features(own["__text"].tolist(), cache))})

    got = sorted(rows.mapInPandas(measure, "id long, y int, fold int, x array<double>").collect(), key=lambda r: r.id)
    x, y, fold = np.array([r.x for r in got]), np.array([r.y for r in got], float), np.array([r.fold for r in got])
    discard(rows)
    raw = np.zeros(len(y))
    for f in range(FOLDS):
        own = fold == f
        if own.any():
            raw[own] = boost(x[~own], y[~own]).raw(x[own]) if (~own).any() else 0
    at, probability = isotonic(raw, y)
    return Model(model(None), boost(x, y), at, probability, float(y.mean()))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5,
                   sample: int = SAMPLE, stems: int = STEMS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    fitted = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample, stems=stems)

    def score(batches):
        import pandas as pd

        cache = IdCache(Lexicon(fitted.stems), 400_000)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": id_array(pdf["__id"]), "score": fitted.scores(features(pdf["__text"].tolist(), cache))})

    rows = docs.select(id_text(quoted(id_col)).alias("__id"), quoted(text_col).alias("__text"))
    out = rows.mapInPandas(score, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
