"""Toxicity, importance resampling and the filter audit against brute force."""

import itertools
import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from lodestone.llm import filter_audit, importance, toxicity
from lodestone.llm._text import IdCache

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# ---- importance ------------------------------------------------------------
def _words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _grams(text, n):
    w = _words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def _plain(docs, target, n, buckets, least, percent, seed=2024):
    def counts(texts):
        return Counter(zlib.crc32(g.encode()) % buckets for t in texts for g in _grams(t, n))

    s, t = counts(x for _, x in docs), counts(target)
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        g = [zlib.crc32(x.encode()) % buckets for x in _grams(text, n)]
        gained = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in g]
        weight = sum(gained) // len(g) if g else 0
        score = None
        if i is not None:
            h = int(sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(g), weight, score, None, len(_words(text))])
    able = [r for r in rows if r[5] >= least]
    for k, r in enumerate(sorted((r for r in able if r[3] is not None), key=lambda r: (-r[3], r[0]))[: percent * len(able) // 100], 1):
        r[4] = k
    return rows


DOCS = [
    (1, "The quick brown fox, the lazy dog"), (2, None), (3, ""), (4, "  \n\t "), (5, "ÄÖ straße ß Ünder 漢字 emoji😀word x" * 40), (6, "a " * 3000), (7, "one-two_three4four"),
    (8, "w" * 5000 + " tail"), (9, "The quick brown fox, the lazy dog"), (9, "another text of the same id"), (9, "another text of the same id"), (2**60 + 3, "far id words " * 30), (None, "no id " * 40), (-7, "negative id " * 15),
]


@pytest.mark.parametrize("n", [1, 3])
def test_importance_equals_brute_force(spark, n):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    target = ["the quick dog jumps", "words of a far land", None, "漢字 straße"]
    got = importance.resample(docs, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), n=n, buckets=97, least_words=5, percent=40, chunk=64)
    want = _plain(DOCS, target, n, 97, 5, 40)

    def key(rows):
        return sorted((tuple(r) for r in rows), key=repr)

    assert key((r.doc_id, r.n_features, r.weight, r.score, r["rank"], r.n_words) for r in got.collect()) == key(want)


def test_chunks_own_every_start_once():
    text = " ".join(f"w{i}" for i in range(103)) + ", end!"
    for most, n in ((1, 1), (7, 3), (200, 2)):
        made = list(importance.chunks(text, most, n))
        assert sum(own for _, own in made) == 104
        parts = [importance.feature_buckets([t], [own], n, 1 << 30)[0].tolist() for t, own in made]
        whole = importance.feature_buckets([text], [None], n, 1 << 30)[0].tolist()
        assert sorted(sum(parts, [])) == sorted(whole)


def test_crc_of_joined_runs():
    words = [b"a", b"bc", b"x" * 100, "ß漢".encode()]
    for k, (a, b) in enumerate(itertools.product(words, words)):
        left, right = (np.array([zlib.crc32(x)], np.uint32) for x in (a, b))
        assert int(importance.joined(left, right, np.array([len(b)]))[0]) == zlib.crc32(a + b), k


def test_importance_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(none, items).count() == 0
    got = importance.resample(spark.createDataFrame([(1, "a b c " * 10), (2, "a")], "doc_id long, text string"), items, percent=100).collect()
    assert sorted((r.doc_id, r["rank"]) for r in got) == [(1, 1), (2, None)]


def test_importance_takes_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b " * 20, 5, 6, 7)], "doc_id long, text string, h long, score long, `rank` long")
    items = spark.createDataFrame([(1, "a", 3)], "item_id long, text string, n long")
    assert importance.resample(docs, items, percent=100).first()["rank"] == 1


# ---- filter audit ----------------------------------------------------------
def _mask(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), bool(re.search(r"[#$%&*|]", text))]


def _audit(docs, labels):
    texts = [(i, t or "", lang or "") for i, t, lang in docs]
    least = {}
    for i, t, _ in texts:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = [(p, i, [*_mask(t), i is not None and i > least[t]]) for i, t, p in texts]
    out = Counter()
    for p in {p for p, *_ in rows}:
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                out[p, "".join(order), k + 1] = np.zeros(7, int)
    for p, i, m in rows:
        fails = {f for f, x in zip("ABCDE", m) if x}
        for order in itertools.permutations("ABCDE"):
            gone = next((k for k, f in enumerate(order) if f in fails), 5)
            for k, f in enumerate(order):
                share = 120 // len(fails) if f in fails else 0
                out[p, "".join(order), k + 1] += [gone > k, gone == k, f in fails and gone < k, fails == {f}, gone == k and i in good, gone == k and i in toxic, share]
    return {k: tuple(v.tolist()) for k, v in out.items()}


def _collected(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in df.collect()}


def test_audit_equals_brute_force(spark):
    long = " ".join(f"word{i}" for i in range(250))
    docs = [(i, long, ["en", "de", None][i % 3]) for i in range(60)]  # copies over many tasks
    docs += [(100 + i, t, "en") for i, t in enumerate([None, "", "ABC def", "a # b", "x " * 300, long + " $", long.upper(), "ABC def", "  \t"])]
    docs += [(200, long, "fr"), (200, long, "fr"), (200, "other", "fr"), (None, long, "en"), (None, None, None), (3, long + "!", "")]
    labels = [(1, 1, 0), (2, 0, 1), (103, 1, 1), (103, 0, None), (200, None, 1), (None, 1, 1), (7, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert _collected(got) == _audit(docs, labels)


def test_audit_boundaries_and_colliding_fingerprints(monkeypatch):
    """Copies over task boundaries, and texts that share a fingerprint."""
    import pandas as pd

    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        rows = sorted({(int(rng.integers(0, 3)), int(rng.integers(0, 60))) for _ in range(n)})  # dealt by (fp, id)
        texts = {r: f"t{r[0]}{rng.integers(0, 3)}" for r in rows}
        cuts = sorted(rng.integers(0, len(rows) + 1, 3).tolist())
        least = {}
        for r in rows:
            least[texts[r]] = min(r[1], least.get(texts[r], r[1]))
        found, heads, tails = {}, [], []
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            own = sorted(((fp, texts[fp, i], i) for fp, i in rows[a:b]))
            step = int(rng.integers(1, 6))
            batches = [pd.DataFrame([("p", i, fp, t, 0) for fp, t, i in own[k : k + step]], columns=["part", "id", "fp", "text", "mask"]) for k in range(0, len(own), step)]
            for out in filter_audit._compare(iter(batches)):
                for r in out.itertuples():
                    (heads if r.kind == "head" else tails).append(r) if r.kind != "row" else found.update({(r.fp, r.id): r.mask})
        for h in heads:
            found[h.fp, h.id] = 16 if any(t.fp == h.fp and t.text == h.text and t.id < h.id for t in tails) else h.mask
        assert found == {r: 16 if r[1] > least[texts[r]] else 0 for r in rows}


def test_audit_of_an_empty_table_and_clashing_names(spark):
    labels = spark.createDataFrame([(1, 1, 0, 4)], "doc_id long, quality int, toxic int, part int")
    assert filter_audit.audit(spark.createDataFrame([], "doc_id long, text string, lang string"), labels).count() == 0
    docs = spark.createDataFrame([(1, "A", "en", 1, 2, "x")], "doc_id long, text string, lang string, fp long, mask int, part string")
    rows = _collected(filter_audit.audit(docs, labels))
    assert len(rows) == 600 and rows["en", "ABCDE", 1] == (0, 1, 0, 0, 1, 0, 60)


# ---- toxicity --------------------------------------------------------------
def test_words_behind_a_disguise():
    lex = toxicity.Lexicon({"gramb": 600, "=zork": 450})
    assert lex(["idiot", "idiots", "table", "you"]) == [(1, 0, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0), (0, 0, 0, 1, 0, 0)]
    assert [lex([w])[0][1] for w in ("1d10t", "i.d.i.o.t", "st*pid", "stuuuupid", "m0r0n", "tr@sh!", "taable", "x1y2")] == [1, 1, 1, 1, 1, 1, 0, 0]
    assert [lex([w])[0][2] for w in ("grambling", "zork", "zorks", "gr4mbl3")] == [600, 450, 0, 600]


def test_features_equal_a_plain_count():
    texts = ["You are an idiot, a stupid STUPID clown!!", None, "", "calm words here only", "s t u p i d you", "x" * 70000 + " idiot"]
    got = toxicity.features(texts, IdCache(toxicity.Lexicon({})))
    n = [len((t or "").split()) for t in texts]
    assert np.allclose(np.expm1(got[:, 0]), n)
    assert np.allclose(got[:, 1], [4 / 8, 0, 0, 0, 0, 1 / 2])
    assert np.allclose(got[:, 12], [2 / len(texts[0]), 0, 0, 0, 0, 0])
    assert got[0, 8] == 2 / 8 and got[4, 19] == 3 / 7 and not got[1].any() and not got[2].any()


def test_isotonic_is_monotone_and_the_best_step_function():
    rng = np.random.default_rng(1)
    raw = rng.normal(size=200)
    y = (rng.random(200) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    at, p = toxicity.isotonic(raw, y)
    assert (np.diff(at) > 0).all() and (np.diff(p) >= 0).all()
    # min-max formula of isotonic regression
    s = y[np.argsort(raw)]
    best = [max(min(s[a : b + 1].mean() for b in range(i, 200)) for a in range(i + 1)) for i in (0, 50, 120, 199)]
    order = np.sort(raw)
    pool = [p[np.searchsorted([order[0], *((at[1:] + at[:-1]) / 2)], order[i], "right") - 1] for i in (0, 199)]
    assert np.isclose(pool[0], np.clip(best[0], 1 / 202, 1)) and np.isclose(pool[1], np.clip(best[3], 0, 1 - 1 / 202))


def test_trees_fit_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = toxicity.boost(x[:1500], y[:1500])
    assert ((model.raw(x[1500:]) > 0) == y[1500:]).mean() > 0.97


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(3)
    base = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("no", "sta", "ver", "lim", "dor", "pa")]
    docs, labels = [], []
    for i in range(1500):
        w = rng.choice(base, 120).tolist()
        bad = i % 6 == 0
        if bad:
            for p in rng.integers(0, 120, 4):
                w[p] = ["idiot", "worthless", "zorgen" + base[p % 30], "zorgat" + base[p % 30]][int(rng.integers(0, 4)) if i % 12 else 2]
        docs.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    docs += [(9001, None, None, None, None), (9002, "", None, None, None), (None, "idiot", None, None, None), (5, docs[5][1], "en", "s", 1)]
    got = toxicity.score_toxicity(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out and r.doc_id < 1500]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_toxicity_without_labels_and_of_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", 3, 4)], "doc_id long, text string, score long, toxic long")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(docs, none).first().score == 0.5
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(2, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(docs, one).first().score == 0
