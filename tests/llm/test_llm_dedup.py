"""Line dedup and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from lodestone.llm import components as comp
from lodestone.llm import line_dedup as lines
from lodestone.llm import minhash as near

BLANK = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(docs, min_chars, min_docs):
    key = lambda x: x.strip(BLANK).translate(LOWER)
    held = defaultdict(set)
    for i, t, *_ in docs:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= min_chars:
                    held[key(x)].add(i)
    out = []
    for i, t, *_ in docs:
        ls = (t or "").split("\n")
        keep = [x for x in ls if i is None or len(key(x)) < min_chars or len(held[key(x)]) < min_docs or max(held[key(x)]) == i]
        out.append((i, len(ls), len(ls) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def line_docs():
    r = random.Random(4)
    pool = [f"common line number {k} " + "x" * 30 for k in range(12)] + ["short", "", "É" * 45, "é" * 45]
    out = [(i, "\n".join(r.choice(["", " ", "\t"]) + (x.upper() if r.random() < 0.3 else x) + r.choice(["", "\r", " "]) for x in r.choices(pool, k=r.randint(0, 8))), "k") for i in range(60)]
    out += [(70, None, "k"), (71, "", "k"), (72, "\n\n", "k"), (None, pool[0], "k"), (5, pool[1], "k"), (80, pool[2] + "\n" + pool[2], "k"), (81, "long " * 30000 + "\n" + pool[3], "k")]
    return out


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (5, 3)])
def test_lines(spark, batches, fanout):
    docs = line_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string, key string").repartition(4)
    got = lines.line_dedup(df, batches=batches, fanout=fanout).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=repr) == brute_lines(docs, 40, 5)
    assert set(got[0].asDict()) == {"doc_id", "text", "key", "n_lines", "n_dropped", "kept_text"}


@pytest.mark.parametrize(("far", "batches"), [([2**60 + 3, 2**61 - 1, 2**61 - 2], 2), ([-(2**63), -(2**62), 2**62, 2**63 - 1], 4)])
def test_lines_of_far_ids(spark, far, batches):
    docs = [(i, "\n".join(f"line {k} held by some " + "y" * 40 for k in (i % 7, 100 + i // 5, 200 + i // 4))) for i in [*range(101), *far]]
    got = lines.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), batches=batches).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=repr) == brute_lines(docs, 40, 5)


def test_lines_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_lines string")
    assert lines.line_dedup(df).count() == 0
    assert lines.line_dedup(spark.createDataFrame([(None, "a")], "doc_id long, text string")).first().kept_text == "a"


def test_runs_are_compacted(spark):
    runs = lines.LineRuns(spark, 2)
    for b in range(5):
        runs.add(spark.createDataFrame([(1, 1, 100 - b), (2 + b, 2, 100 - b)], "h1 long, h2 long, doc long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    got = {r.h1: (r.n_docs, r.keeper) for r in runs.table().collect()}
    assert got[1] == (5, 100) and got[4] == (1, 98) and len(got) == 6
    # runs meet runs without an exchange
    merged = runs._merged([r for level in runs.levels for r in level])
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
    runs.discard()
    assert not runs.paths and lines.LineRuns(spark).table().count() == 0


def test_many_lines_in_linear_time(spark):
    """A text of 20,000 lines, nearly all of which go."""
    text = "\n".join(f"line number {k % 7} that is long enough to take part" for k in range(20000))
    got = lines.line_dedup(spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in got) == [(i, 20000, 20000 if i < 5 else 0) for i in range(6)]


def brute_sets(docs, n):
    out = {}
    for i, t in docs:
        w = [x for x in (t or "").translate(LOWER).replace("\t", " ").replace("\n", " ").split(" ") if x]
        out.setdefault(i, []).append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute_components(docs, n, percent):
    sets = brute_sets(docs, n)
    ids = sorted(i for i in sets if i is not None)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b:
                for x in sets[a]:
                    for y in sets[b]:
                        if x and y and 100 * len(x & y) >= percent * len(x | y):
                            ra, rb = root(a), root(b)
                            up[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}, sets


def near_docs():
    r = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    docs, i = [], 0
    for _ in range(12):
        base = r.choices(words, k=r.choice([3, 8, 30, 80, 150]))
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = r.choice(words)
            docs.append((i, r.choice([" ", "\n", "  "]).join(x.upper() if r.random() < 0.1 else x for x in w)))
            i += 1
    # a large family around the threshold, none of whose members is the centre
    base = r.choices(words, k=120)
    for _ in range(90):
        w = list(base)
        for k in r.sample(range(120), r.randint(2, 9)):
            w[k] = r.choice(words)
        docs.append((i, " ".join(w)))
        i += 1
    docs += [(i, None), (i + 1, ""), (i + 2, " \t"), (i + 3, "one"), (i + 4, "ONE"), (i + 5, "one two"), (i + 6, "One Two"), (None, "one two"), (2**60 + 1, "far off"), (2**60 + 3, "Far off")]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize(("n", "percent"), [(2, 80), (5, 80), (1, 60)])
def test_near_duplicates(spark, n, percent, monkeypatch):
    monkeypatch.setattr(near, "CHUNK", 20)  # several blocks and salts
    docs = near_docs()
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, component_id string, key int").repartition(5)
    got = near.near_duplicates(df, shingle=n, percent=percent, bands=45 if percent == 80 else 150, rows=6).collect()
    want, sets = brute_components(docs, n, percent)
    assert len(got) == len(docs)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.doc_id == r.component_id)
        assert r.n_shingles == len(sets[r.doc_id][0])


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near.near_duplicates(df).count() == 0
    got = near.near_duplicates(spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False)]


def test_rows_of_one_id_go_by_their_own_text(spark):
    a, b = "one two three four five six seven eight", "other words that stand for a text of their own"
    docs = spark.createDataFrame([(5, a), (3, b), (5, b), (None, b), (7, None), (8, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in near.without_near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(5, a), (3, b), (None, b), (7, None), (8, "")], key=repr)


def test_blocks_are_bounded(spark):
    rows = [(1000, 10), (10, 1 << 20), (1, 1)]
    n = [r[0] for r in spark.createDataFrame(rows, "n long, s long").select(near._chunks(near.F.col("n"), 128, near.F.col("s"))).collect()]
    assert n == [8, 4, 1]


def test_band_recall_at_the_threshold():
    rng, hasher, missed = np.random.default_rng(1), near.MinMax(), 0
    for _ in range(200):
        x = rng.integers(0, 2**63, 540).astype(np.uint64)
        a, b = np.sort(x[:540]), np.sort(np.concatenate([x[60:], rng.integers(0, 2**63, 60).astype(np.uint64)]))
        assert 0.79 < len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < 0.81
        missed += not (hasher.band_keys(a) == hasher.band_keys(b)).any()
    assert missed == 0


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7)]
    up = {}
    for a, b in links:
        if a != b:
            up.setdefault(a, a), up.setdefault(b, b)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {x.node: x.label for x in comp.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert comp.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hash_digest_is_over_the_kept_text():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
