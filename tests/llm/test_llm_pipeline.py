"""The pipeline's stages, each against brute force on its own input, and the
registered queries on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from lodestone.llm import queries as q
from lodestone.llm._shared import cut
from tests.llm.test_llm_dedup import brute_components, brute_lines
from tools.compare import TABLES, rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = q.QUERIES[name](spark, SF).toPandas(), con.execute(q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_near_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, sets = brute_components(docs, 2, 80)
    for r in q.op6_near_dedup(spark, SF).collect():
        assert (r.component_id, r.n_shingles) == (want[r.doc_id], len(sets[r.doc_id][0]))


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "sentencepiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        held.append(cut(stage(spark, held[-1], SF), name))
    assert all(d.columns == columns for d in held[1:-1])
    text = [{r.doc_id: r.text for r in d.collect()} for d in held[:-1]]
    # quality: kept rows unchanged, junk gone
    assert text[1].items() <= text[0].items() and 0 < len(text[0]) - len(text[1]) < 0.5 * len(text[0])
    # lines
    assert {i: t for i, _, _, t in brute_lines(list(text[1].items()), 40, 5)} == text[2]
    # near duplicates: one of each component of five-word shingles
    comp, _ = brute_components(list(text[2].items()), 5, 80)
    assert set(text[3]) == {i for i, c in comp.items() if i == c}
    # decontamination: no item is left in a text, and nothing else went
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {i for i, t in text[3].items() if any(x in t for x in items)}
    assert not gone & set(text[4]) and len(set(text[3]) - set(text[4]) - gone) <= 0.02 * len(text[3])
    assert {r.doc_id for r in held[-1].collect()} == set(text[4])


ROWS = [
    (5, "A text that is long enough to pass, with words of many kinds about the sea, the wind and what the sailors told their children of it in the winter."),
    (3, "Another text, by which the cook explains how bread is made of flour and water, why it must rest for a night, and when the oven is hot enough for it."),
    (5, "Another text, by which the cook explains how bread is made of flour and water, why it must rest for a night, and when the oven is hot enough for it."),
    (None, "A third text that has no number, in which a traveller counts the bridges of the town and finds that there is one more of them than the map will show."),
    (-(2**62), "A fourth text with a number far below all others, where the gardener waits for the rain and writes down each evening how high the beans have grown."),
    (2**62, "A fifth text with a number far above all others, in which two friends argue over a game of chess until the lamp is out and nobody knows who has won it."),
    (7, None), (8, ""),
]


def test_stages_of_odd_tables(spark, tmp_path):
    """Rows that repeat an id, null and far ids, null and empty texts, columns
    named like the operators' results, and empty tables, through every stage."""
    schema = "doc_id long, text string, script string, kept_text string, kept boolean, component_id string, `a.b` string, n_chars long"
    docs = spark.createDataFrame([(i, t, "MINE", "OWN", None, "c", "dot", len(t or "")) for i, t in ROWS], schema)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held, none = docs, docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held, none = cut(stage(spark, held, str(tmp_path)), name), cut(stage(spark, none, str(tmp_path)), name)
        assert held.columns == docs.columns and none.columns == docs.columns and none.count() == 0
        got = [(r.doc_id, r.text) for r in held.collect()]
        want = [(i, t) for i, t in ROWS[:6] if name in ("quality_rules", "line_dedup") or (i, t) != ROWS[2]]
        assert sorted(got, key=repr) == sorted(want, key=repr), name
        assert {(r.script, r.kept_text, r.kept, r.component_id, r["a.b"]) for r in held.collect()} == {("MINE", "OWN", None, "c", "dot")}
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, held, str(tmp_path)).count() == 5 and last(spark, none, str(tmp_path)).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
