from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import chunks, corpus, crawl, logs, rag, retrieval, tickets
from lodestone.plans import jobs
from lodestone.schemas import DOCUMENT, UPLOAD_LIMIT, UPLOAD_TYPES
from lodestone.sources import readers, site, uploads


@pytest.mark.parametrize("n", [0, 1, 30, 31, 40, 41, 70])
def test_chunks(spark, n):
    words = [f"w{i}" for i in range(n)]
    docs = spark.createDataFrame([("f.txt", "  " + " ".join(words) + " ", 7)], "source string, text string, extra int")
    got = sorted(chunks.chunk(docs).collect(), key=lambda r: r.chunk_ix)
    assert [r.text for r in got] == [" ".join(words[i : i + 40]) for i in range(0, n, 30)]
    assert [r.chunk_id for r in got] == [f"f.txt#{i}" for i in range(math.ceil(n / 30))]
    assert all(r.extra == 7 for r in got)


def test_chunk_needs_progress(spark):
    with pytest.raises(ValueError):
        chunks.chunk(spark.createDataFrame([("a", "b")], "source string, text string"), size=10, overlap=10)


def test_render(spark):
    rows = [("s", "body", "t", "T", [(2, "two"), (None, "one"), (3, "")], ["x", "y"]), ("s", "", "t", None, None, None)]
    got = [r.x for r in spark.createDataFrame(rows, DOCUMENT).select(corpus.render().alias("x")).collect()]
    assert got[0] == "Title: T\n\nContent: body\n\nSections:\n## two\n# one\n\nCode Examples:\nCode Block 1:\n```\nx\n```\nCode Block 2:\n```\ny\n```\n\nSource: s (Type: t)"
    assert got[1] == "Source: s (Type: t)"


def test_number_is_consecutive(spark):
    rows = spark.range(1000).withColumn("k", F.pmod(F.col("id") * 7919, F.lit(1009))).repartition(7)
    got = {r["k"]: r["index"] for r in corpus.number(rows, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}
    assert corpus.number(rows.where("id < 0"), "k").count() == 0


def test_top_k(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 3.0]), (4, None)]
    index = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [5.0, 0.0])], "query_id long, embedding array<float>")
    got = [(r.rank, r.vec_id, round(r.score, 6)) for r in retrieval.top_k(index, q, 3).orderBy("rank").collect()]
    assert got == [(1, 0, 1.0), (2, 1, 1.0), (3, 2, 0.0)]
    got = [(r.vec_id, r.score) for r in retrieval.top_k(index, q, 10, "l2").orderBy("rank").collect()]
    assert got == [(1, 9.0), (0, 16.0), (2, 25.0), (3, 34.0)]
    assert [r.vec_id for r in retrieval.nearest(index.where("embedding is not null"), [5.0, 0.0], 2).collect()] == [0, 1]
    assert retrieval.top_k(index, q.where("query_id < 0"), 3).count() == 0


def test_top_k_over_batches_and_blocks(spark, monkeypatch):
    """Ties at the edge go by id, whatever batches and query blocks there are."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(0, 3, 4)]) for i in range(300)]
    index = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(i, v) for i, v in rows[:20]], "query_id long, embedding array<float>")
    want = sorted((q, i, sum((a - b) ** 2 for a, b in zip(v, w))) for q, v in rows[:20] for i, w in sorted(rows, key=lambda r: (sum((a - b) ** 2 for a, b in zip(v, r[1])), r[0]))[:7])
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 6)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "16")
    try:
        got = sorted((r.query_id, r.vec_id, r.score) for r in retrieval.top_k(index, queries, 7, "l2").collect())
    finally:
        spark.conf.set(key, old)
    assert got == want


def test_ranks_come_from_counts(spark):
    rows = spark.createDataFrame([("a", 5), ("b", 3), ("c", 5), ("d", 1)], "site string, n long")
    assert {r.site: r.place for r in corpus.rank_by(rows, "n").collect()} == {"a": 1, "c": 1, "b": 3, "d": 4}


def test_pretty_json(spark):
    got = spark.range(1).select(X.pretty_json(a=F.lit('x "y"'), b=F.lit(None)).alias("x")).first().x
    assert got == json.dumps({"a": 'x "y"', "b": None}, indent=2)


def test_failed_generations_are_answers(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id long, query string")
    hits = spark.createDataFrame([(1, 1, "good", "s"), (2, 1, "bad", "s")], "query_id long, rank int, text string, source string")

    def generate(context, sources):
        if context.startswith("bad"):
            raise RuntimeError("model away")
        return context.upper()

    got = {r.query_id: (r.answer, r.sources) for r in rag.answer(q, rag.context(hits), rag.guarded(generate)).collect()}
    assert got == {1: ("GOOD\n[SOURCE: S]", ["s"]), 2: (rag.FAILED + "model away", []), 3: (rag.NOT_FOUND, [])}


def test_pdf_text(monkeypatch):
    import sys
    import types

    monkeypatch.setitem(sys.modules, "pypdf", None)
    assert uploads._pdf(b"%PDF") == uploads.NO_PDF
    page = lambda t: types.SimpleNamespace(extract_text=lambda: t)
    reader = lambda f: types.SimpleNamespace(pages=[page("one"), page(f.read().decode())])
    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=reader))
    assert uploads._pdf(b"two") == "one\ntwo\n"


def test_no_local_work_folder_on_a_cluster():
    import types

    from lodestone.session import work_dir

    cluster = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d: d), sparkContext=types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://x:7077"))
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        work_dir(cluster)


def test_norm_of_zero(spark):
    got = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>").select(retrieval.normalize(F.col("v")).alias("u")).collect()
    assert [r.u for r in got] == [[0.0, 0.0], [0.6, 0.8]]


def test_answers(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, query string")
    hits = spark.createDataFrame([(1, 2, "t2", "s"), (1, 1, "t1", "s")], "query_id long, rank int, text string, source string")
    got = {r.query_id: r for r in rag.answer(q, rag.context(hits)).collect()}
    assert got[1].answer.startswith("t1\n[source: s]\n\nt2\n[source: s]") and got[1].sources == ["s"]
    assert got[2].answer == rag.NOT_FOUND and got[2].sources == []
    assert {r.answer for r in rag.answer(q, None).collect()} == {rag.NOT_AVAILABLE}


def _requests(spark, n):
    rows = [(i, "q", None if i % 2 else "", "", None, "", None, i) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, query string, topic string, sentiment string, priority string, answer string, sources array<string>, s long")
    return df.withColumn("created_at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("s"))).drop("s")


def test_tickets(spark):
    rows = tickets.create(_requests(spark, 1200))
    got = {r.id: r for r in rows.collect()}
    assert got[0].ticket_number == "TKT-2024-001" and got[998].ticket_number == "TKT-2024-999" and got[1199].ticket_number == "TKT-2024-1200"
    r = got[5]
    assert (r.topic, r.sentiment, r.priority, r.response, r.status, r.sources) == ("General Inquiry", "Neutral", "P3", "No response generated", "Resolved", [])
    assert json.loads(r.full_response)["query"] == "q"
    assert {x.id: x.serial for x in tickets.newest_first(rows).collect()}[1199] == 1
    assert tickets.delete(rows, 3).count() == 1199
    assert tickets.by_id(rows, 3).count() == 1 and tickets.by_priority(rows, "P3").count() == 1200
    changed = tickets.update(rows, spark.createDataFrame([(3, "Open", None), (9999, "Open", None)], "id long, status string, topic string"))
    assert changed.count() == 1200 and changed.where("status = 'Open'").select("id", "topic").collect() == [(3, "General Inquiry")]
    assert {(s.dimension, s.value): s.n for s in tickets.stats(rows).collect()} == {("total", None): 1200, ("status", "Resolved"): 1200, ("priority", "P3"): 1200, ("sentiment", "Neutral"): 1200}


@pytest.mark.parametrize("n", [0, 49, 50, 51, 52, 60])
def test_log_tail(spark, n):
    rows = spark.range(n).select("id", F.timestamp_seconds("id").alias("ts"), F.lit("api").alias("type"))
    assert {r.id for r in logs.tail(rows).collect()} == set(range(max(0, n - 51), n))
    assert logs.of_type(rows, "all").count() == n and logs.of_type(rows, "error").count() == 0


def test_blank_query_leaves_no_event(spark):
    rows = spark.createDataFrame([(1, "  ", "t", "s", "P1", "a", "n"), (2, "q", "t", "s", "P0", "a", "n")], "id long, query string, topic string, sentiment string, priority string, answer string, ticket_number string")
    got = logs.emit(rows).orderBy("step").collect()
    assert {r.id for r in got} == {2} and len(got) == 8 and got[6].type == "escalation"


def test_upload_checks(spark):
    rows = [(UPLOAD_LIMIT, k, None) for k in UPLOAD_TYPES] + [(UPLOAD_LIMIT + 1, "text/plain", "too_large"), (1, "application/zip", "unsupported_type"), (1, None, "unsupported_type")]
    got = spark.createDataFrame(rows, "size long, kind string, want string").select(uploads.reject_reason(F.col("size"), F.col("kind")).alias("r"), "want").collect()
    assert all(r.r == r.want for r in got)


def test_ingest(spark):
    rows = [
        ("a.txt", "text/plain", "é".encode()), ("b.txt", "text/plain", b"\xff"), ("c.json", "application/json", b'{"a": [1, "\xc3\xa9"]}'), ("d.json", "application/json", b"{"),
        ("e.png", "image/png", b"x"), ("f.doc", "application/msword", b"x"), ("g.zip", "application/zip", b"x"),
    ]
    got = {r.name: r for r in uploads.ingest(spark.createDataFrame(rows, "name string, content_type string, content binary")).collect()}
    assert got["a.txt"].text == "é" and got["a.txt"].size == 2 and got["a.txt"].stored_name.endswith(".txt")
    assert got["b.txt"].text.startswith("Error processing file: ") and got["d.json"].text.startswith("Error processing file: ")
    assert got["c.json"].text == '{\n  "a": [\n    1,\n    "\\u00e9"\n  ]\n}'
    assert "OCR" in got["e.png"].text and "not implemented for this file type" in got["f.doc"].text
    assert got["g.zip"].text is None and got["g.zip"].reject_reason == "unsupported_type"


def test_readers_and_index_job(spark, tmp_path):
    (tmp_path / "kb").mkdir()
    (tmp_path / "up").mkdir()
    (tmp_path / "kb" / "a.txt").write_text("line 1\nline 2")
    (tmp_path / "kb" / "b.md").write_text("no")
    (tmp_path / "up" / "u.csv").write_text("x,y")
    (tmp_path / "up" / "bad.bin").write_bytes(b"\xff\xfe")
    (tmp_path / "pages.json").write_text(json.dumps([{"url": "https://a/b", "title": "T", "content": "C"}]))
    assert [(r.source, r.text) for r in readers.read_text_files(spark, str(tmp_path / "kb")).collect()] == [("a.txt", "line 1\nline 2")]
    assert readers.read_existing(spark, str(tmp_path / "none.txt")).count() == 0
    docs = corpus.union_documents(
        readers.read_existing(spark, str(tmp_path / "kb" / "a.txt")), readers.read_scraped(spark, str(tmp_path / "pages.json"), "product_docs"), readers.read_uploads(spark, str(tmp_path / "up"))
    )
    assert {r.source for r in docs.collect()} == {"a.txt", "product_docs/https://a/b", "uploaded_files/u.csv"}
    path = str(tmp_path / "index")
    assert readers.read_index(spark, path) is None
    assert jobs.build_index(docs, path) == {"total_documents": 3, "built": True}
    assert jobs.build_index(docs, path) == {"total_documents": 3, "built": False}
    assert jobs.build_index(docs, path, force=True, chunked=True)["built"]
    q = spark.createDataFrame([(1, "line 1 line 2"), (2, " "), (3, "x")], "query_id long, query string")
    model = lambda c: F.when(c == "x", F.lit('{"topic": "SSO", "sentiment": "Curious", "priority": "P0"}')).otherwise(F.lit('{"topic": "SSO", "sentiment": "Curious", "priority": "P1"}'))
    got = {r.query_id: r for r in jobs.answer_queries(spark, path, q, model).collect()}
    assert set(got) == {1, 3} and "a.txt" in got[1].answer and got[3].answer.startswith("⚠️")
    assert retrieval.index_stats(readers.read_index(spark, path), path)["index_loaded"]
    with pytest.raises(Exception, match="dimension"):
        readers.write_index(readers.read_index(spark, path), str(tmp_path / "other"), 3)


SITE = {
    "https://s.com/": '<main><a href="/a">a</a><a href="/b">b</a><a href="/a">again</a></main>',
    "https://s.com/a": '<main><a href="/">home</a><a href="/c">c</a><a href="/gone">x</a></main>',
    "https://s.com/b": '<main><a href="/c">c</a><a href="/d">d</a></main>',
    "https://s.com/c": '<main><a href="/e">e</a></main>',
    "https://s.com/d": "<main>d</main>",
    "https://s.com/e": "<main>e</main>",
}


@pytest.mark.parametrize(("cap", "want"), [(50, "/ /a /b /c /d /e"), (3, "/ /a /b"), (1, "/")])
def test_crawl(spark, cap, want, tmp_path):
    pages = spark.createDataFrame(list(SITE.items()), "url string, html string")
    got = crawl.crawl(spark, "https://s.com/", lambda f: f.join(pages, "url", "left"), cap)
    assert [r.url.removeprefix("https://s.com") for r in got.orderBy("position").collect()] == want.split()
    if cap == 3:
        readers.write_pages(got, str(tmp_path / "j"), str(tmp_path / "t"))
        text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "t")).collect())
        assert "URL: https://s.com/a" in text and "-" * 80 in text


def test_site_from_a_table(spark):
    pages = spark.createDataFrame([("https://s.com/", "<p>1</p>")], "url string, html string")
    asked = spark.createDataFrame([("s.com", "https://s.com/", "https://s.com/"), ("s.com", "https://s.com/gone", "https://s.com/")], "site string, url string, start string")
    got = {r.url: (r.html, r.error) for r in site.from_table(pages)(asked).collect()}
    assert got == {"https://s.com/": ("<p>1</p>", None), "https://s.com/gone": (None, "404")}


def test_preview_always_ends_in_dots(spark):
    assert spark.range(1).select(X.preview(F.lit("ab")).alias("x")).first().x == "ab..."
