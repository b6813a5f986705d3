"""Queries on pages that the small tables lack, against their SQL."""

from __future__ import annotations

import duckdb
import pytest

from lodestone import queries as core
from tools.compare import rows


def _equal(spark, tmp_path, name, pages):
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got, want = core.QUERIES[name](spark, str(tmp_path)).toPandas(), c.execute(core.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    return got


def _page(i, title="T", body="b"):
    return f"<html><head><title>{title}</title></head><body><article><h1>Head {i}</h1><p>{body}</p></article></body></html>"


def test_a_crawl_ends_at_the_depth_of_its_sql(spark, tmp_path):
    # a chain through k to 2k+1 alone: other pages have no address that a crawl takes
    takes, k = {0}, 0
    while k < 5000:
        k = 2 * k + 1
        takes.add(k)
    pages = [(k, f"https://a.example/{k}" + ("" if k in takes else ".pdf"), _page(k)) for k in range(5001)]
    got = _equal(spark, tmp_path, "crawl_bfs", pages)
    assert got.depth.max() == 10 and len(got) == 12


def test_an_address_with_several_pages_is_scanned_once(spark, tmp_path):
    pages = [(1, "https://a.example/en/1", "abc"), (2, "https://a.example/en/1", "abcdef"), (3, "https://a.example/en/2", None), (4, "https://a.example/de/3", "x")]
    got = _equal(spark, tmp_path, "site_scan", pages)
    assert len(got) == 4 and got.n_chars.max() == 6


@pytest.mark.parametrize("copies", [1, 3])
def test_saved_pages_tell_of_the_text_too(spark, tmp_path, copies):
    pages = [(10 * c + i, f"https://a.example/{i}", _page(i)) for c in range(copies) for i in range(3)]
    got = _equal(spark, tmp_path, "saved_pages", pages)
    assert set(got.n_saved) == {copies} and len(got) == 3 * copies


def test_texts_are_numbered_in_order_by_ranges_of_their_heads(spark):
    from lodestone.operators import corpus

    same = "x" * 64
    rows = [("s", same + str(i % 7), i) for i in range(50)] + [("s", same, 5), ("s", same, 4), ("s", None, 1), (None, "a", 2), (None, None, 3), ("r", same[1:], 9), ("é" * 70, "z", 1), ("é" * 64, "y", 1)]
    given = spark.createDataFrame(rows, "source string, text string, n long").repartition(5)
    got = [tuple(r)[:3] for r in corpus.number(given, "source", "text", "n").orderBy("index").collect()]
    key = lambda r: tuple((x is not None, x.encode() if isinstance(x, str) else x or 0) for x in r)
    assert got == sorted(rows, key=key)
    keys = spark.createDataFrame([("s", "y" * 10**6, 1)], "source string, text string, n long")
    sampled = keys.select(*corpus._range_key(keys, ("source", "text", "n"))).first()
    assert len(repr(sampled)) < 1000  # what a sample of bounds holds of a row


def test_pages_and_embeddings_take_a_row_at_a_time(spark):
    from pyspark.sql import functions as F

    from lodestone.functions.html import extract_page
    from lodestone.plans import jobs

    rows = spark.createDataFrame([("<a href='/x'>t</a>", "https://a.example/")], "html string, url string")
    gaps = jobs.loading_embedder(lambda: len)
    for made in (extract_page("html", "url", "url"), jobs.hash_embedding("html"), gaps(F.col("html"))):
        plan = rows.select(made.alias("x"))._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "Arrow" not in plan


def test_a_norm_is_worked_out_once_a_vector(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from lodestone.operators.retrieval import normalize

    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)], "v array<float>")
    assert [r.v for r in rows.select(normalize(F.col("v")).alias("v")).collect()] == [[0.6, 0.8], [0.0, 0.0], [], None]
    import time

    big = spark.range(0, 400, 1, 1).select(F.array(*[(F.col("id") + k).cast("float") for k in range(1024)]).alias("v"))
    began = time.monotonic()
    out = np.array(big.select(normalize(F.col("v")).alias("v")).first().v)
    big.select(F.sum(F.size(normalize(F.col("v"))))).collect()
    big.select(F.sum(F.element_at(normalize(F.col("v")), 5))).collect()
    assert abs((out**2).sum() - 1) < 1e-9 and time.monotonic() - began < 20  # 400 million steps otherwise
