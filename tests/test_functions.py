from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import triage as G
from lodestone.functions import urls as U
from lodestone.functions.html import read_page
from lodestone.schemas import ANSWERED_TOPICS, TOPICS


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("size", "shown"), [(0, "0 Bytes"), (1, "1 Bytes"), (1023, "1023 Bytes"), (1024, "1 KB"), (1536, "1.5 KB"), (1048576, "1 MB"), (1073741824, "1 GB"), (10 * 1024 + 52, "10.05 KB")])
def test_file_size(spark, size, shown):
    assert one(spark, X.file_size(F.col("n")), n=size) == shown


def test_clean_text_keeps_inner_spaces_and_cuts_inside_words(spark):
    assert one(spark, X.clean_text(F.col("t")), t="  a\u00a0 b\n Menu  menus c ") == "a b  s c"
    assert one(spark, X.clean_text(F.col("t")), t="") == ""


def test_words_split_at_any_white_space(spark):
    assert one(spark, X.words(F.col("t")), t=" a\u00a0b\tc ") == ["a", "b", "c"]


def test_suffix(spark):
    assert [one(spark, X.suffix(F.col("t")), t=t) for t in ("a.txt", "a.tar.gz", "a", ".env")] == [".txt", ".gz", "", ""]


RULES = [
    ("I cannot login to export data", ("Login Issue", "Neutral", "High")),
    ("please add a feature", ("Feature Request", "Positive", "Low")),
    ("download this", ("Data Export", "Neutral", "Medium")),
    ("my bill", ("Billing Question", "Neutral", "Medium")),
    ("the flag", ("Performance Issue", "Negative", "High")),
    ("rapid", ("Integration Help", "Neutral", "Medium")),
    ("I knew it", ("Account Setup", "Positive", "Medium")),
    ("is it safe", ("Data Security", "Neutral", "High")),
    ("hello", ("General Inquiry", "Neutral", "Medium")),
    ("slow but great", ("Performance Issue", "Positive", "High")),
    ("a feature is wrong", ("Feature Request", "Negative", "Low")),
    ("", ("General Inquiry", "Neutral", "Medium")),
]


@pytest.mark.parametrize(("text", "want"), RULES)
def test_rules(spark, text, want):
    assert tuple(one(spark, G.classify_rules(F.col("t")), t=text)) == want


def test_classification_json(spark):
    rows = ['{"topic": "SSO", "sentiment": "Curious", "priority": "P1"}', "no json", "```json\n{}\n```", '{"topic": "SSO"}']
    got = [tuple(one(spark, G.parse_classification(F.col("t")), t=r)) for r in rows]
    assert got == [("SSO", "Curious", "P1"), ("Unknown", "Neutral", "P2"), ("Unknown", "Neutral", "P2"), ("SSO", None, None)]


def test_routes(spark):
    rows = spark.createDataFrame([(t, p) for t in [*TOPICS, "Unknown"] for p in ("P0", "P1", "P0 (High)")], "t string, p string")
    for r in rows.select("t", "p", G.route(F.col("t"), F.col("p")).alias("w")).collect():
        assert r.w == ("escalate" if r.p == "P0" else "rag" if r.t in ANSWERED_TOPICS else "team")
    assert one(spark, G.route(F.col("t"), F.col("p"), prefix=True), t="SSO", p="P0 (High)") == "escalate"
    assert one(spark, G.route(F.col("t"), F.col("p"), clarify=True), t="Unknown", p="P2") == "clarify"


def test_same_site(spark):
    base = "https://docs.a.com/"
    urls = {"https://docs.a.com/x": True, "https://docs.a.com/x#y": False, "https://docs.a.com/x.json": False, "https://b.com/x": False, "https://docs.a.com:8080/x": False, "nope": False, "https://docs.a.com/A.PDF?x": False}
    for url, ok in urls.items():
        assert one(spark, U.same_site(F.col("u"), F.col("b")), u=url, b=base) is ok, url


def test_resolve(spark):
    assert one(spark, U.resolve("b", "h"), b="https://a.com/x/y", h="../z") == "https://a.com/z"


PAGE = """<html><head><title> The  Title </title><script>var x = "<main>";</script></head><body><nav><a href="/n">n</a></nav>
<main class="m"><h1>Big one</h1><h2>abc</h2><h3>abcd</h3><p>Text &amp; more<!-- no --></p><script>bad()</script>
<pre><code>0123456789a</code></pre><code>0123456789</code><a href="rel">Rel</a><a href="#frag">f</a><a href="https://else.org/">e</a><a href="/x.json">j</a></main></body></html>"""


def test_read_page():
    got = read_page(PAGE, "https://a.com/d/p", "https://a.com/")
    assert got["title"] == "The Title"
    assert got["sections"] == [{"level": 1, "text": "Big one"}, {"level": 3, "text": "abcd"}]
    assert got["code_blocks"] == ["0123456789a", "0123456789a"]
    assert got["links"] == [{"text": "Rel", "url": "https://a.com/d/rel"}]
    assert got["all_links"] == ["https://a.com/n", "https://a.com/d/rel"]
    assert "bad()" not in got["content"] and "no" not in got["content"].split() and "Text & more" in got["content"]


@pytest.mark.parametrize(("html", "content"), [
    ('<body><div role="main">r</div><article>a</article></body>', "r"),
    ('<body><article>a</article><div class="x content">c</div></body>', "c"),
    ("<body><p>b</p></body>", "b"),
    ('<body><div class="markdown-body">m</div></body>', "m"),
    ("", ""),
])
def test_main_selector_order(html, content):
    assert read_page(html, "https://a.com/", None)["content"] == content


def test_title_falls_back_to_heading():
    assert read_page("<body><h1>Only</h1></body>", "https://a.com/", None)["title"] == "Only"
