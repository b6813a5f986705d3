"""The page extractor on broken pages, and crawls of many sites."""

from __future__ import annotations

import time
from collections import deque

import pytest

from lodestone.functions.html import read_page, tokens
from lodestone.operators import crawl
from lodestone.plans import jobs
from lodestone.sources import site

N = 100_000
BROKEN = {
    "open p": ("<p>x" * N, N), "open li": ("<li>x" * N, N), "nested div": ("<div>" * N + "x", 1), "crossed": ("<b>x" * N + "</i>" * N, N), "stray end tags": ("x" + "</i>" * N, 1),
    "quotes": ('<a "' * N, None), "open values": ("<a b='" * N, None), "comments": ("<!--" * N, 4 * N), "brackets": ("<" * N, N), "headings": ("<h2>some" * N, 4 * N), "links": ("<a href=/x>y" * N, N),
    "code": ("<pre>0123456789ab" * N, 12 * N), "attributes": ("<p " + "x=1 " * N + ">", 0), "spaces": ("<p" + " " * N + ">", 0), "scripts": ("<script>" * N, 0), "signs": ("<p " + "=" * N + ">", 0),
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_pages_take_linear_time(name):
    inner, chars = BROKEN[name]
    began = time.time()
    got = read_page("<body><main>" + inner, "http://a.com/", "http://a.com/")
    assert time.time() - began < 15
    if chars is not None:
        assert len(got["content"]) == chars


def test_deep_elements_end_where_they_should():
    html = "<body><main>" + "<div>" * 50_000 + "<h2>Deep one</h2>" + "</div>" * 50_000 + "<a href=/y>in</a></main><a href=/z>out</a>"
    got = read_page(html, "http://a.com/", "http://a.com/")
    assert got["content"] == "Deep onein" and got["sections"] == [{"level": 2, "text": "Deep one"}]
    assert got["links"] == [{"text": "in", "url": "http://a.com/y"}] and got["all_links"] == ["http://a.com/y", "http://a.com/z"]


def test_text_of_open_headings_and_links_ends_at_the_next():
    got = read_page("<main><h2>First part<h3>Second part</h3><a href=/1>one<a href=/2>two</a> tail", "http://a.com/", "http://a.com/")
    assert [x["text"] for x in got["sections"]] == ["First part", "Second part"]
    assert [x["text"] for x in got["links"]] == ["one", "two"] and got["content"] == "First partSecond partonetwo tail"


def test_tokens_of_odd_attributes():
    got = list(tokens("<a href='q>r' b = \"x &amp; y\" c d=1/>t &lt; u</A ><br/><!-- <p> --><style>a<b</style>< 1"))
    assert got[0] == ("start", "a", {"href": "q>r", "b": "x & y", "c": "", "d": "1/"}, True) or got[0] == ("start", "a", {"href": "q>r", "b": "x & y", "c": "", "d": "1/"}, False)
    assert got[1:4] == [("text", "t < u"), ("end", "a"), ("start", "br", {}, True)]
    assert [t for t in got[4:] if t[0] != "text"] == [("start", "style", {}, False), ("end", "style")] and got[-1] == ("text", "< 1")


def _plain(pages, start, cap):
    """The crawl as one queue, a page at a time."""
    queue, seen, out = deque([(start, 0)]), {start}, []
    while queue and len(out) < cap:
        url, depth = queue.popleft()
        if pages.get(url) is None:
            continue
        out.append((url, depth))
        for link in read_page(pages[url], url, start)["links"]:
            if link["url"] not in seen:
                seen.add(link["url"])
                queue.append((link["url"], depth + 1))
    return out


@pytest.mark.parametrize("cap", [1, 4, None])
def test_crawl_of_many_sites_equals_a_queue(spark, cap):
    import random

    rng, pages, starts = random.Random(7), {}, []
    for s in ("a", "b", "c"):
        urls = [f"https://{s}.com/{i}" for i in range(12)]
        starts.append((s, urls[0]))
        for u in urls:
            links = "".join(f'<a href="{rng.choice(urls)}">x</a>' for _ in range(rng.randrange(4))) + '<a href="https://else.org/">e</a>'
            pages[u] = None if u.endswith("7") else f"<title>{u}</title><main>{links}</main>"
    starts.append(("dead", "https://dead.com/"))
    table = spark.createDataFrame(list(pages.items()), "url string, html string").where("html IS NOT NULL")
    got = crawl.crawl_many(spark.createDataFrame(starts, "site string, url string"), site.from_table(table), cap).collect()
    want = [(s, k, d, u) for s, start in starts for k, (u, d) in enumerate(_plain(pages, start, cap or 99))]
    assert sorted((r.site, r.position, r.depth, r.url) for r in got) == sorted(want)
    assert all(r.title == r.url for r in got)


def test_paced_requests(spark):
    def get(url):
        if url.endswith("bad"):
            raise OSError("refused")
        return None if url.endswith("none") else f"<main>{url}</main>"

    urls = [(s, f"https://{s}/{p}", f"https://{s}/") for s in "ab" for p in ("1", "2", "bad", "none")]
    began = time.time()
    got = {r.url: (r.html, r.error) for r in site.paced(get, 0.3)(spark.createDataFrame(urls, "site string, url string, start string")).collect()}
    assert time.time() - began >= 0.9  # four pages of a site are three pauses
    assert got["https://a/1"] == ("<main>https://a/1</main>", None) and got["https://b/bad"] == (None, "refused") and got["https://a/none"] == (None, "404")


def test_scrape_crawls_and_rebuilds(spark, tmp_path):
    from lodestone.sources.readers import empty
    from lodestone.schemas import DOCUMENT

    table = spark.createDataFrame([("https://a.com/", '<title>A</title><main>about apples <a href="/b">b</a></main>'), ("https://a.com/b", "<main>about bees</main>"), ("https://c.com/", "<main>cats</main>")], "url string, html string")
    starts = spark.createDataFrame([("docs", "a", "https://a.com/"), ("developer", "c", "https://c.com/")], "kind string, site string, url string")
    got = jobs.scrape(starts, site.from_table(table), str(tmp_path / "index"), empty(spark, DOCUMENT))
    assert got == {"total_documents": 3, "built": True, "pages": {"docs": 2, "developer": 1}}
    hits = jobs.retrieve(spark, str(tmp_path / "index"), spark.createDataFrame([(1, "bees about")], "query_id long, query string"), 1).collect()
    assert hits[0].source == "docs/https://a.com/b"
