"""The parser of page texts on deep, crossed and unquoted markup."""

import time

import pytest

from lodestone.llm import html_extract as html

N = 30_000
PAGES = {
    "open p": "<p>x" * N, "open li": "<li>x" * N, "nested div": "<div>" * N + "x", "crossed": "<b>x" * N + "</i>" * N, "inline over blocks": "<b>" + "<div>" * N + "</b>" * N, "quotes": '<a "' * N, "quotes, closed": '<a "' * N + ">",
    "values": "<a b='" * N + ">", "comments": "<!--" * N, "articles below": "<div>" * N + "<article>x</article>" * N, "nested articles": "<article>x" * N, "brackets": "<" * N, "stray ends": "</" * N + ">", "titles": "<title>" * N,
    "attributes": "<a " + "x=1 " * N + ">", "many sections": "".join(f"<div class=post{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}>x</div>" for i in range(N)), "mixed quotes": "<b '><i \">" * N,
}


@pytest.mark.parametrize("name", PAGES)
def test_broken_pages_take_linear_time(name):
    began = time.time()
    text = html.extract(PAGES[name])
    assert time.time() - began < 15
    if name in ("open p", "open li", "articles below", "nested articles", "many sections"):
        assert text == "\n".join("x" * N)


def test_paths_are_bounded_and_no_text_is_lost():
    elements, blocks = html.parse("<div>" * 5000 + "deep <p>inner</p>" + "</div>" * 5000 + "after")
    assert max(p.count("/") for p in elements) <= html.DEEP + 1 and len(elements) <= html.DEEP + 2
    assert [b.text for b in blocks] == ["deep", "inner", "after"]
    assert sum(e[0] for e in elements.values()) == 5001


def test_inline_end_tags_close_no_block():
    _, blocks = html.parse("<b><div>one</b>two<p>three</p></div>four</b>five")
    assert [b.text for b in blocks] == ["onetwo", "three", "fourfive"]
    assert blocks[0].path == "/b/div" and blocks[-1].path == "/b"
