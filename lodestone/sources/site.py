"""Where a crawl gets its pages: over HTTP at a site's pace, or from a table.

A fetcher takes the frontier (site, url, start) and gives (site, url, start, html,
error): html is null where the request failed, and error says why."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FETCHED = "site string, url string, start string, html string, error string"
Fetcher = Callable[[DataFrame], DataFrame]


def http_get(url: str, timeout: float = 10.0) -> str:
    """The page at an address; any status but success raises."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=timeout) as got:  # noqa: S310
        return got.read().decode(got.headers.get_content_charset() or "utf-8", "replace")


def paced(get: Callable[[str], str | None] = http_get, delay: float = 1.0) -> Fetcher:
    """Requests that wait ``delay`` seconds between two of one site.  The pages of a
    site are one task's, in order; sites are fetched side by side.  The pause bounds a
    site to ``1 / delay`` pages a second wherever it runs, so a site of many pages is
    slow by intent and more tasks would not help it."""
    def run(batches):
        import time

        import pandas as pd

        latest: dict[str, float] = {}
        for pdf in batches:
            html, error = [], []
            for site, url in zip(pdf["site"], pdf["url"]):
                if (rest := latest.get(site, float("-inf")) + delay - time.monotonic()) > 0:
                    time.sleep(rest)
                try:
                    html.append(get(url))
                    error.append(None if html[-1] is not None else "404")
                except Exception as e:  # noqa: BLE001  whatever went wrong, the page failed
                    html.append(None)
                    error.append(str(e) or type(e).__name__)
                latest[site] = time.monotonic()
            yield pd.DataFrame({"site": pdf["site"], "url": pdf["url"], "start": pdf["start"], "html": html, "error": error})

    return lambda frontier: frontier.repartition("site").sortWithinPartitions("site", "url").mapInPandas(run, _FETCHED)


def from_table(pages: DataFrame) -> Fetcher:
    """Pages of a table (url, html), one row a url; what it lacks fails with 404, and a
    page without html is no failure."""
    def fetch(frontier: DataFrame) -> DataFrame:
        found = frontier.join(pages.select("url", "html", F.lit(True).alias("there")), "url", "left")
        return found.select("site", "url", "start", "html", F.when(F.col("there").isNull(), "404").alias("error"))

    return fetch
