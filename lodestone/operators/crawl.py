"""Breadth-first crawl of many sites as DataFrame steps.

One level of all sites at a time: the frontier's pages are fetched and parsed in
parallel, and their same-site links, less what was queued before, are the next
frontier in order of discovery.  Each level is written once; the loop holds counts on
the driver and nothing else, and runs as often as the deepest site has levels.  (A
recursive query knows UNION ALL only, so it would list paths instead of pages.)"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.html import extract_page
from ..session import discard, settle
from .corpus import number

_PAGE = "site string, position long, depth int, url string, title string, content string, sections array<struct<level:int,text:string>>, code_blocks array<string>, links array<struct<text:string,url:string>>"


def crawl_many(starts: DataFrame, fetch: Callable[[DataFrame], DataFrame], max_pages: int | None = 50, max_depth: int | None = None) -> DataFrame:
    """``starts``: (site, url), a row a site; links count as of the site if they have
    the start's authority.  ``fetch``: frontier (site, url, start) -> (site, url,
    html), html null where a request failed.  Returns the visited pages of each site
    with depth and crawl position; a failed page is not visited and doesn't count, and
    a site ends after ``max_pages`` pages."""
    spark = starts.sparkSession
    frontier = settle(starts.select("site", "url", F.col("url").alias("start"), F.lit("").alias("place")))
    frontiers, pages, depth = [frontier], [], 0
    by_place = F.row_number().over(Window.partitionBy("site").orderBy("place"))
    while max_depth is None or depth <= max_depth:
        got = fetch(frontier.select("site", "url", "start")).where("html IS NOT NULL").join(frontier, ["site", "url", "start"])
        got = got.withColumn("n", F.lit(0).cast("long"))
        if max_pages is not None:
            if pages:
                full = reduce(DataFrame.unionByName, [x.select("site") for x in pages]).groupBy("site").agg(F.count("*").alias("n"))
                got = got.drop("n").join(full, "site", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            # the first bound is a literal, which keeps all but so many rows of a site from the shuffle
            got = got.withColumn("r", by_place).where((F.col("r") <= max_pages) & (F.col("r") <= max_pages - F.col("n")))
        level = settle(got.select("site", "start", "place", "n", extract_page("html", "url", "start").alias("page"), F.lit(depth).alias("depth")))
        if level.isEmpty():
            discard(level)
            break
        pages.append(level)
        links = level.select("site", "start", "place", F.posexplode("page.links").alias("k", "link")).select("site", "start", "place", "k", F.col("link.url").alias("url"))
        queued = reduce(DataFrame.unionByName, [x.select("site", "url") for x in frontiers])
        # a place is the way to a page, link by link, so that places sort in order of discovery
        way = F.concat("place", F.lpad(F.hex("k"), 6, "0"))
        frontier = settle(links.groupBy("site", "url", "start").agg(F.min(way).alias("place")).join(queued, ["site", "url"], "left_anti"))
        frontiers.append(frontier)
        depth += 1
        if frontier.isEmpty():
            break
    discard(*frontiers)
    if not pages:
        return spark.createDataFrame([], _PAGE)
    found = reduce(DataFrame.unionByName, pages)
    # the pages before a level's own are in n; places are in order within a level
    own = F.row_number().over(Window.partitionBy("site", "depth").orderBy("place"))
    if max_pages is None:
        found = number(found, "site", "depth", "place", name="__n")
        first = found.groupBy("site").agg(F.min("__n").alias("__first"))
        return found.join(first, "site").select("site", (F.col("__n") - F.col("__first")).alias("position"), "depth", "page.*").drop("all_links")
    return found.select("site", (F.col("n") + own - 1).cast("long").alias("position"), "depth", "page.*").drop("all_links")


def crawl(spark: SparkSession, start: str, fetch: Callable[[DataFrame], DataFrame], max_pages: int = 50) -> DataFrame:
    """One site: ``fetch`` takes (url) and gives (url, html).  Returns the visited
    pages with their crawl position."""
    one = spark.createDataFrame([("", start)], "site string, url string")
    found = crawl_many(one, lambda f: f.join(fetch(f.select("url")), "url"), max_pages)
    return found.drop("site", "depth")
