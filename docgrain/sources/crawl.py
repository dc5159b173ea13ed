"""Sitemaps, polite crawling and web results. Fetching is a function that the caller passes."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from urllib.parse import urlsplit
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.functions import text as T
from docgrain.sources import html

Fetch = Callable[[str], str]


def sitemap_locations(xml: str, limit: int) -> list[str]:
    """The first ``limit`` locations of a sitemap, in whatever namespace; what is no XML is searched for the elements' text.

    A sitemap that declares entities or a document type is not parsed, so that none can be expanded.
    """
    try:
        if re.search(r"(?i)<!(?:doctype|entity)", xml):
            raise ElementTree.ParseError
        found = [e.text or "" for e in ElementTree.fromstring(xml.strip()).iter() if str(e.tag).rsplit("}", 1)[-1].lower() == "loc"]
    except ElementTree.ParseError:
        found = re.findall(r"(?is)<(?:\w+:)?loc>(.*?)</(?:\w+:)?loc>", xml)
    return [x.strip() for x in found if x.strip()][:limit]


class Robots:
    """Rules of each host, read once; a host whose rules cannot be read allows everything."""

    def __init__(self, fetch: Fetch):
        self.fetch, self.known = fetch, {}

    def rules(self, url: str) -> tuple[list[str], float]:
        parts = urlsplit(url)
        host = f"{parts.scheme}://{parts.netloc}"
        if host not in self.known:
            try:
                self.known[host] = html.robots_rules(self.fetch(f"{host}/robots.txt"))
            except OSError:
                self.known[host] = ([], 0.0)
        return self.known[host]

    def allows(self, url: str) -> bool:
        return not any((urlsplit(url).path or "/").startswith(p) for p in self.rules(url)[0])


def crawl(spark: SparkSession, sitemap: str, fetch: Fetch, limit: int = 100, delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, html) of the allowed pages of a sitemap, one after the other, with a wait between two requests.

    A crawl of one site is sequential by politeness; ``limit`` bounds what the driver holds.
    """
    robots, rows = Robots(fetch), []
    for url in sitemap_locations(fetch(sitemap), limit):
        if not robots.allows(url):
            continue
        if rows:
            sleep(max(delay, robots.rules(url)[1]))
        rows.append((url, fetch(url)))
    return spark.createDataFrame(rows, "url string, html string")


def page_records(pages: DataFrame) -> DataFrame:
    """(url, title, headings, document_date, text) of crawled pages."""
    h = F.col("html")
    return pages.select("url", html.title(h).alias("title"), html.headings(h).alias("headings"), html.meta_date(h).alias("document_date"), html.html_text(h).alias("text"))


def linked_documents(pages: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """(link, url, name) of the documents that crawled pages (url, html) link to, each once, with the first page by url and the file's name."""
    found = html.absolute_links(pages, suffix=suffix)
    once = found.groupBy("link").agg(F.min("url").alias("url"))
    return once.select("link", "url", F.regexp_extract(F.regexp_replace("link", r"[?#].*$", ""), r"([^/]*)$", 1).alias("name"))


def judge_results(results: DataFrame, question: str, similarity: DataFrame | None = None, least_chars: int = 200, relevance: float = 0.30, novelty: float = 0.88, most: int = 3) -> DataFrame:
    """Web results (title, url, content, score) with tier, verdict and reason; at most ``most`` are added.

    Thin, irrelevant and redundant ones are skipped. A low tier needs half as much relevance again; a good score of
    the provider, weighed by the tier, is relevance, too. ``similarity`` (url, similarity) tells what is known already.
    """
    words = F.filter(T.tokens(F.lit(question)), lambda w: F.length(w) > 2)
    mine = F.filter(T.tokens(F.concat_ws(" ", "title", F.substring("content", 1, 1200))), lambda w: F.length(w) > 2)
    rows = results.withColumns({"tier": T.domain_tier(F.col("url")), "overlap": T.overlap(words, mine)})
    rows = rows.join(similarity, "url", "left") if similarity is not None else rows.withColumn("similarity", F.lit(None).cast("double"))
    floor = relevance * F.when(F.col("tier") < 0.5, 1.5).otherwise(1.0)
    relevant = (F.col("overlap") >= floor) | (F.coalesce("score", F.lit(0.0)) * F.col("tier") >= 0.55)
    reason = F.when(F.length(F.coalesce("content", F.lit(""))) < least_chars, "too thin").when(~relevant, "low relevance").when(F.coalesce("similarity", F.lit(0.0)) >= novelty, "redundant")
    from pyspark.sql import Window

    rows = rows.withColumn("reason", reason)
    place = F.row_number().over(Window.partitionBy(F.col("reason").isNull()).orderBy(F.desc("score"), "url"))  # a page of results
    verdict = F.when(F.col("reason").isNull() & (F.col("place") <= most), "add").otherwise("skip")
    return rows.withColumn("place", place).withColumn("verdict", verdict).drop("place")
