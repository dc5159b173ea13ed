"""HTML pages: text, title, headings, dates and links."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKIPPED = frozenset(("script", "style"))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in SKIPPED

    def handle_endtag(self, tag):
        self.depth -= tag in SKIPPED and self.depth > 0

    def handle_data(self, data):
        if not self.depth and (s := data.strip()):
            self.parts.append(s)


def text_of(html: str | None) -> str:
    """Text nodes outside scripts and styles, stripped, one a line."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return "\n".join(parser.parts)


def html_text(html: Column | str) -> Column:
    """:func:`text_of` each page; null gives an empty text."""

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(text_of)

    return text(html)


def title(html: Column) -> Column:
    """What the title element holds, as written; empty if none."""
    return F.trim(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))


def headings(html: Column, most: int = 10) -> Column:
    """The first headings of levels 1 to 3, without inner tags."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), F.lit(1))
    return F.slice(F.transform(found, lambda h: F.trim(F.regexp_replace(h, r"(?s)<[^>]*>", ""))), 1, most)


def links(html: Column) -> Column:
    """Targets of all links, as written, in order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<a\s[^>]*?href=\"([^\"]*)\""), F.lit(1))


def meta_date(html: Column) -> Column:
    """Content of the first meta element whose name or property speaks of a date or time; empty if none."""
    return F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<meta[^>]*(?:name|property)=\"[^\"]*(?:date|time)[^\"]*\"[^>]*content=\"([^\"]*)\"", 1)


def absolute_links(pages: DataFrame, url_col: str = "url", html_col: str = "html", suffix: str = ".pdf") -> DataFrame:
    """(url, link): distinct absolute links of each page that end in ``suffix``."""

    @F.pandas_udf("string")
    def join(base: pd.Series, link: pd.Series) -> pd.Series:
        return pd.Series([urljoin(b, x) for b, x in zip(base, link, strict=True)], dtype=object)

    rows = pages.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), F.explode(links(F.col(html_col))).alias("raw"))
    rows = rows.where(F.lower(F.regexp_replace("raw", r"[?#].*$", "")).endswith(suffix))
    return rows.select("url", join("url", "raw").alias("link")).distinct()


def sitemap_urls(xml: Column) -> Column:
    """All locations of a sitemap, whatever its namespaces."""
    return F.transform(F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"(?is)<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>"), F.lit(1)), F.trim)


def robots_rules(text: str, agent: str = "*") -> tuple[list[str], float]:
    """(disallowed paths, delay in seconds) for an agent."""
    paths, delay, mine = [], 0.0, False
    for line in text.splitlines():
        key, _, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            mine = value in ("*", agent)
        elif mine and key == "disallow" and value:
            paths.append(value)
        elif mine and key == "crawl-delay":
            delay = float(value) if value.replace(".", "", 1).isdigit() else 0.0
    return paths, delay
