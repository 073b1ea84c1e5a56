"""Article extraction and feed autodiscovery from HTML, with the standard library only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fernweave.functions.url import resolved
from fernweave.sources.batches import SLICE, gathered, rows_of

LEAST_TEXT = 150
_SKIPPED = {"script", "style", "noscript", "template", "svg", "nav", "header", "footer", "aside", "form", "head"}
_BLOCKS = {"p", "div", "section", "article", "main", "li", "ul", "ol", "table", "tr", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "br"}
_MAIN = {"article", "main"}
_DATES = {"article:published_time", "date", "dc.date", "datepublished", "publish-date"}
_VOID = {"br", "img", "meta", "link", "input", "hr", "source", "area", "base", "col", "embed", "track", "wbr"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: list[str] = []
        self.body: list[str] = []
        self.main: list[str] = []
        self.date: str | None = None
        self.feeds: list[str] = []
        self.skipped = self.in_main = 0
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        if tag == "title":
            self.in_title = not self.title
        elif tag == "meta" and (values.get("property") or values.get("name") or values.get("itemprop") or "").lower() in _DATES:
            self.date = self.date or values.get("content")
        elif tag == "time" and self.in_main:
            self.date = self.date or values.get("datetime")
        elif tag == "link" and "alternate" in values.get("rel", "").lower() and re.search(r"application/(rss|atom)\+xml", values.get("type", "").lower()) and values.get("href"):
            self.feeds.append(values["href"])
        if tag in _SKIPPED and tag != "head":
            self.skipped += 1
        if tag in _MAIN:
            self.in_main += 1
        if tag in _BLOCKS:
            self._add("\n")

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in _SKIPPED and tag != "head":
            self.skipped = max(0, self.skipped - 1)
        if tag in _BLOCKS:
            self._add("\n")
        if tag in _MAIN:
            self.in_main = max(0, self.in_main - 1)

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skipped:
            self._add(data)

    def _add(self, text: str) -> None:
        self.body.append(text)
        if self.in_main:
            self.main.append(text)


def _tidy(parts: list[str]) -> str:
    lines = (re.sub(r"\s+", " ", line).strip() for line in "".join(parts).split("\n"))
    return "\n".join(line for line in lines if line)


def extract(html: str) -> dict | None:
    """title, text and date of a page's main part; None if it has fewer than LEAST_TEXT characters."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    text = _tidy(reader.main) or _tidy(reader.body)
    if len(text) < LEAST_TEXT:
        return None
    date = re.match(r"\d{4}-\d{2}-\d{2}", reader.date or "")
    return {"title": _tidy(reader.title) or None, "text": text, "date": date[0] if date else None}


def discovered_feed(html: str, url: str) -> str | None:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return next((u for href in reader.feeds if (u := resolved(href, url))), None)


@F.arrow_udf(StructType([StructField(n, StringType()) for n in ("title", "text", "date")]))
def extracted(html: pa.Array) -> pa.Array:
    """title, text and date of each page, of SLICE pages at once, so that a batch is in memory as Arrow only."""
    kind = pa.struct([(n, pa.string()) for n in ("title", "text", "date")])
    none = {"title": None, "text": None, "date": None}
    parts = [pa.array([none if h is None else extract(h) or none for h in html.slice(at, SLICE).to_pylist()], kind) for at in range(0, len(html), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.pandas_udf(StringType())
def feed_link(html: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else discovered_feed(h, u) for h, u in zip(html, url, strict=True)], dtype=object)


def article_pages(fetched: DataFrame) -> DataFrame:
    """fetched(url, html) to url, title, content, date; pages without enough text go. Each page is parsed once and handed on as it is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in ("url", "title", "content", "date")])
        found = ((url, extract(html)) for url, html in rows_of(batches) if html is not None)
        yield from gathered(((url, page["title"], page["text"], page["date"]) for url, page in found if page), schema)

    return fetched.select("url", "html").mapInArrow(run, "url string, title string, content string, date string")


def plain_title(html: Column) -> Column:
    """The title by a JVM expression."""
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
