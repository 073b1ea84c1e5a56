"""Fetch results as data: status and content-type rules, politeness, and a live source.

A table of (url, status, headers, body) stands for the network; fetch_table() fills one.
"""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernweave.config import FetchError
from fernweave.functions.url import origin, try_normalize_url

#: fixed values
TEXT_TYPES = r"(?i)(text/|html|xml|json|rss|atom)"
TRANSIENT = (408, 425, 429)


def error_kind(status: Column, content_type: Column, allow_not_modified: bool = False) -> Column:
    """null for a good response, else permanent or transient."""
    good = status == 200
    if allow_not_modified:
        good = good | (status == 304)
    bad_type = F.coalesce(content_type, F.lit("")) != ""
    permanent = (status >= 400) & (status < 500) & ~status.isin(*TRANSIENT)
    return F.when(~good, F.when(permanent, "permanent").otherwise("transient")).when((status == 200) & bad_type & ~content_type.rlike(TEXT_TYPES), "permanent")


def conditional_headers(etag: Column, last_modified: Column, history_pending: Column) -> Column:
    """Validators to send; none while the history is pending."""
    pairs = F.array(F.struct(F.lit("If-None-Match").alias("k"), etag.alias("v")), F.struct(F.lit("If-Modified-Since").alias("k"), last_modified.alias("v")))
    return F.when(history_pending, F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())))


def start_times(requests: DataFrame, delay: float) -> DataFrame:
    """requests(origin, at) with start: of one origin, starts are at least delay seconds apart, in order of at.

    start_n = max(at_n, start_{n-1} + delay), which is n * delay + the running maximum of at_k - k * delay.
    """
    order = Window.partitionBy("origin").orderBy("at")
    nth = F.row_number().over(order) - 1
    numbered = requests.withColumn("nth", nth)
    highest = F.max(F.col("at") - F.col("nth") * F.lit(delay)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("start", highest + F.col("nth") * F.lit(delay)).drop("nth")


RESPONSES = "url string, final_url string, status int, content_type string, body binary, etag string, last_modified string"


def fetch_table(urls: DataFrame, delay: float = 2.0, timeout: float = 30.0, agent: str = "fernweave") -> DataFrame:
    """Fetch urls(url, and headers, a map, if there is such a column) live. All of an origin in one task, spaced by delay.

    A URL that is no public http(s) one has status 400, one that can't be reached has none; a redirect to such a URL has no final_url.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for batch in batches:
            rows = []
            for url, headers, site in batch[["url", "headers", "origin"]].itertuples(index=False):
                if site is None:
                    rows.append((url, None, 400, None, None, None, None))
                    continue
                time.sleep(max(0.0, last.get(site, 0.0) + delay - time.monotonic()))
                last[site] = time.monotonic()
                try:
                    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent, **dict(headers or {})}), timeout=timeout) as got:
                        rows.append((url, try_normalize_url(got.url), got.status, got.headers.get("Content-Type"), got.read(), got.headers.get("ETag"), got.headers.get("Last-Modified")))
                except urllib.error.HTTPError as e:
                    rows.append((url, None, e.code, None, None, e.headers.get("ETag"), e.headers.get("Last-Modified")))
                except OSError:
                    rows.append((url, None, None, None, None, None, None))
            yield pd.DataFrame(rows, columns=["url", "final_url", "status", "content_type", "body", "etag", "last_modified"])

    headers = F.col("headers") if "headers" in urls.columns else F.create_map().cast("map<string,string>")
    keyed = urls.select("url", headers.alias("headers"), origin("url").alias("origin"))
    return keyed.repartition("origin").sortWithinPartitions("origin").mapInPandas(run, RESPONSES)


def raise_for(url: str, status: int | None, content_type: str | None, allow_not_modified: bool = False) -> None:
    """FetchError if a response is none to use; the rules of error_kind()."""
    if status is None:
        raise FetchError(f"{url} can't be reached")
    if status == 304 and allow_not_modified:
        return
    if status != 200:
        raise FetchError(f"{url} answered {status}", status, 400 <= status < 500 and status not in TRANSIENT)
    if content_type and not re.search(TEXT_TYPES, content_type):
        raise FetchError(f"{url} is {content_type}, which is no text", status, True)
