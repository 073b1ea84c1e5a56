"""Bulk imports of feed lists, and the clean-up of sites that robots files forbid."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from fernweave.functions.url import is_public_literal, plain_host
from fernweave.operators.status import cleanup_tally, csv_feeds, json_feeds
from fernweave.sources.feeds import fully_disallows


def resolves_public(addresses: list[str]) -> bool:
    """Whether there are answers and all are global; the answers come from the caller."""
    try:
        return bool(addresses) and all(ipaddress.ip_address(a).is_global for a in addresses)
    except ValueError:
        return False


def import_requests(rows: DataFrame, sites: DataFrame, kind: str, limit: int | None = None, refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """Requests for add_sites (url, feed, sitemap) from a feed list (kind csv or json), and one row of counts.

    The best feed of each origin, up to limit origins in order, without configured ones unless they are to be
    refreshed, and without literal addresses that are not public. Counts: valid, duplicates, configured, wanted.
    """
    best = {"csv": csv_feeds, "json": json_feeds}[kind](rows)
    chosen = best.orderBy("origin").limit(limit) if limit is not None else best
    configured = sites.select(F.col("base_url").alias("origin"))
    fresh = chosen if refresh else chosen.join(configured, "origin", "left_anti")
    good = fresh.filter(is_public_literal(plain_host(F.col("feed_url"))))
    requests = good.select(F.col("origin").alias("url"), F.col("feed_url").alias("feed"), F.lit("auto").alias("sitemap"))
    counts = rows.agg(F.count("*").alias("valid"), F.count_distinct("origin").alias("origins"))
    known = chosen.join(configured, "origin", "left_semi").agg(F.count("*").alias("configured"))
    wanted = good.agg(F.count("*").alias("wanted"))
    told = counts.crossJoin(known).crossJoin(wanted)
    return requests, told.select("valid", (F.col("valid") - F.col("origins")).alias("duplicates"), "configured", "wanted")


def forbidden(agent: str):
    @F.pandas_udf(BooleanType())
    def blocked(text: pd.Series) -> pd.Series:
        return text.map(lambda t: fully_disallows(t, agent), na_action="ignore")

    return blocked


def robots_cleanup(sites: DataFrame, robots: DataFrame, agent: str, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """Sites (base_url) whose robots(base_url, text, error) forbid the agent everything, and the tally; none is removed in a dry run."""
    joined = sites.select("base_url").join(robots, "base_url", "left").withColumn("error", F.when(F.col("text").isNull(), F.coalesce("error", F.lit("no answer"))))
    judged = joined.withColumn("blocked", F.coalesce(forbidden(agent)("text"), F.lit(False)))
    judged = judged.withColumn("removed", F.col("blocked") & F.lit(not dry_run))
    return judged.filter("blocked").select("base_url"), cleanup_tally(judged)
