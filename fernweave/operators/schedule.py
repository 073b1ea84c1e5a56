"""The poll schedule as transforms of a sites snapshot; polls are fenced by token alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernweave.functions.text import poll_backoff, scatter_offset
from fernweave.operators.queue import LEASE_SECONDS, after


def is_due(now: Column) -> Column:
    return (F.col("next_poll_at") <= now) & (F.col("poll_lease_until").isNull() | (F.col("poll_lease_until") <= now))


def claim_due(sites: DataFrame, now: Column, count: int = 1) -> DataFrame:
    token = F.substring(F.sha2(F.concat_ws(":", "id", F.unix_timestamp(now)), 256), 1, 32)
    due = sites.filter(is_due(now)).orderBy("next_poll_at", "id").limit(count)
    return due.select("id", "base_url", after(now, LEASE_SECONDS).alias("poll_lease_until"), token.alias("poll_lease_token"))


def apply_poll_claims(sites: DataFrame, claims: DataFrame) -> DataFrame:
    """Write the leases of claim_due() into the snapshot."""
    new = claims.select("id", F.col("poll_lease_until").alias("new_until"), F.col("poll_lease_token").alias("new_token"))
    joined = sites.join(new, "id", "left")
    made = {"poll_lease_until": F.coalesce("new_until", "poll_lease_until"), "poll_lease_token": F.coalesce("new_token", "poll_lease_token")}
    return joined.select(*[made.get(c, F.col(c)).alias(c) for c in sites.columns])


def renew_poll(sites: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """claims(id, token): the token alone is checked."""
    joined = sites.join(claims.select("id", "token"), "id", "left")
    same = F.coalesce(F.col("token") == F.col("poll_lease_token"), F.lit(False))
    return joined.withColumn("poll_lease_until", F.when(same, after(now, LEASE_SECONDS)).otherwise(F.col("poll_lease_until"))).select(*sites.columns)


def poll_succeeded(sites: DataFrame, reports: DataFrame, now: Column, interval: int) -> DataFrame:
    """reports(id, token, etag, last_modified, error): validators stay where the new ones are null."""
    told = reports.select("id", "token", "etag", "last_modified", F.col("error").alias("new_error"))
    joined = sites.join(told, "id", "left")
    same = F.coalesce(F.col("token") == F.col("poll_lease_token"), F.lit(False))
    made = {
        "last_polled_at": now, "next_poll_at": after(now, interval), "feed_etag": F.coalesce("etag", "feed_etag"),
        "feed_last_modified": F.coalesce("last_modified", "feed_last_modified"), "poll_failures": F.lit(0), "sync_error": F.col("new_error"),
        "poll_lease_until": F.lit(None).cast("timestamp"), "poll_lease_token": F.lit(None).cast("string"),
    }
    return joined.select(*[F.when(same, made[c]).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in sites.columns])


def poll_failed(sites: DataFrame, reports: DataFrame, now: Column, interval: int) -> DataFrame:
    """reports(id, token, error): the delay grows with the failures before this one."""
    told = reports.select("id", "token", F.col("error").alias("new_error"))
    joined = sites.join(told, "id", "left")
    same = F.coalesce(F.col("token") == F.col("poll_lease_token"), F.lit(False))
    made = {
        "poll_failures": F.col("poll_failures") + 1, "next_poll_at": after(now, poll_backoff(F.col("poll_failures"), interval)), "sync_error": F.col("new_error"),
        "poll_lease_until": F.lit(None).cast("timestamp"), "poll_lease_token": F.lit(None).cast("string"),
    }
    return joined.select(*[F.when(same, made[c]).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in sites.columns])


def mark_history(sites: DataFrame, reports: DataFrame) -> DataFrame:
    """reports(id, pending, error) set the history flags."""
    told = reports.select("id", F.col("pending").alias("new_pending"), F.col("error").alias("new_error"))
    joined = sites.join(told, "id", "left")
    set_ = F.col("new_pending").isNotNull()
    made = {"history_pending": F.col("new_pending"), "history_error": F.col("new_error")}
    return joined.select(*[F.when(set_, made[c]).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in sites.columns])


def scatter(sites: DataFrame, now: Column, interval: int) -> DataFrame:
    """id and next_poll_at of the sites that were never scheduled or are overdue, spread evenly over the interval.

    One row for each site is ranked in one task, as the spread is over all of them.
    """
    overdue = sites.filter(F.col("next_poll_at").isNull() | (F.col("next_poll_at") <= now)).select("id")
    position = F.row_number().over(Window.orderBy("id")) - 1
    placed = overdue.withColumn("position", position).withColumn("total", F.count("*").over(Window.partitionBy()))
    return placed.select("id", after(now, scatter_offset(interval, F.col("position"), F.col("total"))).alias("next_poll_at"))


def apply_scatter(sites: DataFrame, placed: DataFrame) -> DataFrame:
    """Write the times of scatter() into the snapshot."""
    joined = sites.join(placed.select("id", F.col("next_poll_at").alias("placed_at")), "id", "left")
    return joined.withColumn("next_poll_at", F.coalesce("placed_at", "next_poll_at")).select(*sites.columns)


def upsert_sites(sites: DataFrame, configs: DataFrame, now: Column) -> DataFrame:
    """configs(base_url, sitemap_url, feed_url, delay): new sites are added, known ones keep their state unless the feed changes."""
    new = configs.select("base_url", F.col("sitemap_url").alias("new_sitemap"), F.col("feed_url").alias("new_feed"), "delay")
    joined = sites.join(new, "base_url", "full_outer")
    told, added = F.col("new_feed").isNotNull(), F.col("id").isNull()
    moved = told & (added | (F.col("feed_url") != F.col("new_feed")))
    none = F.lit(None)
    made = {
        "id": F.coalesce("id", F.xxhash64("base_url")), "base_url": F.col("base_url"), "sitemap_url": F.when(told, F.col("new_sitemap")).otherwise(F.col("sitemap_url")),
        "feed_url": F.coalesce("new_feed", "feed_url"), "next_poll_at": F.when(moved, after(now, F.col("delay"))).otherwise(F.col("next_poll_at")),
        "feed_etag": F.when(~moved, F.col("feed_etag")), "feed_last_modified": F.when(~moved, F.col("feed_last_modified")),
        "poll_failures": F.when(moved, 0).otherwise(F.col("poll_failures")), "poll_lease_until": F.when(~moved, F.col("poll_lease_until")),
        "poll_lease_token": F.when(~moved, F.col("poll_lease_token")), "sync_error": F.when(~moved, F.col("sync_error")),
        "history_pending": F.when(moved, F.lit(False)).otherwise(F.col("history_pending")), "history_error": F.when(moved, none).otherwise(F.col("history_error")),
        "added_at": F.coalesce("added_at", now),
    }
    return joined.select(*[made.get(c, F.col(c)).alias(c) for c in sites.columns])


def delete_sites(base_urls: DataFrame, sites: DataFrame, jobs: DataFrame, pages: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """The four relations without the sites of base_urls and all that hangs on them, and the deleted origins in order."""
    gone = sites.join(base_urls.select("base_url").distinct(), "base_url", "left_semi").select("id", "base_url")
    of_site = gone.select(F.col("id").alias("site_id"))
    gone_pages = pages.join(of_site, "site_id", "left_semi").select(F.col("id").alias("page_id"))
    return {
        "sites": sites.join(gone.select("id"), "id", "left_anti"),
        "crawl_jobs": jobs.join(of_site, "site_id", "left_anti"),
        "pages": pages.join(of_site, "site_id", "left_anti"),
        "chunks": chunks.join(gone_pages, "page_id", "left_anti"),
        "deleted": gone.select("base_url").orderBy("base_url"),
    }
