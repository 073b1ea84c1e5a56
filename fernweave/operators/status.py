"""Status counters, activity and import selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.operators.rank import best_of_each


def job_counts(jobs: DataFrame) -> DataFrame:
    """queued (not failed), retrying (of these, tried before) and failed, in one scan."""
    failed = F.col("failed_at").isNotNull()
    return jobs.agg(F.count_if(~failed).alias("queued"), F.count_if(~failed & (F.col("attempt_count") > 0)).alias("retrying"), F.count_if(failed).alias("failed"))


def index_stats(sites: DataFrame, pages: DataFrame, chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row of exact counts."""
    counts = [df.agg(F.count("*").alias(name)) for df, name in ((sites, "site_count"), (pages, "page_count"), (chunks, "chunk_count"))]
    made = job_counts(jobs)
    for one in counts:
        made = made.crossJoin(one)
    return made.select("site_count", "page_count", "chunk_count", "queued", "retrying", "failed")


def failed_jobs(jobs: DataFrame, limit: int = 10) -> DataFrame:
    return jobs.filter("failed_at IS NOT NULL").orderBy(F.desc("failed_at"), "url").limit(limit).select("url", "attempt_count", "failed_at", "last_error")


def recent_activity(pages: DataFrame, jobs: DataFrame, limit: int = 10) -> DataFrame:
    """Fetched pages and failures together, latest first."""
    good = pages.select("url", F.lit("success").alias("status"), F.col("fetched_at").alias("occurred_at"))
    bad = jobs.filter("failed_at IS NOT NULL").select("url", F.lit("failure").alias("status"), F.col("failed_at").alias("occurred_at"), "attempt_count", F.col("last_error").alias("detail"))
    both = good.unionByName(bad, allowMissingColumns=True)
    return both.orderBy(F.desc("occurred_at"), "url").limit(limit)


def available_languages(pages: DataFrame) -> DataFrame:
    return pages.filter("language IS NOT NULL").select("language").distinct().orderBy("language")


def language_options(pages: DataFrame, selected: str | None) -> DataFrame:
    """One row: the sorted languages with the selected one."""
    more = F.array(F.lit(selected)) if selected else F.array().cast("array<string>")
    return pages.agg(F.array_sort(F.array_union(F.collect_set("language"), more)).alias("options"))


def select_feeds(rows: DataFrame, *order: Column) -> DataFrame:
    """The best feed of each origin by order, sorted by origin."""
    return best_of_each(rows, "origin", *order).orderBy("origin")


def json_feeds(rows: DataFrame) -> DataFrame:
    """Rows (origin, feed_url, errors, fetched): fewest errors, most fetched, then the later URL."""
    return select_feeds(rows, F.col("errors"), F.desc("fetched"), F.desc("feed_url"))


def csv_feeds(rows: DataFrame) -> DataFrame:
    """Rows (origin, feed_url, line_no): the first line."""
    return select_feeds(rows, F.col("line_no"))


def cleanup_tally(checks: DataFrame) -> DataFrame:
    """checks(base_url, error, blocked, removed): sites whose robots file could not be read are neither kept nor blocked."""
    read = F.col("error").isNull()
    return checks.agg(
        F.count("*").alias("checked"), F.count_if(read & ~F.col("blocked")).alias("kept"), F.count_if(read & F.col("blocked")).alias("blocked"),
        F.count_if(F.coalesce("removed", F.lit(False))).alias("removed"), F.count_if(~read).alias("failures"),
    )
