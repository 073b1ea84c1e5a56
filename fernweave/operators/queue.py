"""The crawl queue as transforms of a jobs snapshot.

Jobs: id, site_id, url, source, attempt_count, next_attempt_at, lease_until, lease_token, last_error, failed_at,
discovered_at. now is a timestamp column. Spark has no row locks: one writer applies a batch
of transforms to a snapshot and writes the next one; lease tokens stay as fences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernweave.functions.text import next_state, retry_delay

LEASE_SECONDS = 600


def after(now: Column, seconds: Column | int) -> Column:
    return F.timestamp_micros(F.unix_micros(now) + (F.lit(seconds) if isinstance(seconds, int) else seconds).cast("long") * 1_000_000)


def known_urls(urls: DataFrame, pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Those of urls(url) that are a page or a job, failed ones too."""
    known = pages.select("url").union(jobs.select("url")).distinct()
    return urls.select("url").distinct().join(known, "url", "left_semi")


def enqueue(candidates: DataFrame, pages: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """New job rows for candidates(site_id, url, source, pos) that are neither page nor job; the first of a URL counts."""
    first = candidates.withColumn("nth", F.row_number().over(Window.partitionBy("url").orderBy("pos"))).filter("nth = 1")
    new = first.join(pages.select("url"), "url", "left_anti").join(jobs.select("url"), "url", "left_anti")
    nothing = F.lit(None)
    return new.select(
        F.xxhash64("url").alias("id"), "site_id", "url", "source", F.lit(0).alias("attempt_count"), now.alias("next_attempt_at"),
        nothing.cast("timestamp").alias("lease_until"), nothing.cast("string").alias("lease_token"), nothing.cast("string").alias("last_error"),
        nothing.cast("timestamp").alias("failed_at"), now.alias("discovered_at"),
    )


def within_budget(candidates: DataFrame, seen: DataFrame, limit: int) -> DataFrame:
    """Candidates (site_id, url, pos) not in seen(site_id, url), up to limit URLs of a site in all, with overflow of the site."""
    fresh = candidates.withColumn("nth", F.row_number().over(Window.partitionBy("site_id", "url").orderBy("pos"))).filter("nth = 1").drop("nth")
    fresh = fresh.join(seen.select("site_id", "url").distinct(), ["site_id", "url"], "left_anti")
    used = seen.groupBy("site_id").agg(F.count_distinct("url").alias("used"))
    numbered = fresh.withColumn("nth", F.row_number().over(Window.partitionBy("site_id").orderBy("pos")))
    numbered = numbered.withColumn("fresh", F.count("*").over(Window.partitionBy("site_id"))).join(used, "site_id", "left")
    room = F.lit(limit) - F.coalesce("used", F.lit(0))
    return numbered.filter(F.col("nth") <= room).select("site_id", "url", "pos", (F.col("fresh") > room).alias("overflow"))


def is_ready(now: Column) -> Column:
    return F.col("next_attempt_at").isNotNull() & (F.col("next_attempt_at") <= now) & (F.col("lease_until").isNull() | (F.col("lease_until") <= now))


def busy_sites(jobs: DataFrame, now: Column) -> DataFrame:
    """site_id and number of its running jobs."""
    return jobs.filter(F.col("lease_until") > now).groupBy("site_id").agg(F.count("*").alias("running"))


def claim(jobs: DataFrame, now: Column, count: int = 1) -> DataFrame:
    """The jobs that count workers claim one after another: id, and the lease they get.

    Sites without a running job come first, one job of each, and then the rest; within both by
    next_attempt_at, then id. The token is derived from the job and the time.
    """
    ready = jobs.filter(is_ready(now)).join(busy_sites(jobs, now), "site_id", "left")
    nth = F.row_number().over(Window.partitionBy("site_id").orderBy("next_attempt_at", "id"))
    picked = ready.withColumn("spread", (nth > 1) | F.col("running").isNotNull()).orderBy("spread", "next_attempt_at", "id").limit(count)
    token = F.substring(F.sha2(F.concat_ws(":", "id", F.unix_timestamp(now), "attempt_count"), 256), 1, 32)
    return picked.select("id", "site_id", "url", "source", "attempt_count", after(now, LEASE_SECONDS).alias("lease_until"), token.alias("lease_token"))


def apply_claims(jobs: DataFrame, claims: DataFrame) -> DataFrame:
    new = claims.select("id", F.col("lease_until").alias("new_until"), F.col("lease_token").alias("new_token"))
    joined = jobs.join(new, "id", "left")
    return joined.withColumn("lease_until", F.coalesce("new_until", "lease_until")).withColumn("lease_token", F.coalesce("new_token", "lease_token")).select(*jobs.columns)


def _held(now: Column) -> Column:
    return (F.col("token") == F.col("lease_token")) & (F.col("lease_until") > now)


def transition(jobs: DataFrame, reports: DataFrame, now: Column) -> DataFrame:
    """The next snapshot after reports(id, token, outcome, error_kind, error).

    outcome is done, error or renew. A report counts only with the job's token and an unexpired lease; otherwise the
    job stays as it is. done removes the job, renew extends its lease, an error retries later or fails for good.
    """
    told = reports.select("id", "token", "outcome", "error_kind", "error")
    joined = jobs.join(told, "id", "left").withColumn("fenced", F.coalesce(_held(now), F.lit(False)))
    kept = joined.filter(~(F.col("fenced") & (F.col("outcome") == "done")))
    error, renew = F.col("fenced") & (F.col("outcome") == "error"), F.col("fenced") & (F.col("outcome") == "renew")
    failed = error & (next_state(F.col("attempt_count"), F.col("error_kind")) == "failed")
    old = F.col("attempt_count")
    gone = F.lit(None).cast("timestamp")
    made = {
        "attempt_count": F.when(error, old + 1).otherwise(old),
        "next_attempt_at": F.when(failed, gone).when(error, after(now, retry_delay(old))).otherwise(F.col("next_attempt_at")),
        "lease_until": F.when(error, gone).when(renew, after(now, LEASE_SECONDS)).otherwise(F.col("lease_until")),
        "lease_token": F.when(error, F.lit(None)).otherwise(F.col("lease_token")),
        "last_error": F.when(error, F.col("error")).otherwise(F.col("last_error")),
        "failed_at": F.when(failed, now).otherwise(F.col("failed_at")),
    }
    return kept.select(*[made.get(c, F.col(c)).alias(c) for c in jobs.columns])
