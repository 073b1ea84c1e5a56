"""The daemon: poll and crawl ticks over the engine's relations, under one lock, with leases and their heartbeat.

A tick claims a batch, writes the leases, works, and writes the outcome under the lease's token. One process
holds the lock and writes; what is parallel is the work within a tick, which Spark spreads over its executors.
"""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_EXCEPTION, Future, ThreadPoolExecutor, wait
from contextlib import contextmanager
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.config import AlreadyRunningError, LeaseLostError
from fernweave.operators import queue, schedule
from fernweave.plans import ingest, sites

log = logging.getLogger("fernweave.daemon")

HEARTBEAT_SECONDS, IDLE_SECONDS, ERROR_SECONDS = 60.0, 1.0, 5.0
Item, Result = TypeVar("Item"), TypeVar("Result")
#: urls(url, headers) to the responses that plans take
Fetch = Callable[[DataFrame], DataFrame]


@contextmanager
def exclusive(spark, path: str):
    """A lock file that one process can make; AlreadyRunningError if it is there. What dies without its end leaves it, to be deleted by hand."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/daemon.lock")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.create(place, False).close()
    except Exception as e:
        if files.exists(place):
            raise AlreadyRunningError(f"{place} is held by another daemon or change") from e
        raise
    try:
        yield
    finally:
        files.delete(place, False)


def with_lease(work: Callable[[], Result], renew: Callable[[], bool], seconds: float = HEARTBEAT_SECONDS) -> Result:
    """The result of work, while renew is called every so many seconds.

    If renew says no, the lease is another's: LeaseLostError, and work's result is not used. If it raises, the lease
    may still be held; that is logged, and the next beat tries again.
    """
    pool = ThreadPoolExecutor(1)
    try:
        running = pool.submit(work)
        while not wait([running], timeout=seconds).done:
            try:
                kept = renew()
            except Exception:
                log.warning("a lease was not renewed, trying again", exc_info=True)
                continue
            if not kept:
                raise LeaseLostError("the lease is lost")
        return running.result()
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def in_order(items: Iterable[Item], work: Callable[[Item], Result], limit: int) -> list[Result]:
    """Results in the order of items, limit of them at work at a time; the first error cancels what has not begun and is raised."""
    with ThreadPoolExecutor(limit) as pool:
        running: list[Future] = [pool.submit(work, item) for item in items]
        done, waiting = wait(running, return_when=FIRST_EXCEPTION)
        for future in waiting:
            future.cancel()
        for future in running:
            if future in done and future.exception():
                raise future.exception()
        return [f.result() for f in running]


@dataclass(frozen=True)
class Tick:
    """claimed units, and what became of them by outcome."""

    claimed: int
    outcomes: dict[str, int]


def _settled(table: Callable[[], DataFrame], claims: DataFrame, lease: str) -> Callable[[], bool]:
    """Whether all claims still hold their leases."""
    wanted = claims.count()

    def holds() -> bool:
        now = table().select("id", F.col(lease).alias("token"))
        return claims.select("id", "token").join(now, ["id", "token"], "left_semi").count() == wanted

    return holds


def poll_tick(engine, fetch: Fetch, now: Column | None = None, count: int = 16, beat: float = HEARTBEAT_SECONDS) -> Tick:
    """Poll the count sites that are due first: claim, conditional fetch, new posts to the queue, history where all is new, and the next time."""
    now = F.current_timestamp() if now is None else now
    settings = engine.settings
    claimed = engine.kept(schedule.claim_due(engine.table("sites"), now, count))
    n = claimed.count()
    if not n:
        return Tick(0, {})
    engine.replace("sites", schedule.apply_poll_claims(engine.table("sites"), claimed))
    tokens = claimed.select("id", F.col("poll_lease_token").alias("token"))

    def work() -> tuple[DataFrame, DataFrame]:
        due = engine.table("sites").join(tokens, "id")
        got = engine.kept(fetch(sites.poll_requests(due)))
        fresh, reports = sites.poll(due, got, engine.table("pages"), engine.table("crawl_jobs"), settings.history_post_limit)
        reports = engine.kept(reports)
        wanted = due.join(reports.filter("error IS NULL AND (all_new OR history_pending)").select("id"), "id", "left_semi")
        past, troubles = sites.history(wanted, got, fetch, settings.history_post_limit, engine.kept)
        return engine.kept(fresh.select("site_id", "url", "source", "pos").unionByName(past.select("site_id", "url", "source", "pos"))), reports.join(engine.kept(troubles), "id", "left")

    renew = _settled(lambda: engine.table("sites"), tokens, "poll_lease_token")
    found, reports = with_lease(work, renew, beat)
    if not renew():
        raise LeaseLostError("the sites were claimed by another poll")
    engine.replace("crawl_jobs", engine.table("crawl_jobs").unionByName(queue.enqueue(found, engine.table("pages"), engine.table("crawl_jobs"), now)))
    good, bad = reports.filter("error IS NULL"), reports.filter("error IS NOT NULL")
    after = schedule.mark_history(engine.table("sites"), good.filter("pending IS NOT NULL").select("id", "pending", F.col("trouble").alias("error")))
    after = schedule.poll_succeeded(after, good.select("id", "token", "etag", "last_modified", F.col("trouble").alias("error")), now, settings.site_poll_interval_seconds)
    engine.replace("sites", schedule.poll_failed(after, bad.select("id", "token", "error"), now, settings.site_poll_interval_seconds))
    outcomes = {"polled": good.count(), "failed": bad.count(), "found": found.count()}
    log.info("polled %d sites: %s", n, outcomes)
    return Tick(n, {k: v for k, v in outcomes.items() if v})


def crawl_tick(engine, fetch: Fetch, embed: Callable[[list[str]], list[list[float]]], now: Column | None = None, count: int = 8, beat: float = HEARTBEAT_SECONDS) -> Tick:
    """Work on count jobs of the queue, of as many sites as there are: claim, fetch, extract, cut, embed, append, and complete or retry.

    A job whose lease is lost is left as it is; so are its page and chunks.
    """
    now = F.current_timestamp() if now is None else now
    claimed = engine.kept(queue.claim(engine.table("crawl_jobs"), now, count))
    n = claimed.count()
    if not n:
        return Tick(0, {})
    engine.replace("crawl_jobs", queue.apply_claims(engine.table("crawl_jobs"), claimed))
    tokens = claimed.select("id", F.col("lease_token").alias("token"))

    def work() -> tuple[DataFrame, DataFrame, DataFrame]:
        got = engine.kept(fetch(claimed.select("url", F.create_map().cast("map<string,string>").alias("headers"))))
        s = engine.settings
        made = ingest.attempts(claimed, got, engine.table("pages"), now, s.chunk_tokens, s.chunk_token_overlap)
        pages = engine.kept(made.pages)
        return pages, engine.kept(ingest.embedded_chunks(made.chunks, embed, s.embedding_batch_size)), engine.kept(made.reports)

    renew = _settled(lambda: engine.table("crawl_jobs"), tokens, "lease_token")
    pages, chunks, reports = with_lease(work, renew, beat)
    held = reports.join(engine.table("crawl_jobs").select("id", F.col("lease_token").alias("token")), ["id", "token"], "left_semi")
    mine = pages.join(held.join(claimed.select("id", "url"), "id").select("url"), "url", "left_semi")
    engine.append("pages", mine, "url")
    engine.append("chunks", chunks.join(mine.select(F.col("id").alias("page_id")), "page_id", "left_semi"), "id")
    engine.replace("crawl_jobs", queue.transition(engine.table("crawl_jobs"), held, now))
    lost = n - held.count()
    outcomes = {r["outcome"]: r["count"] for r in held.groupBy("outcome").count().collect()} | ({"lease_lost": lost} if lost else {})
    log.info("worked on %d jobs: %s", n, outcomes)
    return Tick(n, outcomes)


def loop(tick: Callable[[], Tick], stop: threading.Event, idle: float = IDLE_SECONDS, error: float = ERROR_SECONDS) -> None:
    """Tick until stop is set; a rest where nothing was to do, a longer one after an error, which ends nothing."""
    while not stop.is_set():
        try:
            rest = 0.0 if tick().claimed else idle
        except LeaseLostError:
            log.warning("a lease was lost; it is left to its new owner")
            rest = 0.0
        except Exception:
            log.exception("a tick failed")
            rest = error
        if rest:
            stop.wait(rest)


def run_daemon(engine, fetch: Fetch, embed: Callable[[list[str]], list[list[float]]], stop: threading.Event, idle: float = IDLE_SECONDS, error: float = ERROR_SECONDS) -> None:
    """Under the lock: spread the overdue polls, then poll and crawl in turn until stop is set. Ticks take turns since both write snapshots."""
    with exclusive(engine.spark, engine.path):
        s = engine.settings
        engine.replace("sites", schedule.apply_scatter(engine.table("sites"), schedule.scatter(engine.table("sites"), F.current_timestamp(), s.site_poll_interval_seconds)))
        log.info("daemon started")

        def both() -> Tick:
            one = poll_tick(engine, fetch, count=s.site_poll_concurrency)
            two = crawl_tick(engine, fetch, embed, count=s.ingest_concurrency)
            return Tick(one.claimed + two.claimed, {})

        loop(both, stop, idle, error)
