"""Engine over a folder of relations, and its command line.

    python -m fernweave.api --path DIR init
    python -m fernweave.api --path DIR site add URL [--feed URL] [--sitemap URL] --fetched PARQUET
    python -m fernweave.api --path DIR site list | site remove URL | status | daemon | search TEXT [--lang xx] [--from D] [--to D] [--long]
"""

from __future__ import annotations

import argparse
import sys
import threading
import uuid
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.config import EngineError, Settings, SiteError, configure_logging
from fernweave.functions.text import parse_range
from fernweave.functions.url import normalize_origin
from fernweave.operators import retrieve, schedule, status
from fernweave.operators.chunk import chunk_text
from fernweave.operators.filters import by_language, by_published_range
from fernweave.plans import imports
from fernweave.plans import search as plans
from fernweave.plans.sites import add_sites
from fernweave.sources import tables
from fernweave.sources.embedding import EmbeddingClient
from fernweave.sources.fetch import fetch_table
from fernweave.streaming.daemon import exclusive, run_daemon
from fernweave.types import RELATIONS


class Engine:
    """Relations are Parquet folders; a change writes a new version beside the old and then moves the pointer, with one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None) -> None:
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings or Settings()

    def _versions(self, name: str) -> str:
        return f"{self.path}/{name}.version"

    def _current(self, name: str) -> str:
        return self.spark.read.text(self._versions(name)).first()[0]

    def _point(self, name: str, version: str) -> None:
        self.spark.createDataFrame([(version,)], "v string").coalesce(1).write.mode("overwrite").text(self._versions(name))

    def init(self) -> None:
        for name, schema in RELATIONS.items():
            version = f"{self.path}/{name}/{uuid.uuid4().hex}"
            self.spark.createDataFrame([], schema).write.mode("error").parquet(version)
            self._point(name, version)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(RELATIONS[name]).parquet(self._current(name))

    def replace(self, name: str, df: DataFrame) -> None:
        version = f"{self.path}/{name}/{uuid.uuid4().hex}"
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RELATIONS[name]]).write.parquet(version)
        self._point(name, version)

    def kept(self, df: DataFrame) -> DataFrame:
        """Rows written to the work folder and read back, so that what follows doesn't compute them anew."""
        path = f"{self.path}/work/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, name: str, df: DataFrame, key: str) -> None:
        """Add the rows whose key is new; of those that share one, one stays."""
        old = self.table(name)
        new = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RELATIONS[name]])
        self.replace(name, old.unionByName(tables.append_new(new, old, key)))

    def add_sites(self, requests: DataFrame, fetched: DataFrame) -> DataFrame:
        sites, refused = add_sites(self.table("sites"), requests, fetched, F.current_timestamp(), self.settings.site_poll_interval_seconds)
        refused = self.kept(refused)
        self.replace("sites", sites)
        return refused

    def list_sites(self) -> DataFrame:
        return tables.sites_in_order(self.table("sites"))

    def remove_site(self, url: str) -> list[str]:
        try:
            origin = normalize_origin(url)
        except ValueError as e:
            raise SiteError(str(e)) from e
        gone = self.delete(self.spark.createDataFrame([(origin,)], "base_url string"))
        if not gone:
            raise SiteError(f"no such site: {origin}")
        return gone

    def delete(self, base_urls: DataFrame) -> list[str]:
        """Delete sites(base_url) and all that hangs on them, which no daemon must write meanwhile; the origins that there were."""
        with exclusive(self.spark, self.path):
            left = schedule.delete_sites(base_urls, self.table("sites"), self.table("crawl_jobs"), self.table("pages"), self.table("chunks"))
            gone = [r["base_url"] for r in left.pop("deleted").collect()]
            if gone:
                for name, df in left.items():
                    self.replace(name, df)
        return gone

    def clean_up(self, robots: DataFrame, agent: str, dry_run: bool = True) -> tuple[list[str], DataFrame]:
        """Sites whose robots(base_url, text, error) forbid the agent everything, deleted if it is no dry run, and the tally."""
        blocked, tally = imports.robots_cleanup(self.table("sites"), robots, agent, dry_run)
        tally = self.kept(tally)
        return ([r["base_url"] for r in blocked.orderBy("base_url").collect()] if dry_run else self.delete(self.kept(blocked))), tally

    def import_sites(self, rows: DataFrame, kind: str, fetched: DataFrame, limit: int | None = None, refresh: bool = False) -> tuple[DataFrame, DataFrame]:
        """Add the wanted origins of a feed list (kind csv or json): refused requests (url, error), and the counts."""
        requests, counts = imports.import_requests(rows, self.table("sites"), kind, limit, refresh)
        counts = self.kept(counts)
        return self.add_sites(self.kept(requests), fetched), counts

    def status(self) -> tuple[DataFrame, DataFrame]:
        jobs = self.table("crawl_jobs")
        return status.index_stats(self.table("sites"), self.table("pages"), self.table("chunks"), jobs), status.failed_jobs(jobs)

    def index(self) -> retrieve.LexicalIndex:
        """The lexical index of the chunks. It is written once for each version of pages and chunks, and read from then on."""
        known = f"{self._current('pages')} {self._current('chunks')}"
        try:
            told = self._current("index")
        except AnalysisException:
            told = ""
        path, _, of = told.partition(" ")
        if of != known:
            path = f"{self.path}/index/{uuid.uuid4().hex}"
            chunks = self.table("chunks").select(F.col("id").alias("chunk_id"), "page_id", "start_offset", "content_length")
            cut = chunk_text(chunks, self.table("pages").select(F.col("id").alias("page_id"), "content"))
            retrieve.write_index(cut.select("chunk_id", "page_id", "content"), path)
            self._point("index", f"{path} {known}")
        return retrieve.read_index(self.spark, path)

    def search(self, text: str, vector: list[float] | None, language: str | None = None, published: tuple[str, str] = ("", ""), prefer_long: bool = False) -> DataFrame:
        """Ranked pages; blank text finds nothing, and without a vector only words count."""
        pages = self.table("pages").select(F.col("id").alias("page_id"), "url", "title", "content", "language", "published_at")
        start, end = parse_range(*published)
        filters = (*((by_language(language.lower()),) if language else ()), by_published_range(start, end))
        stored = self.table("chunks").withColumnRenamed("id", "chunk_id").join(pages.select("page_id", "language", "published_at"), "page_id")
        words = plans.query_terms(text)
        runs = [plans.bm25_run(self.index(), words, self.settings.retriever_limit, pages, filters)]
        if vector is not None:
            runs.insert(0, plans.dense_run(stored, vector, self.settings.retriever_limit, filters))
        rerankers = (plans.rank.length_run,) if prefer_long else ()
        found = plans.fuse(runs, pages, rerankers, self.settings.rrf_k, self.settings.result_limit)
        return plans.display(found, pages)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="fernweave")
    parser.add_argument("--path", required=True)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("init")
    commands.add_parser("status")
    commands.add_parser("daemon")
    site = commands.add_parser("site").add_subparsers(dest="action", required=True)
    site.add_parser("list")
    for name in ("add", "remove"):
        one = site.add_parser(name)
        one.add_argument("url")
        if name == "add":
            one.add_argument("--feed", default="auto")
            one.add_argument("--sitemap", default="auto")
            one.add_argument("--fetched", required=True)
    search = commands.add_parser("search")
    search.add_argument("text")
    search.add_argument("--lang")
    search.add_argument("--from", dest="start", default="")
    search.add_argument("--to", dest="end", default="")
    search.add_argument("--long", action="store_true")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("fernweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    settings = Settings.from_env()
    configure_logging(settings.log_level)
    engine = Engine(spark, given.path, settings)
    try:
        if given.command == "init":
            engine.init()
        elif given.command == "status":
            for df in engine.status():
                df.show(truncate=False)
        elif given.command == "search":
            vector = EmbeddingClient(engine.settings).query(given.text) if engine.settings.embedding_api_base and given.text.strip() else None
            engine.search(given.text, vector, given.lang, (given.start, given.end), given.long).show(64, truncate=80)
        elif given.command == "daemon":
            run_daemon(engine, partial(fetch_table, delay=engine.settings.fetch_delay_seconds), EmbeddingClient(engine.settings).documents, threading.Event())
        elif given.action == "list":
            engine.list_sites().select("base_url", "feed_url", "sitemap_url", "next_poll_at", "sync_error").show(1000, truncate=False)
        elif given.action == "remove":
            print("\n".join(engine.remove_site(given.url)))
        else:
            requests = spark.createDataFrame([(given.url, given.feed, given.sitemap)], "url string, feed string, sitemap string")
            refused = engine.add_sites(requests, spark.read.parquet(given.fetched)).collect()
            for row in refused:
                print(f"{row['url']}: {row['error']}", file=sys.stderr)
            return int(bool(refused))
    except (EngineError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    except AnalysisException as e:
        print(f"{e.getCondition()}: run init first?", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
