"""Queries of the engine's operators over the test tables, with DuckDB SQL for each that SQL can express.

Test tables stand for the relations: documents are pages, embeddings chunk vectors (three to a page),
events crawl jobs, pages raw HTML, benchmark query texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.config import shared_folder
from fernweave.functions import text as T
from fernweave.functions import url as U
from fernweave.operators import chunk, queue, rank, retrieve, schedule, status
from fernweave.operators.filters import by_language, by_published_range, compiled
from fernweave.plans import search as S
from fernweave.sources import feeds, fetch, html, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW = "2024-01-15 00:00:00"
WORDS = "the and password heon"
DIGITS = 6


def query(name: str, sql: str | None = None):
    def register(fun):
        QUERIES[name] = fun
        if sql:
            ORACLE[name] = sql
        return fun

    return register


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _now():
    return F.lit(NOW).cast("timestamp")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("https://"), "source", F.lit(".example/p/"), F.col("doc_id").cast("string")).alias("url"), "source",
        F.element_at(F.split("text", "\n", 2), 1).alias("title"), F.col("text").alias("content"), F.col("lang").alias("language"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 86400).alias("published_at"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("fetched_at"),
    )


PAGES = """pg AS (SELECT doc_id AS page_id, 'https://' || source || '.example/p/' || doc_id AS url, source, split_part(text, chr(10), 1) AS title, text AS content, lang AS language,
    TIMESTAMP '2024-01-01' + to_days(doc_id::INTEGER) AS published_at, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS fetched_at FROM documents)"""


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    made = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 3).cast("long").alias("page_id"), "embedding")
    return made.join(pages(spark, sf).select("page_id", "language", "published_at"), "page_id")


CHUNKS = "ch AS (SELECT vec_id AS chunk_id, vec_id // 3 AS page_id, embedding FROM embeddings)"
QUERY_VECTOR = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"
COSINE = f"round(list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q)), {DIGITS})"


def vector(spark: SparkSession, sf: str) -> list[float]:
    return list(_table(spark, sf, "embeddings").filter("vec_id = 0").first()["embedding"])


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    ts = F.col("ts").cast("timestamp")
    none = F.lit(None)
    return _table(spark, sf, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("site_id"),
        F.concat(F.lit("https://src"), (F.col("event_id") % 20).cast("string"), F.lit(".example/p/"), F.col("event_id").cast("string")).alias("url"),
        F.lit("feed").alias("source"), (F.col("event_id") % 12).cast("int").alias("attempt_count"),
        F.when(~failed, queue.after(ts, (F.col("event_id") % 7) * 3600)).alias("next_attempt_at"),
        F.when(F.col("event_id") % 5 == 0, queue.after(ts, 86400 * 7)).alias("lease_until"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("t"), F.col("event_id").cast("string"))).alias("lease_token"),
        F.when(failed, F.concat(F.lit("E"), F.col("event_id").cast("string"))).otherwise(none).alias("last_error"),
        F.when(failed, ts).alias("failed_at"), ts.alias("discovered_at"),
    )


JOBS = """jb AS (SELECT event_id AS id, user_id % 50 AS site_id, 'https://src' || (event_id % 20) || '.example/p/' || event_id AS url, 'feed' AS source, (event_id % 12)::INTEGER AS attempt_count,
    CASE WHEN event_type <> 'error' THEN ts + to_hours(event_id % 7) END AS next_attempt_at, CASE WHEN event_id % 5 = 0 THEN ts + to_days(7) END AS lease_until,
    CASE WHEN event_id % 5 = 0 THEN 't' || event_id END AS lease_token, CASE WHEN event_type = 'error' THEN 'E' || event_id END AS last_error,
    CASE WHEN event_type = 'error' THEN ts END AS failed_at, ts AS discovered_at FROM events)"""


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """One for each customer; some never scheduled."""
    key = F.col("c_custkey")
    return _table(spark, sf, "customer").select(
        key.alias("id"), F.concat(F.lit("https://c"), key.cast("string"), F.lit(".example")).alias("base_url"), F.lit(None).cast("string").alias("sitemap_url"),
        F.concat(F.lit("https://c"), key.cast("string"), F.lit(".example/feed")).alias("feed_url"), F.lit(None).cast("timestamp").alias("last_polled_at"),
        F.when(key % 4 != 0, F.timestamp_seconds(F.lit(1705276800) + (key % 9 - 4) * 3600)).alias("next_poll_at"),
        F.concat(F.lit("e"), key.cast("string")).alias("feed_etag"), F.lit(None).cast("string").alias("feed_last_modified"), (key % 13).cast("int").alias("poll_failures"),
        F.when(key % 3 == 0, F.timestamp_seconds(F.lit(1705276800) + (key % 5 - 2) * 600)).alias("poll_lease_until"), F.concat(F.lit("t"), key.cast("string")).alias("poll_lease_token"),
        F.lit(None).cast("string").alias("sync_error"), (key % 2 == 0).alias("history_pending"), F.lit(None).cast("string").alias("history_error"), F.timestamp_seconds(F.lit(1704067200)).alias("added_at"),
    )


SITES = """st AS (SELECT c_custkey AS id, 'https://c' || c_custkey || '.example' AS base_url, 'https://c' || c_custkey || '.example/feed' AS feed_url,
    CASE WHEN c_custkey % 4 <> 0 THEN TIMESTAMP '2024-01-15' + to_hours(c_custkey % 9 - 4) END AS next_poll_at, 'e' || c_custkey AS feed_etag, (c_custkey % 13)::INTEGER AS poll_failures,
    CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-15' + to_seconds((c_custkey % 5 - 2) * 600) END AS poll_lease_until, 't' || c_custkey AS poll_lease_token, c_custkey % 2 = 0 AS history_pending FROM customer)"""


def _seconds(*names: str):
    return [F.unix_timestamp(n).alias(n) for n in names]


# --- ranking ------------------------------------------------------------------------------------

DENSE = f"dr AS (SELECT chunk_id, page_id, {COSINE} AS score FROM ch ORDER BY score DESC, chunk_id LIMIT 64)"


@query("r1_dense_topk", f"WITH {CHUNKS}, {QUERY_VECTOR}, {DENSE} SELECT * FROM dr")
def _(spark, sf):
    return retrieve.dense_top_k(chunks(spark, sf), vector(spark, sf), 64, decimals=DIGITS)


@query("r3_dense_filtered", f"""WITH {PAGES}, {CHUNKS}, {QUERY_VECTOR} SELECT chunk_id, page_id, {COSINE} AS score FROM ch JOIN pg USING (page_id)
    WHERE language = 'en' AND published_at >= TIMESTAMP '2024-01-05' AND published_at < TIMESTAMP '2024-04-11' ORDER BY score DESC, chunk_id LIMIT 64""")
def _(spark, sf):
    wanted = (by_language("en"), by_published_range(date(2024, 1, 5), date(2024, 4, 10)))
    return retrieve.dense_top_k(chunks(spark, sf), vector(spark, sf), 64, wanted, decimals=DIGITS)


_TERMS = "regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')"
LEXICAL = f"""tk AS (SELECT page_id AS chunk_id, page_id, {_TERMS} AS ts FROM pg), cs AS (SELECT chunk_id, page_id, len(ts) AS dl FROM tk),
    po AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(ts) AS term FROM tk) GROUP BY ALL), td AS (SELECT term, count(*) AS df FROM po GROUP BY term),
    co AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM cs)"""
_IN = ", ".join(f"'{w}'" for w in WORDS.split())
_SCORE = "round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))), 6)"
BM25 = f"""br AS (SELECT chunk_id, page_id, {_SCORE} AS score FROM po JOIN td USING (term) JOIN cs USING (chunk_id), co WHERE term IN ({_IN})
    GROUP BY chunk_id, page_id ORDER BY score DESC, chunk_id LIMIT 64)"""


_written: dict[tuple[str, str], str] = {}


def _index(spark, sf):
    """The index of the pages, which a session writes once for each folder, as the engine does after a change, and then reads."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _written:
        path = f"{shared_folder(spark)}/lexical-index-{uuid.uuid4().hex}"
        retrieve.write_index(pages(spark, sf).select(F.col("page_id").alias("chunk_id"), "page_id", "content"), path, 8)
        _written[key] = path
    return retrieve.read_index(spark, _written[key])


@query("r2_bm25_topk", f"WITH {PAGES}, {LEXICAL}, {BM25} SELECT * FROM br")
def _(spark, sf):
    return retrieve.bm25_top_k(_index(spark, sf), S.query_terms(WORDS), 64, decimals=DIGITS)


@query("r4_bm25_filtered", f"""WITH {PAGES}, {LEXICAL} SELECT chunk_id, cs.page_id, {_SCORE} AS score FROM po JOIN td USING (term) JOIN cs USING (chunk_id) JOIN pg ON pg.page_id = cs.page_id, co
    WHERE term IN ({_IN}) AND language = 'en' GROUP BY chunk_id, cs.page_id ORDER BY score DESC, chunk_id LIMIT 64""")
def _(spark, sf):
    return retrieve.bm25_top_k(_index(spark, sf), S.query_terms(WORDS), 64, pages(spark, sf), (by_language("en"),), decimals=DIGITS)


@query("u22_postings", f"WITH {PAGES}, {LEXICAL} SELECT term, df, sum(tf)::BIGINT AS tf, sum(chunk_id)::BIGINT AS held_by FROM po JOIN td USING (term) GROUP BY ALL")
def _(spark, sf):
    made = _index(spark, sf)
    held = made.postings.groupBy("term").agg(F.sum("tf").cast("long").alias("tf"), F.sum("chunk_id").alias("held_by"))
    return made.term_stats.join(held, "term").select("term", "df", "tf", "held_by")


RUNS = f"""r0 AS (SELECT 0 AS run_no, 2.0::DOUBLE AS weight, chunk_id, page_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM dr
    UNION ALL SELECT 1, 0.5::DOUBLE, chunk_id, page_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) FROM br)"""
PAGE_RUNS = f"""nr AS (SELECT *, row_number() OVER (PARTITION BY run_no, page_id ORDER BY rank) AS nth FROM r0),
    pr0 AS (SELECT run_no, weight, page_id, round(sum(score * pow(0.1, nth - 1)), {DIGITS}) AS score, sum(score * pow(0.1, nth - 1)) AS raw, min(rank) AS first_rank FROM nr WHERE nth <= 3 GROUP BY ALL),
    pr AS (SELECT run_no, weight, page_id, score, row_number() OVER (PARTITION BY run_no ORDER BY raw DESC, first_rank) AS rank FROM pr0)"""


def _runs(spark, sf):
    return [S.dense_run(chunks(spark, sf), vector(spark, sf), 64, decimals=DIGITS), S.bm25_run(_index(spark, sf), S.query_terms(WORDS), 64, decimals=DIGITS)]


@query("r5_make_run", f"WITH {CHUNKS}, {QUERY_VECTOR}, {DENSE} SELECT chunk_id, page_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM dr")
def _(spark, sf):
    return S.dense_run(chunks(spark, sf), vector(spark, sf), 64, decimals=DIGITS).select("chunk_id", "page_id", "score", "rank")


@query("r6_chunk_union", f"""WITH {PAGES}, {CHUNKS}, {QUERY_VECTOR}, {DENSE}, {LEXICAL}, {BM25}, {RUNS}
    SELECT chunk_id, min(run_no) AS first_run, arg_min(rank, run_no) AS first_rank, max(score) FILTER (run_no = 0) AS dense, max(score) FILTER (run_no = 1) AS bm25 FROM r0 GROUP BY chunk_id""")
def _(spark, sf):
    dense, bm25 = _runs(spark, sf)
    return rank.union_candidates(dense.unionByName(bm25), "chunk_id", ("dense", "bm25"))


@query("r8_page_run", f"WITH {CHUNKS}, {QUERY_VECTOR}, {DENSE}, br AS (SELECT * FROM dr WHERE false), {RUNS}, {PAGE_RUNS} SELECT page_id, score, rank FROM pr")
def _(spark, sf):
    return rank.page_run(S.dense_run(chunks(spark, sf), vector(spark, sf), 64, decimals=DIGITS)).select("page_id", F.round("score", DIGITS).alias("score"), "rank")


@query("r7_page_union", f"""WITH {PAGES}, {CHUNKS}, {QUERY_VECTOR}, {DENSE}, {LEXICAL}, {BM25}, {RUNS}, {PAGE_RUNS}
    SELECT page_id, row_number() OVER (ORDER BY r.run_no, r.rank) AS union_pos FROM (SELECT page_id, min({{'run_no': run_no, 'rank': rank}}) AS r FROM pr GROUP BY page_id)""")
def _(spark, sf):
    dense, bm25 = (rank.page_run(r) for r in _runs(spark, sf))
    return rank.page_union(dense.unionByName(bm25))


_UNION = "un AS (SELECT page_id, row_number() OVER (ORDER BY r.run_no, r.rank) AS union_pos FROM (SELECT page_id, min({'run_no': run_no, 'rank': rank}) AS r FROM pr GROUP BY page_id))"


@query("r9_length_run", f"""WITH {PAGES}, {CHUNKS}, {QUERY_VECTOR}, {DENSE}, {LEXICAL}, {BM25}, {RUNS}, {PAGE_RUNS}, {_UNION}
    SELECT page_id, length(content)::DOUBLE AS score, row_number() OVER (ORDER BY length(content) DESC, union_pos) AS rank FROM un JOIN pg USING (page_id)""")
def _(spark, sf):
    dense, bm25 = (rank.page_run(r) for r in _runs(spark, sf))
    return rank.length_run(rank.page_union(dense.unionByName(bm25)), pages(spark, sf)).select("page_id", "score", "rank")


FUSED = """fu AS (SELECT page_id, round(sum(weight / (60 + rank)), 10) AS rrf, min({'run_no': run_no, 'rank': rank}) AS first, max(score) FILTER (run_no = 0) AS dense,
    max(score) FILTER (run_no = 1) AS bm25, max(score) FILTER (run_no = 2) AS length FROM al GROUP BY page_id)"""


@query("r10_fusion", f"""WITH {PAGES}, {CHUNKS}, {QUERY_VECTOR}, {DENSE}, {LEXICAL}, {BM25}, {RUNS}, {PAGE_RUNS}, al AS (SELECT * FROM pr), {FUSED}
    SELECT page_id, rrf FROM fu ORDER BY rrf DESC, first.run_no, first.rank LIMIT 64""")
def _(spark, sf):
    return S.fuse(_runs(spark, sf), pages(spark, sf), decimals=DIGITS).select("page_id", "rrf")


@query("r11_search", f"""WITH {PAGES}, {CHUNKS}, {QUERY_VECTOR}, {DENSE}, {LEXICAL}, {BM25}, {RUNS}, {PAGE_RUNS}, {_UNION},
    al AS (SELECT run_no, weight, page_id, score, rank FROM pr UNION ALL SELECT 2, 1.0, page_id, length(content), row_number() OVER (ORDER BY length(content) DESC, union_pos) FROM un JOIN pg USING (page_id)), {FUSED}
    SELECT page_id, dense, bm25, length, rrf, row_number() OVER (ORDER BY rrf DESC, first.run_no, first.rank) AS position FROM fu ORDER BY rrf DESC, first.run_no, first.rank LIMIT 64""")
def search(spark, sf):
    everything = pages(spark, sf)
    return S.search(chunks(spark, sf), _index(spark, sf), everything, WORDS, vector(spark, sf), prefer_long=True, decimals=DIGITS)


@query("p5_display", f"""WITH {PAGES}, {CHUNKS}, {QUERY_VECTOR}, {DENSE}, br AS (SELECT * FROM dr WHERE false), {RUNS}, {PAGE_RUNS}
    SELECT page_id, url, title, substr(content, 1, 500) AS snippet, length(content) > 500 AS is_truncated, strftime(published_at, '%Y-%m-%d') AS published_date,
    CASE WHEN score >= 0.65 THEN 'high' WHEN score >= 0.5 THEN 'mid' ELSE 'low' END AS confidence, rank AS position FROM pr JOIN pg USING (page_id)""")
def _(spark, sf):
    run = S.dense_run(chunks(spark, sf), vector(spark, sf), 64, decimals=DIGITS)
    shown = S.display(S.fuse([run], pages(spark, sf), decimals=DIGITS), pages(spark, sf))
    return shown.select("page_id", "url", "title", "snippet", "is_truncated", F.col("published_date").cast("string").alias("published_date"), "confidence", "position")


# --- filters, scans, set operations ---------------------------------------------------------------


@query("p1_p2_p3_filters", f"WITH {PAGES} SELECT page_id FROM pg WHERE language = 'fr' AND published_at >= TIMESTAMP '2024-02-01' AND published_at < TIMESTAMP '2024-08-02'")
def _(spark, sf):
    df = pages(spark, sf)
    return df.filter(compiled((by_language("fr"), by_published_range(date(2024, 2, 1), date(2024, 8, 1))), df)).select("page_id")


@query("p2_open_range", f"WITH {PAGES} SELECT page_id FROM pg WHERE published_at < TIMESTAMP '2024-01-21'")
def _(spark, sf):
    df = pages(spark, sf)
    return df.filter(compiled((by_published_range(None, date(2024, 1, 20)),), df)).select("page_id")


@query("p4_u9_dates", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN epoch(date_trunc('day', ts))::BIGINT END AS day FROM events")
def _(spark, sf):
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyyMMdd")).otherwise(F.lit(""))
    return _table(spark, sf, "events").select("event_id", F.unix_timestamp(T.parse_date(text)).alias("day"))


@query("p6_confidence", "SELECT event_id, CASE WHEN value % 1 >= 0.65 THEN 'high' WHEN value % 1 >= 0.5 THEN 'mid' ELSE 'low' END AS confidence FROM events")
def _(spark, sf):
    return _table(spark, sf, "events").select("event_id", T.confidence(F.col("value") % 1).alias("confidence"))


_SECTIONS = "about contact privacy terms tag tags category categories author authors attachment attachments archive archives".split()
#: what pages are asked under besides their own paths
_PATHS = ("about-me", "About", "Tags/x", "categories/x", "contact-tracing", "archive.html", "terms-of-service-review", "2024/archives", "author/jane/", "roundabout/post", "privacy?x=1", "x.tag/category")


@query("p7_post_urls", f"""SELECT page_id, NOT list_has_any(string_split(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '/')[2:], {_SECTIONS}) AS is_post,
    NOT list_has_any(string_split(lower(regexp_replace({list(_PATHS)}[page_id % {len(_PATHS)} + 1], '[?].*', '')), '/'), {_SECTIONS}) AS other_is_post FROM pages""")
def _(spark, sf):
    other = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("page_id") % len(_PATHS) + 1).cast("int"))
    return _table(spark, sf, "pages").select("page_id", U.is_post_url(F.col("url")).alias("is_post"), U.is_post_url(F.concat(F.lit("https://about.example/"), other)).alias("other_is_post"))


_PLAIN_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1))"


@query("u2_normalized_plain", """SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*')) ||
    CASE WHEN regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://[^/?#]*', '') LIKE '/%' THEN '' ELSE '/' END ||
    regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://[^/?#]*', '') AS url FROM pages""")
def _(spark, sf):
    return _table(spark, sf, "pages").select("page_id", U.plain_normalized(F.col("url")).alias("url"))


@query("u2_normalized", ORACLE["u2_normalized_plain"])
def _(spark, sf):
    return _table(spark, sf, "pages").select("page_id", U.normalized("url").alias("url"))


@query("u3_origins", f"SELECT lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*')) AS origin, count(*) AS n FROM pages GROUP BY 1")
def _(spark, sf):
    return _table(spark, sf, "pages").groupBy(U.origin("url").alias("origin")).agg(F.count("*").alias("n"))


@query("u5_canonical", "SELECT page_id, 'https://site.example' || CASE WHEN p LIKE '/%' THEN p ELSE '/' || p END AS url FROM (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://[^/?#]*', '') AS p FROM pages)")
def _(spark, sf):
    return _table(spark, sf, "pages").select("page_id", U.canonical("url", F.lit("https://site.example")).alias("url"))


@query("u6_same_site", f"SELECT page_id, regexp_replace({_PLAIN_HOST}, '^www\\.', '') = (SELECT regexp_replace({_PLAIN_HOST}, '^www\\.', '') FROM pages WHERE page_id = 0) AS same FROM pages")
def _(spark, sf):
    df = _table(spark, sf, "pages")
    first = df.filter("page_id = 0").select(F.col("url").alias("other"))
    return df.crossJoin(F.broadcast(first)).select("page_id", U.is_same_site("url", "other").alias("same"))


@query("s13_pages_by_id", f"WITH {PAGES} SELECT page_id, title FROM pg WHERE page_id IN (SELECT vec_id // 3 FROM embeddings WHERE label = 3)")
def _(spark, sf):
    ids = _table(spark, sf, "embeddings").filter("label = 3").select(F.floor(F.col("vec_id") / 3).cast("long").alias("page_id"))
    return tables.pages_by_id(pages(spark, sf), ids).select("page_id", "title")


@query("s14_sites", f"WITH {SITES} SELECT id, base_url FROM st ORDER BY base_url")
def _(spark, sf):
    return tables.sites_in_order(sites(spark, sf)).select("id", "base_url")


@query("s15_ping", "SELECT 1 AS one")
def _(spark, sf):
    return tables.ping(spark)


@query("s17_append_pages", "SELECT min(doc_id) AS id, text AS url FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id < 50) GROUP BY text")
def _(spark, sf):
    docs = _table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("url"))
    return tables.append_pages(docs, docs.filter("id < 50")).select("id", "url")


@query("j1_chunk_pages", f"WITH {PAGES}, {CHUNKS} SELECT language, count(*) AS n, sum(chunk_id)::BIGINT AS total FROM ch JOIN pg USING (page_id) GROUP BY language")
def _(spark, sf):
    return chunks(spark, sf).groupBy("language").agg(F.count("*").alias("n"), F.sum("chunk_id").alias("total"))


@query("a4_languages", "SELECT DISTINCT lang AS language FROM documents WHERE lang IS NOT NULL ORDER BY 1")
def _(spark, sf):
    return status.available_languages(pages(spark, sf))


@query("a7_language_options", "SELECT array_to_string(list_sort(list_distinct(list_append(list(DISTINCT lang), 'zz'))), ',') AS options FROM documents")
def _(spark, sf):
    return status.language_options(pages(spark, sf), "zz").select(F.array_join("options", ",").alias("options"))


@query("a5_best_feed", "SELECT site AS origin, event_id AS feed FROM (SELECT 's' || user_id % 50 AS site, event_id, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id % 4, value DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(spark, sf):
    rows = _table(spark, sf, "events").select(F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")).alias("origin"), F.col("event_id").alias("feed_url"), (F.col("event_id") % 4).alias("errors"), F.col("value").alias("fetched"))
    return status.json_feeds(rows).select("origin", F.col("feed_url").alias("feed"))


@query("a6_first_feed", "SELECT 's' || user_id % 50 AS origin, min(event_id) AS feed FROM events GROUP BY 1")
def _(spark, sf):
    rows = _table(spark, sf, "events").select(F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")).alias("origin"), F.col("event_id").alias("feed_url"), F.col("event_id").alias("line_no"))
    return status.csv_feeds(rows).select("origin", F.col("feed_url").alias("feed"))


@query("a8_cleanup_tally", "SELECT count(*) AS checked, count(*) FILTER (event_id % 7 <> 0 AND event_id % 3 <> 0) AS kept, count(*) FILTER (event_id % 7 <> 0 AND event_id % 3 = 0) AS blocked, count(*) FILTER (event_id % 6 = 0) AS removed, count(*) FILTER (event_id % 7 = 0) AS failures FROM events")
def _(spark, sf):
    n = F.col("event_id")
    return status.cleanup_tally(_table(spark, sf, "events").select(n.cast("string").alias("base_url"), F.when(n % 7 == 0, "x").alias("error"), (n % 3 == 0).alias("blocked"), (n % 6 == 0).alias("removed")))


@query("u1_j4_known_urls", f"WITH {PAGES}, {JOBS}, cand AS (SELECT url FROM pg WHERE page_id % 2 = 0 UNION SELECT 'https://src' || (event_id % 20) || '.example/p/' || (event_id + 5) FROM events) SELECT url FROM cand WHERE url IN (SELECT url FROM pg UNION SELECT url FROM jb)")
def _(spark, sf):
    more = _table(spark, sf, "events").select(F.concat(F.lit("https://src"), (F.col("event_id") % 20).cast("string"), F.lit(".example/p/"), (F.col("event_id") + 5).cast("string")).alias("url"))
    candidates = pages(spark, sf).filter("page_id % 2 = 0").select("url").union(more)
    return queue.known_urls(candidates, pages(spark, sf), jobs(spark, sf))


@query("w3_enqueue", f"""WITH {PAGES}, {JOBS}, cand AS (SELECT user_id % 50 AS site_id, 'https://src' || (event_id % 20) || '.example/p/' || (event_id // 2 * 3) AS url, event_id AS pos FROM events),
    f AS (SELECT url, arg_min(site_id, pos) AS site_id FROM cand GROUP BY url) SELECT url, site_id, 0 AS attempt_count FROM f WHERE url NOT IN (SELECT url FROM pg) AND url NOT IN (SELECT url FROM jb)""")
def _(spark, sf):
    n = F.col("event_id")
    cand = _table(spark, sf, "events").select((F.col("user_id") % 50).alias("site_id"), F.concat(F.lit("https://src"), (n % 20).cast("string"), F.lit(".example/p/"), (F.floor(n / 2) * 3).cast("string")).alias("url"), F.lit("feed").alias("source"), n.alias("pos"))
    return queue.enqueue(cand, pages(spark, sf), jobs(spark, sf), _now()).select("url", "site_id", "attempt_count")


@query("t9_history_budget", """WITH e AS (SELECT user_id % 50 AS site_id, 'u' || event_id % 997 AS url, event_id AS pos FROM events), seen AS (SELECT DISTINCT site_id, url FROM e WHERE pos % 10 = 0),
    f AS (SELECT site_id, url, min(pos) AS pos FROM e GROUP BY ALL), fr AS (SELECT f.* FROM f ANTI JOIN seen USING (site_id, url)),
    n AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY pos) AS nth, count(*) OVER (PARTITION BY site_id) AS fresh FROM fr)
    SELECT n.site_id, url, pos, fresh > 60 - coalesce(used, 0) AS overflow FROM n LEFT JOIN (SELECT site_id, count(*) AS used FROM seen GROUP BY 1) u ON u.site_id = n.site_id WHERE nth <= 60 - coalesce(used, 0)""")
def _(spark, sf):
    rows = _table(spark, sf, "events").select((F.col("user_id") % 50).alias("site_id"), F.concat(F.lit("u"), (F.col("event_id") % 997).cast("string")).alias("url"), F.col("event_id").alias("pos"))
    return queue.within_budget(rows, rows.filter("pos % 10 = 0"), 60)


# --- queue and schedule ---------------------------------------------------------------------------


@query("p9_ready_jobs", f"WITH {JOBS} SELECT id FROM jb WHERE next_attempt_at <= TIMESTAMP '{NOW}' AND (lease_until IS NULL OR lease_until <= TIMESTAMP '{NOW}')")
def _(spark, sf):
    return jobs(spark, sf).filter(queue.is_ready(_now())).select("id")


@query("a9_busy_sites", f"WITH {JOBS} SELECT site_id, count(*) AS running FROM jb WHERE lease_until > TIMESTAMP '{NOW}' GROUP BY 1")
def _(spark, sf):
    return queue.busy_sites(jobs(spark, sf), _now())


@query("w4_claim_jobs", f"""WITH {JOBS}, r AS (SELECT * FROM jb WHERE next_attempt_at <= TIMESTAMP '{NOW}' AND (lease_until IS NULL OR lease_until <= TIMESTAMP '{NOW}')),
    n AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY next_attempt_at, id) AS nth FROM r)
    SELECT id, site_id, url FROM n ORDER BY nth > 1 OR site_id IN (SELECT site_id FROM jb WHERE lease_until > TIMESTAMP '{NOW}'), next_attempt_at, id LIMIT 60""")
def _(spark, sf):
    return queue.claim(jobs(spark, sf), _now(), 60).select("id", "site_id", "url")


def _reports(spark, sf):
    n = F.col("event_id")
    return _table(spark, sf, "events").filter("event_id % 10 = 0").select(
        n.alias("id"), F.when(n % 30 == 0, "wrong").otherwise(F.concat(F.lit("t"), n.cast("string"))).alias("token"), F.when(n % 40 == 0, "done").when(n % 50 == 0, "renew").otherwise("error").alias("outcome"),
        F.when(n % 20 == 0, "permanent").when(n % 70 == 0, "content").otherwise("transient").alias("error_kind"), F.lit("boom").alias("error"),
    )


@query("w5_w8_transitions", f"""WITH {JOBS}, rp AS (SELECT event_id AS id, CASE WHEN event_id % 30 = 0 THEN 'wrong' ELSE 't' || event_id END AS token, CASE WHEN event_id % 40 = 0 THEN 'done' WHEN event_id % 50 = 0 THEN 'renew' ELSE 'error' END AS outcome,
    CASE WHEN event_id % 20 = 0 THEN 3 WHEN event_id % 70 = 0 THEN 1 ELSE 10 END AS budget FROM events WHERE event_id % 10 = 0),
    x AS (SELECT jb.*, outcome, budget, coalesce(token = lease_token AND lease_until > TIMESTAMP '{NOW}', false) AS ok FROM jb LEFT JOIN rp USING (id))
    SELECT id, attempt_count + (ok AND outcome = 'error')::INTEGER AS attempt_count,
    epoch_us(CASE WHEN ok AND outcome = 'error' THEN CASE WHEN attempt_count + 1 >= budget THEN NULL ELSE TIMESTAMP '{NOW}' + to_seconds([300, 1800, 7200, 21600, 86400][least(attempt_count, 4) + 1]) END ELSE next_attempt_at END) // 1000000 AS next_attempt_at,
    epoch_us(CASE WHEN ok AND outcome = 'error' THEN NULL WHEN ok AND outcome = 'renew' THEN TIMESTAMP '{NOW}' + to_seconds(600) ELSE lease_until END) // 1000000 AS lease_until,
    CASE WHEN ok AND outcome = 'error' THEN 'boom' ELSE last_error END AS last_error, epoch_us(CASE WHEN ok AND outcome = 'error' AND attempt_count + 1 >= budget THEN TIMESTAMP '{NOW}' ELSE failed_at END) // 1000000 AS failed_at
    FROM x WHERE NOT (ok AND outcome = 'done')""")
def _(spark, sf):
    return queue.transition(jobs(spark, sf), _reports(spark, sf), _now()).select("id", "attempt_count", *_seconds("next_attempt_at", "lease_until"), "last_error", *_seconds("failed_at"))


@query("u15_retry_delay", "SELECT event_id, [300, 1800, 7200, 21600, 86400][least(event_id % 12, 4) + 1] AS delay FROM events")
def _(spark, sf):
    return _table(spark, sf, "events").select("event_id", T.retry_delay(F.col("event_id") % 12).alias("delay"))


@query("p10_w9_claim_sites", f"WITH {SITES} SELECT id, base_url FROM st WHERE next_poll_at <= TIMESTAMP '{NOW}' AND (poll_lease_until IS NULL OR poll_lease_until <= TIMESTAMP '{NOW}') ORDER BY next_poll_at, id LIMIT 20")
def _(spark, sf):
    return schedule.claim_due(sites(spark, sf), _now(), 20).select("id", "base_url")


def _tokens(spark, sf):
    key = F.col("c_custkey")
    return _table(spark, sf, "customer").filter("c_custkey % 5 = 0").select(
        key.alias("id"), F.when(key % 3 == 0, "wrong").otherwise(F.concat(F.lit("t"), key.cast("string"))).alias("token"), F.when(key % 2 == 0, "new").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit("boom").alias("error")
    )


_TOKENS = "tk AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'wrong' ELSE 't' || c_custkey END AS token, CASE WHEN c_custkey % 2 = 0 THEN 'new' END AS etag FROM customer WHERE c_custkey % 5 = 0), x AS (SELECT st.*, etag, coalesce(token = poll_lease_token, false) AS ok FROM st LEFT JOIN tk USING (id))"


@query("w10_renew_poll", f"WITH {SITES}, {_TOKENS} SELECT id, epoch_us(CASE WHEN ok THEN TIMESTAMP '{NOW}' + to_seconds(600) ELSE poll_lease_until END) // 1000000 AS poll_lease_until FROM x")
def _(spark, sf):
    return schedule.renew_poll(sites(spark, sf), _tokens(spark, sf), _now()).select("id", *_seconds("poll_lease_until"))


@query("w11_poll_succeeded", f"WITH {SITES}, {_TOKENS} SELECT id, epoch_us(CASE WHEN ok THEN TIMESTAMP '{NOW}' + to_seconds(43200) ELSE next_poll_at END) // 1000000 AS next_poll_at, CASE WHEN ok THEN coalesce(etag, feed_etag) ELSE feed_etag END AS feed_etag, CASE WHEN ok THEN 0 ELSE poll_failures END AS poll_failures FROM x")
def _(spark, sf):
    return schedule.poll_succeeded(sites(spark, sf), _tokens(spark, sf), _now(), 43_200).select("id", *_seconds("next_poll_at"), "feed_etag", "poll_failures")


@query("w12_u14_poll_failed", f"WITH {SITES}, {_TOKENS} SELECT id, epoch_us(CASE WHEN ok THEN TIMESTAMP '{NOW}' + to_seconds(least(43200, 300 * pow(2, least(poll_failures, 10)))::BIGINT) ELSE next_poll_at END) // 1000000 AS next_poll_at, poll_failures + ok::INTEGER AS poll_failures FROM x")
def _(spark, sf):
    return schedule.poll_failed(sites(spark, sf), _tokens(spark, sf), _now(), 43_200).select("id", *_seconds("next_poll_at"), "poll_failures")


@query("w13_history_flags", f"WITH {SITES} SELECT id, CASE WHEN id % 5 = 0 THEN id % 3 = 0 ELSE history_pending END AS history_pending FROM st")
def _(spark, sf):
    key = F.col("c_custkey")
    told = _table(spark, sf, "customer").filter("c_custkey % 5 = 0").select(key.alias("id"), (key % 3 == 0).alias("pending"), F.lit(None).cast("string").alias("error"))
    return schedule.mark_history(sites(spark, sf), told).select("id", "history_pending")


@query("w14_scatter", f"""WITH {SITES}, o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS position, count(*) OVER () AS total FROM st WHERE next_poll_at IS NULL OR next_poll_at <= TIMESTAMP '{NOW}')
    SELECT id, epoch(TIMESTAMP '{NOW}')::BIGINT + 43200 * position // greatest(total, 1) AS next_poll_at FROM o""")
def _(spark, sf):
    return schedule.scatter(sites(spark, sf), _now(), 43_200).select("id", *_seconds("next_poll_at"))


@query("u12_poll_offset", f"WITH {SITES} SELECT id, (('0x' || substr(sha256(base_url), 1, 16))::UBIGINT % 3600)::BIGINT AS off FROM st")
def _(spark, sf):
    return sites(spark, sf).select("id", T.poll_offset(F.col("base_url"), 3600).alias("off"))


def _configs(spark, sf):
    key = F.col("c_custkey")
    return _table(spark, sf, "customer").filter("c_custkey % 6 = 0").select(
        F.concat(F.lit("https://c"), (key + F.when(key % 4 == 0, 1_000_000).otherwise(0)).cast("string"), F.lit(".example")).alias("base_url"), F.lit("https://x.example/map").alias("sitemap_url"),
        F.concat(F.lit("https://c"), key.cast("string"), F.when(key % 9 == 0, "/new").otherwise("/feed")).alias("feed_url"), (key % 100).alias("delay"),
    ).withColumn("feed_url", F.regexp_replace("feed_url", r"^https://c(\d+)/", "https://c$1.example/"))


@query("w1_j12_upsert", f"""WITH {SITES}, cf AS (SELECT 'https://c' || (c_custkey + CASE WHEN c_custkey % 4 = 0 THEN 1000000 ELSE 0 END) || '.example' AS base_url, 'https://c' || c_custkey || '.example/' || CASE WHEN c_custkey % 9 = 0 THEN 'new' ELSE 'feed' END AS new_feed, c_custkey % 100 AS delay FROM customer WHERE c_custkey % 6 = 0),
    x AS (SELECT *, new_feed IS NOT NULL AND (id IS NULL OR feed_url <> new_feed) AS moved FROM st FULL JOIN cf USING (base_url))
    SELECT base_url, coalesce(new_feed, feed_url) AS feed_url, epoch_us(CASE WHEN moved THEN TIMESTAMP '{NOW}' + to_seconds(delay) ELSE next_poll_at END) // 1000000 AS next_poll_at, CASE WHEN NOT moved THEN feed_etag END AS feed_etag,
    CASE WHEN moved THEN 0 ELSE poll_failures END AS poll_failures, CASE WHEN moved THEN false ELSE history_pending END AS history_pending FROM x""")
def _(spark, sf):
    return schedule.upsert_sites(sites(spark, sf), _configs(spark, sf), _now()).select("base_url", "feed_url", *_seconds("next_poll_at"), "feed_etag", "poll_failures", "history_pending")


@query("w2_delete_sites", f"""WITH {SITES}, {JOBS}, {PAGES}, {CHUNKS}, gone AS (SELECT id FROM st WHERE id % 3 = 0)
    SELECT 'job' AS kind, count(*) AS n, sum(id)::BIGINT AS total FROM jb WHERE site_id NOT IN (FROM gone) UNION ALL SELECT 'site', count(*), sum(id)::BIGINT FROM st WHERE id % 3 <> 0
    UNION ALL SELECT 'page', count(*), sum(page_id)::BIGINT FROM pg WHERE page_id % 50 NOT IN (FROM gone)
    UNION ALL SELECT 'chunk', count(*), sum(chunk_id)::BIGINT FROM ch WHERE page_id NOT IN (SELECT page_id FROM pg WHERE page_id % 50 IN (FROM gone))
    UNION ALL SELECT 'deleted', count(*), sum(length(base_url))::BIGINT FROM st WHERE id % 3 = 0""")
def _(spark, sf):
    gone = sites(spark, sf).filter("id % 3 = 0").select("base_url")
    paged = pages(spark, sf).select(F.col("page_id").alias("id"), (F.col("page_id") % 50).alias("site_id"))
    left = schedule.delete_sites(gone, sites(spark, sf), jobs(spark, sf), paged, chunks(spark, sf))
    kinds = (("job", "crawl_jobs", "id"), ("site", "sites", "id"), ("page", "pages", "id"), ("chunk", "chunks", "chunk_id"), ("deleted", "deleted", "base_url"))
    made = [left[name].agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum(F.length(by) if kind == "deleted" else by).cast("long").alias("total")) for kind, name, by in kinds]
    return reduce(DataFrame.unionByName, made)


# --- status ---------------------------------------------------------------------------------------


@query("w18_index_stats", f"WITH {JOBS} SELECT (SELECT count(*) FROM customer) AS site_count, (SELECT count(*) FROM documents) AS page_count, (SELECT count(*) FROM embeddings) AS chunk_count, count(*) FILTER (failed_at IS NULL) AS queued, count(*) FILTER (failed_at IS NULL AND attempt_count > 0) AS retrying, count(*) FILTER (failed_at IS NOT NULL) AS failed FROM jb")
def _(spark, sf):
    return status.index_stats(sites(spark, sf), pages(spark, sf), _table(spark, sf, "embeddings"), jobs(spark, sf))


@query("w17_t4_failed_jobs", f"WITH {JOBS} SELECT url, attempt_count, epoch_us(failed_at) // 1000000 AS failed_at, last_error FROM jb WHERE failed_at IS NOT NULL ORDER BY jb.failed_at DESC, url LIMIT 10")
def _(spark, sf):
    return status.failed_jobs(jobs(spark, sf)).select("url", "attempt_count", *_seconds("failed_at"), "last_error")


@query("w16_u2_t3_activity", f"""WITH {PAGES}, {JOBS}, b AS (SELECT url, 'success' AS status, fetched_at AS o, NULL::INTEGER AS attempt_count, NULL::VARCHAR AS detail FROM pg UNION ALL SELECT url, 'failure', failed_at, attempt_count, last_error FROM jb WHERE failed_at IS NOT NULL)
    SELECT url, status, epoch_us(o) // 1000000 AS occurred_at, coalesce(attempt_count, -1) AS attempt_count, detail FROM b ORDER BY o DESC, url LIMIT 10""")
def _(spark, sf):
    found = status.recent_activity(pages(spark, sf), jobs(spark, sf))
    return found.select("url", "status", *_seconds("occurred_at"), F.coalesce("attempt_count", F.lit(-1)).alias("attempt_count"), "detail")


# --- chunks and texts -----------------------------------------------------------------------------

WINDOWS = f"""tk AS (SELECT page_id, content, regexp_extract_all(content, '\\S+') AS ws FROM pg), cn AS (SELECT *, CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= 64 THEN 1 ELSE ceil((len(ws) - 64) / 56.0)::INTEGER + 1 END AS n FROM tk)"""


@query("u10_windows", f"WITH {PAGES}, {WINDOWS} SELECT page_id, i::INTEGER AS chunk_no, array_to_string(ws[i * 56 + 1:least(i * 56 + 64, len(ws))], ' ') AS words FROM (SELECT page_id, ws, unnest(range(0, n)) AS i FROM cn)")
def _(spark, sf):
    made = chunk.word_windows(pages(spark, sf), 64, 8)
    return made.select("page_id", "chunk_no", F.regexp_replace("content", r"\s+", " ").alias("words"))


@query("u10_offsets", f"""WITH {PAGES}, {WINDOWS}, tl AS (SELECT page_id, ws, regexp_extract_all(content, '\\s*\\S+') AS gs FROM tk WHERE len(ws) > 0),
    pl AS (SELECT page_id, ws, list_transform(gs, lambda g: length(g)) AS gl FROM tl),
    sp AS (SELECT page_id, ws, gl, i FROM pl JOIN (SELECT page_id, unnest(range(0, n)) AS i FROM cn) USING (page_id))
    SELECT page_id, i::INTEGER AS chunk_no, (list_sum(gl[1:i * 56 + 1]) - length(ws[i * 56 + 1]))::INTEGER AS start_offset,
    (list_sum(gl[1:least(i * 56 + 64, len(ws))]) - list_sum(gl[1:i * 56 + 1]) + length(ws[i * 56 + 1]))::INTEGER AS content_length FROM sp""")
def _(spark, sf):
    return chunk.word_windows(pages(spark, sf), 64, 8).select("page_id", "chunk_no", F.col("start_offset").cast("int").alias("start_offset"), F.col("content_length").cast("int").alias("content_length"))


@query("u11_embedding_text", f"WITH {PAGES} SELECT page_id, md5(CASE WHEN title IS NOT NULL AND title <> '' THEN title || chr(10) || chr(10) || content ELSE content END) AS digest FROM pg")
def _(spark, sf):
    return pages(spark, sf).select("page_id", F.md5(T.embedding_text(F.col("title"), F.col("content")).cast("binary")).alias("digest"))


@query("u13_fingerprint", "SELECT page_id, sha256(html) AS print FROM pages")
def _(spark, sf):
    return _table(spark, sf, "pages").select("page_id", T.fingerprint(F.col("html").cast("binary")).alias("print"))


@query("u16_budgets", "SELECT event_id, CASE WHEN event_id % 12 + 1 >= CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 10 END THEN 'failed' ELSE 'retrying' END AS state FROM events")
def _(spark, sf):
    kind = F.element_at(F.array(F.lit("content"), F.lit("permanent"), F.lit("transient")), (F.col("event_id") % 3 + 1).cast("int"))
    return _table(spark, sf, "events").select("event_id", T.next_state(F.col("event_id") % 12, kind).alias("state"))


@query("u18_payload", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '0.5 ' || event_id || ' 3.0 ' || user_id || '.25' END AS vectors FROM events")
def _(spark, sf):
    """Of four payloads only the first one is right: its indexes come out of order."""
    n, m = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    good = F.concat(F.lit('{"data":[{"index":1,"embedding":[3,'), m, F.lit('.25]},{"index":0,"embedding":[0.5,'), n, F.lit("]}]}"))
    bodies = (good, F.lit('{"data":[{"index":true,"embedding":[5,6]},{"index":1,"embedding":[7,8]}]}'), F.lit('{"data":[{"index":0,"embedding":[5,6]},{"index":2,"embedding":[7,8]}]}'), F.lit('{"error":"x"}'))
    vectors = T.embeddings_payload(F.element_at(F.array(*bodies), (F.col("event_id") % 4 + 1).cast("int")), F.lit(2), 2)
    told = F.concat_ws(" ", vectors[0][0].cast("string"), vectors[0][1].cast("long").cast("string"), vectors[1][0].cast("string"), vectors[1][1].cast("string"))
    return _table(spark, sf, "events").select("event_id", F.when(vectors.isNotNull(), told).alias("vectors"))


@query("u19_retryable", "SELECT event_id, (400 + event_id % 120) IN (429, 500, 502, 503, 504) AS retry, pow(2, event_id % 3)::BIGINT AS wait FROM events")
def _(spark, sf):
    return _table(spark, sf, "events").select("event_id", T.is_retryable(F.lit(400) + F.col("event_id") % 120).alias("retry"), T.retry_wait(F.col("event_id") % 3).alias("wait"))


@query("u23_language_codes", "SELECT event_type, regexp_full_match(substr(event_type, 1, 2), '[a-z]{2}') AS good FROM events GROUP BY ALL")
def _(spark, sf):
    return _table(spark, sf, "events").select("event_type", T.is_language_code(F.substring("event_type", 1, 2)).alias("good")).distinct()


@query("u21_redaction", """SELECT page_id, [split_part(url, '://', 1) || '://' || split_part(url, '://', 2), 'host=db password=*** user=u' || page_id, 'postgresql://db.example/p' || page_id || '?sslmode=on', 'no secret @ all'][page_id % 4 + 1] AS url FROM pages""")
def _(spark, sf):
    key = F.col("page_id").cast("string")
    given = F.array(
        F.regexp_replace("url", "://", "://user:secret@"), F.concat(F.lit("host=db password=p4ss"), key, F.lit(" user=u"), key),
        F.concat(F.lit("postgresql://me:"), key, F.lit("@db.example/p"), key, F.lit("?sslmode=on")), F.lit("no secret @ all"),
    )
    return _table(spark, sf, "pages").select("page_id", U.redacted(F.element_at(given, (F.col("page_id") % 4 + 1).cast("int"))).alias("url"))


@query("u8_language")
def _(spark, sf):
    """The language told of every page, null where no stop word occurs."""
    return pages(spark, sf).select("page_id", T.detect_language(F.col("content"), F.lit(None).cast("string")).alias("language"))


# --- sources --------------------------------------------------------------------------------------


@query("s1_fetch_rules", """SELECT event_id, CASE WHEN s <> 200 THEN CASE WHEN s >= 400 AND s < 500 AND s NOT IN (408, 425, 429) THEN 'permanent' ELSE 'transient' END WHEN event_id % 4 = 1 THEN 'permanent' END AS kind
    FROM (SELECT event_id, [200, 304, 404, 408, 429, 500][event_id % 6 + 1] AS s FROM events)""")
def _(spark, sf):
    n = F.col("event_id")
    code = F.element_at(F.array(*map(F.lit, (200, 304, 404, 408, 429, 500))), (n % 6 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("text/html", "image/png", "", "application/xml"))), (n % 4 + 1).cast("int"))
    return _table(spark, sf, "events").select("event_id", fetch.error_kind(code, kind).alias("kind"))


@query("s2_politeness", """WITH RECURSIVE e AS (SELECT user_id % 50 AS origin, epoch(ts) AS t0, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS n FROM events),
    w AS (SELECT origin, n, t0 AS go FROM e WHERE n = 1 UNION ALL SELECT e.origin, e.n, greatest(e.t0, w.go + 2) FROM w JOIN e ON e.origin = w.origin AND e.n = w.n + 1)
    SELECT origin, count(*) AS n, round(sum(go - t0), 3) AS waited FROM w JOIN e USING (origin, n) GROUP BY origin""")
def _(spark, sf):
    rows = _table(spark, sf, "events").select((F.col("user_id") % 50).alias("origin"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"))
    placed = fetch.start_times(rows.select("origin", (F.col("us") / 1e6).alias("at")), 2.0)
    return placed.groupBy("origin").agg(F.count("*").alias("n"), F.round(F.sum(F.col("start") - F.col("at")), 3).alias("waited"))


@query("s9_titles", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def _(spark, sf):
    return _table(spark, sf, "pages").select("page_id", html.plain_title(F.col("html")).alias("title"))


@query("s9_articles")
def _(spark, sf):
    return html.article_pages(_table(spark, sf, "pages"))


@query("s6_robots", "SELECT 'https://c' || c_custkey || '.example/' || unnest(CASE WHEN c_custkey % 3 = 0 THEN ['map.xml#' || c_custkey] WHEN c_custkey % 3 = 1 THEN ['a.xml', 'b' || c_custkey || '.xml'] ELSE [] END) AS sitemap_url FROM customer")
def _(spark, sf):
    key = F.col("c_custkey").cast("string")
    base = F.concat(F.lit("https://c"), key, F.lit(".example"))
    told = F.element_at(
        F.array(
            F.concat(F.lit("User-agent: *\nSITEMAP:  /map.xml#"), key, F.lit("\nDisallow: /x")), F.concat(F.lit("sitemap: a.xml\r\n Sitemap :"), base, F.lit("/b"), key, F.lit(".xml")),
            F.lit("# Sitemap: /no.xml\nSitemap:\nsitemaps: /no.xml"),
        ),
        (F.col("c_custkey") % 3 + 1).cast("int"),
    )
    fetched = _table(spark, sf, "customer").select(F.concat(base, F.lit("/robots.txt")).alias("url"), told.alias("text"))
    return feeds.robots_sitemaps(fetched).select("sitemap_url")


@query("s7_sitemap_candidates", """SELECT id, CASE id % 3 WHEN 0 THEN base_url || '/told.xml' WHEN 1 THEN base_url || '/blog/sitemap.xml,' || base_url || '/blog/wp-sitemap.xml,' || base_url || '/sitemap.xml' ELSE base_url || '/sitemap.xml' END AS candidates
    FROM (SELECT c_custkey AS id, 'https://c' || c_custkey || '.example' AS base_url FROM customer)""")
def _(spark, sf):
    told = F.when(F.col("id") % 3 == 0, F.array(F.concat("base_url", F.lit("/told.xml")))).otherwise(F.array().cast("array<string>"))
    site = F.concat("base_url", F.when(F.col("id") % 3 == 2, "/").otherwise("/blog/"))
    return sites(spark, sf).select("id", F.array_join(feeds.sitemap_candidates(told, site), ",").alias("candidates"))


@query("s5_s8_sitemap_walk", """SELECT site, 1 + p AS pos, 'https://x.example/' || site || '/' || p AS url
    FROM (SELECT 's' || c_custkey AS site, unnest(CASE c_custkey % 3 WHEN 0 THEN [0, 1, 2] WHEN 1 THEN [0, 1] ELSE [] END) AS p FROM customer)""")
def _(spark, sf):
    """An index with a cycle and a sitemap that repeats a page; an index of which one sitemap is of posts; documents of a namespace that is not theirs."""
    site = F.concat(F.lit("s"), F.col("c_custkey").cast("string"))

    def doc(space: str, root: str, item: str, *locs):
        inner = F.concat(*[F.concat(F.lit(f"<{item}><loc>"), loc, F.lit(f"</loc></{item}>")) for loc in locs])
        return F.concat(F.lit(f'<{root} xmlns="{space}">'), inner, F.lit(f"</{root}>"))

    def page(n: int):
        return F.concat(F.lit("https://x.example/"), site, F.lit(f"/{n}"))

    def name(n: str):
        return F.concat(F.lit(f"https://myblogger.example/{n}-"), site)

    plain, safe, other = "http://www.sitemaps.org/schemas/sitemap/0.9", "https://www.sitemaps.org/schemas/sitemap/0.9", "https://example.org/schema"
    base = _table(spark, sf, "customer")
    cycle, posts, strange = ("c_custkey % 3 = 0", "c_custkey % 3 = 1", "c_custkey % 3 = 2")
    docs = [
        (cycle, name("index"), doc(plain, "sitemapindex", "sitemap", name("a"), name("index"), name("b"))), (cycle, name("a"), doc(safe, "urlset", "url", page(0), page(1))), (cycle, name("b"), doc(plain, "urlset", "url", page(1), page(2))),
        (posts, name("index"), doc(safe, "sitemapindex", "sitemap", name("pages"), name("post"))), (posts, name("pages"), doc(plain, "urlset", "url", page(7))), (posts, name("post"), doc(safe, "urlset", "url", page(0), page(1), page(0))),
        (strange, name("index"), doc(other, "urlset", "url", page(8))),
    ]
    parts = [base.filter(where).select(url.alias("url"), body.cast("binary").alias("body")) for where, url, body in docs]
    starts = base.select(site.alias("site"), name("index").alias("sitemap_url"))
    return feeds.walk(feeds.sitemap_edges(reduce(DataFrame.unionByName, parts)), starts, U.POST_MAP, 100)


# --- extensions: not operators of the reference --------------------------------------------------


@query("x_activity_windows", "SELECT epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def _(spark, sf):
    from fernweave.streaming.loops import activity_windows

    return activity_windows(_table(spark, sf, "events")).select(*_seconds("start"), "event_type", "n", F.round("total", 2).alias("total"))


# --- imports and clean-up -------------------------------------------------------------------------


@query("p14_c8_robots_cleanup", "SELECT count(*) AS checked, count(*) FILTER (c_custkey % 7 <> 0 AND c_custkey % 3 <> 0) AS kept, count(*) FILTER (c_custkey % 7 <> 0 AND c_custkey % 3 = 0) AS blocked, 0::BIGINT AS removed, count(*) FILTER (c_custkey % 7 = 0) AS failures FROM customer")
def _(spark, sf):
    from fernweave.plans.imports import robots_cleanup

    every = sites(spark, sf).select("id", "base_url")
    text = F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 3 == 0, "User-agent: *\nDisallow: /\nAllow: /robots.txt").otherwise("User-agent: *\nDisallow: /x")
    robots = every.select("base_url", text.alias("text"), F.lit(None).cast("string").alias("error"))
    return robots_cleanup(every, robots, "reader")[1]


@query("c7_j11_import", "SELECT count(*) AS valid, count(*) - count(DISTINCT event_id % 400) AS duplicates, count(DISTINCT event_id % 400) FILTER (event_id % 400 IN (SELECT c_custkey FROM customer)) AS configured, count(DISTINCT event_id % 400) FILTER (event_id % 400 NOT IN (SELECT c_custkey FROM customer)) AS wanted FROM events")
def _(spark, sf):
    from fernweave.plans.imports import import_requests

    origin = F.concat(F.lit("https://c"), (F.col("event_id") % 400).cast("string"), F.lit(".example"))
    rows = _table(spark, sf, "events").select(origin.alias("origin"), F.concat(origin, F.lit("/feed")).alias("feed_url"), F.col("event_id").alias("line_no"))
    return import_requests(rows, sites(spark, sf), "csv")[1]


from fernweave import site_queries  # noqa: E402, F401
