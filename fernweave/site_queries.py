"""Queries of feeds, sitemaps, site set-up, polls, history and crawl attempts, over documents made from the test tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.config import shared_folder
from fernweave.functions import text as T
from fernweave.functions import url as U
from fernweave.operators import queue, schedule
from fernweave.plans import imports, ingest
from fernweave.plans import sites as plans
from fernweave.queries import JOBS, SITES, _now, _seconds, _table, jobs, pages, query, sites
from fernweave.sources import feeds, html, tables
from fernweave.sources.fetch import RESPONSES


def _key() -> Column:
    return F.col("c_custkey")


def _base() -> Column:
    return F.concat(F.lit("https://c"), _key().cast("string"), F.lit(".example"))


def _item(path: Column) -> Column:
    return F.concat(F.lit("<item><link>"), path, F.lit("</link></item>"))


def _rss(*items: Column, link: Column | None = None, generator: str = "", complete: bool = False) -> Column:
    head = F.lit(f'<rss xmlns:a="http://www.w3.org/2005/Atom" xmlns:h="http://purl.org/syndication/history/1.0"><channel><generator>{generator}</generator>' + "<h:complete/>" * complete)
    more = [F.lit('<a:link rel="prev-archive" href="'), link, F.lit('"/>')] if link is not None else []
    return F.concat(head, *more, *items, F.lit("</channel></rss>"))


def _document(df: DataFrame, url: Column, body: Column, status: Column | int = 200, kind: str = "application/xml") -> DataFrame:
    """Rows of df as responses."""
    status = F.lit(status) if isinstance(status, int) else status
    return df.select(
        url.alias("url"), url.alias("final_url"), status.cast("int").alias("status"), F.lit(kind).alias("content_type"), F.when(status == 200, body.cast("binary")).alias("body"),
        F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"),
    )


def _together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _kept(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- feeds, pages and lists ---------------------------------------------------------------------


@query("s4_feeds", """SELECT 'https://c' || c_custkey || '.example/feed' AS feed_url, p AS pos, 'https://c' || c_custkey || '.example' || CASE p WHEN 0 THEN '/a?n=' || c_custkey ELSE '/b' END AS url,
    c_custkey % 3 = 1 AS wordpress, c_custkey % 3 = 2 AS complete, CASE WHEN c_custkey % 3 = 0 THEN 'https://c' || c_custkey || '.example/old' END AS history, NULL AS error
    FROM (SELECT c_custkey, unnest([0, 1]) AS p FROM customer WHERE c_custkey % 7 <> 0)
    UNION ALL SELECT 'https://c' || c_custkey || '.example/feed', NULL, NULL, NULL, NULL, NULL, 'bad' FROM customer WHERE c_custkey % 7 = 0""")
def _(spark, sf):
    """RSS with relative links, a repeat, a link that is no web page and a guid; Atom where the number divides by 2; no XML at all."""
    rows = _table(spark, sf, "customer")
    items = [_item(F.concat(F.lit("/a?n="), _key().cast("string"), F.lit("#top"))), _item(F.lit("mailto:me@c.example")), F.concat(F.lit("<item><guid>"), _base(), F.lit("/b</guid></item>")), _item(F.lit("/b"))]
    entries = F.concat(F.lit('<entry><link rel="edit" href="/no"/><link href="/a?n='), _key().cast("string"), F.lit('"/></entry><entry><id>'), _base(), F.lit("/b</id></entry>"))
    atom = {
        0: F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><link rel="prev-archive" href="/old"/>'), entries, F.lit("</feed>")),
        1: F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><generator uri="https://wordpress.org"/>'), entries, F.lit("</feed>")),
        2: F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:h="http://purl.org/syndication/history/1.0"><h:complete/>'), entries, F.lit("</feed>")),
    }
    plain = {0: _rss(*items, link=F.lit("/old")), 1: _rss(*items, generator="https://wordpress.org/?v=6"), 2: _rss(*items, complete=True)}
    body = F.when(_key() % 7 == 0, "no feed")
    for k in range(3):
        body = body.when((_key() % 3 == k) & (_key() % 2 == 0), atom[k]).when(_key() % 3 == k, plain[k])
    found = feeds.feed_entries(_document(rows, F.concat(_base(), F.lit("/feed")), body))
    return found.select("feed_url", "pos", "url", "wordpress", "complete", "history", F.when(F.col("error").isNotNull(), "bad").alias("error"))


@query("s10_feed_links", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'https://c' || c_custkey || '.example/rss' WHEN 1 THEN 'https://feeds.example/' || c_custkey WHEN 2 THEN 'https://c' || c_custkey || '.example/blog/atom.xml' END AS feed FROM customer")
def _(spark, sf):
    n = _key().cast("string")
    page = (
        F.when(_key() % 4 == 0, F.lit('<head><link rel="alternate" type="text/html" href="/no"><LINK rel="alternate" type="application/rss+xml" href="/rss"></head>'))
        .when(_key() % 4 == 1, F.concat(F.lit("<link type='application/atom+xml' rel='alternate' href='https://feeds.example/"), n, F.lit("'/>")))
        .when(_key() % 4 == 2, F.lit('<body><link rel="alternate" type="application/atom+xml" href="atom.xml"><link rel="alternate" type="application/rss+xml" href="/second"></body>'))
        .otherwise(F.lit('<link rel="stylesheet" href="/x.css">'))
    )
    return _table(spark, sf, "customer").select(_key().alias("id"), html.feed_link(page, F.concat(_base(), F.lit("/blog/"))).alias("feed"))


@query("s11_csv_list", "SELECT 'https://c' || c_custkey || '.example' AS origin, 'https://c' || c_custkey || '.example/feed' AS feed_url FROM customer WHERE c_custkey % 5 <> 0")
def _(spark, sf):
    path = f"{shared_folder(spark)}/list-{uuid.uuid4().hex}"
    rows = _table(spark, sf, "customer").select(
        F.concat(F.lit(" "), F.upper(F.substring(_base(), 1, 5)), F.substring(_base(), 6, 100), F.lit("/about")).alias("Address"), F.col("c_name").alias("Owner"), F.when(_key() % 5 != 0, F.concat(_base(), F.lit("/feed#x"))).alias("RSS feed"),
    )
    rows.write.csv(path, header=True)
    return tables.csv_feed_list(spark, path).select("origin", "feed_url")


@query("s12_json_list", "SELECT 'https://c' || c_custkey || '.example' AS origin, 'https://c' || c_custkey || '.example/feed' AS feed_url, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 4 END AS errors, c_custkey AS fetched FROM customer")
def _(spark, sf):
    path = f"{shared_folder(spark)}/list-{uuid.uuid4().hex}"
    errors = F.when(_key() % 3 == 0, F.lit("-1")).otherwise((_key() % 4).cast("string"))
    one = F.concat(F.lit('{"url": "'), _base(), F.lit('/feed", "home": '), F.when(_key() % 2 == 0, F.concat(F.lit('"'), _base(), F.lit('/"'))).otherwise(F.lit("null")), F.lit(', "errors": '), errors, F.lit(', "fetched": '), _key().cast("string"), F.lit("}"))
    lists = _table(spark, sf, "customer").groupBy((_key() % 16).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("value"))
    lists.write.partitionBy("part").text(path)
    return tables.json_feed_list(spark, path).select("origin", "feed_url", "errors", "fetched")


@query("s18_append_chunks", "SELECT count(*) AS n, sum(vec_id)::BIGINT AS total FROM embeddings")
def _(spark, sf):
    """A second write of what is there, and of repeated rows, adds nothing."""
    every = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label"))
    old = every.filter("id % 3 = 0")
    return tables.append_new(every.unionByName(every.filter("id % 5 = 0")), old, "id").unionByName(old).agg(F.count("*").alias("n"), F.sum("id").cast("long").alias("total"))


# --- URLs and errors ----------------------------------------------------------------------------

#: given and normalized
_URLS = (
    ("HTTP://Rosen.Example:80/Mai?x=1#a", "http://rosen.example/Mai?x=1"), ("rosen.example:8080", "https://rosen.example:8080/"), ("https://wir:geheim@rosen.example?q", "https://rosen.example/?q"), ("http://169.254.1.1/", None),
    ("http://[::ffff:7f00:1]/", None), ("https://8.8.8.8/x", "https://8.8.8.8/x"), ("ftp://rosen.example/", None), ("mailto:wir@rosen.example", None), ("http://localhost:80/", None), ("https://", None), ("http://rosen.example:99999/", None),
    ("  rosen.example/a/../b  ", "https://rosen.example/a/../b"),
)


@query("u1_u4_normalize", f"SELECT event_id, {[b for _, b in _URLS]}[event_id % {len(_URLS)} + 1] AS url FROM events".replace("None", "NULL"))
def _(spark, sf):
    given = F.element_at(F.array(*[F.lit(a) for a, _ in _URLS]), (F.col("event_id") % len(_URLS) + 1).cast("int"))
    return _table(spark, sf, "events").select("event_id", U.normalized(given).alias("url"))


@query("u7_query_values", """SELECT event_id, 'https://a.example/p' || CASE event_id % 4 WHEN 0 THEN '?paged=2' WHEN 1 THEN '?n=' || event_id || '&paged=2' WHEN 2 THEN '?paged=2&n=' || event_id ELSE '?leer=&a=1&paged=2' END AS url FROM events""")
def _(spark, sf):
    n = F.col("event_id").cast("string")
    tails = F.array(F.lit("#top"), F.concat(F.lit("?n="), n), F.concat(F.lit("?paged=7&n="), n, F.lit("&paged=9#x")), F.lit("?leer=&a=0&a=1"))
    url = F.concat(F.lit("https://a.example/p"), F.element_at(tails, (F.col("event_id") % 4 + 1).cast("int")))
    return _table(spark, sf, "events").select("event_id", U.query_set(url, F.lit("paged"), F.lit("2")).alias("url"))


@query("u20_error_summary", "SELECT event_id, substr('model=m' || user_id || '; inputs=' || event_id % 32 || CASE WHEN event_id % 2 = 0 THEN '; request=r' || event_id ELSE '' END || '; keys=data,error,zz' || repeat('z', event_id % 600), 1, 500) AS told FROM events")
def _(spark, sf):
    n = F.col("event_id")
    body = F.concat(F.lit('{"zz'), F.repeat(F.lit("z"), (n % 600).cast("int")), F.lit('": 1, "error": "x", "data": []}'))
    request = F.when(n % 2 == 0, F.concat(F.lit("r"), n.cast("string")))
    return _table(spark, sf, "events").select("event_id", T.error_summary(F.concat(F.lit("m"), F.col("user_id").cast("string")), n % 32, request, body).alias("told"))


# --- adding sites -------------------------------------------------------------------------------


@query("c3_sitemaps", """SELECT 'https://c' || c_custkey || '.example' AS base_url, 'https://c' || c_custkey || '.example' || CASE c_custkey % 6 WHEN 0 THEN '/second.xml' WHEN 1 THEN '/blog/sitemap.xml' WHEN 2 THEN '/sitemap.xml' ELSE '/own.xml' END AS sitemap_url
    FROM customer WHERE c_custkey % 6 < 4""")
def _(spark, sf):
    """Robots with one of another site, one that is empty and a good one; usual places; one that is typed; none; and nothing that can be read."""
    rows = _table(spark, sf, "customer")
    good, empty = F.lit("<urlset><url><loc>https://a.example/1</loc></url></urlset>"), F.lit("<urlset></urlset>")

    def at(path: str) -> Column:
        return F.concat(_base(), F.lit(path))

    told = F.concat(F.lit("Sitemap: https://other.example/map.xml\nSitemap: /empty.xml\nSitemap: "), at("/second.xml"))
    got = _together(
        _document(rows.filter("c_custkey % 6 = 0"), at("/robots.txt"), told, kind="text/plain"), _document(rows.filter("c_custkey % 6 = 0"), at("/second.xml"), good), _document(rows.filter("c_custkey % 6 = 0"), at("/empty.xml"), empty),
        _document(rows.filter("c_custkey % 6 = 0"), at("/sitemap.xml"), good), _document(rows.filter("c_custkey % 6 = 1"), at("/sitemap.xml"), good), _document(rows.filter("c_custkey % 6 = 1"), at("/blog/sitemap.xml"), good),
        _document(rows.filter("c_custkey % 6 = 2"), at("/sitemap.xml"), good), _document(rows.filter("c_custkey % 6 = 2"), at("/blog/sitemap.xml"), good, 404), _document(rows.filter("c_custkey % 6 = 5"), at("/sitemap.xml"), F.lit("<urlset>")),
    )
    mode = F.when(_key() % 6 == 3, "/own.xml").when(_key() % 6 == 4, "none").otherwise("auto")
    return plans.resolve_sitemaps(rows.select(_base().alias("base_url"), at("/blog/").alias("url"), mode.alias("sitemap")), got)


@query("c1_c2_add_sites", f"""WITH {SITES} SELECT coalesce(st.base_url, n.base_url) AS base_url, coalesce(n.feed_url, st.feed_url) AS feed_url, n.base_url IS NOT NULL AND (st.id IS NULL OR st.feed_url <> n.feed_url) AS moved
    FROM (SELECT * FROM st WHERE id % 2 = 0) st FULL JOIN (SELECT 'https://c' || c_custkey || '.example' AS base_url, 'https://c' || c_custkey || '.example' || CASE c_custkey % 3 WHEN 0 THEN '/feed' ELSE '/found' END AS feed_url FROM customer WHERE c_custkey % 3 < 2) n USING (base_url)""")
def _(spark, sf):
    """A typed feed, one that the page links to, and pages without; half of the sites are there."""
    rows = _table(spark, sf, "customer")

    def at(path: str) -> Column:
        return F.concat(_base(), F.lit(path))

    got = _together(
        _document(rows.filter("c_custkey % 3 = 0"), at("/feed"), _rss(_item(F.lit("/1")))), _document(rows.filter("c_custkey % 3 = 1"), at("/"), F.lit('<link rel="alternate" type="application/rss+xml" href="/found">'), kind="text/html"),
        _document(rows.filter("c_custkey % 3 = 1"), at("/found"), _rss(_item(F.lit("/1")))), _document(rows.filter("c_custkey % 3 = 2"), at("/"), F.lit("<p>nothing"), kind="text/html"),
    )
    asked = rows.select(at("/").alias("url"), F.when(_key() % 3 == 0, at("/feed")).otherwise("auto").alias("feed"), F.lit("none").alias("sitemap"))
    before = sites(spark, sf).filter("id % 2 = 0")
    after, _ = plans.add_sites(before, asked, got, _now(), 43_200)
    return after.join(before.select("base_url", F.col("feed_url").alias("old")), "base_url", "left").select("base_url", "feed_url", (F.col("next_poll_at") >= _now()).alias("again"), F.coalesce("old", F.lit("")).alias("old")).select(
        "base_url", "feed_url", (F.col("old") != F.col("feed_url")).alias("moved")
    )


@query("c8_clean_up", f"""WITH {SITES}, {JOBS}, gone AS (SELECT id FROM st WHERE id % 3 = 0 AND id % 7 <> 0) SELECT (SELECT count(*) FROM st WHERE id NOT IN (FROM gone)) AS sites, (SELECT count(*) FROM jb WHERE site_id NOT IN (FROM gone)) AS jobs,
    (SELECT count(*) FROM gone) AS removed, (SELECT count(*) FROM st WHERE id % 7 = 0) AS failures""")
def _(spark, sf):
    """What a clean-up that is no dry run leaves."""
    every = sites(spark, sf)
    text = F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 3 == 0, "User-agent: *\nDisallow: /").otherwise("User-agent: *\nDisallow: /x")
    robots = every.select("base_url", text.alias("text"), F.lit(None).cast("string").alias("error"))
    gone, tally = imports.robots_cleanup(every, robots, "reader", dry_run=False)
    chunks = spark.createDataFrame([], "page_id long")
    left = schedule.delete_sites(gone, every, jobs(spark, sf), pages(spark, sf).select(F.col("page_id").alias("id"), F.lit(0).cast("long").alias("site_id")), chunks)
    counts = left["sites"].agg(F.count("*").alias("sites")).crossJoin(left["crawl_jobs"].agg(F.count("*").alias("jobs")))
    return counts.crossJoin(tally.select("removed", "failures"))


# --- polls --------------------------------------------------------------------------------------


def _polled(spark, sf):
    """Claimed sites, and feeds: unchanged, broken, gone, of another site, or two posts of which one may be known."""
    claimed = sites(spark, sf).withColumn("token", F.col("poll_lease_token"))
    feed, n = F.col("feed_url"), F.col("id").cast("string")
    status = F.when(F.col("id") % 7 == 0, 304).when(F.col("id") % 7 == 1, 410).when(F.col("id") % 7 == 2, 503).otherwise(200)
    body = F.when(F.col("id") % 7 == 3, "<nothing").when(F.col("id") % 7 == 4, _rss(_item(F.lit("https://other.example/1")))).otherwise(_rss(_item(F.lit("/p?v=1")), _item(F.concat(F.lit("http://www.c"), n, F.lit(".example/q")))))
    got = _document(claimed, feed, body, status).withColumn("etag", F.concat(F.lit("n"), F.regexp_extract("url", r"c(\\d+)\\.", 1)))
    known = claimed.filter("id % 2 = 0").select(F.concat("base_url", F.lit("/q")).alias("url"))
    return claimed, got, known


@query("p16_poll_headers", f"WITH {SITES} SELECT feed_url AS url, CASE WHEN NOT history_pending THEN feed_etag END AS none_match FROM st")
def _(spark, sf):
    return plans.poll_requests(sites(spark, sf)).select("url", F.col("headers")["If-None-Match"].alias("none_match"))


@query("x8_poll_posts", """SELECT c_custkey AS site_id, 'https://c' || c_custkey || '.example' || p AS url, 'feed' AS source FROM (SELECT c_custkey, unnest(['/p?v=1', '/q']) AS p FROM customer WHERE c_custkey % 7 > 4) WHERE NOT (c_custkey % 2 = 0 AND p = '/q')""")
def _(spark, sf):
    claimed, got, known = _polled(spark, sf)
    return plans.poll(claimed, got, known, jobs(spark, sf))[0].select("site_id", "url", "source")


@query("x8_poll_reports", """SELECT c_custkey AS id, 't' || c_custkey AS token, CASE WHEN c_custkey % 7 IN (0, 5, 6) THEN 'good' WHEN c_custkey % 7 < 3 THEN 'fetch' WHEN c_custkey % 7 = 4 THEN 'elsewhere' ELSE 'feed' END AS outcome,
    c_custkey % 7 > 4 AND c_custkey % 2 = 1 AS all_new FROM customer""")
def _(spark, sf):
    claimed, got, known = _polled(spark, sf)
    reports = plans.poll(claimed, got, known, jobs(spark, sf))[1]
    error = F.col("error")
    outcome = F.when(error.isNull(), "good").when(error.startswith("the feed can't be fetched"), "fetch").when(error.contains("another site"), "elsewhere").otherwise("feed")
    return reports.select("id", "token", outcome.alias("outcome"), F.coalesce("all_new", F.lit(False)).alias("all_new"))


@query("x1_poll_claims", f"""WITH {SITES} SELECT id, CASE WHEN c THEN NULL ELSE epoch(poll_lease_until)::BIGINT END AS poll_lease_until, c AS claimed FROM (SELECT *, id IN (SELECT id FROM st WHERE next_poll_at <= TIMESTAMP '2024-01-15'
    AND (poll_lease_until IS NULL OR poll_lease_until <= TIMESTAMP '2024-01-15') ORDER BY next_poll_at, id LIMIT 16) AS c FROM st)""")
def _(spark, sf):
    """The first step of a poll: the snapshot with the leases that 16 workers take."""
    before = sites(spark, sf)
    after = schedule.apply_poll_claims(before, schedule.claim_due(before, _now(), 16))
    joined = after.join(before.select("id", F.col("poll_lease_token").alias("old")), "id").withColumn("claimed", ~F.col("poll_lease_token").eqNullSafe(F.col("old")))
    return joined.select("id", F.when(~F.col("claimed"), F.unix_timestamp("poll_lease_until")).alias("poll_lease_until"), "claimed")


@query("x5_scattered", f"""WITH {SITES}, d AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n, count(*) OVER () AS total FROM st WHERE next_poll_at IS NULL OR next_poll_at <= TIMESTAMP '2024-01-15')
    SELECT st.id, coalesce(epoch(TIMESTAMP '2024-01-15')::BIGINT + 3600 * n // total, epoch(next_poll_at)::BIGINT) AS next_poll_at FROM st LEFT JOIN d USING (id)""")
def _(spark, sf):
    """The snapshot with which a daemon begins."""
    before = sites(spark, sf)
    return schedule.apply_scatter(before, schedule.scatter(before, _now(), 3600)).select("id", *_seconds("next_poll_at"))


def _network(*parts: DataFrame):
    """A fetch over a table of documents; what is not in it is gone."""
    documents = _kept(_together(*parts))

    def fetch(urls: DataFrame) -> DataFrame:
        found = urls.select("url").join(documents, "url", "left")
        return found.withColumn("status", F.coalesce("status", F.lit(404))).select(*[f.split(" ")[0] for f in RESPONSES.split(", ")])

    return fetch


@query("x7_history", """SELECT c_custkey AS site_id, 'https://c' || c_custkey || '.example/' || p AS url, s AS source FROM (SELECT c_custkey,
    unnest(CASE c_custkey % 6 WHEN 0 THEN ['a1', 'a2', 'b1'] WHEN 1 THEN ['w1', 'w2'] WHEN 2 THEN ['m1', 'm2'] WHEN 3 THEN ['m1', 'm2'] ELSE [] END) AS p, CASE WHEN c_custkey % 6 IN (2, 3) THEN 'sitemap' ELSE 'history' END AS s FROM customer WHERE c_custkey < 200)""")
def _(spark, sf):
    """Archives of two documents that end in a cycle, WordPress pages, a sitemap, one after an archive that is gone, a feed that is complete, and none at all."""
    rows = _table(spark, sf, "customer").filter("c_custkey < 200")

    def at(path: str) -> Column:
        return F.concat(_base(), F.lit(path))

    def of(k: int) -> DataFrame:
        return rows.filter(f"c_custkey % 6 = {k}")

    first, smap = _item(F.lit("/p")), F.concat(F.lit("<urlset><url><loc>"), at("/m1"), F.lit("</loc></url><url><loc>"), at("/tags/x"), F.lit("</loc></url><url><loc>"), at("/m2"), F.lit("</loc></url></urlset>"))
    now = _together(
        _document(of(0), at("/feed"), _rss(first, link=F.lit("/old1"))), _document(of(1), at("/feed"), _rss(first, generator="wordpress")), _document(of(2), at("/feed"), _rss(first)),
        _document(of(3), at("/feed"), _rss(first, link=F.lit("/gone"))), _document(of(4), at("/feed"), _rss(first, complete=True)), _document(of(5), at("/feed"), _rss(first)),
    )
    fetch = _network(
        _document(of(0), at("/old1"), _rss(_item(F.lit("/a1")), first, _item(F.lit("/a2")), link=F.lit("/old2"))), _document(of(0), at("/old2"), _rss(_item(F.lit("/b1")), link=F.lit("/old1"))),
        _document(of(1), at("/feed?paged=2"), _rss(_item(F.lit("/w1")), first)), _document(of(1), at("/feed?paged=3"), _rss(_item(F.lit("/w2")))), _document(of(1), at("/feed?paged=4"), _rss(_item(F.lit("/w1")))),
        _document(of(2), at("/map.xml"), smap), _document(of(3), at("/map.xml"), smap),
    )
    asked = rows.select(_key().alias("id"), _base().alias("base_url"), at("/feed").alias("feed_url"), F.when((_key() % 6).isin(2, 3), at("/map.xml")).alias("sitemap_url"))
    return plans.history(asked, now, fetch, 2000, _kept)[0].select("site_id", "url", "source")


# --- crawling -----------------------------------------------------------------------------------


def _attempts(spark, sf):
    """Jobs that are pages already, have no answer, a bad status or type, come from another site, hold no article, or are good."""
    rows = _table(spark, sf, "customer")
    url = F.concat(_base(), F.lit("/post"))
    claims = rows.select(_key().alias("id"), _key().alias("site_id"), url.alias("url"), F.concat(F.lit("t"), _key().cast("string")).alias("lease_token"))
    words = F.concat(F.lit("<html><head><title>Post "), _key().cast("string"), F.lit("</title></head><body><article><p>"), F.repeat(F.lit("the rose and the garden "), 20), F.lit("</p></article></body></html>"))
    status = F.when(_key() % 8 == 2, 404).when(_key() % 8 == 3, 429).otherwise(200)
    got = _document(rows.filter("c_custkey % 8 <> 1"), url, F.when(_key() % 8 == 6, "<p>short</p>").otherwise(words), status, "text/html")
    got = got.withColumn("content_type", F.when(F.col("url").isin([]), "").otherwise(F.col("content_type"))).join(rows.select(url.alias("url"), _key().alias("k")), "url")
    got = got.withColumn("content_type", F.when(F.col("k") % 8 == 4, "image/png").otherwise(F.col("content_type"))).withColumn("final_url", F.when(F.col("k") % 8 == 5, "https://other.example/post").otherwise(F.col("final_url"))).drop("k")
    known = rows.filter("c_custkey % 8 = 0").select(url.alias("url"))
    return ingest.attempts(claims, got, known, _now(), 40, 8)


@query("c9_p11_p13_attempts", """SELECT c_custkey AS id, 't' || c_custkey AS token, CASE WHEN c_custkey % 8 IN (0, 7) THEN 'done' ELSE 'error' END AS outcome,
    [NULL, 'transient', 'permanent', 'transient', 'permanent', 'content', 'content', NULL][c_custkey % 8 + 1] AS error_kind FROM customer""")
def _(spark, sf):
    return _attempts(spark, sf).reports.select("id", "token", "outcome", "error_kind")


@query("x2_crawled_pages", "SELECT c_custkey AS site_id, 'https://c' || c_custkey || '.example/post' AS url, 'Post ' || c_custkey AS title, 'en' AS language, length(trim(repeat('the rose and the garden ', 20))) AS size, 3 AS chunks FROM customer WHERE c_custkey % 8 = 7")
def _(spark, sf):
    made = _attempts(spark, sf)
    cut = made.chunks.groupBy("page_id").agg(F.count("*").alias("chunks"))
    return made.pages.join(cut, made.pages["id"] == cut["page_id"]).select("site_id", "url", "title", "language", F.length("content").alias("size"), "chunks")


@query("x2_claims_applied", f"""WITH {JOBS} SELECT count(*) AS jobs, count(*) FILTER (lease_until > TIMESTAMP '2024-01-15') + 8 AS running FROM jb""")
def _(spark, sf):
    before = jobs(spark, sf)
    after = queue.apply_claims(before, queue.claim(before, _now(), 8))
    return after.agg(F.count("*").alias("jobs"), F.count_if(F.col("lease_until") > _now()).alias("running"))


@query("x6_job_states", """SELECT user_id, CASE WHEN max(event_id) % 3 = 0 THEN 'done' ELSE 'open' END AS state FROM events GROUP BY user_id""")
def _(spark, sf):
    """The last report of each user's job, applied under its token."""
    last = _table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("n"))
    until = queue.after(_now(), 60)
    held = last.select(
        F.col("user_id").alias("id"), F.lit(1).cast("long").alias("site_id"), F.col("n").cast("string").alias("url"), F.lit("feed").alias("source"), F.lit(1).alias("attempt_count"), _now().alias("next_attempt_at"), until.alias("lease_until"),
        F.lit("t").alias("lease_token"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("timestamp").alias("failed_at"), _now().alias("discovered_at"),
    )
    outcome = F.when(F.col("n") % 3 == 0, "done").when(F.col("n") % 3 == 1, "error").otherwise("renew")
    reports = last.select(F.col("user_id").alias("id"), F.lit("t").alias("token"), outcome.alias("outcome"), F.lit("transient").alias("error_kind"), F.lit("x").alias("error"))
    after = queue.transition(held, reports, _now()).select(F.col("id").alias("user_id"), F.lit("open").alias("state"))
    return last.select("user_id").join(after, "user_id", "left").select("user_id", F.coalesce("state", F.lit("done")).alias("state"))
