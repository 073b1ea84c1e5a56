import pytest
from pyspark.sql import functions as F

from fernweave.config import FeedError, Settings, SitemapError
from fernweave.functions.url import POST_MAP
from fernweave.sources import feeds, fetch, html, tables

RSS = b"""<?xml version="1.0"?><rss version="2.0" xmlns:a="http://www.w3.org/2005/Atom"><channel><title>Beete</title><link>https://garten.example</link><generator>https://wordpress.org/?v=5.9</generator>
<a:link rel="self" href="/neues.rss"/><a:link rel="next" href="/neues.rss?seite=2"/><a:link rel="prev-archive" href="/2019/neues.rss"/>
<item><title>Mai</title><link> /beete/mai#oben </link><guid>g1</guid></item><item><link>https://garten.example/beete/mai</link></item><item><guid>https://garten.example/beete/juni?bild=gross</guid></item>
<item><link>mailto:wir@garten.example</link></item><item><title>ohne</title></item></channel></rss>"""
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom" xmlns:h="http://purl.org/syndication/history/1.0"><h:complete/><link href="https://garten.example/start"/>
<entry><link rel="enclosure" href="/ton.mp3"/><link rel="alternate" href="beet/9"/><id>urn:9</id></entry></feed>"""


def test_rss():
    feed = feeds.parse_feed(RSS, "https://garten.example/neues.rss")
    assert feed.urls == ["https://garten.example/beete/mai", "https://garten.example/beete/juni?bild=gross"]
    assert (feed.home, feed.history, feed.wordpress, feed.complete) == ("https://garten.example/", "https://garten.example/2019/neues.rss", True, False)


def test_atom():
    feed = feeds.parse_feed(ATOM, "https://garten.example/blog/neues.atom")
    assert (feed.urls, feed.complete, feed.wordpress, feed.home) == (["https://garten.example/blog/beet/9"], True, False, "https://garten.example/start")


@pytest.mark.parametrize("body", [b'{"items": []}', b"\n[]", b"<urlset/>", b"<feed><entry>", b"", b'<!DOCTYPE feed [<!ENTITY rose "dorn">]><feed/>'])
def test_bad_feeds(body):
    with pytest.raises(FeedError):
        feeds.parse_feed(body, "https://garten.example/neues.rss")


def test_foreign_posts_are_dropped():
    feed = feeds.Feed(["https://wald.example/1", "http://www.garten.example/beet?n=3"], None, "https://wald.example/alt")
    own = feeds.site_feed(feed, "https://garten.example")
    assert (own.urls, own.history) == (["https://garten.example/beet?n=3"], None)
    assert feeds.site_feed(feeds.Feed([], None, "https://www.garten.example/alt"), "https://garten.example").history == "https://www.garten.example/alt"
    with pytest.raises(FeedError):
        feeds.site_feed(feeds.Feed(["https://wald.example/1"]), "https://garten.example")


def sitemap(root, item, *locs):
    return f'<{root} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://www.google.com/schemas/sitemap-image/1.1">{"".join(f"<{item}><loc> {x} </loc><image:loc>no</image:loc></{item}>" for x in locs)}</{root}>'.encode()


def test_sitemaps():
    assert feeds.parse_sitemap(sitemap("urlset", "url", "https://a.example/1")) == (False, ["https://a.example/1"])
    assert feeds.parse_sitemap(b"<sitemapindex><sitemap><loc>x</loc></sitemap></sitemapindex>") == (True, ["x"])
    assert feeds.parse_sitemap(b'<urlset xmlns="https://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a.example/2</loc></url></urlset>') == (False, ["https://a.example/2"])
    assert feeds.parse_sitemap(b'<urlset xmlns="http://www.google.com/schemas/sitemap/0.84"><url><loc>https://a.example/3</loc></url></urlset>') == (False, [])
    for bad in (b"nope", b'<!DOCTYPE x [<!ENTITY a "b">]><urlset/>'):
        with pytest.raises(SitemapError):
            feeds.parse_sitemap(bad)


def test_walk_prefers_posts_and_ends_in_cycles(spark):
    docs = [("i", sitemap("sitemapindex", "sitemap", "post-1", "i", "pages")), ("post-1", sitemap("urlset", "url", "u1", "u2", "u1")), ("pages", sitemap("urlset", "url", "u3")), ("bad", b"<")]
    edges = feeds.sitemap_edges(spark.createDataFrame(docs, "url string, body binary"))
    starts = spark.createDataFrame([("s", "i")], "site string, sitemap_url string")
    assert [r.url for r in feeds.walk(edges, starts, POST_MAP, 10).orderBy("pos").collect()] == ["u1", "u2"]
    assert [r.url for r in feeds.walk(edges, starts, POST_MAP, 1).collect()] == ["u1"]
    assert edges.filter("error IS NOT NULL").count() == 1


def test_robots(spark):
    text = "User-agent: *\r\nSITEMAP:karte.xml\n  sitemap : https://wald.example/k.xml#teil\n# Sitemap: nein\nSitemap:\n"
    expected = ["https://garten.example/karte.xml", "https://wald.example/k.xml#teil"]
    assert feeds.parse_robots_sitemaps(text, "https://garten.example/robots.txt") == expected
    df = spark.createDataFrame([("https://garten.example/robots.txt", text)], "url string, text string")
    assert [r.sitemap_url for r in feeds.robots_sitemaps(df).orderBy("pos").collect()] == expected


@pytest.mark.parametrize(
    ("text", "blocked"),
    [
        ("user-agent: gartenbot\ndisallow: /*", True),
        ("User-agent: *\nDisallow: /   # all\nAllow:", True),
        ("User-agent: *\nDisallow: /\nAllow: /beete/", False),
        ("User-agent: *\nDisallow: /beete/", False),
        ("User-agent: gartenbot\nAllow: /\n\nUser-agent: *\nDisallow: /", False),
        ("User-agent: waldbot\nUser-agent: gartenbot\nDisallow: /", True),
        ("User-agent: waldbot\nDisallow: /", False),
        ("Disallow: /", False),
    ],
)
def test_full_disallow(text, blocked):
    assert feeds.fully_disallows(text, "gartenbot/2.1") is blocked


def test_article_text():
    body = "word " * 60
    page = html.extract(f"<html><head><title>T &amp; U</title><meta property='article:published_time' content='2025-01-02T10:00'></head><body><nav>menu</nav><article><p>{body}</p><script>x()</script></article><footer>f</footer></body></html>")
    assert page == {"title": "T & U", "text": body.strip(), "date": "2025-01-02"}
    assert html.extract("<p>short</p>") is None


def test_feed_link():
    page = '<link rel="alternate" type="text/html" href="/no"><link rel="alternate" type="application/rss+xml" href="/feed">'
    assert html.discovered_feed(page, "https://a.example/x") == "https://a.example/feed"


def test_starts_are_spaced(spark):
    df = spark.createDataFrame([("a", 100.0), ("a", 100.0), ("b", 100.0), ("a", 105.0)], "origin string, at double")
    found = sorted((r.origin, r.start) for r in fetch.start_times(df, 1.0).collect())
    assert found == [("a", 100.0), ("a", 101.0), ("a", 105.0), ("b", 100.0)]


def test_feed_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Address, RSS feed\nhttps://A.example/x, https://a.example/feed\nhttps://b.example, \n", encoding="utf-8")
    assert [(r.origin, r.feed_url) for r in tables.csv_feed_list(spark, str(tmp_path / "a.csv")).collect()] == [("https://a.example", "https://a.example/feed")]
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        tables.csv_feed_list(spark, str(tmp_path / "b.csv"))
    (tmp_path / "a.json").write_text('[{"url": "https://a.example/f", "errors": -3, "fetched": 7}]')
    assert tables.json_feed_list(spark, str(tmp_path / "a.json")).select("errors", "fetched").first() == (0, 7)


def test_embedding_batches(spark):
    df = spark.createDataFrame([(n, "x" * n) for n in range(5)], "id long, text string").coalesce(1)
    rows = tables.embedded(df, lambda texts: [[float(len(t)), float(len(texts))] for t in texts], 2).orderBy("id").collect()
    assert [r.embedding for r in rows] == [[0.0, 2.0], [1.0, 2.0], [2.0, 2.0], [3.0, 2.0], [4.0, 1.0]]


def test_settings():
    assert Settings.from_env(env={"FERNWEAVE_CHUNK_TOKENS": "100"}).chunk_tokens == 100
    for bad in ({"chunk_tokens": 32, "chunk_token_overlap": 32}, {"embedding_dim": 0}, {"rrf_k": True}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_attempts(spark):
    from fernweave.plans.ingest import attempts

    claims = spark.createDataFrame([(1, 1, "https://a.example/1", "t1"), (2, 1, "https://a.example/2", "t2"), (3, 1, "https://a.example/3", "t3"), (4, 1, "https://a.example/4", "t4")], "id long, site_id long, url string, lease_token string")
    good = b"<article>" + b"word " * 60 + b"</article>"
    responses = spark.createDataFrame(
        [("https://a.example/1", "https://b.example/1", 200, "text/html", good), ("https://a.example/2", "https://a.example/2", 200, "text/html", good), ("https://a.example/3", None, 503, None, None)],
        "url string, final_url string, status int, content_type string, body binary",
    )
    pages = spark.createDataFrame([("https://a.example/4",)], "url string")
    made = attempts(claims, responses, pages, F.current_timestamp(), 40, 8)
    assert {(r.id, r.outcome, r.error_kind) for r in made.reports.collect()} == {(1, "error", "content"), (2, "done", None), (3, "error", "transient"), (4, "done", None)}
    assert [r.url for r in made.pages.collect()] == ["https://a.example/2"]
    assert made.chunks.count() == 2


def test_imports(spark):
    from fernweave.plans.imports import import_requests, resolves_public, robots_cleanup

    rows = spark.createDataFrame(
        [("https://b.example", "https://b.example/1", 1, 5), ("https://b.example", "https://b.example/2", 0, 1), ("https://a.example", "http://10.0.0.1/f", 0, 1), ("https://c.example", "https://c.example/f", 0, 0)],
        "origin string, feed_url string, errors long, fetched long",
    )
    sites = spark.createDataFrame([("https://c.example",)], "base_url string")
    requests, counts = import_requests(rows, sites, "json")
    assert [tuple(r) for r in requests.collect()] == [("https://b.example", "https://b.example/2", "auto")]
    assert tuple(counts.first()) == (4, 1, 1, 1)
    assert {r.url for r in import_requests(rows, sites, "json", refresh=True)[0].collect()} == {"https://b.example", "https://c.example"}
    robots = spark.createDataFrame([("https://c.example", "User-agent: *\nDisallow: /", None)], "base_url string, text string, error string")
    gone, tally = robots_cleanup(sites, robots, "reader", dry_run=False)
    assert [r.base_url for r in gone.collect()] == ["https://c.example"]
    assert tuple(tally.first()) == (1, 0, 1, 1, 0)
    assert resolves_public(["8.8.8.8"]) and not resolves_public([]) and not resolves_public(["8.8.8.8", "10.0.0.1"])
