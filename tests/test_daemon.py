"""The daemon's ticks over an engine with a table of documents for a network."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from fernweave.api import Engine
from fernweave.config import AlreadyRunningError, EmbeddingError, FetchError, LeaseLostError, Settings, SiteError
from fernweave.plans import sites
from fernweave.sources.embedding import EmbeddingClient
from fernweave.sources.fetch import RESPONSES, raise_for
from fernweave.streaming import daemon

SITE = "https://garten.example"


def rss(*posts, link="", generator="", complete=False):
    items = "".join(f"<item><link>{p}</link></item>" for p in posts)
    more = f'<a:link rel="prev-archive" href="{link}"/>' if link else ""
    whole = "<h:complete/>" if complete else ""
    head = f'<rss xmlns:a="http://www.w3.org/2005/Atom" xmlns:h="http://purl.org/syndication/history/1.0"><channel><link>{SITE}</link>'
    return f"{head}<generator>{generator}</generator>{more}{whole}{items}</channel></rss>".encode()


def article(word):
    return f"<html><head><title>{word}</title></head><body><article><p>{(word + ' ') * 80}</p></article></body></html>".encode()


def urlset(*urls, root="urlset"):
    return f"<{root}>{''.join(f'<url><loc>{u}</loc></url>' for u in urls)}</{root}>".encode()


class Web:
    """Answers of documents: url to body, status, or (status, body, etag). Keeps what was asked."""

    def __init__(self, spark, documents):
        self.spark, self.documents, self.asked = spark, documents, []

    def __call__(self, urls):
        rows = []
        for r in urls.collect():
            self.asked.append((r.url, dict(r.headers or {})))
            told = self.documents.get(r.url, 404)
            status, body, etag = (told, None, None) if isinstance(told, int) else told if isinstance(told, tuple) else (200, told, None)
            if etag and r.headers and r.headers.get("If-None-Match") == etag:
                status, body = 304, None
            if status:
                rows.append((r.url, r.url, status, "text/xml" if body and not body.startswith(b"<html") else "text/html", body, etag, None))
            else:
                rows.append((r.url, None, None, None, None, None, None))
        return self.spark.createDataFrame(rows, RESPONSES)


@pytest.fixture
def engine(spark, tmp_path):
    made = Engine(spark, str(tmp_path / "engine"), Settings(chunk_tokens=30, chunk_token_overlap=5, embedding_dim=2, history_post_limit=6))
    made.init()
    return made


def add(engine, web, feed=f"{SITE}/feed", sitemap="none"):
    asked = engine.spark.createDataFrame([(SITE, feed, sitemap)], "url string, feed string, sitemap string")
    assert engine.add_sites(asked, web(engine.spark.createDataFrame([(u, {}) for u in web.documents], "url string, headers map<string,string>"))).count() == 0
    engine.replace("sites", engine.table("sites").withColumn("next_poll_at", F.lit("2024-01-01").cast("timestamp")))


def vectors(texts):
    return [[1.0, float(len(t))] for t in texts]


def at(text):
    return F.lit(text).cast("timestamp")


def test_poll_and_crawl(engine, spark):
    web = Web(spark, {f"{SITE}/feed": (200, rss(f"{SITE}/p1", f"{SITE}/p2", "https://other.example/x"), '"v1"'), f"{SITE}/p1": article("rosen"), f"{SITE}/p2": 503})
    add(engine, web)
    first = daemon.poll_tick(engine, web, at("2024-02-01"))
    assert (first.claimed, first.outcomes) == (1, {"polled": 1, "found": 2})
    site = engine.table("sites").first()
    # neither archive nor sitemap: the history stays to be found
    assert (site.feed_etag, site.history_pending, site.poll_lease_token) == ('"v1"', True, None) and "neither" in site.sync_error
    assert daemon.poll_tick(engine, web, at("2024-02-01")).claimed == 0
    done = daemon.crawl_tick(engine, web, vectors, at("2024-02-02"))
    assert done.outcomes == {"done": 1, "error": 1}
    assert [(r.url, r.title) for r in engine.table("pages").collect()] == [(f"{SITE}/p1", "rosen")]
    assert engine.table("chunks").count() == 3
    left = engine.table("crawl_jobs").collect()
    assert [(r.url, r.attempt_count, r.lease_token) for r in left] == [(f"{SITE}/p2", 1, None)]
    assert [r.page_id for r in engine.search("rosen", None).collect()] == [engine.table("pages").first().id]
    # without pending history the validators are sent, and nothing has changed
    engine.replace("sites", engine.table("sites").withColumn("history_pending", F.lit(False)))
    web.asked.clear()
    again = daemon.poll_tick(engine, web, at("2024-03-01"))
    assert again.outcomes == {"polled": 1} and web.asked == [(f"{SITE}/feed", {"If-None-Match": '"v1"'})]


def test_a_poll_that_fails_is_put_off(engine, spark):
    web = Web(spark, {f"{SITE}/feed": rss(f"{SITE}/p1")})
    add(engine, web)
    web.documents[f"{SITE}/feed"] = 500
    assert daemon.poll_tick(engine, web, at("2024-02-01")).outcomes == {"failed": 1}
    site = engine.table("sites").first()
    assert site.poll_failures == 1 and "500" in site.sync_error and site.poll_lease_token is None


@pytest.mark.parametrize(
    ("feed", "others", "found", "pending", "trouble"),
    [
        (rss(f"{SITE}/p1", complete=True), {}, [], False, None),
        (rss(f"{SITE}/p1", link="/old1"), {"/old1": rss(f"{SITE}/p2", f"{SITE}/p1", link="/old2"), "/old2": rss(f"{SITE}/p3", link="/old1")}, ["p2", "p3"], False, None),
        (rss(f"{SITE}/p1", link="/old1"), {"/old1": 503}, [], True, "again"),
        (rss(f"{SITE}/p1", link="/old1"), {"/old1": 404, "/map.xml": urlset(f"{SITE}/p8", f"{SITE}/about", f"{SITE}/p1", "https://other.example/p")}, ["p8"], False, None),
        (rss(f"{SITE}/p1", generator="wordpress"), {"/feed?paged=2": rss(f"{SITE}/p2"), "/feed?paged=3": rss(f"{SITE}/p2", f"{SITE}/p3"), "/feed?paged=4": rss(f"{SITE}/p3")}, ["p2", "p3"], False, None),
        (rss(f"{SITE}/p1", generator="wordpress"), {"/map.xml": urlset(f"{SITE}/posts.xml", f"{SITE}/rest.xml", root="sitemapindex"), "/posts.xml": urlset(f"{SITE}/p4"), "/rest.xml": urlset(f"{SITE}/p5")}, ["p4"], False, None),
        (rss(f"{SITE}/p1"), {"/map.xml": 500}, [], True, "again"),
        (rss(f"{SITE}/p1"), {"/map.xml": urlset(*[f"{SITE}/q{k}" for k in range(9)])}, [f"q{k}" for k in range(5)], False, "more than 6"),
        (rss(*[f"{SITE}/p{k}" for k in range(7)]), {"/map.xml": urlset(f"{SITE}/q")}, [], False, "more than 6"),
    ],
)
def test_history(engine, spark, feed, others, found, pending, trouble):
    web = Web(spark, {f"{SITE}/feed": feed} | {SITE + path: body for path, body in others.items()})
    asked = spark.createDataFrame([(5, SITE, f"{SITE}/feed", f"{SITE}/map.xml")], "id long, base_url string, feed_url string, sitemap_url string")
    got = web(spark.createDataFrame([(f"{SITE}/feed", {})], "url string, headers map<string,string>"))
    posts, troubles = sites.history(asked, got, web, 6, engine.kept)
    assert [r.url.rpartition("/")[2] for r in posts.orderBy("pos").collect()] == found
    row = troubles.first()
    assert row.pending is pending and (trouble in row.trouble if trouble else row.trouble is None)


def test_sitemaps_of_new_sites(spark):
    robots = f"User-agent: *\nSitemap: https://other.example/map.xml\nSitemap: {SITE}/empty.xml\nSitemap: /told.xml".encode()
    asked = spark.createDataFrame([(SITE, f"{SITE}/blog/", m) for m in ("auto",)], "base_url string, url string, sitemap string")

    def of(documents, asked=asked):
        rows = [(u, u, 200, "text/plain", b, None, None) for u, b in documents.items()]
        return [r.sitemap_url for r in sites.resolve_sitemaps(asked, spark.createDataFrame(rows, RESPONSES)).collect()]

    good = urlset(f"{SITE}/p1")
    assert of({f"{SITE}/robots.txt": robots, f"{SITE}/told.xml": good, f"{SITE}/empty.xml": urlset(), "https://other.example/map.xml": good, f"{SITE}/sitemap.xml": good}) == [f"{SITE}/told.xml"]
    assert of({f"{SITE}/sitemap.xml": good, f"{SITE}/blog/wp-sitemap.xml": good}) == [f"{SITE}/blog/wp-sitemap.xml"]
    assert of({f"{SITE}/blog/sitemap.xml": b"<"}) == []
    explicit = spark.createDataFrame([(SITE, SITE, "/eigene.xml"), ("https://x.example", "https://x.example", f"{SITE}/karte.xml"), ("https://y.example", "https://y.example", "none")], asked.schema)
    assert of({}, explicit) == [f"{SITE}/eigene.xml"]


def test_lost_leases_are_left_to_others(engine, spark):
    web = Web(spark, {f"{SITE}/feed": rss(f"{SITE}/p1", complete=True), f"{SITE}/p1": article("rosen")})
    add(engine, web)
    daemon.poll_tick(engine, web, at("2024-02-01"))

    def stolen(urls):
        engine.replace("crawl_jobs", engine.table("crawl_jobs").withColumn("lease_token", F.lit("other")))
        return web(urls)

    lost = daemon.crawl_tick(engine, stolen, vectors, at("2024-02-02"))
    assert lost.outcomes == {"lease_lost": 1}
    assert engine.table("pages").count() == 0 and engine.table("crawl_jobs").first().lease_token == "other"


def test_heartbeat():
    beats = []

    def renew(answers=iter((True, OSError("no answer"), True, False))):
        beats.append(1)
        told = next(answers)
        if isinstance(told, Exception):
            raise told
        return told

    assert daemon.with_lease(lambda: time.sleep(0.05) or "done", lambda: True, 0.01) == "done"
    with pytest.raises(LeaseLostError):
        daemon.with_lease(lambda: time.sleep(0.5), renew, 0.01)
    assert len(beats) == 4
    with pytest.raises(ZeroDivisionError):
        daemon.with_lease(lambda: 1 // 0, lambda: True, 1)


def test_results_keep_their_order():
    assert daemon.in_order([0.03, 0.0, 0.01], lambda s: time.sleep(s) or s, 2) == [0.03, 0.0, 0.01]
    seen = []

    def work(n):
        seen.append(n)
        if n == 1:
            raise ValueError(n)
        time.sleep(0.02)

    with pytest.raises(ValueError):
        daemon.in_order(range(50), work, 1)
    assert len(seen) < 50


def test_one_daemon_at_a_time(engine, spark):
    stop = threading.Event()
    stop.set()
    daemon.run_daemon(engine, None, None, stop)
    with daemon.exclusive(spark, engine.path):
        with pytest.raises(AlreadyRunningError):
            daemon.run_daemon(engine, None, None, stop)
        with pytest.raises(AlreadyRunningError):
            engine.remove_site(SITE)
    with pytest.raises(SiteError):
        engine.remove_site(SITE)


def test_loop_rests_and_goes_on():
    stop, ticks = threading.Event(), []

    def tick():
        ticks.append(1)
        if len(ticks) == 1:
            raise OSError("once")
        if len(ticks) == 4:
            stop.set()
        return daemon.Tick(len(ticks) % 2, {})

    daemon.loop(tick, stop, 0.001, 0.001)
    assert len(ticks) == 4


def answers(*told):
    """A service that gives these answers one after another; posts are kept."""
    posts, left = [], list(told)

    def send(url, body, headers, timeout):
        posts.append((url, json.loads(body), headers, timeout))
        given = left.pop(0)
        if isinstance(given, Exception):
            raise given
        status, payload = given
        return status, {"x-request-id": "r7"}, payload if isinstance(payload, bytes) else json.dumps(payload).encode()

    return send, posts


def data(*rows):
    return {"data": [{"index": k, "embedding": v} for k, v in rows]}


def test_embedding_client():
    s = Settings(embedding_dim=2, embedding_batch_size=2, embedding_api_base="https://v.example/v1/", embedding_api_key="k", embedding_model="m", embedding_query_instruction="Finde")
    rests = []
    send, posts = answers(OSError("down"), (503, b"busy"), (200, data((1, [3, 4]), (0, [1, 2]))), (200, data((0, [5, 6]))), (200, data((0, [7, 8]))))
    client = EmbeddingClient(s, send, rests.append)
    assert client.documents(["a", "b", "c"]) == [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]
    assert rests == [2, 4] and posts[0][0] == "https://v.example/v1/embeddings" and posts[0][2] == {"Authorization": "Bearer k"}
    assert [p[1]["input"] for p in posts] == [["a", "b"]] * 3 + [["c"]]
    assert client.query("rot") == [7.0, 8.0] and posts[-1][1]["input"] == ["Instruct: Finde\nQuery: rot"]
    with pytest.raises(EmbeddingError):
        EmbeddingClient(Settings())


@pytest.mark.parametrize(
    ("answer", "told"),
    [
        ((400, b"bad model"), "HTTP 400, model m, 1 texts, request r7: bad model"), ((200, b"<html>"), "no JSON"), ((200, {"error": "x", "a": 1}), "keys a, error; error x"), ((200, data((1, [1, 2]))), "bad index 1"),
        ((200, data((0, [1, 2, 3]))), "3 values and not 2"), ((200, data((0, [1, None]))), "finite"), ((200, data((True, [1, 2]))), "bad index True"), ((200, data((0, [1, 2]), (1, [1, 2]))), "1 vectors"), ((200, []), "a list"),
    ],
)
def test_bad_embeddings(answer, told):
    send, posts = answers(answer)
    with pytest.raises(EmbeddingError) as e:
        EmbeddingClient(Settings(embedding_dim=2, embedding_api_base="b", embedding_model="m"), send).documents(["a"])
    assert told in str(e.value) and len(posts) == 1


def test_attempts_end():
    send, posts = answers(*[(429, b"")] * 3)
    with pytest.raises(EmbeddingError, match="3 attempts"):
        EmbeddingClient(Settings(embedding_dim=2, embedding_api_base="b"), send, lambda s: None).query("a")
    assert len(posts) == 3


@pytest.mark.parametrize(("status", "kind", "permanent"), [(404, None, True), (429, None, False), (500, None, False), (200, "image/png", True), (None, None, False), (304, None, False)])
def test_fetch_errors(status, kind, permanent):
    with pytest.raises(FetchError) as e:
        raise_for("https://a.example", status, kind)
    assert e.value.permanent is permanent and e.value.status == status
    raise_for("https://a.example", 304, None, allow_not_modified=True)
    raise_for("https://a.example", 200, "application/rss+xml")
