"""Feeds, sitemaps and robots files: parsers of one document, and DataFrame sources over them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernweave.config import FeedError, SitemapError
from fernweave.functions.url import canonicalize_url, same_site, try_normalize_url
from fernweave.sources.batches import gathered, rows_of

ATOM, RSS1, DC, FH = "http://www.w3.org/2005/Atom", "http://purl.org/rss/1.0/", "http://purl.org/dc/elements/1.1/", "http://purl.org/syndication/history/1.0"
#: fixed values
SITEMAP_SPACES = ("", "http://www.sitemaps.org/schemas/sitemap/0.9", "https://www.sitemaps.org/schemas/sitemap/0.9")
MAX_DEPTH = 5
_ENTITY = re.compile(rb"<!ENTITY|<!DOCTYPE[^>]*\[", re.IGNORECASE)


@dataclass
class Feed:
    urls: list[str] = field(default_factory=list)
    home: str | None = None
    history: str | None = None
    wordpress: bool = False
    complete: bool = False


def _root(body: bytes, error: type[Exception]) -> ElementTree.Element:
    if _ENTITY.search(body):
        raise error("documents that declare entities are rejected")
    try:
        return ElementTree.fromstring(body.strip())
    except ElementTree.ParseError as e:
        raise error(f"not XML: {e}") from e


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _first(nodes: dict[str, str], *names: str) -> str | None:
    return next((nodes[n] for n in names if n in nodes), None)


def parse_feed(body: bytes, url: str, content_type: str = "") -> Feed:
    """Post URLs in order without repeats, the home page, the archive link, and flags of an RSS or Atom document."""
    if "json" in content_type.lower() or body.lstrip()[:1] in (b"{", b"["):
        raise FeedError("JSON feeds are not supported")
    root = _root(body, FeedError)
    kind = _local(root.tag)
    if kind not in ("rss", "feed", "rdf"):
        raise FeedError(f"not a feed: {kind}")
    head = root if kind == "feed" else next((c for c in root if _local(c.tag) == "channel"), root)
    entries = [e for e in root.iter() if _local(e.tag) in ("item", "entry")]
    feed, links, generator = Feed(), {}, ""
    for node in head:
        name = _local(node.tag)
        if name == "link":
            href = node.get("href") or (node.text or "").strip()
            rel = node.get("rel") or "alternate"
            if href and rel not in links:
                links[rel] = urljoin(url, href.strip())
        elif name == "generator":
            generator = " ".join([node.text or "", node.get("uri") or ""])
        elif name == "complete" and node.tag.startswith("{" + FH):
            feed.complete = True
    feed.home = try_normalize_url(links.get("alternate"))
    feed.history = try_normalize_url(_first(links, "prev-archive", "next"))
    feed.wordpress = "wordpress" in generator.lower()
    found = []
    for entry in entries:
        link = ident = None
        for node in entry:
            name = _local(node.tag)
            if name == "link" and link is None and (node.get("rel") or "alternate") == "alternate":
                link = node.get("href") or (node.text or "").strip() or None
            elif name in ("id", "guid") and ident is None:
                ident = (node.text or "").strip() or None
        target = try_normalize_url(urljoin(url, (link or ident).strip())) if link or ident else None
        if target:
            found.append(target)
    feed.urls = list(dict.fromkeys(found))
    return feed


def site_feed(feed: Feed, origin: str) -> Feed:
    """Same-site posts on the site's origin; an error if there are posts and all belong elsewhere."""
    own = list(dict.fromkeys(canonicalize_url(u, origin) for u in feed.urls if same_site(u, origin)))
    if feed.urls and not own:
        raise FeedError("all posts of the feed belong to another site")
    history = feed.history if feed.history and same_site(feed.history, origin) else None
    return Feed(own, feed.home, history, feed.wordpress, feed.complete)


def parse_sitemap(body: bytes) -> tuple[bool, list[str]]:
    """Whether it is an index, and the <loc> texts of the sitemap's own namespaces."""
    root = _root(body, SitemapError)
    wanted = {f"{{{s}}}loc" if s else "loc" for s in SITEMAP_SPACES}
    locs = [text for node in root.iter() if node.tag in wanted and (text := (node.text or "").strip())]
    return _local(root.tag) == "sitemapindex", locs


def parse_robots_sitemaps(text: str, base: str) -> list[str]:
    found = []
    for line in text.splitlines():
        key, colon, value = line.partition(":")
        if colon and key.strip().lower() == "sitemap" and value.strip():
            found.append(urljoin(base, value.strip()))
    return list(dict.fromkeys(found))


def _groups(text: str) -> list[tuple[list[str], list[tuple[str, str]]]]:
    """Groups of user agents and their rules (RFC 9309)."""
    groups: list[tuple[list[str], list[tuple[str, str]]]] = []
    open_ = False
    for line in text.splitlines():
        key, colon, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if not open_:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
            open_ = True
        elif key in ("allow", "disallow"):
            open_ = False
            if groups:
                groups[-1][1].append((key, value))
    return groups


def fully_disallows(text: str, agent: str) -> bool:
    """Whether the agent's rules deny every path and allow none but '' and /robots.txt."""
    groups, name = _groups(text), agent.lower()
    own = [rules for agents, rules in groups if any(a != "*" and a and a in name for a in agents)] or [rules for agents, rules in groups if "*" in agents]
    rules = [r for group in own for r in group]
    denied = any(kind == "disallow" and path in ("/", "/*", "*") for kind, path in rules)
    return denied and not any(kind == "allow" and path not in ("", "/robots.txt") for kind, path in rules)


# --- sources ------------------------------------------------------------------------------------


def _dealt(fetched: DataFrame) -> DataFrame:
    """Documents over all cores: they take far longer to parse than to read, and few files of small rows make few tasks."""
    return fetched.repartition("url")


def feed_entries(fetched: DataFrame) -> DataFrame:
    """fetched(url, body, content_type) to one row for each post: feed_url, pos, url, home, history, wordpress, complete, error.

    A feed that can't be read gives one row with its error and no url.
    """

    def entries(url: str, body: bytes | None, kind: str | None) -> list[tuple]:
        try:
            feed = parse_feed(bytes(body or b""), url, kind or "")
            return [(url, n, u, feed.home, feed.history, feed.wordpress, feed.complete, None) for n, u in enumerate(feed.urls)]
        except FeedError as e:
            return [(url, None, None, None, None, None, None, str(e))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["feed_url", "pos", "url", "home", "history", "wordpress", "complete", "error"]
        schema = pa.schema(list(zip(names, [pa.string(), pa.int32(), *[pa.string()] * 3, *[pa.bool_()] * 2, pa.string()], strict=True)))
        yield from gathered((found for row in rows_of(batches) for found in entries(*row)), schema)

    schema = "feed_url string, pos int, url string, home string, history string, wordpress boolean, complete boolean, error string"
    return _dealt(fetched.select("url", "body", "content_type")).mapInArrow(run, schema)


def sitemap_edges(fetched: DataFrame) -> DataFrame:
    """fetched(url, body) to sitemap_url, pos, loc, is_index, error."""

    def edges(url: str, body: bytes | None) -> list[tuple]:
        try:
            index, locs = parse_sitemap(bytes(body or b""))
            return [(url, n, loc, index, None) for n, loc in enumerate(locs)]
        except SitemapError as e:
            return [(url, None, None, None, str(e))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("sitemap_url", pa.string()), ("pos", pa.int32()), ("loc", pa.string()), ("is_index", pa.bool_()), ("error", pa.string())])
        yield from gathered((found for row in rows_of(batches) for found in edges(*row)), schema)

    return _dealt(fetched.select("url", "body")).mapInArrow(run, "sitemap_url string, pos int, loc string, is_index boolean, error string")


def robots_sitemaps(fetched: DataFrame) -> DataFrame:
    """fetched(url, text) to url, pos, sitemap_url; absolute and relative links."""
    lines = fetched.select("url", F.posexplode(F.split("text", r"\R")).alias("pos", "line"))
    value = F.trim(F.regexp_extract("line", r"(?i)^\s*sitemap\s*:(.*)$", 1))
    base = F.regexp_extract("url", r"^[A-Za-z]+://[^/]+", 0)
    target = F.when(value.rlike("^[A-Za-z]+://"), value).when(value.startswith("/"), F.concat(base, value)).otherwise(F.concat(base, F.lit("/"), value))
    return lines.filter(F.col("line").rlike(r"(?i)^\s*sitemap\s*:") & (value != "")).select("url", "pos", target.alias("sitemap_url"))


def sitemap_candidates(robots_url, site_url):
    """Sitemaps to try (columns): those of robots without repeats, else those of the site's path and then the origin's."""
    path = F.regexp_replace(site_url, r"/+$", "")
    origin = F.regexp_extract(site_url, r"^[A-Za-z]+://[^/]+", 0)
    at_root = F.array(F.concat(origin, F.lit("/sitemap.xml")))
    usual = F.when(path == origin, at_root).otherwise(F.concat(F.array(F.concat(path, F.lit("/sitemap.xml")), F.concat(path, F.lit("/wp-sitemap.xml"))), at_root))
    return F.when(F.size(robots_url) > 0, F.array_distinct(robots_url)).otherwise(usual)


def walk(edges: DataFrame, starts: DataFrame, post_map: str, limit: int, depth: int = MAX_DEPTH) -> DataFrame:
    """Pages below starts(site, sitemap_url), depth first, over edges of sitemap_edges: site, pos, url.

    At most depth joins. A sitemap on its own path is not entered again; of an index that names a post-like
    sitemap only those are entered; a URL counts where it is first met, up to limit for a site.
    """
    edges = edges.filter("loc IS NOT NULL").withColumn("post", F.col("loc").rlike(post_map))
    edges = edges.withColumn("any_post", F.max("post").over(Window.partitionBy("sitemap_url")))
    edges = edges.filter(~F.col("is_index") | ~F.col("any_post") | F.col("post")).select("sitemap_url", "pos", "loc", "is_index")
    front = starts.select("site", "sitemap_url", F.array().cast("array<int>").alias("path"), F.array("sitemap_url").alias("seen"))
    leaves = None
    for _ in range(depth + 1):
        met = front.join(edges, "sitemap_url").withColumn("path", F.concat("path", F.array("pos")))
        pages = met.filter(~F.col("is_index")).select("site", "path", F.col("loc").alias("url"))
        leaves = pages if leaves is None else leaves.unionByName(pages)
        front = met.filter(F.col("is_index") & ~F.array_contains("seen", F.col("loc"))).select("site", F.col("loc").alias("sitemap_url"), "path", F.concat("seen", F.array("loc")).alias("seen"))
    first = leaves.groupBy("site", "url").agg(F.min("path").alias("path"))
    pos = F.row_number().over(Window.partitionBy("site").orderBy("path"))
    return first.withColumn("pos", pos).filter(F.col("pos") <= limit).select("site", "pos", "url")
