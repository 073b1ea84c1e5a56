"""Sites: adding, polling and history over tables of fetched documents.

fetched(url, final_url, status, content_type, body, etag, last_modified) stands for the network: each plan looks
documents up by URL, and the URLs it missed can be fetched for the next round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernweave.functions.text import fingerprint, poll_offset
from fernweave.functions.url import POST_MAP, canonical, is_post_url, is_same_site, joined_on_site, normalized, normalized_on_site, origin, query_set
from fernweave.operators.queue import known_urls
from fernweave.operators.schedule import upsert_sites
from fernweave.sources.feeds import MAX_DEPTH, feed_entries, robots_sitemaps, sitemap_candidates, sitemap_edges, walk
from fernweave.sources.fetch import conditional_headers, error_kind
from fernweave.sources.html import feed_link


def resolve_feeds(requests: DataFrame, fetched: DataFrame) -> DataFrame:
    """requests(url, feed): feed is auto or a URL. Gives url, feed_url (as fetched in the end), home and error."""
    text = F.decode(F.coalesce("body", F.lit(b"")), "ISO-8859-1")
    found = fetched.select(normalized("url").alias("page"), feed_link(text, "url").alias("linked"))
    wanted = requests.select(F.col("url").alias("asked"), normalized("url").alias("page"), F.lower(F.trim("feed")).alias("mode"), normalized("feed").alias("explicit"))
    entries = feed_entries(fetched.select("url", "body", "content_type")).groupBy("feed_url").agg(F.first("home", True).alias("home"), F.first("error", True).alias("feed_error"))
    ends = fetched.select(F.col("url").alias("feed_url"), F.coalesce("final_url", "url").alias("end"))
    read = entries.join(ends, "feed_url").select(normalized("feed_url").alias("feed_url"), "home", "feed_error", "end")
    own = read.select(F.col("feed_url").alias("page"), F.col("feed_error").isNull().alias("is_feed"))
    target = F.when(F.col("mode") == "none", F.lit(None)).when(F.col("mode") != "auto", F.col("explicit")).when(F.coalesce("is_feed", F.lit(False)), F.col("page")).otherwise(F.col("linked"))
    chosen = wanted.join(found, "page", "left").join(own, "page", "left").withColumn("feed_url", target).join(read, "feed_url", "left")
    error = F.when(F.col("mode") == "none", "a feed is required").when(F.col("feed_url").isNull(), "no feed found").when(F.col("feed_error").isNotNull() | F.col("end").isNull(), "the feed can't be read")
    return chosen.select(F.col("asked").alias("url"), F.when(error.isNull(), F.col("end")).alias("feed_url"), "home", error.alias("error"))


def resolve_sitemaps(requests: DataFrame, fetched: DataFrame) -> DataFrame:
    """requests(base_url, url, sitemap: none, auto or a URL) to base_url and sitemap_url, where there is one.

    auto: of those that the origin's robots file names, or else of the usual places below the typed path and at the origin, the first on
    the same site that can be read and is not empty. A URL is taken as it is if it is on the site.
    """
    typed = requests.select("base_url", normalized("url").alias("typed"), F.lower(F.trim("sitemap")).alias("mode"), "sitemap")
    start = typed.withColumn("home", origin("typed"))
    robots = fetched.filter("status = 200").select(F.col("url"), F.decode(F.coalesce("body", F.lit(b"")), "UTF-8").alias("text"))
    told = robots_sitemaps(robots).groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sitemap_url"))), lambda s: s["sitemap_url"]).alias("told"))
    auto = start.filter("mode = 'auto'").join(told.withColumnRenamed("url", "robots"), F.concat("home", F.lit("/robots.txt")) == F.col("robots"), "left")
    candidates = sitemap_candidates(F.coalesce("told", F.array().cast("array<string>")), F.col("typed"))
    tried = auto.select("base_url", "typed", F.posexplode(candidates).alias("pos", "candidate")).select("base_url", "pos", normalized_on_site("candidate", "typed").alias("candidate"))
    usable = sitemap_edges(fetched.filter("status = 200").select("url", "body")).filter("loc IS NOT NULL").select(F.col("sitemap_url").alias("candidate")).distinct()
    good = tried.filter("candidate IS NOT NULL").join(usable, "candidate", "left_semi")
    explicit = start.filter("mode NOT IN ('none', 'auto')").select("base_url", F.lit(0).alias("pos"), joined_on_site("sitemap", "typed").alias("candidate")).filter("candidate IS NOT NULL")
    every = good.select("base_url", "pos", "candidate").unionByName(explicit.select("base_url", "pos", "candidate"))
    return every.groupBy("base_url").agg(F.min(F.struct("pos", "candidate"))["candidate"].alias("sitemap_url"))


def add_sites(sites: DataFrame, requests: DataFrame, fetched: DataFrame, now: Column, interval: int) -> tuple[DataFrame, DataFrame]:
    """The next sites and the refused requests (url, error). A site is the origin of the feed's home, else of the typed URL."""
    feeds = resolve_feeds(requests, fetched)
    good = feeds.filter("error IS NULL").withColumn("base_url", F.coalesce(origin("home"), origin("url")))
    asked = good.join(requests.select("url", "sitemap"), "url")
    maps = resolve_sitemaps(asked.select("base_url", "url", "sitemap"), fetched)
    first = asked.groupBy("base_url").agg(F.min("feed_url").alias("feed_url")).join(maps, "base_url", "left")
    configs = first.select("base_url", "sitemap_url", "feed_url", poll_offset(F.col("base_url"), interval).alias("delay"))
    return upsert_sites(sites, configs, now), feeds.filter("error IS NOT NULL").select("url", "error")


def poll_requests(due: DataFrame) -> DataFrame:
    """url and headers of the feeds of due (sites): validators, unless their history is still to be found."""
    return due.select(F.col("feed_url").alias("url"), conditional_headers(F.col("feed_etag"), F.col("feed_last_modified"), F.col("history_pending")).alias("headers"))


def poll(claimed: DataFrame, fetched: DataFrame, pages: DataFrame, jobs: DataFrame, limit: int = 2000) -> tuple[DataFrame, DataFrame]:
    """claimed(id, base_url, feed_url, token, history_pending) to candidates for the queue and reports.

    Candidates: site_id, url, source, pos. Reports: id, token, etag, last_modified, error, all_new (a feed none of whose
    posts is known: its history is to be discovered), history_pending. A response of 304 is a success without posts. Of sites
    whose history is to be discovered, limit posts are taken at most.
    """
    got = fetched.select(F.col("url").alias("feed_url"), "status", "content_type", "etag", "last_modified")
    state = claimed.join(got, "feed_url", "left").withColumn("kind", error_kind(F.coalesce("status", F.lit(0)), F.col("content_type"), allow_not_modified=True))
    posts = feed_entries(fetched.filter("status = 200").select("url", "body", "content_type"))
    mine = claimed.select("id", "base_url", "feed_url").join(posts, "feed_url")
    own = mine.filter("url IS NOT NULL").filter(is_same_site("url", "base_url")).withColumn("url", canonical("url", "base_url"))
    candidates = own.groupBy(F.col("id").alias("site_id"), "url").agg(F.min("pos").alias("pos"))
    known = known_urls(candidates, pages, jobs).withColumn("known", F.lit(True))
    marked = candidates.join(known, "url", "left")
    novelty = marked.groupBy(F.col("site_id").alias("id")).agg(F.count("*").alias("own"), F.count("known").alias("seen"))
    told = mine.groupBy("id").agg(F.first("error", True).alias("feed_error"), F.count("url").alias("posts"))
    joined = state.join(told, "id", "left").join(novelty, "id", "left")
    own_count = F.coalesce("own", F.lit(0))
    error = (
        F.when(F.col("status") == 304, F.lit(None).cast("string")).when(F.col("kind").isNotNull(), F.concat(F.lit("the feed can't be fetched: "), F.coalesce(F.col("status").cast("string"), F.lit("no answer"))))
        .when(F.col("feed_error").isNotNull(), F.col("feed_error")).when((F.col("posts") > 0) & (own_count == 0), "all posts of the feed belong to another site")
    )
    changed = F.col("status") != 304
    judged = joined.select("id", "token", "etag", "last_modified", error.alias("error"), ((own_count > 0) & (F.col("seen") == 0)).alias("all_new"), (F.col("history_pending") & changed).alias("history_pending"))
    numbered = marked.join(judged.filter("error IS NULL").select(F.col("id").alias("site_id"), (F.col("all_new") | F.col("history_pending")).alias("cut")), "site_id")
    numbered = numbered.withColumn("nth", F.row_number().over(Window.partitionBy("site_id").orderBy("pos")))
    fresh = numbered.filter(F.col("known").isNull() & (~F.col("cut") | (F.col("nth") <= limit)))
    return fresh.select("site_id", "url", F.lit("feed").alias("source"), "pos"), judged


#: documents of a site's history that are walked at most
WALK = 1000


def history(wanted: DataFrame, fetched: DataFrame, fetch: Callable[[DataFrame], DataFrame], limit: int, kept: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Older posts of wanted (sites whose feeds fetched holds): site_id, url, source, pos; and id, pending, trouble of each site.

    A feed that says it is complete has no history. Else its archive links are walked, and where there are none, or they are gone or no
    feeds, the pages of a WordPress feed, and where these are of no use, the sitemap. Feed and history together have limit
    posts at most; beyond, the site stays as it is, with trouble. What can't be fetched now is pending, to be tried again.
    kept writes rows and reads them back, as each round of fetching hangs on the last one.
    """
    feeds = kept(feed_entries(fetched.filter("status = 200").select("url", "body", "content_type")))
    start = kept(_own(wanted.select("id", "base_url", "feed_url"), feeds))
    of_feed = feeds.groupBy("feed_url").agg(F.first("history", True).alias("history"), F.max("wordpress").alias("wordpress"), F.max("complete").alias("complete"))
    state = wanted.select("id", "base_url", "feed_url", "sitemap_url").join(of_feed, "feed_url", "left").join(start.groupBy(F.col("site_id").alias("id")).agg(F.count("*").alias("used")), "id", "left")
    state = kept(state.withColumn("history", F.when(is_same_site("history", "base_url"), F.col("history"))).withColumn("used", F.coalesce("used", F.lit(0))))
    open_ = state.filter((F.col("used") <= limit) & ~F.coalesce("complete", F.lit(False)))
    walked, walk_ends = _walked(open_.filter("history IS NOT NULL").select("id", "base_url", F.col("history").alias("url")), fetch, kept)
    # archive links that are gone leave the other ways open
    rest = kept(open_.join(walk_ends.filter("how IN ('done', 'late')").select("id"), "id", "left_anti"))
    seen = kept(start.select("site_id", "url").unionByName(walked.select("site_id", "url")).distinct())
    paged, page_ends = _paged(rest.filter("wordpress").select("id", "base_url", "feed_url"), fetch, seen, kept)
    rest = kept(rest.join(page_ends.filter("how IN ('done', 'late')").select("id"), "id", "left_anti"))
    mapped, map_ends = _mapped(rest.filter("sitemap_url IS NOT NULL").select("id", "base_url", "sitemap_url"), fetch, limit, kept)
    none = rest.filter("sitemap_url IS NULL").select("id", F.lit("none").alias("how"))
    ends = kept(reduce(DataFrame.unionByName, [walk_ends, page_ends, map_ends, none]).filter("how IN ('late', 'none')").groupBy("id").agg(F.max("how").alias("how")))
    found = walked.withColumn("way", F.lit(0)).unionByName(paged.withColumn("way", F.lit(1))).unionByName(mapped.withColumn("way", F.lit(2)))
    fresh = found.join(start.select("site_id", "url"), ["site_id", "url"], "left_anti")
    first = fresh.withColumn("nth", F.row_number().over(Window.partitionBy("site_id", "url").orderBy("way", "pos"))).filter("nth = 1")
    numbered = first.withColumn("nth", F.row_number().over(Window.partitionBy("site_id").orderBy("way", "pos"))).join(state.select(F.col("id").alias("site_id"), "used"), "site_id")
    numbered = kept(numbered)
    over = numbered.filter(F.col("used") + F.col("nth") > limit).select(F.col("site_id").alias("id")).unionByName(state.filter(F.col("used") > limit).select("id")).distinct().withColumn("over", F.lit(True))
    told = state.select("id").join(over, "id", "left").join(ends, "id", "left")
    trouble = (
        F.when(F.col("over"), F.concat(F.lit("more than "), F.lit(limit), F.lit(" posts: the rest of the history is left")))
        .when(F.col("how") == "late", "history to be tried again: a document can't be fetched now").when(F.col("how") == "none", "history to be tried again: there is neither an archive nor a sitemap")
    )
    found = numbered.filter(F.col("used") + F.col("nth") <= limit).select("site_id", "url", F.when(F.col("way") == 2, "sitemap").otherwise("history").alias("source"), "pos")
    return found, told.select("id", (F.col("over").isNull() & F.col("how").isNotNull()).alias("pending"), trouble.alias("trouble"))


def _own(sites: DataFrame, feeds: DataFrame) -> DataFrame:
    """Posts of sites(id, base_url, feed_url) in their feeds: site_id, url, pos."""
    mine = sites.join(feeds.filter("url IS NOT NULL").select("feed_url", "pos", "url"), "feed_url").filter(is_same_site("url", "base_url"))
    return mine.select(F.col("id").alias("site_id"), canonical("url", "base_url").alias("url"), "pos").groupBy("site_id", "url").agg(F.min("pos").alias("pos"))


def _answers(front: DataFrame, fetch: Callable, kept: Callable) -> tuple[DataFrame, DataFrame]:
    """front(id, url, …) with status, kind of error and print of the answers, and the answers' feed entries."""
    asked = front.select("url", F.create_map().cast("map<string,string>").alias("headers")).dropDuplicates(["url"])
    got = kept(fetch(asked).select("url", "status", "content_type", "body"))
    told = got.select("url", "status", error_kind(F.coalesce("status", F.lit(0)), F.col("content_type")).alias("kind"), fingerprint(F.col("body")).alias("print"))
    return front.join(told, "url", "left").withColumn("kind", F.when(F.col("status").isNull(), "transient").otherwise(F.col("kind"))), feed_entries(got.filter("status = 200").select("url", "body", "content_type"))


_FOUND, _ENDS = "site_id long, url string, pos long", "id long, how string"


def _rounds(front: DataFrame, step: Callable, kept: Callable) -> tuple[DataFrame, DataFrame]:
    """step(front, number) to found, ends and the next front, until it is empty."""
    spark = front.sparkSession
    found, ends, front = [spark.createDataFrame([], _FOUND)], [spark.createDataFrame([], _ENDS)], kept(front)
    for number in range(WALK):
        if not front.limit(1).count():
            break
        new, over, following = step(front, number)
        found.append(kept(new.select("site_id", "url", F.col("pos").cast("long").alias("pos"))))
        ends.append(kept(over.select("id", "how")))
        front = kept(following)
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, ends)


def _walked(sites: DataFrame, fetch: Callable, kept: Callable) -> tuple[DataFrame, DataFrame]:
    """Posts along archive links from sites(id, base_url, url). Ends: done, late (to be tried again) or gone."""

    def step(front: DataFrame, number: int):
        judged, entries = _answers(front, fetch, kept)
        judged, entries = kept(judged), kept(entries)
        posts = _own(judged.select("id", "base_url", F.col("url").alias("feed_url")), entries)
        of = entries.groupBy(F.col("feed_url").alias("url")).agg(F.first("history", True).alias("next"), F.first("error", True).alias("error"))
        told = judged.join(of, "url", "left").withColumn("next", F.when(is_same_site("next", "base_url"), F.col("next")))
        again = F.coalesce(F.array_contains("prints", F.col("print")), F.lit(False))
        how = (
            F.when(F.col("kind") == "transient", "late").when((F.col("kind") == "permanent") | F.col("error").isNotNull(), "gone")
            .when(again | F.col("next").isNull() | F.array_contains("walked", F.col("next")), "done")
        )
        told = told.withColumn("how", how).withColumn("again", again)
        new = posts.join(told.filter(~F.col("again")).select(F.col("id").alias("site_id")), "site_id", "left_semi").withColumn("pos", F.lit(number) * 1_000_000 + F.col("pos"))
        following = told.filter("how IS NULL").select("id", "base_url", F.col("next").alias("url"), F.concat("walked", F.array("next")).alias("walked"), F.concat("prints", F.array("print")).alias("prints"))
        return new, told.filter("how IS NOT NULL"), following

    front = sites.select("id", "base_url", "url", F.array("url").alias("walked"), F.array().cast("array<string>").alias("prints"))
    return _rounds(front, step, kept)


def _paged(sites: DataFrame, fetch: Callable, seen: DataFrame, kept: Callable) -> tuple[DataFrame, DataFrame]:
    """Posts of the pages 2, 3, … of the WordPress feeds of sites(id, base_url, feed_url), as long as they have news. Ends: done, late or gone (page 2 is of no use)."""

    def step(front: DataFrame, number: int):
        page = number + 2
        asked = front.withColumn("url", query_set("feed_url", F.lit("paged"), F.lit(str(page))))
        judged, entries = _answers(asked, fetch, kept)
        judged, entries = kept(judged), kept(entries)
        posts = kept(_own(judged.select("id", "base_url", F.col("url").alias("feed_url")), entries))
        before = reduce(DataFrame.unionByName, [seen, *past])
        news = posts.join(before, ["site_id", "url"], "left_anti")
        errors = entries.filter("error IS NOT NULL").select(F.col("feed_url").alias("url"), "error").dropDuplicates(["url"])
        told = judged.join(errors, "url", "left").join(news.groupBy(F.col("site_id").alias("id")).agg(F.count("*").alias("fresh")), "id", "left")
        useless = F.col("status").isin(404, 410) | F.coalesce(F.array_contains("prints", F.col("print")), F.lit(False)) | (F.col("kind").isNull() & F.col("error").isNull() & F.col("fresh").isNull())
        how = F.when(useless, "gone" if page == 2 else "done").when(F.col("kind").isNotNull() | F.col("error").isNotNull(), "late")
        told = told.withColumn("how", how)
        good = news.join(told.filter("how IS NULL").select(F.col("id").alias("site_id")), "site_id", "left_semi").withColumn("pos", F.lit(page) * 1_000_000 + F.col("pos"))
        good = kept(good)
        past.append(good.select("site_id", "url"))
        return good, told.filter("how IS NOT NULL"), told.filter("how IS NULL").select("id", "base_url", "feed_url", F.concat("prints", F.array("print")).alias("prints"))

    past: list[DataFrame] = []
    return _rounds(sites.select("id", "base_url", "feed_url", F.array().cast("array<string>").alias("prints")), step, kept)


def _mapped(sites: DataFrame, fetch: Callable, limit: int, kept: Callable) -> tuple[DataFrame, DataFrame]:
    """Posts below the sitemaps of sites(id, base_url, sitemap_url); a sitemap that can't be read makes the site late."""
    front = kept(sites.select("id", "base_url", F.col("sitemap_url").alias("url")))
    edges, late = [], []
    for _ in range(MAX_DEPTH + 1):
        if not front.limit(1).count():
            break
        got = kept(fetch(front.select("url", F.create_map().cast("map<string,string>").alias("headers")).dropDuplicates(["url"])).select("url", "status", "content_type", "body"))
        met = kept(sitemap_edges(got.filter("status = 200").select("url", "body")))
        bad = got.filter(error_kind(F.coalesce("status", F.lit(0)), F.col("content_type")).isNotNull()).select("url").unionByName(met.filter("error IS NOT NULL").select(F.col("sitemap_url").alias("url")))
        late.append(kept(front.join(bad.distinct(), "url", "left_semi").select("id", F.lit("late").alias("how"))))
        edges.append(met)
        below = front.join(met.filter("is_index").select(F.col("sitemap_url").alias("url"), "loc"), "url").select("id", "base_url", F.col("loc").alias("url")).filter(is_same_site("url", "base_url")).distinct()
        known = reduce(DataFrame.unionByName, edges).select(F.col("sitemap_url").alias("url")).distinct()
        front = kept(below.join(known, "url", "left_anti"))
    spark = sites.sparkSession
    if not edges:
        return spark.createDataFrame([], _FOUND), spark.createDataFrame([], _ENDS)
    every = reduce(DataFrame.unionByName, edges).dropDuplicates(["sitemap_url", "pos"])
    # what is no post is met too, so the limit comes later
    found = walk(every, sites.select(F.col("base_url").alias("site"), "sitemap_url"), POST_MAP, 1 << 30)
    joined = found.join(sites.select("id", F.col("base_url").alias("site")), "site").filter(is_post_url(F.col("url")) & is_same_site("url", "site"))
    posts = joined.select(F.col("id").alias("site_id"), canonical("url", "site").alias("url"), F.col("pos").cast("long").alias("pos"))
    ends = reduce(DataFrame.unionByName, late).distinct()
    return kept(posts), ends
