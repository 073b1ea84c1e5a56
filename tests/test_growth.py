"""Steps that must hold on larger tables than the test tables."""

import json
import re
import secrets
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from fernweave.operators import chunk, retrieve, schedule
from fernweave.plans import sites
from fernweave.sources import batches, feeds, html, tables


class _Caught:
    """Stands for a DataFrame: gives the function that would run over its Arrow batches."""

    def select(self, *columns):
        return self

    def repartition(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_scatter_of_many_sites(spark):
    n, interval = 60_000, 43_200
    every = spark.range(n).select("id", F.lit(None).cast("timestamp").alias("next_poll_at"))
    placed = schedule.scatter(every, F.lit("2024-01-15 00:00:00").cast("timestamp"), interval).select("id", F.unix_timestamp("next_poll_at").alias("at")).toPandas()
    assert placed.sort_values("id")["at"].tolist() == [1705276800 + interval * k // n for k in range(n)]


def test_index_has_blocks_and_counts_ids_that_repeat(spark, tmp_path, monkeypatch):
    """Few rows, each over several terms; a small block makes a term meet in several; files grow with the bytes."""
    monkeypatch.setattr(retrieve, "FILE_BYTES", 256)
    rows = [(k, k // 3, "The " * (k % 3 + 1) + f"Rose w{k % 7}; É{k}!") for k in range(200)]
    rows += [(5, 1, "the the other"), (900, 300, None), (901, 300, ""), (902, 300, " .,; ")]
    chunks = spark.createDataFrame(rows, "chunk_id long, page_id long, content string")
    retrieve.write_index(chunks, str(tmp_path / "index"), 2)
    made = retrieve.read_index(spark, str(tmp_path / "index"))
    counts, lengths = Counter(), Counter()
    for chunk_id, page_id, text in rows:
        words = None if text is None else re.findall(r"\w+", text.lower())
        counts.update((w, chunk_id) for w in words or ())
        lengths[chunk_id, page_id, words if words is None else len(words)] += 1
    assert {(r.term, r.chunk_id): r.tf for r in made.postings.collect()} == counts and made.postings.count() == len(counts)
    assert Counter((r.chunk_id, r.page_id, r.dl) for r in made.chunk_stats.collect()) == lengths
    assert {r.term: r.df for r in made.term_stats.collect()} == Counter(w for w, _ in counts)
    told = [n for _, _, n in lengths.elements() if n is not None]
    assert made.corpus.collect() == [(len(rows), sum(told) / len(told))]
    assert len(list((tmp_path / "index" / "postings").glob("part-*"))) > 4 and not (tmp_path / "index" / "blocks").exists()
    stored = spark.read.parquet(str(tmp_path / "index" / "postings"))
    assert stored.count() < made.postings.count()


def _bytes_read(spark) -> int:
    return sum(s.getBytesRead() for s in spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())


def test_json_list_reads_its_file_once(spark, tmp_path):
    rows = [{"url": f"https://a{n}.example/f", "home": None, "errors": n % 5 - 1, "fetched": str(n)} for n in range(4000)]
    odd = [{"url": "https://b.example/f", "errors": e, "fetched": f} for e, f in ((1.5, 1e2), (1.0, True), ("x", None), ({"a": 1}, [1]), (10**18 - 1, 10**18))]
    (tmp_path / "list.json").write_text(json.dumps(rows + odd))
    before = _bytes_read(spark)
    found = tables.json_feed_list(spark, str(tmp_path / "list.json")).select("errors", "fetched").collect()
    assert _bytes_read(spark) - before < 10 * (tmp_path / "list.json").stat().st_size
    assert Counter(map(tuple, found)) == Counter([(max(0, n % 5 - 1), n) for n in range(4000)] + [(0, 0)] * 4 + [(10**18 - 1, 0)])


def test_documents_of_one_task_are_dealt_out(spark):
    """More than a task's worth of feeds and of sitemaps, all from one task."""
    item = "<item><link>https://a.example/p</link></item>"
    rss = [(f"https://a.example/{n}", f"<rss><channel><!--{secrets.token_hex(1 << 17)}-->{item}</channel></rss>".encode(), "application/xml") for n in range(40)]
    maps = [(url, f"<urlset><!--{secrets.token_hex(1 << 17)}--><url><loc>{url}</loc></url></urlset>".encode()) for url, _, _ in rss]
    for found, n in ((feeds.feed_entries(spark.createDataFrame(rss, "url string, body binary, content_type string").coalesce(1)), 40), (feeds.sitemap_edges(spark.createDataFrame(maps, "url string, body binary").coalesce(1)), 40)):
        parts = found.select(F.spark_partition_id().alias("part")).groupBy("part").count().collect()
        assert len(parts) > 1 and sum(r["count"] for r in parts) == n


def test_documents_are_parsed_in_pieces(spark):
    body = ("<rss><channel>" + "".join(f"<item><link>https://a.example/{'p' * 100}{k}</link></item>" for k in range(300)) + "</channel></rss>").encode()
    batch = pa.record_batch({"url": [f"https://a.example/{n}" for n in range(200)], "body": [body] * 200, "content_type": ["application/xml"] * 200})
    got = [len(b) for b in feeds.feed_entries(_Caught())(iter([batch]))]
    assert len(got) > 4 and sum(got) == 200 * 300
    body = ("<urlset>" + "".join(f"<url><loc>https://a.example/{'p' * 100}{k}</loc></url>" for k in range(300)) + "</urlset>").encode()
    got = [len(b) for b in feeds.sitemap_edges(_Caught())(iter([pa.record_batch({"url": ["u"] * 200, "body": [body] * 200})]))]
    assert len(got) > 4 and sum(got) == 200 * 300


def test_windows_are_handed_on_in_pieces(spark):
    batch = pa.record_batch({"page_id": list(range(300)), "content": ["word " * 4000] * 299 + [None]})
    made = chunk.word_windows(_Caught(), 64, 8)(iter([batch]))
    sizes = [(len(b), b.nbytes) for b in made]
    assert len(sizes) > 3 and max(n for _, n in sizes) < 4 * batches.CHARACTERS
    assert sum(n for n, _ in sizes) == 299 * len(chunk.spans_of([(0, 1)] * 4000, 64, 8))


def test_articles_are_extracted_slice_by_slice(monkeypatch):
    page = "<title>T{0}</title><article><p>" + "the rose " * 40 + "</p></article>"
    given = [None if n % 7 == 0 else "<p>short" if n % 5 == 0 else page.format(n) for n in range(3 * batches.SLICE + 1)]
    got = html.extracted.func(pa.array(given, pa.string()))
    assert [r["title"] for r in got.to_pylist()] == [None if n % 7 == 0 or n % 5 == 0 else f"T{n}" for n in range(len(given))]
    assert html.extracted.func(pa.array([], pa.string())).to_pylist() == []


def test_articles_are_parsed_once_and_handed_on_in_pieces(spark, monkeypatch):
    page = "<title>T</title><article><p>" + "the rose " * 4000 + "</p></article>"
    seen = []
    monkeypatch.setattr(html, "extract", lambda text, found=html.extract: seen.append(text) or found(text))
    given = [None if n % 50 == 0 else "<p>short" if n % 50 == 1 else page for n in range(200)]
    sizes = [len(b) for b in html.article_pages(_Caught())(iter([pa.record_batch({"url": [f"u{n}" for n in range(200)], "html": given})]))]
    assert len(sizes) > 3 and sum(sizes) == 192 and len(seen) == 196


def test_candidates_of_a_sitemap_take_one_worker_a_task(spark):
    requests = spark.createDataFrame([("https://a.example", "https://a.example/blog/", "auto"), ("https://b.example", "https://b.example", " https://www.b.example/m.xml#y"), ("https://c.example", "https://c.example", "https://other.example/m.xml")], "base_url string, url string, sitemap string")
    body = "<urlset><url><loc>https://a.example/1</loc></url></urlset>"
    told = "Sitemap: https://other.example/m.xml\nSitemap: HTTP://WWW.A.example:80/m.xml#top"
    fetched = spark.createDataFrame([("https://a.example/robots.txt", 200, told.encode()), ("http://www.a.example/m.xml", 200, body.encode())], "url string, status int, body binary")
    found = sites.resolve_sitemaps(requests, fetched)
    assert {tuple(r) for r in found.collect()} == {("https://a.example", "http://www.a.example/m.xml"), ("https://b.example", "https://www.b.example/m.xml")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("normalized_on_site(") == 1 and plan.count("joined_on_site(") == 1 and "is_same_site(" not in plan
