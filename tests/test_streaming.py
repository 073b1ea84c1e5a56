import pandas as pd
from pyspark.sql import functions as F

from fernweave.api import Engine
from fernweave.streaming import loops


def test_append_once(spark, tmp_path):
    schema = "url string, n long"
    for k, rows in enumerate(([("a", 1), ("b", 1)], [("b", 2), ("c", 2)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    empty = spark.createDataFrame([], schema)
    table = loops.Snapshots(spark, str(tmp_path / "table"), empty)
    stream = loops.crawl_stream(spark, str(tmp_path / "in"), empty.schema)
    step = loops.append_once(table, "url")
    loops.run_batches(stream, str(tmp_path / "check"), step).awaitTermination()
    assert sorted(r.url for r in table.at(2).collect()) == ["a", "b", "c"]
    step(spark.createDataFrame([("b", 2), ("c", 2)], schema), 1)
    assert table.at(2).count() == 3


def test_job_states(spark, tmp_path):
    schema = "url string, at long, kind string"
    spark.createDataFrame([("a", 1, "transient"), ("b", 1, "content"), ("c", 1, None)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("a", 2, None), ("b", 2, None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = loops.crawl_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files=10)
    seen = []
    query = loops.job_states(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda df, n: seen.append(df.toPandas())).trigger(availableNow=True).start()
    query.awaitTermination()
    last = pd.concat(seen).groupby("url").last()
    assert last["status"].to_dict() == {"a": "done", "b": "failed", "c": "done"}


def test_windows_stream_as_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    query = loops.activity_windows(stream).writeStream.format("memory").queryName("activity").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    ours = spark.table("activity").orderBy("start", "event_type").collect()
    assert ours == loops.activity_windows(events).orderBy("start", "event_type").collect()


def test_engine(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.init()
    feed = b"<rss><channel><link>https://a.example</link><item><link>https://a.example/1</link></item></channel></rss>"
    fetched = spark.createDataFrame([("https://a.example/feed", "https://a.example/feed", 200, "application/rss+xml", feed, None, None)], "url string, final_url string, status int, content_type string, body binary, etag string, last_modified string")
    asked = spark.createDataFrame([("https://a.example", "https://a.example/feed", "none"), ("https://b.example", "auto", "none")], "url string, feed string, sitemap string")
    assert [r.url for r in engine.add_sites(asked, fetched).collect()] == ["https://b.example"]
    assert [r.base_url for r in engine.list_sites().collect()] == ["https://a.example"]
    text = "alpha beta gamma. " * 20
    engine.replace("pages", spark.createDataFrame([(1, 1, "https://a.example/1", "T", text, "en")], "id long, site_id long, url string, title string, content string, language string").withColumn("published_at", F.lit(None)).withColumn("fetched_at", F.current_timestamp()))
    engine.replace("chunks", spark.createDataFrame([(7, 1, 0, len(text), [1.0, 0.0])], "id long, page_id long, start_offset int, content_length int, embedding array<double>"))
    assert [r.page_id for r in engine.search("beta", [1.0, 0.0]).collect()] == [1]
    assert engine.search("beta", [1.0, 0.0], "fr").count() == 0
    assert engine.search("", None).count() == 0
    stats, _ = engine.status()
    assert stats.first().page_count == 1
    assert engine.remove_site("https://a.example/x") == ["https://a.example"]
