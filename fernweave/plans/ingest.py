"""Ingest: from claimed jobs and their responses to pages, chunks and reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.functions.text import decoded, detect_language, embedding_text, parse_date
from fernweave.functions.url import is_same_site
from fernweave.operators.chunk import word_windows
from fernweave.sources.fetch import error_kind
from fernweave.sources.html import extracted
from fernweave.sources.tables import embedded


@dataclass(frozen=True)
class Attempt:
    """pages(id, site_id, url, title, content, published_at, language, fetched_at), chunks (with text to embed) and reports for the queue."""

    pages: DataFrame
    chunks: DataFrame
    reports: DataFrame


def attempts(claims: DataFrame, responses: DataFrame, pages: DataFrame, now: Column, size: int = 384, overlap: int = 32) -> Attempt:
    """claims(id, site_id, url, lease_token), responses(url, final_url, status, content_type, body).

    A job whose URL is a page already is done. A bad status or type is an error of its kind, a response from another site
    and a page without an article are errors of content; what is left becomes a page under the job's URL, not the one it was redirected to.
    """
    known = pages.select("url", F.lit(True).alias("known"))
    joined = claims.join(known, "url", "left").join(responses, "url", "left")
    kind = (
        F.when(F.col("known"), F.lit(None).cast("string"))
        .when(F.col("status").isNull(), "transient")
        .when(error_kind(F.col("status"), F.col("content_type")).isNotNull(), error_kind(F.col("status"), F.col("content_type")))
        .when(~is_same_site(F.coalesce("final_url", "url"), F.col("url")), "content")
    )
    judged = joined.withColumn("kind", kind)
    read = judged.withColumn("page", F.when(F.col("kind").isNull() & F.col("known").isNull(), extracted(decoded("body"))))
    read = read.withColumn("kind", F.when(F.col("kind").isNull() & F.col("known").isNull() & F.col("page.text").isNull(), "content").otherwise(F.col("kind")))
    good = read.filter(F.col("page.text").isNotNull())
    made = good.select(
        F.xxhash64("url").alias("id"), "site_id", "url", F.col("page.title").alias("title"), F.col("page.text").alias("content"), parse_date(F.col("page.date")).alias("published_at"),
        detect_language(F.col("page.text"), F.col("page.title")).alias("language"), now.alias("fetched_at"),
    )
    cut = word_windows(made.select(F.col("id").alias("page_id"), "content"), size, overlap)
    chunks = cut.join(made.select(F.col("id").alias("page_id"), "title"), "page_id").select(
        F.xxhash64("page_id", "start_offset").alias("id"), "page_id", "start_offset", "content_length", embedding_text(F.col("title"), F.col("content")).alias("text")
    )
    error = F.when(F.col("kind").isNotNull(), F.concat_ws(" ", F.lit("fetch:"), "kind", F.col("status").cast("string")))
    reports = read.select(
        "id", F.col("lease_token").alias("token"), F.when(F.col("kind").isNull(), "done").otherwise("error").alias("outcome"), F.col("kind").alias("error_kind"), error.alias("error")
    )
    return Attempt(made, chunks, reports)


def embedded_chunks(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """Chunks of attempts() with their vectors, as the relation has them."""
    vectors = embedded(chunks.select("id", "text"), embed, batch)
    return chunks.join(vectors, "id").select("id", "page_id", "start_offset", "content_length", "embedding")
