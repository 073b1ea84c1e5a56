"""Tables: feed lists in CSV and JSON, pages, chunks and embeddings as sources and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.functions.url import normalized, origin
from fernweave.types import RELATIONS


def csv_feed_list(spark: SparkSession, path: str) -> DataFrame:
    """Rows (origin, feed_url, line_no) of a CSV with the columns Address and RSS feed; rows without a feed go."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, encoding="UTF-8", multiLine=True)
    names = {c.lstrip("﻿"): c for c in raw.columns}
    missing = {"Address", "RSS feed"} - set(names)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    numbered = raw.withColumn("line_no", F.monotonically_increasing_id())
    rows = numbered.select(origin(F.col(f"`{names['Address']}`")).alias("origin"), normalized(F.col(f"`{names['RSS feed']}`")).alias("feed_url"), "line_no")
    return rows.filter("origin IS NOT NULL AND feed_url IS NOT NULL")


def json_feed_list(spark: SparkSession, path: str) -> DataFrame:
    """Rows (origin, feed_url, errors, fetched) of a JSON array; counts that are no whole numbers from 0 on are 0.

    Counts are variants: for a string that is none in the file, the reader would seek and read a buffer of the file anew.
    """
    schema = "url string, home string, errors variant, fetched variant"
    raw = spark.read.json(path, schema=schema, multiLine=True)

    def count(name: str):
        told = F.try_variant_get(F.col(name), "$", "string")
        return F.when(F.schema_of_variant(name).isin("BIGINT", "STRING") & told.rlike(r"^\d{1,18}$"), told.cast("long")).otherwise(0)

    rows = raw.select(origin(F.coalesce("home", "url")).alias("origin"), normalized("url").alias("feed_url"), count("errors").alias("errors"), count("fetched").alias("fetched"))
    return rows.filter("origin IS NOT NULL AND feed_url IS NOT NULL")


def create_relations(spark: SparkSession, path: str) -> None:
    """Empty tables with the fixed schemas; fails if there are any."""
    for name, schema in RELATIONS.items():
        spark.createDataFrame([], schema).write.mode("error").parquet(f"{path}/{name}")


def append_pages(new: DataFrame, pages: DataFrame) -> DataFrame:
    """The rows of new whose URL is no page yet, one of each URL (the lowest id)."""
    first = new.groupBy("url").agg(F.min("id").alias("id"))
    return new.join(first, ["url", "id"], "left_semi").join(pages.select("url"), "url", "left_anti")


def append_new(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """The rows of new whose key is not in old, one of each."""
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti").select(*new.columns)


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """texts(id, text) to id, embedding: embed gets batches of the given size, in order, and is checked for their number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                vectors = embed(part["text"].tolist())
                if len(vectors) != len(part):
                    raise ValueError("as many vectors as texts are needed")
                yield pd.DataFrame({"id": part["id"], "embedding": vectors})

    return texts.select("id", "text").mapInPandas(run, "id long, embedding array<float>")


def joined_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks with the vectors(chunk_id, embedding) computed before."""
    return chunks.join(vectors, "chunk_id")


def pages_by_id(pages: DataFrame, ids: DataFrame) -> DataFrame:
    return pages.join(ids.select("page_id").distinct(), "page_id", "left_semi")


def sites_in_order(sites: DataFrame) -> DataFrame:
    return sites.orderBy("base_url")


def ping(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT 1 AS one")
