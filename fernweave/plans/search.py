"""The hybrid search plan: one lazily composed DataFrame from two retrievers to ranked pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernweave.functions.text import TERM, confidence, is_truncated, snippet
from fernweave.operators import rank, retrieve
from fernweave.operators.filters import SearchFilter

#: from the pages seen so far (page_id, union_pos) and pages to a page run
Reranker = Callable[[DataFrame, DataFrame], DataFrame]


def query_terms(text: str) -> list[str]:
    import regex

    return regex.findall(TERM, text.lower())


def dense_run(chunks: DataFrame, query: list[float], k: int, filters: tuple[SearchFilter, ...] = (), decimals: int | None = None) -> DataFrame:
    return rank.make_run(retrieve.dense_top_k(chunks, query, k, filters, decimals), 0, "dense", retrieve.DENSE_WEIGHT, "chunk_id")


def bm25_run(index: retrieve.LexicalIndex, terms: list[str], k: int, pages: DataFrame | None = None, filters: tuple[SearchFilter, ...] = (), decimals: int | None = None) -> DataFrame:
    return rank.make_run(retrieve.bm25_top_k(index, terms, k, pages, filters, decimals), 1, "bm25", retrieve.BM25_WEIGHT, "chunk_id")


def fuse(chunk_runs: list[DataFrame], pages: DataFrame, rerankers: tuple[Reranker, ...] = (), k: int = 60, limit: int = 64, decimals: int | None = None) -> DataFrame:
    """page_id, scores dense, bm25 and length (null where absent), rrf and position, best first.

    Every step from here on is over at most a few times the retrievers' limit of rows; the
    content of pages is joined for the candidates only.
    """
    runs = rank.page_run(chunk_runs[0])
    for more in chunk_runs[1:]:
        runs = runs.unionByName(rank.page_run(more))
    if decimals is not None:
        runs = runs.withColumn("score", F.round("score", decimals))
    if rerankers:
        union = rank.page_union(runs)
        for reranker in rerankers:
            runs = runs.unionByName(reranker(union, pages))
    fused = rank.reciprocal_rank_fusion(runs, k, ("dense", "bm25", "length"))
    if decimals is not None:
        fused = fused.withColumn("rrf", F.round("rrf", decimals + 4))
    order = Window.orderBy(F.desc("rrf"), "first_run", "first_rank")
    top = fused.orderBy(F.desc("rrf"), "first_run", "first_rank").limit(limit)
    return top.withColumn("position", F.row_number().over(order).cast("long")).select("page_id", "dense", "bm25", "length", "rrf", "position")


def search(
    chunks: DataFrame, index: retrieve.LexicalIndex, pages: DataFrame, query: str, vector: list[float], filters: tuple[SearchFilter, ...] = (),
    prefer_long: bool = False, retriever_limit: int = 64, limit: int = 64, decimals: int | None = None,
) -> DataFrame:
    """chunks: chunk_id, page_id, embedding, language, published_at; pages: page_id, content, language, published_at."""
    runs = [dense_run(chunks, vector, retriever_limit, filters, decimals), bm25_run(index, query_terms(query), retriever_limit, pages, filters, decimals)]
    return fuse(runs, pages, (rank.length_run,) if prefer_long else (), limit=limit, decimals=decimals)


def display(results: DataFrame, pages: DataFrame) -> DataFrame:
    """Results with url, title, snippet, is_truncated, published_date and confidence."""
    joined = results.join(pages.select("page_id", "url", "title", "content", "published_at"), "page_id")
    return joined.select(
        *results.columns, "url", "title", snippet(F.col("content")).alias("snippet"), is_truncated(F.col("content")).alias("is_truncated"),
        F.to_date("published_at").alias("published_date"), confidence(F.col("dense")).alias("confidence"),
    ).orderBy("position")
