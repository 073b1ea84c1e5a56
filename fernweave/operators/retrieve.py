"""Retrievers: exact cosine top-k and BM25 top-k over chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.functions.text import NO_TERM, terms
from fernweave.operators.filters import SearchFilter, compiled

K1, B = 1.2, 0.75
DENSE_WEIGHT, BM25_WEIGHT = 2.0, 0.5


def cosines(chunks: DataFrame, query: list[float]) -> DataFrame:
    """chunk_id, page_id and score of chunks(chunk_id, page_id, embedding): one matrix product for each batch.

    In double precision; vectors that are zero, of another length, null or with nulls have no score and give no row.
    """
    wanted = np.asarray(query, np.float64)
    norm = float(np.sqrt(wanted @ wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            whole = pc.fill_null(pc.equal(pc.list_value_length(vectors), len(wanted)), False)
            batch = batch.filter(whole)
            flat = batch.column(2).flatten()
            matrix = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, len(wanted))
            size = np.sqrt(np.einsum("ij,ij->i", matrix, matrix)) * norm
            good = size != 0
            if flat.null_count:
                good &= flat.is_valid().to_numpy(zero_copy_only=False).reshape(matrix.shape).all(1)
            score = (matrix @ wanted)[good] / size[good]
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(score)], ["chunk_id", "page_id", "score"])

    rows = chunks.select(F.col("chunk_id").cast("long"), F.col("page_id").cast("long"), "embedding")
    return rows.mapInArrow(run, "chunk_id long, page_id long, score double")


def dense_top_k(chunks: DataFrame, query: list[float], k: int, filters: tuple[SearchFilter, ...] = (), decimals: int | None = None) -> DataFrame:
    """chunk_id, page_id and score of the k chunks most similar to the query vector.

    chunks holds chunk_id, page_id and embedding and, for filters, language and published_at, so that
    filters prune before vectors are read. Exact: k partial heaps, one merge.
    """
    scored = cosines(chunks.filter(compiled(filters, chunks)), query)
    if decimals is not None:
        scored = scored.withColumn("score", F.round("score", decimals))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(k)


@dataclass(frozen=True)
class LexicalIndex:
    """postings(term, chunk_id, tf), chunk_stats(chunk_id, page_id, dl), term_stats(term, df), corpus(n, avgdl)."""

    postings: DataFrame
    chunk_stats: DataFrame
    term_stats: DataFrame
    corpus: DataFrame


def lexical_index(chunks: DataFrame) -> LexicalIndex:
    """From chunks(chunk_id, page_id, content); the statistics are those of all chunks. Texts are cut into words once for each part that is read."""
    words = chunks.select("chunk_id", "page_id", terms(F.col("content")).alias("terms"))
    postings = words.select("chunk_id", F.explode("terms").alias("term")).groupBy("term", "chunk_id").agg(F.count("*").cast("int").alias("tf"))
    return _with_statistics(postings, words.select("chunk_id", "page_id", F.size("terms").alias("dl")))


def _with_statistics(postings: DataFrame, stats: DataFrame) -> LexicalIndex:
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    return LexicalIndex(postings, stats, df, _corpus(stats))


def _corpus(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


#: bytes of text whose postings are gathered in blocks together, and rows of a batch that are looked at at once
BLOCK_BYTES, SLICE = 16 << 20, 256
#: bytes of blocks for each file of postings, about
FILE_BYTES = 32 << 20
BLOCKS = "term string, chunk_ids array<long>, page_ids array<long>, counts array<int>, repeated boolean"


def _block_rows(chunk_ids: pa.Array, page_ids: pa.Array, texts: pa.Array, repeated: bool) -> pa.RecordBatch:
    """One row for each term of the texts, whose words have a blank between them, and a row of their lengths."""
    lists = pc.split_pattern(texts, " ")
    owner, words = pc.list_parent_indices(lists), lists.flatten()
    real = pc.not_equal(words, "")
    owner, coded = owner.filter(real).to_numpy(zero_copy_only=False), words.filter(real).dictionary_encode()
    rows = len(texts)
    pairs, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * rows + owner, return_counts=True)
    codes, at = np.unique(pairs // max(rows, 1), return_index=True)
    lengths = pa.array(np.bincount(owner, minlength=rows), pa.int32(), mask=texts.is_null().to_numpy(zero_copy_only=False))
    ends = pa.array(np.concatenate([at, [len(pairs), len(pairs) + rows]]), pa.int32())
    ids = pa.concat_arrays([chunk_ids.take(pa.array(pairs % max(rows, 1))), chunk_ids])
    counts = pa.concat_arrays([pa.array(tf, pa.int32()), lengths])
    columns = [
        pa.concat_arrays([coded.dictionary.take(pa.array(codes)), pa.nulls(1, pa.string())]), pa.ListArray.from_arrays(ends, ids),
        pa.ListArray.from_arrays(pa.array([0] * (len(codes) + 1) + [rows], pa.int32()), page_ids), pa.ListArray.from_arrays(ends, counts), pa.array([repeated] * (len(codes) + 1)),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in BLOCKS.split(", ")])


def _blocks(chunks: DataFrame) -> DataFrame:
    """chunks(chunk_id, page_id, content, repeated) as blocks, one for each term of some thousand chunks: their ids and frequencies.

    Texts are cut into words once and counted within their rows. A block without a term has the lengths of chunks, null where
    the content is.
    """

    def flushed(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        for repeated in (False, True):
            found = table.filter(pc.equal(table.column(3), repeated)).combine_chunks()
            if found.num_rows:
                yield _block_rows(*(c.chunk(0) for c in found.columns[:3]), repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                parts.append(part)
                size += pc.sum(pc.binary_length(part.column(2))).as_py() or 0
                if size >= BLOCK_BYTES:
                    yield from flushed(parts)
                    parts, size = [], 0
        if parts:
            yield from flushed(parts)

    words = F.trim(F.regexp_replace(F.lower("content"), NO_TERM, " "))
    return chunks.select(F.col("chunk_id").cast("long"), F.col("page_id").cast("long"), words.alias("words"), "repeated").mapInArrow(run, BLOCKS)


def _postings(blocks: DataFrame) -> DataFrame:
    """Rows term, chunk_id, tf of blocks(term, chunk_ids, counts)."""
    each = blocks.select("term", F.explode(F.arrays_zip("chunk_ids", "counts")).alias("one"))
    return each.select("term", F.col("one.chunk_ids").alias("chunk_id"), F.col("one.counts").alias("tf"))


def write_index(chunks: DataFrame, path: str, partitions: int = 64) -> None:
    """Write the index of chunks(chunk_id, page_id, content), cutting the texts into words once.

    Postings are blocks, clustered and sorted by term, so a query reads the row groups of its terms only; they have as many partitions as
    their bytes need, at least those given. An id of several rows has one posting for each term and the length of each row.
    """
    spark = chunks.sparkSession
    twice = chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select("chunk_id", F.lit(True).alias("repeated"))
    known = not twice.isEmpty()
    marked = chunks.join(twice, "chunk_id", "left").withColumn("repeated", F.coalesce("repeated", F.lit(False))) if known else chunks.withColumn("repeated", F.lit(False))
    _blocks(marked).write.mode("overwrite").parquet(f"{path}/blocks")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    of_terms = blocks.filter("term IS NOT NULL").select("term", "chunk_ids", "counts", "repeated")
    postings = of_terms.filter("NOT repeated").drop("repeated")
    if known:
        summed = _postings(of_terms.filter("repeated")).groupBy("term", "chunk_id").agg(F.sum("tf").cast("int").alias("tf"))
        postings = postings.unionByName(summed.select("term", F.array("chunk_id").alias("chunk_ids"), F.array("tf").alias("counts")))
    size = int(str(blocks._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    partitions = max(partitions, -(-size // FILE_BYTES))
    postings.repartitionByRange(partitions, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    lengths = blocks.filter("term IS NULL").select(F.explode(F.arrays_zip("chunk_ids", "page_ids", "counts")).alias("one"))
    stats = lengths.select(F.col("one.chunk_ids").alias("chunk_id"), F.col("one.page_ids").alias("page_id"), F.col("one.counts").alias("dl"))
    stats.write.mode("overwrite").parquet(f"{path}/chunk_stats")
    df = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.sum(F.size("chunk_ids")).alias("df"))
    df.repartitionByRange(max(1, partitions // 8), "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/term_stats")
    _corpus(spark.read.parquet(f"{path}/chunk_stats")).coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/blocks")
    made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(made, True)


def read_index(spark, path: str) -> LexicalIndex:
    postings, *statistics = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "chunk_stats", "term_stats", "corpus"))
    return LexicalIndex(_postings(postings), *statistics)


def bm25_top_k(index: LexicalIndex, query_terms: list[str], k: int, pages: DataFrame | None = None, filters: tuple[SearchFilter, ...] = (), decimals: int | None = None) -> DataFrame:
    """chunk_id, page_id and score of the k best chunks that share a term with the query.

    pages (page_id, language, published_at) is needed for filters only; they don't touch the statistics.
    """
    wanted = sorted(set(query_terms))
    hits = index.postings.filter(F.col("term").isin(*wanted)) if wanted else index.postings.filter(F.lit(False))
    df = index.term_stats.filter(F.col("term").isin(*wanted)) if wanted else index.term_stats.filter(F.lit(False))
    stats = index.chunk_stats
    if filters and pages is not None:
        stats = stats.join(pages.filter(compiled(filters, pages)).select("page_id"), "page_id", "left_semi")
    # df has a row for each query term, corpus has one row
    rows = hits.join(F.broadcast(df), "term").join(stats, "chunk_id").crossJoin(F.broadcast(index.corpus))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    summed = F.sum(idf * part)
    scored = rows.groupBy("chunk_id", "page_id").agg((F.round(summed, decimals) if decimals is not None else summed).alias("score"))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(k)
