"""Corpus preparation from operators of fernweave.llm.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept; run()
writes each stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fernweave.llm import binary, decontam, mixing, quality, simhash, tokens
from fernweave.llm.common import drop_stored, scratch, stored, table


def _small_batches(spark: SparkSession) -> None:
    """Rows that go to Python at a time: the default of 10,000 whole documents takes executors much memory.

    The setting stays, since a stage's result is lazy and the caller's write of it needs it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier accepts."""
    _small_batches(spark)
    return quality.accepted(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group of near copies (five-word shingles, similarity 0.8)."""
    _small_batches(spark)
    return simhash.one_of_each(docs, width=5, least=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, verbatim or with other numbers, names and units."""
    _small_batches(spark)
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by source takes them."""
    _small_batches(spark)
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written and read back: doc_id, start, n_tokens, ids_crc32 of each row."""
    _small_batches(spark)
    return binary.written_and_read(docs, tokens.vocabulary_path(tokens.TOKENIZER))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("token-ID output", token_stage),
]

#: the classifier, the verified fingerprints and the range coder have no SQL; tests hold run() against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. What a stage wrote for itself goes when its result is written, and that when the next one is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            docs = stored(made, "stage-" + "".join(c if c.isalnum() else "-" for c in name), keep=True)
        if before is not None:
            drop_stored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
