"""Token ids in a compressed binary format.

Documents are tokenized, closed with an end id, and written in ascending doc_id order. A dataset is
a Parquet folder of frames; part and frame number give the order, doc_ids and sizes tell the
documents apart, and the payload is a frame of rangecoder.py. Each range of ids is one task, which
writes its frames one after another, so memory is bounded by a frame.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernweave.llm import rangecoder
from fernweave.llm.common import batches_of, shared_dir, size_of, table, trim
from fernweave.llm.tokens import CACHE_PIECES, TOKENIZER, pieces, vocabulary_path

END_ID = 1
#: ids of a frame at most (but for a longer document), and bytes of input that a task gets about
FRAME_IDS, TASK_BYTES = rangecoder.BLOCK, 16 << 20
#: pieces that each half of a worker's memo holds where no other step shares the worker
MEMO_PIECES = 500_000
#: decoded documents handed on at a time
ROWS = 4096

SCHEMA = "part int, frame int, n_ids long, doc_ids array<long>, sizes array<long>, payload binary"


def _frames(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, memo_pieces: int) -> Iterator[pa.RecordBatch]:
    memo, number, count = pieces(tokenizer, memo_pieces), 0, 0
    end = np.array([end_id], "<u4").tobytes()
    doc_ids: list[int | None] = []
    sizes: list[int] = []
    held: list[np.ndarray] = []

    def frame(part: int) -> pa.RecordBatch:
        ids = np.concatenate(held)
        held.clear()
        payload = rangecoder.encode(ids)
        del ids
        trim()
        values = ([part], [number], [count], [doc_ids], [sizes], [payload])
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["part", "frame", "n_ids", "doc_ids", "sizes", "payload"])

    part = 0
    trim()
    for batch in batches:
        part = batch.column(0)[0].as_py() if batch.num_rows else part
        for doc_id, value in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            ids = np.frombuffer(memo.ids(value.as_py() or b"") + end, "<u4")
            if int(ids.max()) > rangecoder.MAX_ID:
                raise ValueError("the format holds ids of 18 bits")
            doc_ids.append(doc_id)
            sizes.append(len(ids))
            held.append(ids)
            count += len(ids)
            if count >= FRAME_IDS:
                yield frame(part)
                number, count, doc_ids, sizes, held = number + 1, 0, [], [], []
    if held:
        yield frame(part)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, memo_pieces: int = CACHE_PIECES) -> None:
    """Write the ids of docs (doc_id, text; other columns are ignored) to path.

    A null text counts as empty and is written as its end id alone. Null ids come first; rows
    that share an id are written one after another in order of their texts, so reruns agree. A very long text makes its
    frame longer, in blocks as long as others. An empty table gives an empty dataset. No special tokens are added; special
    strings in texts are theirs. A worker remembers the ids of up to twice memo_pieces pieces of text, which bounds its memory.
    """
    raw = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("data"))
    size = size_of(docs)
    parts = min(1 << 16, max(1, -(-size // TASK_BYTES)))
    ordered = raw.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("data").asc_nulls_first())
    ordered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "data")
    with batches_of(docs.sparkSession, 1000):
        ordered.mapInArrow(lambda it: _frames(it, tokenizer, end_id, memo_pieces), SCHEMA).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = ["part", "frame", "doc_id", "local", "n_tokens", "ids_crc32"]
    for batch in batches:
        for k in range(batch.num_rows):
            part, frame = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            ids = rangecoder.decode(batch.column(4)[k].as_py())
            doc_ids, sizes = batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
            starts = np.cumsum([0, *sizes])
            if starts[-1] != len(ids):
                raise ValueError(f"part {part}, frame {frame}: documents don't add up")
            for at in range(0, len(doc_ids), ROWS):
                here = range(at, min(at + ROWS, len(doc_ids)))
                crc = [zlib.crc32(ids[starts[d] : starts[d + 1]].astype("<u4").tobytes()) for d in here]
                values = ([part] * len(here), [frame] * len(here), doc_ids[at : at + ROWS], starts[at : here[-1] + 1], sizes[at : at + ROWS], crc)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names)
            trim()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Decode a dataset: doc_id, start (ids before the document), n_tokens and ids_crc32 (of 32-bit ids)."""
    frames = spark.read.schema(SCHEMA).parquet(path)
    # one row for each frame of up to BLOCK ids or one document
    before = Window.orderBy("part", "frame").rowsBetween(Window.unboundedPreceding, -1)
    offsets = frames.select("part", "frame", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("offset"))
    schema = "part int, frame int, doc_id long, local long, n_tokens long, ids_crc32 long"
    rows = frames.select("part", "frame", "doc_ids", "sizes", "payload").mapInArrow(_documents, schema)
    return rows.join(offsets, ["part", "frame"]).select("doc_id", (F.col("local") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids = rangecoder.decode(batch.column(2)[k].as_py())
            at = 0
            for doc_id, size in zip(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids[at : at + size].astype(np.int32)], pa.list_(pa.int32()))], ["doc_id", "ids"])
                at += size


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and the ids of each document of a dataset."""
    return spark.read.schema(SCHEMA).parquet(path).select("doc_ids", "sizes", "payload").mapInArrow(_ids, "doc_id long, ids array<int>")


def written_and_read(docs: DataFrame, tokenizer: str, end_id: int = END_ID, memo_pieces: int = CACHE_PIECES) -> DataFrame:
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer, end_id, memo_pieces)
    return read_documents(spark, path)


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_and_read(table(spark, sf_dir, "documents"), vocabulary_path(TOKENIZER), memo_pieces=MEMO_PIECES)
