"""Exact deduplication by a tree-merge of sorted digest runs.

Each input partition becomes a run: its records (digest, smallest or largest id, count), sorted by digest, one for each
digest. Runs then meet in rounds along a binomial tree. In every round each run cuts its piece into FAN pieces by the next bits of the
digest and FAN runs exchange them, so that a task gets one digest range of all runs of its group; it merges these sorted
pieces into one. A group of FAN times as many runs has FAN times as many ranges, so pieces keep the size that they had in the first round,
and a run sends FAN pieces in a round, however many runs there are. After the last round each digest is one record.

Records are verified at every level: they are merged only if SHA-256, XXH64 and the byte length are all equal. A
digest of a third of all rows is one record of each run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.llm.common import LOWER, UPPER, batches_of, lookup, stored, table

#: runs that meet in a round, as bits of the digest that tell their ranges apart
FAN_BITS = 4
#: rows that are sorted at a time
RUN_ROWS = 1 << 18
#: a record of a run: the digest in four numbers, by which runs are sorted, what it is verified by, the id that stays if there is one, and the rows that have it
RECORD = np.dtype([("sha", "<u8", (4,)), ("check", "<u8"), ("n_bytes", "<i8"), ("id", "<i8"), ("has_id", "u1"), ("count", "<i8")])
PIECE = "run int, range long, records binary"

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sha, check, size = [], [], []
        for value in batch.column(1):
            data = (value.as_py() or b"").translate(_FOLD)
            sha.append(hashlib.sha256(data).digest())
            check.append(xxhash.xxh64_intdigest(data) - 2**63)
            size.append(len(data))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sha, pa.binary()), pa.array(check, pa.int64()), pa.array(size, pa.int64())],
            ["doc_id", "sha", "check", "n_bytes"],
        )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, sha, check, n_bytes of each text after lower-casing A-Z; null counts as empty."""
    raw = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("data"))
    return raw.mapInArrow(_digest, "doc_id long, sha binary, check long, n_bytes long")


def merge(runs: list[np.ndarray], keep: str) -> np.ndarray:
    """One run of sorted runs, with one record for each verified digest."""
    rows = np.concatenate(runs)
    if not len(rows):
        return rows
    # a stable sort of runs laid end to end finds the runs and merges them
    rows = rows[np.argsort(rows["sha"][:, 0], kind="stable")]
    words = [rows["sha"][:, k] for k in range(4)] + [rows["check"], rows["n_bytes"].astype(np.uint64)]
    same = words[0][1:] == words[0][:-1]
    whole = same.copy()
    for word in words[1:]:
        whole &= word[1:] == word[:-1]
    if (same & ~whole).any():
        # digests that begin alike may stand in any order yet
        order = np.lexsort(words[::-1])
        rows, words = rows[order], [word[order] for word in words]
        whole = np.logical_and.reduce([word[1:] == word[:-1] for word in words])
    at = np.flatnonzero(np.concatenate([[True], ~whole]))
    made = rows[at].copy()
    made["count"] = np.add.reduceat(rows["count"], at)
    made["has_id"] = np.maximum.reduceat(rows["has_id"], at)
    missing, best = (2**63 - 1, np.minimum) if keep == "min" else (-(2**63), np.maximum)
    made["id"] = best.reduceat(np.where(rows["has_id"] == 1, rows["id"], missing), at)
    return made


def _pieces(run: int, range_: int, records: np.ndarray, level: int, rounds: int, fan_bits: int) -> pa.RecordBatch:
    """A run's range cut by the digest bits of the next level, for the group of runs that meets there; in the last one all meet."""
    fan = 1 << fan_bits
    bits = records["sha"][:, 0] >> np.uint64(64 - fan_bits * (level + 1)) & np.uint64(fan - 1)
    cuts = np.searchsorted(bits, np.arange(fan + 1))
    found = [(range_ * fan + k, records[cuts[k] : cuts[k + 1]].tobytes()) for k in range(fan) if cuts[k] < cuts[k + 1]]
    columns = ([0 if level + 1 == rounds else run // fan] * len(found), [r for r, _ in found], [p for _, p in found])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["run", "range", "records"])


def _first_runs(batches: Iterator[pa.RecordBatch], keep: str, rounds: int, fan_bits: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs of rows (run, doc_id, sha, check, n_bytes), of RUN_ROWS rows each."""
    held: list[np.ndarray] = []
    run = 0

    def flush() -> pa.RecordBatch:
        rows = np.concatenate(held)
        rows = rows[np.lexsort([rows["sha"][:, k] for k in (3, 2, 1, 0)])]
        return _pieces(run, 0, merge([rows], keep), 0, rounds, fan_bits)

    for batch in batches:
        if not batch.num_rows:
            continue
        run = batch.column(0)[0].as_py()
        rows = np.zeros(batch.num_rows, RECORD)
        ids = batch.column(1)
        rows["sha"] = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u8").reshape(-1, 4)
        rows["check"] = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
        rows["n_bytes"] = batch.column(4).to_numpy(zero_copy_only=False)
        rows["id"], rows["has_id"] = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
        rows["count"] = 1
        held.append(rows)
        if sum(map(len, held)) >= RUN_ROWS:
            yield flush()
            held.clear()
    if held:
        yield flush()


def _met(batches: Iterator[pa.RecordBatch], keep: str, level: int, rounds: int, fan_bits: int) -> Iterator[pa.RecordBatch]:
    """Merge the pieces of each (run group, range), which come together, and cut the result for the next level."""
    now, held = None, []

    def flush() -> pa.RecordBatch:
        merged = merge(held, keep)
        if level < rounds:
            return _pieces(*now, merged, level, rounds, fan_bits)
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([merged.tobytes()], pa.binary())], ["run", "range", "records"])

    for batch in batches:
        for run, range_, records in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if (run, range_) != now and held:
                yield flush()
                held = []
            now = (run, range_)
            held.append(np.frombuffer(records, RECORD))
    if held:
        yield flush()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["sha", "check", "n_bytes", "keep_id", "group_size"]
    for batch in batches:
        for value in batch.column(2):
            rows = np.frombuffer(value.as_py(), RECORD)
            sha = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(rows), [None, pa.py_buffer(rows["sha"].astype(">u8").tobytes())]).cast(pa.binary())
            ids = pa.array(np.ascontiguousarray(rows["id"]), pa.int64(), mask=rows["has_id"] == 0)
            rest = [pa.array(np.ascontiguousarray(rows[k]).view(np.int64)) for k in ("check", "n_bytes")]
            yield pa.RecordBatch.from_arrays([sha, *rest, ids, pa.array(np.ascontiguousarray(rows["count"]))], names)


def merge_runs(rows: DataFrame, keep: str = "min", fan_bits: int = FAN_BITS) -> DataFrame:
    """Merge rows (doc_id, sha, check, n_bytes) to one row for each verified digest. The partitions are the runs.

    Returns sha, check, n_bytes, keep_id and group_size. Null ids lose against any other and a group of null ids only keeps null.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    # the number of rounds is a matter of balance only: in the last one all runs meet
    runs = int(rows.select(F.spark_partition_id().alias("run")).agg(F.max("run")).first()[0] or 0) + 1
    rounds = 1
    while 1 << fan_bits * rounds < runs:
        rounds += 1
    level = rows.select(F.spark_partition_id().alias("run"), "doc_id", "sha", "check", "n_bytes").mapInArrow(partial(_first_runs, keep=keep, rounds=rounds, fan_bits=fan_bits), PIECE)
    for number in range(1, rounds + 1):
        met = level.repartition(F.col("run"), F.col("range")).sortWithinPartitions("run", "range")
        level = met.mapInArrow(partial(_met, keep=keep, level=number, rounds=rounds, fan_bits=fan_bits), PIECE)
    return level.mapInArrow(_records, "sha binary, check long, n_bytes long, keep_id long, group_size long")


def exact_groups(docs: DataFrame, keep: str = "min", fan_bits: int = FAN_BITS) -> DataFrame:
    """One row for each row of docs (doc_id, text; other columns are ignored).

    Returns doc_id, keep_id, group_size, kept, text_sha256. Texts are equal if identical
    after lower-casing A-Z; a null text counts as empty. Of equal texts the row with the
    smallest doc_id stays (keep="max": the largest). Rows that repeat a doc_id and its
    text are each returned and count in group_size, all with the same kept; a null doc_id
    is kept only if its group has no other. Very long texts are digested whole, and a tie of ids is no tie: the id stays. An
    empty table gives no rows.
    """
    rows = stored(digests(docs), "digests")
    # a row is a piece of up to a partition's records
    with batches_of(docs.sparkSession, 64):
        groups = stored(merge_runs(rows, keep, fan_bits).drop("check", "n_bytes"), "groups")
    joined = lookup(rows.select("doc_id", "sha"), "sha", groups, F.col("group_size"), rows.count())
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


OP9_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
