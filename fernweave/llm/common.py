"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a key with at least 1/HOT_PARTS of all rows is hot; by counting, there are at most HOT_PARTS of them
HOT_PARTS = 1000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in spark.checkpoint.dir; only where that is unset and all runs on this machine
    (tests) a temporary folder is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fernweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: paths that stored() wrote, by the open scratch() they are written in
_scratch: list[list[str]] = []


def stored(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here.

    The files outlive this call since the result is lazy; they go at the end of the scratch() that this is called in,
    if not kept, or else with the application's shared folder.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if _scratch and not keep:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, top: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """What stored() writes within goes at the end, but for what it keeps."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _delete(spark, path)


def drop_stored(df: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    base = shared_dir(spark)
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if top.split(":", 1)[-1].lstrip("/").startswith(base.split(":", 1)[-1].lstrip("/")):
            _delete(spark, top)


def text_key(text: Column) -> Column:
    """Tells the texts under one id apart; a null text counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def size_of(docs: DataFrame) -> int:
    """Bytes of docs by Spark's estimate, or of its texts where there is none."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """While this holds, actions hand Arrow batches of so many rows to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that nothing refers to any more.

    Spark's cleaner goes by the driver's garbage; what a finished query holds is freed by the second collection.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def trim() -> None:
    """Give the free memory of a Python worker, which serves later stages too, back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def lookup(rows: DataFrame, by: str, facts: DataFrame, size: Column, total: int) -> DataFrame:
    """Inner-join rows with facts (one row for each value of by), whatever the skew.

    size is the column of facts that tells how many of the total rows have the key.
    Keys with over total / HOT_PARTS rows number HOT_PARTS at most, so these are
    broadcast; the rest is shuffled, and no key of it is large.
    """
    hot = facts.filter(size * HOT_PARTS > total)
    cold = facts.filter(size * HOT_PARTS <= total)
    keys = F.broadcast(hot.select(F.col(by).alias("__hot")))
    rest = rows.join(keys, F.col(by) == F.col("__hot"), "left_anti")
    return rows.join(F.broadcast(hot), by).unionByName(rest.join(cold, by))


def fresh(df: DataFrame, name: str) -> str:
    """name, or with underscores so that no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
