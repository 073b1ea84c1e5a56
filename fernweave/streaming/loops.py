"""Continuous forms: micro-batches of a file source, snapshots as state, exactly-once by batch number."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from fernweave.functions.text import RETRY_DELAYS


def crawl_stream(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


class Snapshots:
    """Versions of a table below a path. A batch writes version batch + 1 whole; a batch that is run again overwrites its own."""

    def __init__(self, spark: SparkSession, path: str, empty: DataFrame) -> None:
        self.spark, self.path, self.empty = spark, str(PurePosixPath(path)), empty

    def at(self, version: int) -> DataFrame:
        return self.empty if version == 0 else self.spark.read.schema(self.empty.schema).parquet(f"{self.path}/v={version}")

    def put(self, version: int, df: DataFrame) -> None:
        df.select(*self.empty.columns).write.mode("overwrite").parquet(f"{self.path}/v={version}")


def run_batches(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None], once: bool = True, seconds: int = 1) -> StreamingQuery:
    """step(batch, number) for each micro-batch; with once, until what is there now is done."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def append_once(snapshots: Snapshots, key: str) -> Callable[[DataFrame, int], None]:
    """Batches of rows into a table with one row for each key; the first one stays, also if a batch is repeated."""

    def step(batch: DataFrame, number: int) -> None:
        old = snapshots.at(number)
        new = batch.dropDuplicates([key]).join(old.select(key), key, "left_anti")
        snapshots.put(number + 1, old.unionByName(new.select(*old.columns)))

    return step


STATE = "attempts int, status string"
OUTPUT = "url string, attempts int, status string, delay long"
BUDGETS = {"content": 1, "permanent": 3}


def job_states(attempts: DataFrame) -> DataFrame:
    """A stream of attempts(url, kind: null if it went well) to the state of each job after each batch.

    queued, then retrying with a growing delay, then done or failed; both of these are final.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, status = state.get if state.exists else (0, "queued")
        delay = None
        for batch in batches:
            for kind in batch.sort_values("at")["kind"]:
                if status in ("done", "failed"):
                    break
                if kind is None or pd.isna(kind):
                    status, delay = "done", None
                    continue
                status = "failed" if count + 1 >= BUDGETS.get(kind, 10) else "retrying"
                delay = None if status == "failed" else RETRY_DELAYS[min(count, len(RETRY_DELAYS) - 1)]
                count += 1
        state.update((count, status))
        yield pd.DataFrame({"url": [key[0]], "attempts": [count], "status": [status], "delay": pd.array([delay], "Int64")})

    return attempts.groupBy("url").applyInPandasWithState(run, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def activity_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Extension: events(ts, event_type, value) counted in tumbling windows, late rows up to the watermark."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("ts", late)
    counted = stamped.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")
