"""The webhook inbox as a stream: dedupe, rate windows, retries, idempotent batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .parts import exists


def delivery_id(source: F.Column, body: F.Column) -> F.Column:
    return F.sha2(F.concat_ws(chr(31), source, body), 256)


def inbox_dedupe(deliveries: DataFrame, at: str = "received_at", keep: str = "7 days") -> DataFrame:
    """One row per delivery.  State lasts ``keep`` after the watermark; a repeat that comes later is caught by the append's key join."""
    return deliveries.withWatermark(at, keep).dropDuplicatesWithinWatermark(["delivery_id"])


def rate_windows(calls: DataFrame, at: str = "received_at", width: str = "1 minute", limit: int = 60) -> DataFrame:
    """Calls per caller and minute, and whether the limit was passed."""
    n = calls.withWatermark(at, "5 minutes").groupBy(F.window(at, width), "caller").agg(F.count("*").alias("n"))
    return n.select(F.col("window.start").alias("start"), "caller", "n", (F.col("n") > limit).alias("over"))


def retry_attempts(results: DataFrame, max_attempts: int = 8) -> DataFrame:
    """State of each delivery over its attempts (delivery_id, ok): pending, processed, or failed after ``max_attempts``.

    State per delivery is two small fields; a final state is kept so that late
    repeats change nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, final = state.get if state.exists else (0, "")
        for frame in frames:
            for ok in frame["ok"]:
                if not final:
                    attempts += 1
                    final = "processed" if ok else "failed" if attempts >= max_attempts else ""
        state.update((attempts, final))
        yield pd.DataFrame({"delivery_id": [key[0]], "attempts": [attempts], "state": [final or "pending"]})

    return results.groupBy("delivery_id").applyInPandasWithState(step, "delivery_id string, attempts int, state string", "attempts int, final string", "update", GroupStateTimeout.NoTimeout)


def promise_states(events: DataFrame, at: str = "received_at", delay: str = "1 day") -> DataFrame:
    """Changes of state of each promise (transaction_id, state): PENDING, MISSING_SETTLEMENT, SETTLED.

    ``events`` has transaction_id, ``at``, escalates_at (null for a settlement)
    and settled.  ``at`` is the instant of intake, not of the business event:
    Spark drops rows whose ``at`` is behind the watermark, and evidence that
    comes late must count.  A promise is missing once the watermark passes its
    deadline; a settlement counts before its promise and after the deadline
    too, so the order of arrival does not change the last state.  State is a
    number and a word for each promise and stays, so repeats change nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        deadline, before = state.get if state.exists else (0, "")
        now = before
        for frame in frames:
            if frame["settled"].fillna(False).any():
                now = "SETTLED"
            due = frame["deadline"].dropna()
            if not now and len(due):
                deadline, now = int(due.min()), "PENDING"
        if now == "PENDING" and (state.hasTimedOut or deadline <= state.getCurrentWatermarkMs()):
            now = "MISSING_SETTLEMENT"
        state.update((deadline, now))
        if now == "PENDING":
            state.setTimeoutTimestamp(deadline)
        if now != before:
            yield pd.DataFrame({"transaction_id": [key[0]], "state": [now]})

    timed = events.withWatermark(at, delay).withColumn("deadline", F.unix_millis("escalates_at"))
    return timed.groupBy("transaction_id").applyInPandasWithState(step, "transaction_id string, state string", "deadline long, state string", "append", GroupStateTimeout.EventTimeTimeout)


def idempotent_append(path: str, key: str) -> Callable[[DataFrame, int], Any]:
    """A foreachBatch function that appends rows whose key is not in the table at ``path`` yet.

    Each micro-batch is one commit; a batch that is replayed adds nothing.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(path)

    return write


def append_once(stream: DataFrame, path: str, key: str, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Starts a query that appends each key's first row to ``path``; nothing of the table is ever read.

    The keys seen are the state of ``dropDuplicates``, hashed over the state
    partitions (RocksDB where the session sets it), so the work of a batch
    follows the batch and not the table's age.  A batch is the folder
    ``batch=n``, written anew when it is replayed: a crash between the rows and
    the commit of the batch leaves no row twice.  Null is a key like others: its
    first row stays.  A new checkpoint over a table
    that has rows is refused, as its keys would be unknown.
    """
    spark = stream.sparkSession
    if exists(spark, path) and not exists(spark, f"{checkpoint}/offsets"):
        raise ValueError(f"{path} has rows, but {checkpoint} does not know their keys")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    own = stream.dropDuplicates([key])
    return own.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()
