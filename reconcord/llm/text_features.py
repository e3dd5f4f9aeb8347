"""Hashed features of whole texts, shared by the trained scorers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the documents that is held out, by crc32 of the id as text.
FOLDS = 5


def held_out(id_col: str = "id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, most: int) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents that are not held out, those with the smallest hashes of their ids.

    The bound is for fitting alone.  Rows with a null label or id teach nothing;
    an id with several labels counts with the largest.
    """
    own = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.max(label_col).cast("double").alias("label")).where(~held_out())
        .withColumn("o", F.xxhash64("id")).orderBy("o", "id").limit(most).drop("o")
    )
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(own), "id").select("text", "label")  # bounded by ``most`` rows of 16 bytes


def gradient(batches: Iterator[pa.RecordBatch], step) -> Iterator[pa.RecordBatch]:
    """One row with the sums of ``step(batch)`` (an array of doubles) over a task's batches."""
    total = None
    for batch in batches:
        if batch.num_rows:
            g = step(batch)
            total = g if total is None else total + g
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], names=["i", "v"])


def summed(df: DataFrame, step, n: int) -> np.ndarray:
    """The sums of ``step`` over all batches of ``df``: ``n`` numbers, added up by position."""
    rows = df.mapInArrow(lambda it: gradient(it, step), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(n)
    out[rows["i"].to_numpy(np.int64)] = rows["v"].to_numpy()
    return out


def added(df: DataFrame, step, n: int) -> np.ndarray:
    """As ``summed``, for a frame of a few bounded partitions: each sends its ``n`` numbers as one row, without a shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for batch in batches:
            if batch.num_rows:
                total += step(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    return np.sum([np.zeros(n), *(np.frombuffer(r["v"]) for r in df.mapInArrow(rows, "v binary").collect())], 0)
