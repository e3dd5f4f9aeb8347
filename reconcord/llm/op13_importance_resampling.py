"""Importance resampling towards a target distribution, by hashed word runs.

Every text becomes its word runs (of one word by default), each in the bucket
that is the crc32 of its bytes modulo ``buckets``.  Two passes over Arrow
batches:

1. Each task counts its runs by bucket (``np.bincount``), one vector a
   partition; ``treeReduce`` merges the vectors of the corpus and of the target.
   A bucket's gain is ``floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))``.
2. The gains, ``buckets`` numbers whatever the input, go to every task, which
   gathers them for its runs and sums them by document (``np.bincount`` with
   weights; exact, as all sums stay far below 2 ** 53).

A document's score is its weight plus a Gumbel number that its id and ``seed``
fix, so the highest scores are a weighted draw without replacement, the same
in every rerun.  Ranks come from a range partitioning by score: each task
numbers its rows, and the counts of the partitions before are added.

Inputs: ``id_col`` integer, ``text_col`` string, any further columns.  A null or
empty text has no runs and weight 0.  A null id is hashed as an empty string
and comes last among equal scores.  Rows that repeat an id are documents of
their own; if their scores tie as well, their order among themselves is free.
An empty target gives gains that only even out the corpus; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage
from .shingles import buffers, slices
from .words import words

BUCKETS = 10_000
RUN = 1
SEED = 2024
#: Documents with fewer words are scored but not drawn.
LEAST_WORDS = 20
#: Per cent of the documents with enough words that are drawn.
PERCENT = 10


def run_buckets(raw: np.ndarray, run: int, buckets: int) -> tuple[np.ndarray, int]:
    """Buckets of all runs of up to ``run`` words of a text, and the number of its words."""
    found, tail, n = [np.zeros(0, np.int64)], [], 0
    for piece in words(raw):
        n += len(piece)
        found.append(np.fromiter(map(zlib.crc32, piece), np.int64, len(piece)))
        for k in range(2, run + 1):
            line = tail[max(0, len(tail) - k + 1) :] + piece  # with the runs that began in the piece before
            found.append(np.fromiter((zlib.crc32(b" ".join(line[i : i + k])) for i in range(len(line) - k + 1)), np.int64))
        tail = (tail + piece)[1 - run :] if run > 1 else []
    return np.concatenate(found) % buckets, n


def _batches(batches: Iterator[pa.RecordBatch], column: int, run: int, buckets: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bucket and owner of each run and the words of each text."""
    for batch in batches:
        data, offsets = buffers(batch.column(column))
        for i, j in slices(offsets):
            own = [run_buckets(data[a:b], run, buckets) for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1])]
            size = [len(b) for b, _ in own]
            yield batch.slice(i, j - i), np.concatenate([b for b, _ in own]), np.repeat(np.arange(j - i), size), np.array([n for _, n in own], np.int64)


def bucket_counts(texts: DataFrame, text_col: str, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of all texts fall in each bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, bucket, _, _ in _batches(batches, 0, run, buckets):
            total += np.bincount(bucket, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    vectors = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(rows, "v binary").rdd.map(lambda r: np.frombuffer(r["v"], np.int64))
    return np.zeros(buckets, np.int64) if vectors.getNumPartitions() == 0 else np.asarray(vectors.treeReduce(np.add))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of the smoothed shares of each bucket, rounded down."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (s + n) / ((int(a) + 1) * (t + n)))) for a, b in zip(source, target)], np.int64)


def gumbel(id_: int | None, seed: int = SEED) -> int:
    """1000 times the Gumbel number of an id, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, seed: int = SEED) -> DataFrame:
    """Rows (id, n_words, n_features, weight, score), one for each row of ``docs``."""
    buckets = len(gain)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = gain.astype(np.float64)
        for part, bucket, owner, n_words in _batches(batches, 1, run, buckets):
            n = part.num_rows
            weight = np.bincount(owner, value[bucket], minlength=n).astype(np.int64)
            noise = np.array([gumbel(i, seed) for i in part.column(0).to_pylist()], np.int64)
            columns = [part.column(0), n_words, np.bincount(owner, minlength=n), weight, weight + noise]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) if isinstance(x, np.ndarray) else x for x in columns], names=["id", "n_words", "n_features", "weight", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(rows, "id long, n_words long, n_features long, weight long, score long")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the place in it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        place = np.arange(at, at + batch.num_rows)
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(place), part), pa.int32()), pa.array(place, pa.int64())], names=[*batch.schema.names, "part", "place"])


def ranked(stage: Stage, scored: DataFrame, drawn: int) -> DataFrame:
    """``scored`` with its rank by falling score and rising id (null last), from 1, null beyond ``drawn``."""
    fields = ", ".join(f"{c} {t}" for c, t in scored.dtypes)
    # the row's own number spreads rows that repeat one id and score over partitions too
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    in_order = scored.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    in_order = stage.keep(in_order.mapInArrow(_numbered, f"{fields}, row long, part int, place long"))
    sizes = sorted((r["part"], r["n"]) for r in in_order.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each partition
    before = dict(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0)))
    table = stage.spark.createDataFrame(list(before.items()), "part int, before long")
    rank = F.col("before") + F.col("place") + 1
    return in_order.join(F.broadcast(table), "part").select(*scored.columns, F.when(rank <= drawn, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", run: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Rows (id, n_words, n_features, weight, score, rank), one for each row of ``docs``; those with a rank are the draw."""
    stage = Stage(docs.sparkSession, "importance-resampling")
    gain = gains(bucket_counts(docs, text_col, run, buckets), bucket_counts(target, target_text_col, run, buckets))
    scored = stage.keep(weigh(docs, gain, id_col, text_col, run, seed))
    enough = F.col("n_words") >= least_words
    drawn = percent * scored.where(enough).count() // 100
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked(stage, scored.where(enough), drawn).unionByName(rest).withColumnRenamed("id", id_col)
