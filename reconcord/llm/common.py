"""Helpers shared by the corpus operators: staged tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; words are maximal runs of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an id and a count or less that are sent to every task (16 MB).
BROADCAST = 1_000_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor sees; in local mode, where it may be unset, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{_local_dir()}"
    return found.rstrip("/")


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="reconcord-")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written here leaves no shuffle files; else they stay until the driver's garbage collection.  A session's own value stays."""
    own = spark.conf.get(_CLEANUP, None)
    if own is None:
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(_CLEANUP)


class Stage:
    """Tables written to the shared folder in place of a long lineage.

    ``keep`` writes a frame and returns the written table, so a lost executor
    costs the tasks it ran and no earlier step.  ``drop`` removes tables that
    no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}"
        with shuffles_removed(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            if path := self.paths.pop(id(df), None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


def components(stage: Stage, edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every id in ``edges`` (a, b): rows (id, component).

    Each round every node joins its smallest neighbour's smallest neighbour, and
    the edges are rewritten to the joined nodes; edges within one fall away, so
    the graph shrinks fast.  All steps are aggregates with a map-side part and
    equi-joins that adaptive execution may split, so a hub with a third of all
    nodes is no single task; edges and labels stay in tables.
    """
    now = stage.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    names = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stage.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("p")))
        label = stage.keep(parent.join(parent.select(F.col("id").alias("p"), F.col("p").alias("label")), "p").select("id", "label"))
        if names is None:
            merged = label.select("id", F.col("label").alias("component"))
        else:
            merged = names.join(label.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("label", "component").alias("component"))
        merged = stage.keep(merged)
        a, b = (label.select(F.col("id").alias(s), F.col("label").alias(f"to_{s}")) for s in "ab")
        left = now.join(a, "a").join(b, "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        left = stage.keep(left.distinct())
        stage.drop(now, parent, label, *([names] if names is not None else []))
        now, names = left, merged
        if not now.head(1):
            stage.drop(now)
            return names


def by_size(rows: DataFrame) -> DataFrame:
    """Narrow rows (staged) to join texts with: up to ``BROADCAST`` of them are broadcast, so that texts need no shuffle; beyond that both sides are shuffled."""
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def semi_by_size(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (distinct, staged)."""
    return df.join(by_size(ids), key, "left_semi")
