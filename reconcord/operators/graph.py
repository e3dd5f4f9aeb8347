"""Connected components by minimum labels and label jumps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _kept(df: DataFrame, root: str) -> DataFrame:
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only in local mode may it be unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="reconcord-")
    return found.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: what reads it several times computes it once, and its lineage ends here."""
    return _kept(df, shared(df.sparkSession) + "/staged")


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) from edges (a, b): the smallest id reachable.  Rounds are tables in spark.checkpoint.dir (a temporary folder where it is unset)."""
    spark = edges.sparkSession
    root = shared(spark) + "/components"
    both = _kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), root)
    labels = _kept(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), root)
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        spread = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        root_of = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = _kept(spread.join(root_of, "component", "left").select("id", F.least("component", "up").alias("component"), (F.least("component", "up") != F.col("was")).alias("moved")), root)
        labels = new.select("id", "component")
        if not new.where("moved").head(1):
            return labels
