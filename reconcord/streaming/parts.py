"""Tables in parts by the hash of a key: what changes few keys reads and writes few parts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def files(spark: SparkSession, path: str):
    """The file system of a path and the path, for listings and removals of whole folders."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = files(spark, path)
    return fs.exists(hadoop)


def touched(df: DataFrame, key: str, parts: int) -> list[int]:
    """The parts that hold the keys of ``df``: at most ``parts`` numbers."""
    return sorted(r[0] for r in df.select(part_of(F.col(key), parts)).distinct().collect())


@dataclass(frozen=True)
class KeyedTable:
    """A Parquet table in folders ``part=n`` by the hash of a string key, each file sorted by it.

    A point lookup reads one folder, and of it the row groups that the key's
    statistics leave.  ``append`` adds the rows whose key is not there yet and
    reads keys of the parts that the new rows fall into only.  An append that
    was cut short is run again: rows that are in the table already stay single.
    One writer at a time.  A null key is an error, as no lookup could find it.
    """

    spark: SparkSession
    path: str
    key: str
    schema: str
    parts: int = 64

    def append(self, new: DataFrame, order: str | None = None) -> None:
        """Appends the rows of keys that are new; of several with one key the first by ``order``, then by the other columns."""
        names = new.columns
        known = F.coalesce(self.key, F.raise_error(F.lit(f"null in {self.key}")).cast("string"))
        lead = order or self.key
        by = F.struct(lead, *[c for c in names if c != lead])
        first = new.groupBy(known.alias("_key")).agg(F.min(by).alias("_row")).select("_row.*").select(names)
        if exists(self.spark, self.path):
            kept = self.read(touched(first, self.key, self.parts)).select(self.key)
            first = first.join(kept, self.key, "left_anti")
        laid = first.select(*names, part_of(F.col(self.key), self.parts).alias("part")).hint("rebalance", "part").sortWithinPartitions("part", self.key)
        laid.write.mode("append").partitionBy("part").parquet(self.path)

    def _table(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, part int").parquet(self.path)

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """All rows, or those of some parts, whose folders alone are read."""
        return (self._table() if parts is None else self._table().where(F.col("part").isin(parts))).drop("part")

    def lookup(self, value: str) -> DataFrame:
        """The row of one key; the part folds to a constant, so that one folder is read."""
        one = F.lit(value)
        return self._table().where((F.col("part") == part_of(one, self.parts)) & (F.col(self.key) == one)).drop("part")


@dataclass(frozen=True)
class Snapshots:
    """A table that streams keep up to date: batch ``e`` writes ``version=e`` with the parts that it touches, whole.

    A part's present rows are those of its newest version that was finished
    (``_SUCCESS``).  Batch ``e`` builds on versions before ``e`` alone, so one
    that failed half way, or is replayed, writes the same rows again.  Two
    versions of each part are kept, which is what a replay of the last batch
    needs.  A part that once has rows must not become empty.
    """

    spark: SparkSession
    path: str
    schema: str
    parts: int = 64

    def _versions(self) -> dict[int, list[int]]:
        """Part to its finished versions, oldest first."""
        fs, root = files(self.spark, self.path)
        out: dict[int, list[int]] = {}
        if not fs.exists(root):
            return out
        for version in fs.listStatus(root):
            folder = version.getPath()
            if fs.exists(files(self.spark, f"{folder}/_SUCCESS")[1]):
                for part in fs.listStatus(folder):
                    name = part.getPath().getName()
                    if name.startswith("part="):
                        out.setdefault(int(name[5:]), []).append(int(folder.getName()[8:]))
        return {part: sorted(found) for part, found in out.items()}

    def read(self, parts: list[int] | None = None, before: int | None = None) -> DataFrame:
        """Present rows, of some parts if told, as they were before a version if told."""
        newest = {}
        for part, found in self._versions().items():
            fit = [e for e in found if before is None or e < before]
            if fit and (parts is None or part in parts):
                newest[part] = fit[-1]
        if not newest:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/version={e}/part={p}" for p, e in sorted(newest.items())])

    def write(self, rows: DataFrame, key: str, version: int) -> None:
        """Writes whole parts as one version and removes what no replay reads any more."""
        # a large part is written in several tasks, as files of its own each
        laid = rows.select("*", part_of(F.col(key), self.parts).alias("part")).hint("rebalance", "part")
        laid.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/version={version}")
        versions = self._versions()
        kept = {e for found in versions.values() for e in found[-2:]}
        for part, found in versions.items():
            for old in found[:-2]:
                whole = old not in kept
                fs, folder = files(self.spark, f"{self.path}/version={old}" + ("" if whole else f"/part={part}"))
                fs.delete(folder, True)
