"""Large files of one JSON array, read in many tasks.

Spark's text source splits a file at any byte and frames records at a
separator; with ``}`` as the separator no record of usual JSON is long, also
where the whole file is one line.  What a task cannot know is where in the JSON
its split begins: inside a string or not, how deep, in the array or not, and
behind how many elements.  All of that adds up over the splits of a file:

1. Each split counts its quotes, and what it adds to the depth if it begins
   outside of a string and if it begins inside one.  Running sums over the
   splits of a file tell where each really begins.
2. Knowing that, each split counts the commas between elements if it begins
   before the array and if it begins inside it, and whether it enters or leaves
   it.  Running sums again tell how many elements come before it.
3. Each split cuts out its elements.  The pieces of an element that lies in
   several splits, at most two a split, are put together by its position.

The tables of splits have one row for each split; files are read in groups of at
most ``SPLITS`` splits, whose states go to all tasks.  No task holds more than
a batch of records and one element.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import staged

#: Splits whose states, about 100 bytes each, go to all tasks at a time.
SPLITS = 100_000
#: Elements that one hash covers in the evidence of files beyond what one row can hold.
HASHED = 1 << 14
#: Bytes up to which a file is hashed as a whole.
WHOLE = 2_000_000_000
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1
_MARK = _STEP != 0
_MARK[ord(",")] = True

BEFORE, INSIDE, BEHIND = 0, 1, 2


def marks(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets, braces and commas, whether an odd number of quotes is before each, and the number of quotes.

    A quote that an odd run of backslashes precedes is no quote; such runs stand in strings alone.
    """
    b = np.frombuffer(data, np.uint8)
    quote = np.flatnonzero(b == 34)
    escaped = quote[(quote > 0) & (b[quote - 1] == 92)] if len(quote) else quote
    if len(escaped):
        other = np.flatnonzero(b != 92)
        at = np.searchsorted(other, escaped) - 1
        run = escaped - 1 - np.where(at >= 0, other[at], -1)
        quote = np.setdiff1d(quote, escaped[run % 2 == 1], assume_unique=True)
    place = np.flatnonzero(_MARK[b])
    return place, np.searchsorted(quote, place) & 1, len(quote)


class Place:
    """Where in the JSON of a file a split has come to."""

    def __init__(self, in_string: int, depth: int, name: str | None):
        self.in_string, self.depth = in_string, depth
        self.key = f'"{name}"'.encode() if name else None
        #: Depth of what stands directly in the array.
        self.own = 2 if name else 1

    def read(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, steps and the depths behind them of all marks outside of strings; moves on behind ``data``."""
        place, odd, quotes = marks(data)
        place = place[odd == self.in_string]
        step = _STEP[np.frombuffer(data, np.uint8)[place]].astype(np.int64)
        depth = self.depth + np.cumsum(step)
        self.in_string = (self.in_string + quotes) & 1
        self.depth = int(depth[-1]) if len(depth) else self.depth
        return place, step, depth

    def opens(self, data: bytes, place: np.ndarray, step: np.ndarray, depth: np.ndarray) -> int:
        """Index of the mark that opens the array, or -1."""
        for k in np.flatnonzero((step == 1) & (depth == self.own)):
            if data[place[k]] == ord("["):
                head = data[max(0, place[k] - 4096) : place[k]].rstrip()
                if self.key is None or head.endswith(b":") and head[:-1].rstrip().endswith(self.key):
                    return int(k)
        return -1

    def cuts(self, state: int, data: bytes, place: np.ndarray, step: np.ndarray, depth: np.ndarray) -> tuple[int, int, np.ndarray, int]:
        """(state after, begin, places of the commas between elements, end) within ``data``; begin and end are -1 where the array is not entered or left."""
        begin, first = -1, 0
        if state == BEFORE:
            k = self.opens(data, place, step, depth)
            if k < 0:
                return BEFORE, -1, place[:0], -1
            begin, first, state = int(place[k]) + 1, k + 1, INSIDE
        if state == BEHIND:
            return BEHIND, -1, place[:0], -1
        out = np.flatnonzero(depth[first:] < self.own)
        last = first + int(out[0]) if len(out) else len(place)
        comma = place[first:last][(step[first:last] == 0) & (depth[first:last] == self.own)]
        return (BEHIND if len(out) else INSIDE), begin, comma, int(place[last]) if len(out) else -1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict | None, bytes]]:
    """The bytes of a batch's records of one split; the split's number and state columns beside them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        path, block = batch.column("path"), np.asarray(batch.column("block"))
        if pa.types.is_dictionary(path.type):
            path = path.cast(pa.string())
        new = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | np.asarray(pa.compute.not_equal(path[1:], path[:-1]))]))
        state = [c for c in batch.schema.names if c not in ("value", "path", "block")]
        for i, j in zip(new, [*new[1:], batch.num_rows]):
            records = batch.column("value").slice(i, j - i).cast(pa.binary()).to_pylist()
            # the file's last record may have no brace; one more behind the array changes nothing
            yield (path[int(i)].as_py(), int(block[i])), {c: batch.column(c)[int(i)].as_py() for c in state}, b"}".join(records) + b"}"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quotes of each split modulo 2 and what it adds to the depth from outside and from inside of a string."""
    out: dict[tuple, list[int]] = {}
    for key, _, data in _chunks(batches):
        own = out.setdefault(key, [0, 0, 0])
        place, odd, quotes = marks(data)
        step = _STEP[np.frombuffer(data, np.uint8)[place]].astype(np.int64)
        for h in (0, 1):
            own[1 + h] += int(step[odd == (own[0] ^ h)].sum())
        own[0] = (own[0] + quotes) & 1
    rows = [[*k, *v] for k, v in out.items()]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 5, [pa.string(), *[pa.int64()] * 4])], names=["path", "block", "quotes", "from_outside", "from_inside"])


def _counts(name: str | None):
    """Elements that begin in each split and the state behind it, if it begins before the array and if it begins inside."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple, list] = {}
        for key, state, data in _chunks(batches):
            if key not in out:
                out[key] = [Place(state["in_string"], state["depth"], name), [BEFORE, 0], [INSIDE, 0]]
            at, *both = out[key]
            found = at.read(data)
            for x in both:
                x[0], _, comma, _ = at.cuts(x[0], data, *found)
                x[1] += len(comma)
        done = [[*k, *a, *b] for k, (_, a, b) in out.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done) if done else [[]] * 6, [pa.string(), *[pa.int64()] * 5])], names=["path", "block", "end_before", "n_before", "end_inside", "n_inside"])

    return rows


def _elements(name: str | None, parts: bool):
    """(path, block, position, row): whole elements of each split, or with ``parts`` the pieces of those that lie in several."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, state, position, whole, held = None, None, BEHIND, 0, True, []

        def batch(key: tuple, positions: list[int] | np.ndarray, pieces: list[bytes]) -> pa.RecordBatch:
            n = len(pieces)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(positions, pa.int64()), pa.array(pieces, pa.binary())], names=["path", "block", "position", "row"])

        for key, start, data in _chunks(batches):
            if key != last:
                if state == INSIDE and parts:
                    yield batch(last, [position], [b"".join(held)])
                last, at, state, position, whole, held = key, Place(start["in_string"], start["depth"], name), start["state"], start["position"], False, []
            found = at.read(data)
            was, (state, begin, comma, end) = state, at.cuts(state, data, *found)
            if was == BEHIND or state == BEFORE:
                continue
            if begin >= 0:
                whole, held = True, []
            stops = comma.tolist() + ([end] if end >= 0 else [])
            starts = [max(begin, 0), *(x + 1 for x in comma.tolist())]
            pieces = [data[a:b] for a, b in zip(starts, stops)]
            if pieces:
                pieces[0] = b"".join([*held, pieces[0]])
                skip = int(not whole)
                if parts:
                    if skip:
                        yield batch(key, [position], pieces[:1])
                elif len(pieces) > skip:
                    yield batch(key, np.arange(position + skip, position + len(pieces)), [x.strip() for x in pieces[skip:]])
                whole, held = True, []
            position += len(comma)
            if state == INSIDE:
                held.append(data[starts[len(stops)] :])
        if state == INSIDE and parts:
            yield batch(last, [position], [b"".join(held)])

    return rows


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("lineSep", "}").text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def _group(spark: SparkSession, paths: list[str], name: str | None) -> DataFrame:
    source = _read(spark, paths)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = source.mapInArrow(_summaries, "path string, block long, quotes long, from_outside long, from_inside long")
    sums = sums.withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    depth = F.coalesce(F.sum(F.when(F.col("in_string") == 0, F.col("from_outside")).otherwise(F.col("from_inside"))).over(before), F.lit(0))
    begins = staged(sums.select("path", "block", "in_string", depth.alias("depth")))

    counts = source.join(F.broadcast(begins), ["path", "block"]).mapInArrow(_counts(name), "path string, block long, end_before long, n_before long, end_inside long, n_inside long")
    # the array is entered in the first split that gets so far from before it, and left in the first behind that one that does
    every = Window.partitionBy("path")
    entered = F.min(F.when(F.col("end_before") > BEFORE, F.col("block"))).over(every)
    state = counts.withColumn("entered", entered).withColumn("done", F.max(F.when((F.col("block") == F.col("entered")) & (F.col("end_before") == BEHIND), 1)).over(every).isNotNull())
    left = F.min(F.when((F.col("block") > F.col("entered")) & (F.col("end_inside") == BEHIND), F.col("block"))).over(every)
    state = state.withColumn("left", F.when(F.col("done"), F.col("entered")).otherwise(left))
    inside = (F.col("block") > F.col("entered")) & (F.col("left").isNull() | (F.col("block") <= F.col("left")))
    own = F.when(F.col("block") == F.col("entered"), F.col("n_before")).when(inside, F.col("n_inside")).otherwise(0)
    begin = F.when(F.col("entered").isNull() | (F.col("block") <= F.col("entered")), BEFORE).when(inside, INSIDE).otherwise(BEHIND)
    state = state.select("path", "block", begin.cast("long").alias("state"), F.coalesce(F.sum(own).over(before), F.lit(0)).alias("position"))
    ready = F.broadcast(staged(begins.join(state, ["path", "block"])))
    cut = lambda parts: source.join(ready, ["path", "block"]).mapInArrow(_elements(name, parts), "path string, block long, position long, row binary")
    pieces = F.array_sort(F.collect_list(F.struct("block", F.hex("row").alias("row"))))
    joined = cut(True).groupBy("path", "position").agg(F.unhex(F.array_join(F.transform(pieces, lambda p: p["row"]), "")).alias("row"))
    joined = joined.withColumn("row", F.btrim(F.col("row").cast("string"), F.lit(" \t\r\n")).cast("binary"))
    out = cut(False).select("path", "position", "row").unionByName(joined)
    return out.select("path", "position", F.col("row").cast("string").alias("row")).where("row <> ''")


def sizes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length) of the files, from their metadata alone."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def array_rows(spark: SparkSession, path: str | list[str], root: str = "$") -> DataFrame:
    """(path, position, lineage, row): the elements of the JSON array at ``root`` ($ or $.name) of each file, as their text.

    A file without such an array has no rows.  A file that ends inside of its
    array has its elements up to there, the last as far as it goes.  Blank
    elements, as in ``[1,,2]`` or an empty array, are no rows but keep their position.
    """
    if root != "$" and not (root.startswith("$.") and root[2:].isidentifier()):
        raise ValueError(f"root must be $ or $.name, not {root}")
    name = root[2:] or None
    most = int(spark.conf.get("spark.sql.files.maxPartitionBytes").lower().removesuffix("b").replace("k", "000").replace("m", "000000").replace("g", "000000000"))
    groups, splits = [[]], 0
    for r in sizes(spark, path).orderBy("path").toLocalIterator():  # names and lengths, as Spark's own listing holds them
        n = 1 + r["length"] // most
        if groups[-1] and splits + n > SPLITS:
            groups.append([])
            splits = 0
        groups[-1].append(r["path"])
        splits += n
    if not groups[0]:
        return spark.createDataFrame([], "path string, position long, lineage string, row string")
    out = _group(spark, groups[0], name)
    for g in groups[1:]:
        out = out.unionByName(_group(spark, g, name))
    return out.select("path", "position", F.concat(F.lit(root + "["), "position", F.lit("]")).alias("lineage"), "row")


def evidence(spark: SparkSession, path: str | list[str], rows: DataFrame) -> DataFrame:
    """(path, evidence_id): the SHA-256 of each file's bytes.

    A file beyond ``WHOLE`` bytes fits in no row; its evidence is ``rows:`` and
    the SHA-256 over those of its elements in order, in stretches of ``HASHED``,
    which does not depend on how the file was split.
    """
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= WHOLE).select("path", F.sha2("content", 256).alias("evidence_id"))
    large = rows.join(sizes(spark, path).where(F.col("length") > WHOLE).select(F.regexp_replace("path", "^file:/+", "/").alias("own")), F.regexp_replace("path", "^file:/+", "/") == F.col("own"), "left_semi")
    hashed = lambda c, by: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda x: x[c]), ","), 256)
    some = large.select("path", F.floor(F.col("position") / HASHED).alias("run"), "position", F.sha2("row", 256).alias("h")).groupBy("path", "run").agg(hashed("h", "position").alias("h"))
    # staged, so that its size is known where it is joined
    return staged(small.unionByName(some.groupBy("path").agg(F.concat(F.lit("rows:"), hashed("h", "run")).alias("evidence_id"))))
