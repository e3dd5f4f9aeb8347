"""Best-fit packing by minimum bin slack.

A document's ids are its tokens and an end mark.  A document longer than a
sequence is cut into full pieces, its first piece being the shorter one; any
other document is one piece.  Pieces are packed so that each bin in turn gets
the combination of available lengths that fills it best: the longest length
left, and then the fullest subset sum of the rest, found by dynamic programming
over bitsets (bit i: the sum i can be reached).  The combination is removed, as
often as the counts of its lengths allow, and the next bin follows.

Only lengths matter, so the search runs on the counts by length, at most
``capacity`` numbers whatever the input; it takes milliseconds a combination.
Pieces then get their places by rank among the pieces of their length.  Ranks
come from salted groups with the groups' counts in front, so that a length with
a third of all pieces is many tasks.

Tokens are those of the given byte-level vocabulary.  A string of ``special``
inside a text is the one token it names, as the vocabulary's own file has it by
default; ``special={}`` makes it ordinary text.  The ids come from the same
vocabulary in the form of ranks, which is faster.  Its pattern looks ahead only
where white space is longer than one character; texts without such white space
are encoded without that part of it, which is faster again.  A long run of white
space, on which looking ahead would exhaust the stack, is cut out and encoded as
the one piece that the pattern makes of it.

A null text is an empty text: one piece of the end mark.  Repeated rows are
packed each.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage

CAPACITY = 1024
END_ID = 2
#: Fixed value: the added token of the vocabulary file.
SPECIAL = {"<|endoftext|>": 50256}
_GAP = re.compile(r"\s\s")
#: The part of the vocabulary's pattern that only matters where white space is longer than one character.
LOOK_AHEAD = r"\s+(?!\S)|"
#: Runs of the pattern's white space that are cut out before it is applied.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


class Encoder:
    """Ids of a byte-level vocabulary (a tiktoken file of base64 tokens and ranks) as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, pattern: str, special: dict[str, int] | None = None):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.special = SPECIAL if special is None else special
        self.named = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        make = lambda p: tiktoken.Encoding("vocabulary", pat_str=p, mergeable_ranks=ranks, special_tokens={})
        self.full = make(pattern)
        self.quick = make(pattern.replace(LOOK_AHEAD, ""))
        self.whole = make(r"[\s\S]+")

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without special strings."""
        out, at = [], 0
        for run in _RUN.finditer(text):
            # the pattern leaves the last character of a run to what follows
            end = run.end() - (run.end() < len(text))
            out += self._short(text[at : run.start()]) + self.whole.encode_ordinary(text[run.start() : end])
            at = end
        return out + self._short(text[at:]) if at else self._short(text)

    def _short(self, text: str) -> list[int]:
        return (self.full if _GAP.search(text) else self.quick).encode_ordinary(text)

    def __call__(self, text: str) -> bytes:
        found, at = array("I"), 0
        for name in self.named.finditer(text) if self.named else ():
            found.extend(self._plain(text[at : name.start()]))
            found.append(self.special[name[0]])
            at = name.end()
        found.extend(self._plain(text[at:] if at else text))
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()


def _piece_rows(vocabulary: str, pattern: str, capacity: int, with_ids: bool, special: dict[str, int] | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, pattern, special)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            owner, number, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = (encoder(text) if text else b"") + end
                n = len(data) // 4
                at, k = 0, 0
                while at < n:
                    size = n % capacity or capacity if at == 0 and n > capacity else min(capacity, n)
                    piece = data[4 * at : 4 * (at + size)]
                    owner.append(i)
                    number.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(piece))
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
                    at, k = at + size, k + 1
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, special: dict[str, int] | None = None) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32[, ids]) of all documents."""
    if vocabulary is None or pattern is None:
        import public_tokenizers

        vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    schema = "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_piece_rows(vocabulary, pattern, capacity, with_ids, special), schema)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths of the fullest combination that fits into ``room``, longest first; counts are how many there are."""
    mask, reach, layers = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            k = min(times, left)
            layers.append((reach, length, k))
            reach |= reach << length * k & mask
            left, times = left - k, times * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for before, length, k in reversed(layers):
        if not before >> total & 1:
            total -= length * k
            out += [length] * k
    return sorted(out, reverse=True)


def minimum_slack(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) of all bins; every piece is in one."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        combination = [longest, *fullest({k: v for k, v in rest.items() if v}, capacity - longest)]
        need = {x: combination.count(x) for x in combination}
        times = min(left[x] // k for x, k in need.items())
        for x, k in need.items():
            left[x] -= times * k
            if not left[x]:
                del left[x]
        out.append((tuple(combination), times))
    return out


def places(bins: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, per bin, first bin, offset): the pieces of a length with ranks from first to last lie ``per bin`` to a bin, from an offset on."""
    out, used, base = [], {}, 0
    for lengths, times in bins:
        offset = 0
        for length in dict.fromkeys(lengths):
            k, first = lengths.count(length), used.get(length, 0)
            used[length] = first + k * times
            out.append((length, first, used[length] - 1, k, base, offset))
            offset += length * k
        base += times
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = 4096) -> DataFrame:
    """``pieces`` (id, piece, length, ...) with sequence_id and offset; read twice, so stage it before."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    table = spark.createDataFrame(places(minimum_slack(counts, capacity)) or [], "length long, first long, last long, per long, base long, at long")
    salts = {k: -(-v // group_rows) for k, v in counts.items()}
    many = spark.createDataFrame(list(salts.items()), "length long, salts long")
    salted = pieces.join(F.broadcast(many), "length").withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("salts")))
    size = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = size.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("own", rank).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own"))
    # the table has one row for each length of each combination, a few thousand for any input
    t = F.broadcast(table.withColumnRenamed("length", "t_length"))
    placed = ranked.join(t, (F.col("length") == F.col("t_length")) & F.col("rank").between(F.col("first"), F.col("last")))
    nth = F.col("rank") - F.col("first")
    return placed.select(
        *pieces.columns, (F.col("base") + F.floor(nth / F.col("per"))).alias("sequence_id"), (F.col("at") + F.col("length") * (nth % F.col("per"))).alias("offset")
    )


def best_fit_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False, vocabulary: str | None = None, pattern: str | None = None, special: dict[str, int] | None = None) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32[, ids], sequence_id, offset), one for each piece of each row of ``docs``."""
    stage = Stage(docs.sparkSession, "packing")
    cut = stage.keep(pieces(docs, id_col, text_col, vocabulary, pattern, capacity, with_ids, special))
    return pack(cut, capacity).withColumnRenamed("id", id_col)
