"""Ranked lexical search with block-max pruning.

1. Each task turns its texts into blocks of consecutive documents.  A block is
   one row: its documents' ids and a forward index (document, term,
   occurrences) of the terms that the items ask for.
2. Numbers of documents and of terms, and the documents that hold each term,
   are counted over the blocks.  They give each occurrence its gain, and each
   block the largest gain of each of its terms; both are stored with the block.
3. For an item, the bound of a block is the sum of weight times largest gain
   over the item's terms.  A task sorts its blocks by bound and scores their
   forward index until the bound drops below the threshold.
   A first pass scores the best block of each batch alone; the tenth best score
   found there, over all tasks, is a threshold that the second pass starts from.
   Within a task it rises with the documents that are scored.
4. The best of each task are ranked once more, in two steps, with partial limits.

A block whose bound equals the threshold is still scored, since equal scores
are ranked by id, so pruning never changes a result.

Items are searched in parts of about ``PART`` characters of their texts, one
part at a time, so what goes to every task and comes back is bounded whatever
the number of items; documents are in no part and never collected.

Inputs: ``id_col`` and ``item_col`` integers, texts as strings, any further
columns.  A null or empty text has no terms: as a document it counts nowhere
and is never found, as an item it finds nothing.  Rows that repeat a document's
id are documents of their own; a null id comes last among equal scores.  Rows
that repeat an item's id are items of their own, each with ranks from 1; a null
item id is returned as null.  Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage
from .shingles import buffers
from .words import words

BEST = 10
#: Documents of a block.
BLOCK = 64
#: Characters of items' texts that are searched at a time, about.
PART = 1 << 20
_LAST = np.iinfo(np.int64).max


def _list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _block_rows(terms: list[bytes], block: int):
    """Blocks of the texts: ids, terms in each text, and the forward index by (document of the block, term)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(terms)}.get
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i in range(0, batch.num_rows, block):
                j = min(batch.num_rows, i + block)
                n, doc, term, tf = np.zeros(j - i, np.int64), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for d in range(j - i):
                    found = []
                    for piece in words(data[offsets[i + d] : offsets[i + d + 1]]):
                        n[d] += len(piece)
                        found.append(np.fromiter(map(number, piece, repeat(-1)), np.int32, len(piece)))
                    if found:
                        own, k = np.unique(np.concatenate(found), return_counts=True)
                        own, k = own[own >= 0], k[own >= 0]
                        doc.append(np.full(len(own), d, np.int32))
                        term.append(own)
                        tf.append(k)
                columns = [pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(0).slice(i, j - i)), _list(n, pa.int64())]
                columns += [_list(np.concatenate(x), kind) for x, kind in ((doc, pa.int32()), (term, pa.int32()), (tf, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "n", "doc", "term", "tf"])

    return rows


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a task hold each term."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        own = np.bincount(np.asarray(batch.column(0).flatten()), minlength=len(total))
        own[: len(total)] += total
        total = own
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["term", "df"])


def _peak_rows(documents: int, length: int):
    """Puts gains in the place of occurrences, by term, and adds each term's largest gain in the block and the end of its run."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                n, doc, term, tf = (np.asarray(batch.column(c)[b].values) for c in range(1, 5))
                m = 10 + (90 * n * documents) // max(1, length)
                order = np.argsort(term, kind="stable")
                doc, tf = doc[order], tf[order]
                gain = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
                own, first = np.unique(term[order], return_index=True)
                peak = np.maximum.reduceat(gain, first) if len(own) else gain
                end = np.append(first, len(doc))[1:]
                columns = [batch.column(0).slice(b, 1), _list(doc, pa.int32()), _list(gain, pa.int64()), _list(own, pa.int32()), _list(end, pa.int32()), _list(peak, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "doc", "gain", "term", "end", "peak"])

    return rows


class Items:
    """Items as term lists, with the weights of all terms."""

    def __init__(self, terms: list[np.ndarray], weight: np.ndarray):
        self.terms, self.weight = terms, weight
        item = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        flat = np.concatenate([np.zeros(0, np.int64), *terms])
        order = np.argsort(flat, kind="stable")
        self.by_term = item[order]
        self.at = np.searchsorted(flat[order], np.arange(len(weight) + 1))

    def bounds(self, batch: pa.RecordBatch) -> np.ndarray:
        """Bound of each block (row) of a batch for each item."""
        block = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(batch.column("term").offsets)))
        term, peak = (np.asarray(batch.column(c).flatten()) for c in ("term", "peak"))
        many = self.at[term + 1] - self.at[term]
        place = np.repeat(self.at[term] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        out = np.zeros(batch.num_rows * len(self.terms), np.int64)
        np.add.at(out, np.repeat(block, many) * len(self.terms) + self.by_term[place], np.repeat(peak * self.weight[term], many))
        return out.reshape(batch.num_rows, -1)


class Forward:
    """The forward index of one block: views of the batch, so that open blocks take no memory of their own."""

    def __init__(self, batch: pa.RecordBatch, b: int):
        self.ids = np.asarray(batch.column("ids")[b].values.fill_null(_LAST))
        self.doc, self.gain, self.own, self.end = (np.asarray(batch.column(c)[b].values) for c in ("doc", "gain", "term", "end"))

    def scores(self, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.own, terms), len(self.own) - 1)
        here = self.own[at] == terms
        out = np.zeros(len(self.ids), np.int64)
        for k, w in zip(at[here], weight[terms[here]]):
            run = slice(self.end[k - 1] if k else 0, self.end[k])
            out[self.doc[run]] += w * self.gain[run]  # a document stands once in a run
        return out


def _search_rows(items: Items, floor: np.ndarray, best: int, first: bool):
    """The best documents of a task for each item; ``first`` scores one block of each batch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = [np.zeros(0, np.int64)] * len(items.terms)
        id_ = list(score)
        threshold = np.maximum(floor, 1)  # only scores above 0 count
        for batch in batches:
            if not batch.num_rows:
                continue
            bound, open_ = items.bounds(batch), {}
            for q in np.flatnonzero((bound >= threshold).any(axis=0)):
                order = np.argsort(-bound[:, q], kind="stable")
                for b in order[:1] if first else order:
                    if bound[b, q] < threshold[q]:
                        break
                    if b not in open_:
                        open_[b] = Forward(batch, b)
                    found = open_[b].scores(items.terms[q], items.weight)
                    keep = found >= threshold[q]
                    if keep.any():
                        s, d = np.concatenate([score[q], found[keep]]), np.concatenate([id_[q], open_[b].ids[keep]])
                        top = np.lexsort((d, -s))[:best]
                        score[q], id_[q] = s[top], d[top]
                        if len(top) == best:
                            threshold[q] = max(threshold[q], s[top[-1]])
        size = [len(s) for s in score]
        d = np.concatenate([np.zeros(0, np.int64), *id_])
        columns = [pa.array(np.repeat(np.arange(len(size)), size), pa.int32()), pa.array(d, pa.int64(), mask=d == _LAST), pa.array(np.concatenate([np.zeros(0, np.int64), *score]), pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(d), TaskContext.get().partitionId()), pa.int32())], names=["item", "id", "score", "part"])

    return rows


def _top(found: DataFrame, best: int) -> DataFrame:
    """Rank of the best of each item: first those of each run of tasks, then of all."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    some = found.withColumn("run", F.floor(F.col("part") / 64)).withColumn("r", F.row_number().over(Window.partitionBy("item", "run").orderBy(*order))).where(F.col("r") <= best)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= best).select("item", "rank", "id", "score")


def _part(stage: Stage, source: DataFrame, rows: list, best: int, block: int) -> DataFrame:
    """Ranks for a bounded number of items: rows (item, rank, id, score), items by their place in ``rows``."""
    asked = [sorted({w for piece in words((r["text"] or "").encode()) for w in piece}) for r in rows]
    terms = sorted(set().union(*asked))
    number = {w: i for i, w in enumerate(terms)}
    blocks = stage.keep(source.mapInArrow(_block_rows(terms, block), "ids array<long>, n array<long>, doc array<int>, term array<int>, tf array<long>"))
    sizes = blocks.agg(F.sum(F.size(F.filter("n", lambda x: x > 0))).alias("documents"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("length")).first()
    documents, length = sizes["documents"] or 0, sizes["length"] or 0
    df = np.zeros(len(terms), np.int64)
    for r in blocks.select("term").mapInArrow(_held, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most the items' terms
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(k) + 1))) for k in df], np.int64)
    items = Items([np.array([number[w] for w in own], np.int64) for own in asked], weight)

    index = stage.keep(blocks.mapInArrow(_peak_rows(documents, length), "ids array<long>, doc array<int>, gain array<long>, term array<int>, end array<int>, peak array<long>"))
    stage.drop(blocks)
    search = lambda floor, first: index.mapInArrow(_search_rows(items, floor, best, first), "item int, id long, score long, part int")
    floor = np.zeros(len(rows), np.int64)
    for r in _top(search(floor, True), best).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") == best).collect():  # a row an item
        floor[r["item"]] = r["low"]
    out = stage.keep(_top(search(floor, False), best))
    stage.drop(index)
    return out


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", best: int = BEST, block: int = BLOCK, part: int = PART) -> DataFrame:
    """Rows (item, rank, id, score): the ``best`` documents of each row of ``items``."""
    spark = docs.sparkSession
    stage = Stage(spark, "block-max-search")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = stage.keep(items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()))
    parts = -(-(asked.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)))).first()[0] or 0) // part)
    out = spark.createDataFrame([], f"{item_col} long, rank int, {id_col} long, score long")
    for k in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == k).orderBy("row").collect()  # about ``part`` characters
        if rows:
            found = _part(stage, source, rows, best, block)
            own = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], "item int, own long")
            out = out.unionByName(found.join(F.broadcast(own), "item").select(F.col("own").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
    return out
