"""Toxicity by multiple-instance learning.

A document is a bag of sentences (ended by ``. ! ?`` or a line end).  A
sentence i has the score p_i = sigmoid(b + sum of the weights of its features)
and the document the noisy-or of its sentences,

    P = 1 - (1 - p_1) (1 - p_2) ...

so that document labels train the sentence scores, and the sentences with
p_i >= 1/2 are those that offend.  Features are the words and their first
three, four and five bytes, hashed.

Training sees at most ``most`` labelled documents (those with the smallest id
hashes; the bound is for fitting alone), none of them held out.  One pass
counts features by label, Spark ranks them, and the ``slots`` that tell the
labels apart best are kept; weights start from these counts and follow the
gradient of the document likelihood, added up in each step over ``FIT_TASKS``
tasks.  Every text is then
scored whole.

A null or empty text has one empty sentence and gets sigmoid(b).  Without
labelled documents all weights are 0 and b is -5.  Repeated rows come back as
often, extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage
from .shingles import _BASE, _BYTE, _INVERSE, _powers, buffers, mix, slices
from .text_features import added, held_out, labelled

BITS = 18
SLOTS = 2048
MOST = 20_000
STEPS = 40
RATE = 0.15
#: Tasks of a training step; it reads the bags of at most ``most`` documents.
FIT_TASKS = 8
_PREFIXES = (3, 4, 5)


def sentence_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes (BITS bits) with their sentence numbers; for each sentence its text and its first byte."""
    low = int(offsets[0])
    raw, at = data[low : int(offsets[-1])], offsets - low
    byte = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    ends = (raw == 46) | (raw == 33) | (raw == 63) | (raw == 10)
    # sentences: one at each text's start and one after each end inside a text
    breaks = np.unique(np.concatenate([at[:-1], np.flatnonzero(ends) + 1]))
    breaks = breaks[breaks < len(raw)]
    empty = np.flatnonzero(at[1:] == at[:-1])
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.arange(len(at) - 1), at[:-1]
    owner = np.searchsorted(at, breaks, "right") - 1
    inside = (byte >= 128) | ((byte >= 97) & (byte <= 122)) | ((byte >= 48) & (byte <= 57))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[byte] * _powers(_BASE, len(raw)), dtype=np.uint64)])
        inverse = _powers(_INVERSE, len(raw))[start]
        hashes = [mix((total[end] - total[start]) * inverse, 41)]
        hashes += [mix((total[np.minimum(end, start + k)] - total[start]) * inverse, 41 + k) for k in _PREFIXES]
    sentence = np.searchsorted(breaks, start, "right") - 1
    feature = np.concatenate(hashes) >> np.uint64(64 - BITS)
    # an empty text is one empty sentence
    owner, breaks = np.concatenate([owner, empty]), np.concatenate([breaks, at[empty]])
    return feature.astype(np.int64), np.tile(sentence, len(hashes)), owner, breaks


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, clean, toxic): a task's documents with each feature, by label, without zeros; feature -1 stands for all documents."""
    out = np.zeros((2, 1 << BITS), np.int64)
    all_ = np.zeros(2, np.int64)
    for batch in batches:
        label = (np.asarray(batch.column(1)) > 0).astype(np.int64)
        data, offsets = buffers(batch.column(0))
        for i, j in slices(offsets):
            feature, sentence, owner, _ = sentence_features(data, offsets[i : j + 1])
            both = np.unique((owner[sentence] << BITS) | feature)
            np.add.at(out, (label[i:j][both >> BITS], both & ((1 << BITS) - 1)), 1)
            all_ += np.bincount(label[i:j], minlength=2)
    if all_.any():
        seen = np.flatnonzero(out.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int32()), *(pa.array(np.append(out[y, seen], all_[y])) for y in (0, 1))], names=["feature", "clean", "toxic"])


def log_odds(a: Column, b: Column, n1: int, n0: int) -> tuple[Column, Column]:
    """Log odds of a feature in ``a`` of n1 toxic and ``b`` of n0 clean documents, and its z value."""
    odds = F.log((a + 0.5) / (n1 - a + 0.5)) - F.log((b + 0.5) / (n0 - b + 0.5))
    return odds, odds / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (n1 - a + 0.5) + 1 / (n0 - b + 0.5))


def choose(counts: DataFrame, n0: int, n1: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The features that tell the labels apart best, and their log odds; only these ``slots`` rows reach the driver."""
    odds, z = log_odds(F.col("toxic"), F.col("clean"), n1, n0)
    scored = counts.where("feature >= 0 and clean + toxic >= 3").select("feature", odds.alias("odds"), F.abs(z).alias("z")).where("z >= 2.5")
    rows = sorted((r["feature"], r["odds"]) for r in scored.orderBy(F.desc("z"), "feature").limit(slots).select("feature", "odds").collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows])


def slot_table(chosen: np.ndarray) -> np.ndarray:
    table = np.full(1 << BITS, -1, np.int32)
    table[chosen] = np.arange(len(chosen), dtype=np.int32)
    return table


def _bags(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (sentence, slot) pairs, and each sentence's text and first byte."""
    feature, sentence, owner, first = sentence_features(data, offsets)
    slot = table[feature]
    hit = slot >= 0
    both = np.unique(sentence[hit] * len(table) + slot[hit])
    return both // len(table), both % len(table), owner, first


def _bag_rows(table: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for i, j in slices(offsets):
                sentence, slot, owner, _ = _bags(data, offsets[i : j + 1], table)
                text = owner[sentence]
                order = np.argsort(text, kind="stable")
                at = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=j - i))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x[order].astype(np.int32))) for x in (sentence, slot)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array(np.bincount(owner, minlength=j - i).astype(np.int32)), *lists], names=["label", "sentences", "sentence", "slot"])

    return rows


def _step(w: np.ndarray):
    def step(batch: pa.RecordBatch) -> np.ndarray:
        y = np.asarray(batch.column(0)) > 0
        n = np.asarray(batch.column(1)).astype(np.float64)
        length = np.diff(np.asarray(batch.column(2).offsets))
        text = np.repeat(np.arange(len(y)), length)
        pair = text.astype(np.int64) << 32 | np.asarray(batch.column(2).flatten()).astype(np.int64)
        slot = np.asarray(batch.column(3).flatten())
        own, sentence = np.unique(pair, return_inverse=True)
        bag = (own >> 32).astype(np.int64)
        z = w[0] + np.bincount(sentence, w[1:][slot], minlength=len(own))
        rest = n - np.bincount(bag, minlength=len(y))
        total = np.bincount(bag, softplus(z), minlength=len(y)) + rest * softplus(w[0])
        total = np.maximum(total, 1e-9)
        d = np.where(y, -1 / np.expm1(np.minimum(total, 50.0)), 1.0)  # loss by total
        p = 1 / (1 + np.exp(-z))
        out = np.zeros(len(w) + 1)
        out[0] = (d[bag] * p).sum() + (d * rest).sum() / (1 + np.exp(-w[0]))
        out[1:-1] = np.bincount(slot, (d[bag] * p)[sentence], minlength=len(w) - 1)
        out[-1] = len(y)
        return out

    return step


def train(stage: Stage, texts: DataFrame, slots: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(chosen features, weights with b in front) from rows (text, label), of which there is a bounded number."""
    texts = stage.keep(texts)
    counts = stage.keep(texts.mapInArrow(_count_rows, "feature int, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    n0, n1 = next(((r["clean"], r["toxic"]) for r in counts.where("feature = -1").collect()), (0, 0))
    if not n0 or not n1:
        stage.drop(texts, counts)
        return np.zeros(0, np.int64), np.array([-5.0])
    chosen, odds = choose(counts, n0, n1, slots)
    w = np.concatenate([[-6.0], np.clip(odds, -4, 4)])
    # the bags are small and few: a set number of tasks, whatever the partitions of the texts
    bags = stage.keep(texts.mapInArrow(_bag_rows(slot_table(chosen)), "label double, sentences int, sentence array<int>, slot array<int>").repartition(FIT_TASKS))
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, steps + 1):
        out = added(bags, _step(w), len(w) + 1)
        g = (out[:-1] + np.concatenate([[0.0], 0.5 * w[1:]])) / max(1.0, out[-1])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    stage.drop(texts, counts, bags)
    return chosen, w


def _score_rows(chosen: np.ndarray, w: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slot_table(chosen)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j in slices(offsets):
                sentence, slot, owner, first = _bags(data, offsets[i : j + 1], table)
                z = w[0] + np.bincount(sentence, w[1:][slot], minlength=len(owner))
                n = j - i
                score = -np.expm1(-np.bincount(owner, softplus(z), minlength=n))
                # offending sentences as spans in code points
                at = offsets[i : j + 1] - offsets[i]
                bad = np.flatnonzero(z >= 0)
                spans: list[list[dict]] = [[] for _ in range(n)]
                if len(bad):
                    raw = data[offsets[i] : offsets[j]]
                    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    order = np.sort(first)
                    for b in bad:
                        k, start = int(owner[b]), int(first[b])
                        nxt = int(np.searchsorted(order, start, "right"))
                        end = min(int(at[k + 1]), int(order[nxt]) if nxt < len(order) else int(at[k + 1]))
                        spans[k].append({"start": int(points[start] - points[at[k]]), "end": int(points[end] - points[at[k]]), "score": float(1 / (1 + np.exp(-z[b])))})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(np.clip(score, 0.0, 1.0)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))],
                    names=["id", "score", "sentences"],
                )

    return rows


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST, slots: int = SLOTS, steps: int = STEPS) -> DataFrame:
    """Rows (id, held_out, score, predicted, sentences), one for each row of ``docs``; ``sentences`` are the offending spans with their scores."""
    stage = Stage(docs.sparkSession, "toxicity")
    chosen, w = train(stage, labelled(docs, labels, label_col, id_col, text_col, most), slots, steps)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(_score_rows(chosen, w), "id long, score double, sentences array<struct<start:int,end:int,score:double>>")
    return out.select(F.col("id").alias(id_col), held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST, slots: int = SLOTS, steps: int = STEPS) -> DataFrame:
    """The rows of ``docs``, all columns, with a score under one half."""
    stage = Stage(docs.sparkSession, "toxicity")
    chosen, w = train(stage, labelled(docs, labels, label_col, id_col, text_col, most), slots, steps)
    at = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slot_table(chosen)
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            total = []
            for i, j in slices(offsets):
                sentence, slot, owner, _ = _bags(data, offsets[i : j + 1], table)
                z = w[0] + np.bincount(sentence, w[1:][slot], minlength=len(owner))
                total.append(np.bincount(owner, softplus(z), minlength=j - i))
            if total:
                yield batch.filter(pa.array(-np.expm1(-np.concatenate(total)) < 0.5))

    return docs.mapInArrow(rows, docs.schema)
