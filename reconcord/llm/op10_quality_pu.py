"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1; all documents are the
unlabelled web text.  A logistic model g over shape features of the text
minimises the non-negative unbiased risk

    pi E_P[l(g)] + max(0, E_U[l(-g)] - pi E_P[l(-g)])

With the logistic loss the unbiased part is convex, E_U[l(-g)] - pi E_P[g], so
Newton steps over sums from all tasks solve it; a step that would push the
inner term below zero is halved until it does not.

The class prior pi is estimated from the same two samples: a first model tells
positives from web text, and over thresholds t of its score that keep at least
``keep`` of the positives, pi is the least ratio of U(score >= t) to
P(score >= t) (a region without negatives has the ratio pi).

Negative labels are never used.  Held-out documents give no positives.  The
features of all documents are staged as small numbers; texts are read whole,
once for the features and never shuffled.

A null or empty text has features 0 and gets the score of that point.  Without
positives every score is 1/2.  Repeated rows come back as often; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage
from .shingles import buffers, slices, word_hashes
from .text_features import held_out, summed

MOST = 20_000
FEATURES = ("words", "word_bytes", "symbols", "shouts", "capitals", "digits", "lines", "distinct", "repeats", "bars", "stops", "wide", "same_lines", "all_caps_words")


def shape_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text, each of a moderate range."""
    n = len(offsets) - 1
    low = int(offsets[0])
    raw, at = data[low : int(offsets[-1])], offsets - low

    def per(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[at[1:]] - total[at[:-1]]).astype(np.float64)

    size = np.diff(at).astype(np.float64)
    word, owner = word_hashes(data, offsets)
    words = np.bincount(owner, minlength=n).astype(np.float64)
    order = np.lexsort((word, owner))
    new = np.ones(len(word), bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=n)
    again = np.bincount(owner[1:][(word[1:] == word[:-1]) & (owner[1:] == owner[:-1])], minlength=n)
    symbol = np.isin(raw, np.frombuffer(b"#*$%&|<>", np.uint8))
    upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
    caps = upper.copy()
    caps[1:] &= upper[:-1]  # a capital after a capital
    lines = per(raw == 10)
    # lines of one length and sum of bytes count as equal
    ends = np.unique(np.concatenate([np.flatnonzero(raw == 10), at[1:][at[1:] > 0] - 1]))
    begin = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    plain = np.concatenate([[0], np.cumsum(raw.astype(np.int64))])
    key = np.stack([ends - begin, plain[ends] - plain[begin]]) if len(ends) else np.zeros((2, 0), np.int64)
    line_owner = np.searchsorted(at, begin, "right") - 1
    twice = np.zeros(len(ends), bool)
    if len(ends):
        o = np.lexsort((key[1], key[0], line_owner))
        same = (key[:, o[1:]] == key[:, o[:-1]]).all(0) & (line_owner[o[1:]] == line_owner[o[:-1]]) & (key[0][o[1:]] > 8)
        twice[o[1:]] = same
    w, b = np.maximum(words, 1), np.maximum(size, 1)
    out = np.stack(
        [
            np.log1p(words) / 5, size / w / 10, np.minimum(per(symbol) / w, 3), np.minimum(per(raw == 33) / w, 2), per(upper) / np.maximum(per(upper | lower), 1), per((raw >= 48) & (raw <= 57)) / b * 5,
            np.minimum(lines / w * 10, 3), np.where(words > 0, 1 - distinct / w, 0), again / w, np.minimum(per(raw == 124) / w, 2), np.minimum(per((raw == 46) | (raw == 44)) / w * 5, 3), per(raw >= 128) / b,
            np.minimum(np.bincount(line_owner[twice], minlength=n) / np.maximum(lines, 1), 1), per(caps) / b,
        ],
        1,
    )
    return np.where(words[:, None] > 0, out, 0.0)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        for i, j in slices(offsets):
            x = shape_features(data, offsets[i : j + 1]).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), flat], names=["id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    x = np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)
    return np.concatenate([np.ones((len(x), 1)), x, x**2], 1)


DIMENSIONS = 1 + 2 * len(FEATURES)


def _sums(w: np.ndarray):
    """Over a batch (x, positive): gradient and Hessian of E_U[l(-g)], E_P[x], losses and counts."""
    d = len(w)

    def step(batch: pa.RecordBatch) -> np.ndarray:
        x, p = _matrix(batch.column(0)), np.asarray(batch.column(1).cast(pa.int8())).astype(bool)
        z = x @ w
        s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        tail = [np.logaddexp(0, z).sum(), float(len(x)), np.logaddexp(0, z[p]).sum(), np.logaddexp(0, -z[p]).sum(), float(p.sum())]
        return np.concatenate([x.T @ s, ((x * (s * (1 - s))[:, None]).T @ x).ravel(), x[p].sum(0), tail])

    step.size = 2 * d + d * d + 5
    return step


def _risk(out: np.ndarray, pi: float) -> tuple[float, float]:
    """Non-negative risk and its inner term."""
    u, n, p_minus, p_plus, k = out[-5:]
    inner = u / n - pi * p_minus / k
    return pi * p_plus / k + max(0.0, inner), inner


def minimise(table: DataFrame, pi: float, steps: int = 12, ridge: float = 1e-3) -> np.ndarray:
    """Weights of least non-negative risk; ``table`` has (x, positive)."""
    d = DIMENSIONS
    w = np.zeros(d)
    keep = np.full(d, ridge)
    keep[0] = 0.0
    f = _sums(w)
    out = summed(table, f, f.size)
    if not out[-1]:
        return w
    best = _risk(out, pi)[0] + (keep * w * w).sum() / 2
    for _ in range(steps):
        n, k = out[-4], out[-1]
        grad = out[:d] / n - pi * out[d + d * d : 2 * d + d * d] / k + keep * w
        hess = out[d : d + d * d].reshape(d, d) / n + np.diag(keep + 1e-9)
        move, scale = np.linalg.solve(hess, grad), 1.0
        while scale > 1e-3:
            new = w - scale * move
            f = _sums(new)
            got = summed(table, f, f.size)
            risk, inner = _risk(got, pi)
            risk += (keep * new * new).sum() / 2
            if inner >= 0 and risk <= best + 1e-9:
                break
            scale /= 2
        else:
            break
        done = best - risk < 1e-6
        w, out, best = new, got, risk
        if done:
            break
    return w


def _histogram(w: np.ndarray, bins: int):
    def step(batch: pa.RecordBatch) -> np.ndarray:
        p = np.asarray(batch.column(1).cast(pa.int8())).astype(bool)
        at = np.clip(((_matrix(batch.column(0)) @ w + 20) / 40 * bins).astype(np.int64), 0, bins - 1)
        return np.concatenate([np.bincount(at, minlength=bins), np.bincount(at[p], minlength=bins)]).astype(np.float64)

    return step


def class_prior(table: DataFrame, keep: float = 0.8, bins: int = 2000) -> float:
    """Least U(A) / P(A) over upper level sets A of a first model that hold at least ``keep`` of the positives."""
    w = minimise(table, 0.5)
    counts = summed(table, _histogram(w, bins), 2 * bins).reshape(2, bins)
    if not counts[1].sum():
        return 0.5
    u, p = (c[::-1].cumsum() / c.sum() for c in counts)
    ok = p >= keep
    return float(np.clip((u[ok] / p[ok]).min(), 0.05, 0.98))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST, threshold: float = 0.3) -> DataFrame:
    """Rows (id, held_out, score, predicted), one for each row of ``docs``."""
    stage = Stage(docs.sparkSession, "quality")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    x = stage.keep(source.mapInArrow(_feature_rows, "id long, x array<float>"))
    trusted = (
        labels.where(F.col(label_col) > 0).select(F.col(id_col).cast("long").alias("id")).where(F.col("id").isNotNull() & ~held_out()).distinct()
        .withColumn("o", F.xxhash64("id")).orderBy("o", "id").limit(most).select("id", F.lit(True).alias("positive"))
    )
    table = stage.keep(x.join(F.broadcast(trusted), "id", "left").select("x", F.coalesce("positive", F.lit(False)).alias("positive")))  # bounded by ``most`` ids
    w = minimise(table, class_prior(table))
    stage.drop(table)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _matrix(batch.column(1)) @ w
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], names=["id", "score"])

    out = x.mapInArrow(rows, "id long, score double")
    return out.select(F.col("id").alias(id_col), held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
