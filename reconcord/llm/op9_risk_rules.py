"""Quality rules with risk-controlled thresholds.

Each rule rejects texts whose statistic exceeds a cutoff.  The cutoffs are
chosen per stratum on labelled documents so that, with confidence
``1 - delta`` for all strata and rules together, at most a share ``alpha`` of
good documents is rejected:

* good documents rejected at a cutoff are binomial, and the exact
  (Clopper-Pearson) upper bound at level ``delta / (strata * rules)`` must not
  exceed ``alpha / rules``;
* cutoffs are tried from lax to strict and the first that fails ends the
  search (fixed-sequence testing), so the grid needs no further correction;
* among those that hold, the cutoff with the largest lead of bad over good
  documents rejected is taken, the laxest of equals.

A stratum with too few labelled documents rejects nothing by these rules.  The
base rules (fewer than ``least`` words, or more than half of the words in
repeated windows) hold everywhere and are not part of the guarantee.

Labels enter through counts by (stratum, rule, grid place); one task holds one
stratum's few hundred counts.  A null or blank text has all counts 0 and fails
the base rules.  A null stratum is a stratum of its own.  Repeated rows come
back as often; an id with several labels counts with the largest; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage
from .shingles import _BASE, _BYTE, _INVERSE, _powers, buffers, mix, slices, word_hashes

ALPHA = 0.05
DELTA = 0.05
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouts")
#: Statistic of each rule, larger being worse.
RULES = {
    "symbols": "n_symbols / n_words",
    "dup_lines": "n_dup_lines / n_words",
    "repeats": "n_repeat_words / n_words",
    "shouts": "n_shouts / n_words",
    "long_words": "word_chars / n_words / 40",
}
#: Cutoffs from lax to strict.
GRID = tuple(round(2.0 * 0.9**k, 6) for k in range(60))


def text_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of COUNTS for each text."""
    n = len(offsets) - 1
    low = int(offsets[0])
    raw, at = data[low : int(offsets[-1])], offsets - low
    out = np.zeros((n, len(COUNTS)), np.int64)
    if not len(raw):
        return out

    def per(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[at[1:]] - total[at[:-1]]

    word, owner = word_hashes(data, offsets, fold=False)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    out[:, 0] = np.bincount(owner, minlength=n)
    out[:, 1] = per(((raw & 0xC0) != 0x80) & ~blank)
    out[:, 2] = per(np.isin(raw, np.frombuffer(b"#*$%&|<>", np.uint8)))
    out[:, 5] = per(raw == 33)

    # lines with a word that equal an earlier one of their text
    ends = np.unique(np.concatenate([np.flatnonzero(raw == 10), at[1:]]))
    begin = np.concatenate([[0], ends[:-1] + (raw[ends[:-1]] == 10)])  # after an end that is a newline, else at it
    keep = begin < ends
    begin, ends = begin[keep], ends[keep]
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _powers(_BASE, len(raw)), dtype=np.uint64)])
        line = mix((total[ends] - total[begin]) * _powers(_INVERSE, len(raw))[begin], 61) + (ends - begin).astype(np.uint64)
    words = np.concatenate([[0], np.cumsum(~blank)])
    full = words[ends] > words[begin]
    line, text = line[full], (np.searchsorted(at, begin, "right") - 1)[full]
    o = np.lexsort((line, text))
    same = (line[o][1:] == line[o][:-1]) & (text[o][1:] == text[o][:-1])
    out[:, 3] = np.bincount(text[o][1:][same], minlength=n)

    # words inside three-word windows found twice or more
    if len(word) >= 3:
        factor = mix(np.arange(3, dtype=np.uint64), 67) | np.uint64(1)
        with np.errstate(over="ignore"):
            window = mix(word[:-2] * factor[0] + word[1:-1] * factor[1] + word[2:] * factor[2], 71)
        place = np.flatnonzero(owner[2:] == owner[:-2])
        window, text = window[place], owner[place]
        o = np.lexsort((window, text))
        same = (window[o][1:] == window[o][:-1]) & (text[o][1:] == text[o][:-1])
        hit = np.zeros(len(o), bool)
        hit[o[1:][same]] = True
        hit[o[:-1][same]] = True
        covered = np.zeros(len(word), bool)
        for k in range(3):
            covered[place[hit] + k] = True
        out[:, 4] = np.bincount(owner[covered], minlength=n)
    return out


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column(2))
        for i, j in slices(offsets):
            x = text_counts(data, offsets[i : j + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *[pa.array(np.ascontiguousarray(x[:, k])) for k in range(x.shape[1])]], names=["id", "stratum", *COUNTS])


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest rate at which k or fewer of n still has the probability ``level``."""
    if not n or k >= n:
        return 1.0
    i = np.arange(k + 1)
    choose = np.array([math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in i])
    lo, hi = k / n, 1.0
    for _ in range(50):
        p = (lo + hi) / 2
        if p >= 1:
            break
        logs = choose + i * math.log(max(p, 1e-300)) + (n - i) * math.log1p(-p)
        lo, hi = (p, hi) if np.exp(logs - logs.max()).sum() * math.exp(logs.max()) > level else (lo, p)
    return hi


def choose_cutoffs(good: np.ndarray, bad: np.ndarray, alpha: float, level: float) -> float:
    """Cutoff from the numbers of good and bad documents rejected at each place of GRID (the last number of each is the total); infinity rejects nothing."""
    best, lead = math.inf, 0.0
    for k, cutoff in enumerate(GRID):
        if upper_bound(int(good[k]), int(good[-1]), level) > alpha:
            break
        now = bad[k] / max(bad[-1], 1) - good[k] / max(good[-1], 1)
        if now > lead + 1e-12:
            best, lead = cutoff, now
    return best


def _stratum(alpha: float, level: float):
    def rows(frame: pd.DataFrame) -> pd.DataFrame:
        out = {"key": [frame["key"].iloc[0]]}
        for r in RULES:
            own = frame[frame["rule"] == r]
            n = np.zeros((2, len(GRID) + 1))
            np.add.at(n, (own["good"].to_numpy(np.int64), own["place"].to_numpy(np.int64)), own["n"].to_numpy(np.float64))
            # a document at place p is rejected by the cutoffs p and after
            rejected = np.concatenate([n[:, :-1].cumsum(1), n.sum(1, keepdims=True)], 1)
            out[f"cut_{r}"] = [choose_cutoffs(rejected[1], rejected[0], alpha, level)]
        return pd.DataFrame(out)

    return rows


def risk_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality",
    alpha: float = ALPHA, delta: float = DELTA, least: int = 50,
) -> DataFrame:
    """Rows (id, counts, base_failed, kept, failed), one for each row of ``docs``; ``failed`` names the rules that reject."""
    stage = Stage(docs.sparkSession, "risk-rules")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).cast("string").alias("text"))
    counts = stage.keep(source.mapInArrow(_count_rows, "id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS)))
    key = F.when(F.col("stratum").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("stratum")))
    base = (F.col("n_words") < least) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stat = {r: F.coalesce(F.try_divide(F.lit(1.0) * F.expr(e.split(" / ")[0]), F.col("n_words") * (40.0 if r == "long_words" else 1.0)), F.lit(0.0)) for r, e in RULES.items()}
    counts = counts.withColumn("key", key).withColumn("base_failed", base)
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.max(label_col) > 0).cast("int").alias("good"))
    place = lambda s: F.aggregate(F.array(*[F.lit(c) for c in GRID]), F.lit(0), lambda n, c: n + (s <= c).cast("int"))  # noqa: E731  cutoffs that spare it
    # a labelled document is one trial, however many rows hold it: the row with the most words stands for it
    single = counts.where("not base_failed").join(own, "id")
    single = single.groupBy("id", "good").agg(F.max_by(F.struct("key", *COUNTS), F.struct(*COUNTS, "key")).alias("x")).select("good", "x.*")
    holdout = single.select("key", "good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), place(s).alias("place")) for r, s in stat.items()])).alias("x"))
    grid = stage.keep(holdout.groupBy("key", "good", "x.rule", "x.place").agg(F.count("*").alias("n")))
    strata = max(1, grid.select("key").distinct().count())
    schema = "key string, " + ", ".join(f"cut_{r} double" for r in RULES)
    cuts = stage.keep(grid.groupBy("key").applyInPandas(_stratum(alpha / len(RULES), delta / (strata * len(RULES))), schema))
    failed = F.array_compact(F.array(*[F.when(s > F.col(f"cut_{r}"), F.lit(r)) for r, s in stat.items()]))
    out = counts.join(cuts, "key", "left").withColumn("failed", failed)
    return out.select(F.col("id").alias(id_col), *COUNTS, "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed")
