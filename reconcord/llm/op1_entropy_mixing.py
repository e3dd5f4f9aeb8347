"""Mixing sources to target weights by entropy balancing.

Each document d of source s gets a rate r_d, the copies the mix takes of it on
average.  The rates are the solution of

    minimise    sum r_d log r_d - r_d
    subject to  sum over s of size_d r_d = target_s,   0 <= r_d <= limit

whose dual has one multiplier per source and gives exponentially tilted rates
``min(limit, exp(lambda_s size_d / mean_s))``.  The dual is convex; Newton
steps, kept within a bracket, solve it.  Documents of one source and size have
one rate, so every step is one aggregate over the (source, size) counts.

Rates become copies by carrying the rounding error from document to document,
from long to short, within strata of about ``stratum`` documents of a source:
a stratum's words differ from its share by about half its shortest document.
A source with a third of all rows is simply many strata.

Targets: sources in order of code points, null last, have the weights
``weights`` in turn and share ``share`` times all sizes; a target stops at
``limit`` times its source's size, and the excess goes to the others by weight
until none is above.

Null or blank texts have size 0, rate 0 and are never taken.  A null source is
a source of its own.  Rows of one id, source and size are rounded together and
share their copies evenly, those with the smaller texts taking what is over.  If all sources
stop at their limit, every document is taken ``limit`` times.  An empty table
gives an empty result.  Results depend on the rows alone, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Stage, by_size

STRATUM = 512
#: Equal rows that are written out by one step.
RUN = 4096


def source_weights(stage: Stage, sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """(key, source_size, n_docs, weight): the k-th source by code point has weight k mod len(weights).

    Ranks come from a range partitioning and the row counts of its parts, so no
    task sees all sources.
    """
    per = sizes.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    part = stage.keep(per.repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    counts = part.groupBy("part").agg(F.count("*").alias("rows"))
    # one row for each partition, so this window is small whatever the input
    before = counts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    ranked = part.join(before, "part").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    return stage.keep(ranked.select("key", "source_size", "n_docs", weight.alias("weight")))


def capped_targets(per: DataFrame, share: float, limit: float) -> DataFrame:
    """Adds ``target``: shares by weight, none above ``limit`` times its source's size."""
    top = F.col("source_size") * limit
    total = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0  # target of a source of weight 1 that does not stop
    while True:
        stops = F.col("weight") * level >= top
        held, free, n = per.agg(F.sum(F.when(stops, top)), F.sum(F.when(~stops, F.col("weight"))), F.count(F.when(~stops, 1))).first()
        new = max(0.0, total - (held or 0.0)) / free if n else level
        if not n or new <= level:
            return per.withColumn("target", F.least(top, F.col("weight") * level) if n else top)
        level = new


def tilted_rates(stage: Stage, counts: DataFrame, per: DataFrame, limit: float, steps: int = 60) -> DataFrame:
    """Adds ``tilt`` to the sources by Newton steps on the dual; ``counts`` has (key, size, docs).

    A tilt of null means that the source is taken whole ``limit`` times.
    """
    full = F.col("target") >= F.col("source_size") * limit * (1 - 1e-12)
    now = stage.keep(
        per.withColumn("mean", F.col("source_size") / F.col("n_docs"))
        .withColumn("tilt", F.when(full | (F.col("source_size") == 0), None).otherwise(F.lit(0.0)))
        .withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double"))
        .withColumn("open", F.col("tilt").isNotNull())
    )
    for _ in range(steps):
        if not now.where("open").head(1):
            break
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(limit)), F.exp(F.least(F.lit(50.0), F.col("tilt") * x)))
        words = F.col("docs") * F.col("size") * rate
        sums = (
            counts.join(now.where("open").select("key", "mean", "tilt"), "key")
            .groupBy("key").agg(F.sum(words).alias("got"), F.sum(F.when(rate < limit, words * x).otherwise(0.0)).alias("slope"))
        )
        low = F.when(F.col("got") < F.col("target"), F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("got") >= F.col("target"), F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") + (F.col("target") - F.col("got")) / F.col("slope")
        newton = F.when(F.col("slope") > 0, newton)
        inside = (F.coalesce(newton > F.col("low"), F.col("low").isNull())) & (F.coalesce(newton < F.col("high"), F.col("high").isNull()))
        wide = F.when(F.col("high").isNull(), F.col("low") * 2 + 1).when(F.col("low").isNull(), F.col("high") * 2 - 1).otherwise((F.col("low") + F.col("high")) / 2)
        stepped = (
            now.where("open").drop("low", "high").join(now.select("key", "low", "high"), "key").join(sums, "key")
            .withColumn("low", low).withColumn("high", high)
            .withColumn("near", F.abs(F.col("got") - F.col("target")) <= 1e-9 * F.col("target") + 1e-6)
            .withColumn("next", F.when(F.col("near"), F.col("tilt")).otherwise(F.when(newton.isNotNull() & inside, newton).otherwise(wide)))
            .withColumn("open", ~F.col("near") & (F.col("next") != F.col("tilt")))
            .withColumn("tilt", F.col("next")).select(now.columns)
        )
        new = stage.keep(now.where("not open").unionByName(stepped))
        stage.drop(now)
        now = new
    return now.select("key", "source_size", "target", "mean", "tilt", "n_docs")


def _round(limit: int):
    def rows(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "id"], ascending=[False, True], kind="stable")
        size, n = frame["size"].to_numpy(np.float64), frame["n"].to_numpy(np.int64)
        rate = frame["rate"].to_numpy(np.float64)
        low = np.floor(rate)
        top = np.minimum(low + (rate > low), limit)
        copies, owed = np.zeros(len(frame), np.int64), 0.0
        for i in range(len(frame)):
            if size[i] > 0:
                owed += n[i] * size[i] * rate[i]
                copies[i] = min(n[i] * top[i], max(n[i] * low[i], np.rint(owed / size[i])))
                owed -= size[i] * copies[i]
        return frame.assign(copies=copies)[["id", "size", "key", "n", "copies"]]

    return rows


def _key(source_col: str) -> Column:
    return F.when(F.col(source_col).isNull(), "t").otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def _copies(stage: Stage, docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, limit: int, stratum: int) -> DataFrame:
    """Rows (id, key, size, n, copies, source_size, target): the n rows of an id, source and size and the copies taken of them all."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), _key(source_col).alias("key"), _size(text_col).alias("size"))
    sizes = stage.keep(rows.groupBy("id", "key", "size").agg(F.count("*").alias("n")))
    per = stage.keep(capped_targets(source_weights(stage, sizes, weights), share, limit))
    counts = stage.keep(sizes.where("size > 0").groupBy("key", "size").agg(F.sum("n").alias("docs")))
    tilts = tilted_rates(stage, counts, per, limit)
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("tilt").isNull(), float(limit)).otherwise(F.least(F.lit(float(limit)), F.exp(F.least(F.lit(50.0), F.col("tilt") * F.col("size") / F.col("mean")))))
    # rows with a null id are dealt by their size
    salt = F.pmod(F.when(F.col("id").isNull(), F.xxhash64("size")).otherwise(F.xxhash64("id")), F.greatest(F.lit(1), F.ceil(F.col("n_docs") / stratum)))
    taken = (
        sizes.join(tilts, "key").select("id", "size", "key", "n", rate.alias("rate"), salt.alias("salt"))
        .groupBy("key", "salt").applyInPandas(_round(limit), "id long, size long, key string, n long, copies long")
    )
    return taken.join(per.select("key", "source_size", "target"), "key")


def _shared(n: str, copies: str, i: Column) -> Column:
    """Copies of the i-th of ``n`` equal rows: the first ones take what an even split leaves over."""
    return F.expr(f"{copies} div {n}") + (i < F.expr(f"{copies} % {n}")).cast("long")


def entropy_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, limit: int = 2, stratum: int = STRATUM,
) -> DataFrame:
    """Rows (id, size, source_size, target, copies, taken), one for each row of ``docs``; size and taken count words."""
    found = _copies(Stage(docs.sparkSession, "entropy-mix"), docs, id_col, text_col, source_col, weights, share, limit, stratum)
    # rows that share an id, source and size are written out again, in runs
    run = found.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))))
    row = run.withColumn("i", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("n")) - 1)))
    row = row.withColumn("copies", _shared("n", "copies", F.col("i")))
    return row.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, limit: int = 2, stratum: int = STRATUM,
) -> DataFrame:
    """Each row of ``docs``, all columns, as often as the mix takes it.

    Counts are joined to the texts by id.  Only rows that share an id with
    others are numbered, by text, among those of their id, source and size.
    """
    stage = Stage(docs.sparkSession, "mixed")
    found = stage.keep(_copies(stage, docs, id_col, text_col, source_col, weights, share, limit, stratum).select(F.col("id").alias("mix_id"), F.col("key").alias("mix_key"), F.col("size").alias("mix_size"), F.col("n").alias("mix_n"), F.col("copies").alias("mix_copies")))
    often = stage.keep(found.groupBy("mix_id").agg(F.sum("mix_n").alias("rows")).where("rows > 1 or mix_id is null").select("mix_id"))
    own = F.col(id_col).cast("long")
    times = lambda df, c: df.withColumn("mix_copy", F.explode(F.array_repeat(F.lit(0), c.cast("int")))).select(*docs.columns)
    taken = stage.keep(found.where("mix_copies > 0").join(often, "mix_id", "left_anti").select("mix_id", "mix_copies"))
    out = times(docs.join(by_size(taken), own == F.col("mix_id")), F.col("mix_copies"))
    if often.head(1):
        rows = docs.join(often.withColumnRenamed("mix_id", "mix_often"), own.eqNullSafe(F.col("mix_often")), "left_semi").withColumn("mix_own_key", _key(source_col)).withColumn("mix_own_size", _size(text_col))
        rows = rows.withColumn("mix_row", F.row_number().over(Window.partitionBy(own, "mix_own_key", "mix_own_size").orderBy(text_col)) - 1)
        both = rows.join(found.where("mix_copies > 0"), own.eqNullSafe(F.col("mix_id")) & (F.col("mix_own_key") == F.col("mix_key")) & (F.col("mix_own_size") == F.col("mix_size")))
        out = out.unionByName(times(both, _shared("mix_n", "mix_copies", F.col("mix_row"))))
    return out
