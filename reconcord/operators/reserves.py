"""Reserves withheld and released, and the position at the bank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import staged


def reserve_positions(holds: DataFrame, releases: DataFrame) -> DataFrame:
    """Withheld, released and outstanding for each hold."""
    per = releases.groupBy("inflow_key").agg(F.sum("released_kobo").alias("released_kobo"))
    out = holds.join(per, "inflow_key", "left").fillna(0, ["released_kobo"])
    return out.withColumn("outstanding_kobo", F.col("withheld_kobo") - F.col("released_kobo"))


def reserve_fifo_release(positions: DataFrame, release: DataFrame) -> DataFrame:
    """Applies one release per source (source, amount_kobo), oldest hold first: rows (inflow_key, source, applied_kobo).

    The excess over all that is outstanding is not applied.
    """
    w = Window.partitionBy("source").orderBy("withheld_at", "inflow_key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("outstanding_kobo").over(w), F.lit(0))
    x = positions.where("outstanding_kobo > 0").withColumn("before", before).join(release, "source")
    return x.withColumn("applied_kobo", F.least(F.col("outstanding_kobo"), F.greatest(F.lit(0), F.col("amount_kobo") - F.col("before")))).where("applied_kobo > 0").select("inflow_key", "source", "applied_kobo")


def _in_parts(df: DataFrame, *order: str) -> DataFrame:
    """``df`` sorted by source and ``order`` into parts: a source with most of the rows is many of them."""
    return staged(df.repartitionByRange("source", *order).withColumn("part", F.spark_partition_id()))


def reserve_fold(holds: DataFrame, releases: DataFrame) -> DataFrame:
    """Any number of releases (source, at, released_by, amount_kobo) in order: rows (source, released_by, inflow_key, applied_kobo, unapplied_kobo).

    A release sees the holds recorded up to its instant; its excess is reported
    and not carried on.  Amounts of zero and less do nothing.

    What is outstanding is a running sum that stops at zero, so the excess up to
    a release is how far the plain sum of holds less releases has ever been
    below zero.  Sum and lowest sum of a stretch of events add up, so each part
    of a source needs only those of the parts before it.  Each hold and each
    release then has its stretch of all kobo held; where two stretches overlap,
    that much is applied.  The stretches meet in one more pass in order, in
    which each row looks back to the last hold and the last release.
    """
    events = holds.select("source", F.col("withheld_at").alias("at"), F.lit(0).alias("turn"), F.col("inflow_key").alias("name"), F.col("withheld_kobo").alias("kobo")).unionByName(
        releases.select("source", "at", F.lit(1).alias("turn"), F.col("released_by").alias("name"), F.col("amount_kobo").alias("kobo"))
    )
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    e = _in_parts(events.where("kobo > 0"), "at", "turn", "name")
    so_far = Window.partitionBy("source", "part").orderBy("at", "turn", "name").rowsBetween(Window.unboundedPreceding, 0)
    held = F.when(F.col("turn") == 0, F.col("kobo")).otherwise(0)
    e = e.withColumn("sum", F.sum(2 * held - F.col("kobo")).over(so_far)).withColumn("held", F.sum(held).over(so_far))
    part = e.groupBy("source", "part").agg(F.max_by("sum", F.struct("at", "turn", "name")).alias("total"), F.min("sum").alias("low"), F.max("held").alias("all_held"))
    part = part.withColumn("sum_before", F.coalesce(F.sum("total").over(earlier), F.lit(0))).withColumn("held_before", F.coalesce(F.sum("all_held").over(earlier), F.lit(0)))
    part = part.withColumn("low_before", F.least(F.lit(0), F.min(F.col("sum_before") + F.col("low")).over(earlier)))
    x = e.join(part.select("source", "part", "sum_before", "held_before", "low_before"), ["source", "part"])
    low = lambda till: F.least("low_before", F.min(F.col("sum_before") + F.col("sum")).over(so_far.rowsBetween(Window.unboundedPreceding, till)))
    x = x.withColumn("low_now", low(0)).withColumn("low_then", F.coalesce(low(-1), F.col("low_before"))).withColumn("held", F.col("held_before") + F.col("held")).withColumn("sum", F.col("sum_before") + F.col("sum"))
    over = F.col("low_then") - F.col("low_now")
    # releases up to this one less the excess of all of them
    end = F.when(F.col("turn") == 0, F.col("held")).otherwise(F.col("held") - F.col("sum") + F.col("low_now"))
    x = staged(x.select("source", "turn", "name", (end - F.col("kobo") + F.when(F.col("turn") == 1, over).otherwise(0)).alias("start"), end.alias("end"), F.when(F.col("turn") == 1, over).otherwise(0).alias("over")))

    stretch = F.struct("start", "end", "name")
    y = _in_parts(x.where("start < end").select("source", "start", "turn", F.when(F.col("turn") == 0, stretch).alias("hold"), F.when(F.col("turn") == 1, stretch).alias("release")), "start", "turn")
    back = Window.partitionBy("source", "part").orderBy("start", "turn").rowsBetween(Window.unboundedPreceding, 0)
    carried = y.groupBy("source", "part").agg(F.max("hold").alias("hold"), F.max("release").alias("release"))
    carried = carried.select("source", "part", F.max("hold").over(earlier).alias("hold_before"), F.max("release").over(earlier).alias("release_before"))
    y = y.select("source", "part", "start", F.max("hold").over(back).alias("hold"), F.max("release").over(back).alias("release")).join(carried, ["source", "part"])
    y = y.select("source", "start", F.coalesce("hold", "hold_before").alias("hold"), F.coalesce("release", "release_before").alias("release"))
    used = F.least("hold.end", "release.end") - F.col("start")
    applied = y.where(F.col("hold").isNotNull() & F.col("release").isNotNull() & (used > 0)).select("source", F.col("release.name").alias("released_by"), F.col("hold.name").alias("inflow_key"), used.alias("applied_kobo"), F.lit(0).cast("long").alias("unapplied_kobo"))
    return applied.unionByName(x.where("over > 0").select("source", F.col("name").alias("released_by"), F.lit(None).cast("string").alias("inflow_key"), F.lit(0).cast("long").alias("applied_kobo"), F.col("over").alias("unapplied_kobo")))


def record_reserve_movement(inflows: DataFrame, release_days: int | None) -> tuple[DataFrame, DataFrame]:
    """Holds and releases that inflows' reserve sums cause: a positive sum is withheld, a negative one released."""
    due = F.lit(None).cast("timestamp") if release_days is None else F.col("at") + F.make_dt_interval(F.lit(release_days))
    holds = inflows.where("reserve_kobo > 0").select("inflow_key", "source", F.col("reserve_kobo").alias("withheld_kobo"), F.col("at").alias("withheld_at"), due.alias("due_at"))
    return holds, inflows.where("reserve_kobo < 0").select("source", "at", F.col("inflow_key").alias("released_by"), (-F.col("reserve_kobo")).alias("amount_kobo"))


def unreleased_reserves(positions: DataFrame, as_of: F.Column) -> DataFrame:
    """Holds past due with something outstanding."""
    return positions.where((F.col("due_at") < as_of) & (F.col("outstanding_kobo") > 0)).select("inflow_key", "source", "outstanding_kobo", F.lit("RESERVE_UNRELEASED").alias("reason"))


def bank_position(lines: DataFrame, ledger_kobo: DataFrame) -> DataFrame:
    """Closing balance of the last statement line with one, beside the ledger's balance (bank_account_id, ledger_kobo)."""
    last = lines.where("balance_after_kobo is not null").groupBy("bank_account_id").agg(F.max_by("balance_after_kobo", F.struct("value_date", "idempotency_key")).alias("statement_kobo"))
    return last.join(ledger_kobo, "bank_account_id", "left").fillna(0, ["ledger_kobo"]).withColumn("difference_kobo", F.col("statement_kobo") - F.col("ledger_kobo"))


def running_balance_breaks(lines: DataFrame) -> DataFrame:
    """Statement lines whose balance does not follow from the line before."""
    w = Window.partitionBy("bank_account_id").orderBy("value_date", "idempotency_key")
    moved = F.when(F.col("direction") == "credit", F.col("amount_kobo")).otherwise(-F.col("amount_kobo"))
    return lines.withColumn("expected_kobo", F.lag("balance_after_kobo").over(w) + moved).where("balance_after_kobo <> expected_kobo")
