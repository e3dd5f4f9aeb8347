"""Business calendars as a dimension table and deadlines as joins on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def edition_days(editions: DataFrame, days: DataFrame) -> DataFrame:
    """For each day (day) the edition in force: of those that cover it the highest revision, then the highest id; null where none does.

    editions: calendar_id, revision, covers_from, covers_to.  Editions are
    spread over the days that they cover, so the join is on equal days.
    """
    cover = editions.select("calendar_id", "revision", F.explode(F.sequence("covers_from", "covers_to")).alias("day"))
    best = cover.groupBy("day").agg(F.max(F.struct("revision", "calendar_id")).alias("e"))
    return days.join(best, "day", "left").select(*days.columns, F.col("e.calendar_id").alias("calendar_id"), F.col("e.revision").alias("revision"))


def deadline_provenance(deadlines: DataFrame, covered: DataFrame) -> DataFrame:
    """Adds editions (sorted ``id@revision``) and fully_covered to rows with local_day and due_day.

    ``covered`` is a result of ``edition_days`` (a few thousand days).  The days
    of each distinct span are looked up once, however many rows have it.
    """
    spans = deadlines.select("local_day", "due_day").distinct()
    name = F.when(F.col("revision").isNotNull(), F.concat_ws("@", "calendar_id", "revision"))
    each = spans.withColumn("day", F.explode(F.sequence("local_day", "due_day"))).join(F.broadcast(covered.select("day", name.alias("edition"))), "day", "left")
    per = each.groupBy("local_day", "due_day").agg(F.array_sort(F.collect_set("edition")).alias("editions"), (F.count("edition") == F.count("*")).alias("fully_covered"))
    return deadlines.join(per, ["local_day", "due_day"])


def calendar_dim(spark: SparkSession, first: str, last: str, holidays: list[str], weekend: tuple[int, ...] = (0, 6)) -> DataFrame:
    """(day, open, ordinal): ordinal counts the business days up to and with ``day``.  Days without an edition count as business days."""
    days = spark.sql(f"select explode(sequence(date '{first}', date '{last}')) as day")
    free = (F.dayofweek("day") - 1).isin(*weekend) | F.col("day").cast("string").isin(*holidays)
    # one row per day of some years: a few thousand at most
    return days.withColumn("open", ~free).withColumn("ordinal", F.sum(F.col("open").cast("int")).over(Window.orderBy("day")))


def local_minutes(at: Column, zone: str) -> tuple[Column, Column]:
    """Local day and minutes since local midnight."""
    here = F.from_utc_timestamp(at, zone)
    return F.to_date(here), F.hour(here) * 60 + F.minute(here)


def settlement_deadline(payments: DataFrame, dim: DataFrame, at: str, zone: str, cut_off_minutes: int, business_days: int, grace_minutes: int) -> DataFrame:
    """Adds effective_day, due_at and escalates_at.

    From the cut-off on the next day counts; a closed day rolls forward; then
    so many business days follow.  A day outside the dimension gives nulls.
    """
    day, minutes = local_minutes(F.col(at), zone)
    start = F.when(minutes >= cut_off_minutes, F.date_add(day, 1)).otherwise(day)
    small = F.broadcast(dim)  # a few thousand days
    opens = F.broadcast(dim.where("open").select(F.col("ordinal").alias("o"), F.col("day").alias("effective_day")))
    due = F.broadcast(dim.where("open").select(F.col("ordinal").alias("p"), F.col("day").alias("due_day")))
    out = payments.withColumn("_start", start).join(small.select(F.col("day").alias("_start"), "open", "ordinal"), "_start", "left")
    out = out.withColumn("o", F.col("ordinal") + F.when(F.col("open"), 0).otherwise(1)).join(opens, "o", "left")
    out = out.withColumn("p", F.col("o") + business_days).join(due, "p", "left")
    local = F.col("due_day").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(cut_off_minutes))
    out = out.withColumn("due_at", F.to_utc_timestamp(local, zone))
    return out.withColumn("escalates_at", F.col("due_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(grace_minutes))).drop("_start", "open", "ordinal", "o", "p")


def is_overdue(as_of: Column) -> Column:
    """Strictly later than deadline and grace."""
    return as_of > F.col("escalates_at")
