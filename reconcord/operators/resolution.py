"""A person's decision on an exception: the decision, its entries and the closing row together, or none of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .queue import approval_failure


@dataclass
class Resolved:
    """Rows to append, and the decisions that were refused with ``failure``."""

    accepted: DataFrame
    entries: DataFrame
    closing: DataFrame
    refused: DataFrame


def resolve(view: DataFrame, decisions: DataFrame, entries: DataFrame) -> Resolved:
    """Takes decisions whole: the first of an exception, by ``at`` and decision_id, that nothing forbids.

    decisions: decision_id (unique), exception_key, action, amount_kobo,
    resolver, approver, approved_at, at.  entries: decision_id, account_id,
    amount_kobo, currency.  Refused are decisions on no exception or a resolved
    one, those that ``approval_failure`` names, entries that touch the bank
    account, are zero, null or not balanced in one currency, and later
    decisions on an exception that this call closes.
    """
    booked = entries.groupBy("decision_id").agg(
        F.sum("amount_kobo").alias("_sum"), F.count_distinct("currency").alias("_currencies"), F.max(F.coalesce(F.col("account_id") == "bank_account", F.lit(True))).alias("_bank"),
        F.max(F.coalesce(F.col("amount_kobo") == 0, F.lit(True)) | F.col("currency").isNull()).alias("_void"),
    )
    own = decisions.join(booked, "decision_id", "left").join(view.select("exception_key", F.col("to_state").alias("from_state")), "exception_key", "left")
    asked = approval_failure(own.withColumn("books_entries", F.col("_sum").isNotNull() | F.col("_void").isNotNull())).withColumnRenamed("failure", "_forbidden")
    failure = (
        F.when(F.col("from_state").isNull(), "no such exception").when(F.col("from_state") == "resolved", "already resolved").when(F.col("_forbidden").isNotNull(), F.col("_forbidden"))
        .when(F.col("_bank"), "touches the bank").when(F.col("_void"), "void entry").when((F.col("_sum") != 0) | (F.col("_currencies") > 1), "unbalanced")
    )
    w = Window.partitionBy("exception_key", F.col("failure").isNull()).orderBy("at", "decision_id")
    told = asked.withColumn("failure", failure).withColumn("_n", F.row_number().over(w))
    told = told.withColumn("failure", F.when(F.col("failure").isNull() & (F.col("_n") > 1), "already resolved").otherwise(F.col("failure")))
    good = told.where("failure is null")
    closing = good.select("exception_key", "from_state", F.lit("resolved").alias("to_state"), F.col("resolver").alias("actor"), "at", "decision_id")
    return Resolved(good.select(decisions.columns), entries.join(good.select("decision_id"), "decision_id", "left_semi"), closing, told.where("failure is not null").select("decision_id", "failure"))
