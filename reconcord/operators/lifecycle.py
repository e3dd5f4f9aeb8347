"""The life of exceptions and anomalies: drafts, moves, recurrences, as rows to append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .queue import anomaly_severity
from .reads import reason_kind

#: Moves that an exception or anomaly may make.
MOVES = (("open", "acknowledged"), ("open", "resolved"), ("acknowledged", "resolved"), ("acknowledged", "open"), ("resolved", "open"))


def draft_from(results: DataFrame) -> DataFrame:
    """Drafts of the results that are exceptions and name a subject: adds subject and subject_id.

    results: reason and arrays bank_credit_keys, payout_references,
    settlement_keys, transaction_ids.  Which link is the subject depends on the
    reason; a result without that link makes no draft.
    """
    first = lambda c: F.get(F.col(c), F.lit(0))
    one = lambda kind, c: F.when(first(c).isNotNull(), F.struct(F.lit(kind).alias("subject"), first(c).alias("subject_id")))
    credit, payout, line, transaction = one("bank_credit", "bank_credit_keys"), one("payout", "payout_references"), one("settlement_line", "settlement_keys"), one("transaction", "transaction_ids")
    subject = (
        F.when(F.col("reason").isin("UNIDENTIFIED_CREDIT", "DUPLICATE_BANK_CREDIT"), credit).when(F.col("reason").isin("RETURNED_PAYOUT", "PAYOUT_UNBALANCED"), payout)
        .when(F.col("reason") == "MISSING_SETTLEMENT", F.coalesce(transaction, payout)).otherwise(F.coalesce(credit, payout, line, transaction))
    )
    own = results.where(reason_kind(F.col("reason")) == "exception").withColumn("_s", subject).where("_s is not null")
    return own.select(*results.columns, "_s.subject", "_s.subject_id")


def collision_draft(collisions: DataFrame) -> DataFrame:
    """Drafts of bank lines that collide (idempotency_key, arriving_kobo, arriving_evidence, stored_kobo, stored_evidence)."""
    return collisions.select(
        F.lit("bank_credit").alias("subject"), F.col("idempotency_key").alias("subject_id"), F.lit("BANK_LINE_COLLISION").alias("reason"), F.col("arriving_kobo").alias("amount_kobo"),
        F.col("arriving_evidence").alias("evidence_id"), F.col("stored_evidence").alias("candidate_id"), (F.col("arriving_kobo") - F.col("stored_kobo")).alias("difference_kobo"), F.lit("already_claimed").alias("rejected_because"),
    )


def may_move(before: Column, after: Column) -> Column:
    ok = F.lit(False)
    for a, b in MOVES:
        ok = ok | ((before == a) & (after == b))
    return ok


def move(view: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Events to append for requests (key, to, actor, at): those whose item exists and may make the move; of several for one item the earliest.

    Adds from_state.  A request for the state that an item has, or for one that no arc leads to, makes nothing.
    """
    first = requests.groupBy(key).agg(F.min(F.struct("at", "to", "actor")).alias("r")).select(key, "r.*")
    both = first.join(view.select(key, F.col("to_state").alias("from_state")), key)
    return both.where(may_move(F.col("from_state"), F.col("to"))).select(key, "from_state", "to", "actor", "at")


def record_anomalies(view: DataFrame, seen: DataFrame) -> DataFrame:
    """Events to append for anomalies seen (anomaly_key, ...): what each is (raised, recurring or reopened), its state before and after.

    One that somebody has acknowledged stays acknowledged; any other is open.
    """
    both = seen.join(view.select("anomaly_key", F.col("to_state").alias("from_state")), "anomaly_key", "left")
    effect = F.when(F.col("from_state").isNull(), "raised").when(F.col("from_state") == "resolved", "reopened").otherwise("recurring")
    return both.withColumn("effect", effect).withColumn("to_state", F.when(F.col("from_state") == "acknowledged", "acknowledged").otherwise("open"))


def open_anomalies(history: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` anomalies first seen longest ago that are not resolved, the severest first."""
    oldest = history.where("to_state <> 'resolved'").orderBy("first_seen", "anomaly_key").limit(limit)
    return oldest.withColumn("severity", anomaly_severity(F.col("kind"), F.col("occurrences") / F.col("rows_in_file"))).orderBy(F.desc("severity"), "first_seen", "anomaly_key")


def inbox_originals(deliveries: DataFrame, before: Column, limit: int) -> DataFrame:
    """The next ``limit`` deliveries to reduce: originals received before a cut-off, oldest first."""
    return deliveries.where((F.col("content") == "original") & (F.col("received_at") < before)).orderBy("received_at", "delivery_id").limit(limit)
