"""A reconciliation run as one plan: price, allocate, confirm, queue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calendar, confirmation, fees, payouts, sequential
from ..operators.graph import staged


@dataclass
class Run:
    """The deltas of a run; nothing is written until the caller does."""

    allocations: DataFrame
    confirmations: DataFrame
    exceptions: DataFrame
    #: Debits that took a banked inflow back.
    returned: DataFrame
    #: What is put off: promises not due yet or partly paid, inflows that the bank may still credit.
    deferred: DataFrame


def promises_for(entries: DataFrame, promises: DataFrame, allocations: DataFrame, dim: DataFrame, zone: str, cut_off: int, days: int, grace: int, contracts: DataFrame | None = None) -> DataFrame:
    """Open promises with what they are owed, when they escalate and, with ``contracts``, the terms by which their fees are predicted."""
    from ..operators.ledger import open_promises

    owed = open_promises(entries, allocations).select("transaction_id", F.col("outstanding_kobo").alias("owed_kobo"))
    due = calendar.settlement_deadline(promises.join(owed, "transaction_id"), dim, "occurred_at", zone, cut_off, days, grace)
    if contracts is not None:
        due = fees.contract_asof(due, contracts, "transaction_id", "occurred_at")
    kept = [c for c in ("state", "contract") if c in due.columns]
    return due.select("source", "transaction_id", "owed_kobo", "occurred_at", "escalates_at", *kept)


_TAKEN = ("PAYOUT_MATCH", "PARTIAL_PAYOUT_MATCH", "RESERVE_RELEASED")


def reconcile(promises: DataFrame, payout_rows: DataFrame, adjustments: DataFrame, bank_lines: DataFrame, allowance: int, banked: DataFrame | None = None, as_of: F.Column | None = None, pairs: bool = True, grace_days: int = 3) -> Run:
    """Allocates promises to payouts, confirms the payouts' inflows by bank lines and says what becomes of all that is left.

    Promises with a ``contract`` are retried by what they come to after
    predicted fees.  ``banked`` are inflows that earlier runs confirmed, so that
    a second credit or a return is known; without ``as_of`` nothing is overdue.
    """
    ready = payouts.payout_arithmetic(payout_rows, adjustments, "source", "gross_kobo", "expected_net_kobo", "value_date").drop("unexplained_kobo", "consistent")
    promises = staged(promises)
    allocated = staged(sequential.allocate(promises, ready))  # read by each step below
    taken = allocated.where(F.col("reason").isin(*_TAKEN)).select("payout_reference").distinct()
    due = F.col("value_date") + F.make_dt_interval(F.lit(grace_days))
    inflows = ready.join(taken, "payout_reference", "left_semi").select(F.col("payout_reference").alias("inflow_key"), "expected_net_kobo", "value_date", due.alias("escalates_at"), F.lit(allowance).cast("long").alias("allowance_kobo"), F.lit(pairs).alias("pairs"))
    spark = promises.sparkSession
    before = spark.range(0).select(F.col("id").cast("string").alias("inflow_key"), F.col("id").alias("credited_kobo")) if banked is None else banked
    now = F.lit(None).cast("timestamp") if as_of is None else as_of
    bank = staged(confirmation.bank_stage(inflows, bank_lines, before, now))

    bad = allocated.where("reason in ('PAYOUT_UNBALANCED', 'BATCH_TOO_LARGE', 'PHANTOM_CREDIT')").select(F.lit("payout").alias("subject"), F.col("payout_reference").alias("subject_id"), "reason")
    of_bank = bank.select(F.when(F.col("subject") == "credit", "bank_credit").otherwise(F.col("subject")).alias("subject"), F.coalesce("idempotency_key", "inflow_key").alias("subject_id"), "reason", "deferred")
    loose = of_bank.where("reason in ('AMOUNT_MISMATCH', 'DUPLICATE_BANK_CREDIT', 'UNIDENTIFIED_CREDIT', 'MISSING_SETTLEMENT')")
    exceptions, deferred = bad.unionByName(loose.drop("deferred")), of_bank.where("deferred").drop("deferred")
    if "state" in promises.columns:
        claims = allocated.where("transaction_id is not null").select("transaction_id", "amount_kobo")
        rest = staged(sequential.leftovers(promises, claims, now).select(F.lit("promise").alias("subject"), F.col("transaction_id").alias("subject_id"), "reason", "deferred"))
        exceptions, deferred = exceptions.unionByName(rest.where("not deferred").drop("deferred")), deferred.unionByName(rest.where("deferred").drop("deferred"))
    confirmed = bank.where("reason in ('BANK_CONFIRMED', 'BANK_CHARGE')").select("idempotency_key", "inflow_key", "how")
    return Run(allocated, confirmed, exceptions, bank.where("reason = 'RETURNED_PAYOUT'").select("idempotency_key", "inflow_key"), deferred)
