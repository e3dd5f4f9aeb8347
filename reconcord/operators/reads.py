"""Reads of the ledger, its log and the store: joins, pages and counts over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import latest

#: What each reason says of a conclusion; all others are exceptions.
MATCHES = ("EXACT_MATCH", "FEE_ADJUSTED_MATCH", "BATCH_MATCH", "PAYOUT_MATCH", "BANK_CONFIRMED")
EXPLANATIONS = (
    "FEE_VARIANCE", "AWAITING_BANK_CREDIT", "PARTIAL_SETTLEMENT", "RESERVE_WITHHELD", "RESERVE_RELEASED", "TAX_WITHHELD", "PENALTY", "BANK_CHARGE",
    "REVERSAL", "PARTIAL_REVERSAL", "CHARGEBACK", "PARTIAL_CHARGEBACK", "PENDING_T_PLUS_N", "FX_ROUNDING",
)


def reason_kind(reason: Column) -> Column:
    return F.when(reason.isin(*MATCHES), "match").when(reason.isin(*EXPLANATIONS), "explanation").otherwise("exception")


def transactions_read(transactions: DataFrame, state_changes: DataFrame, entries: DataFrame) -> DataFrame:
    """Transactions with their latest state and their entries in order, as an array of (ordinal, account_id, amount_kobo)."""
    state = latest(state_changes, "transaction_id", "change_id", "to_state").select("transaction_id", F.col("to_state").alias("state_now"))
    legs = entries.groupBy("transaction_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "account_id", "amount_kobo"))).alias("entries"))
    return transactions.join(state, "transaction_id", "left").join(legs, "transaction_id", "left")


def event_page(events: DataFrame, after: int, limit: int, sequence: str = "sequence") -> DataFrame:
    """The next ``limit`` events behind a sequence number, in order; a page keeps just its rows in each task."""
    return events.where(F.col(sequence) > after).orderBy(sequence).limit(limit)


def genesis(entries: DataFrame) -> DataFrame:
    """One opening event with the balance of each account that is not zero, and the number of transactions; nothing without entries."""
    total = entries.groupBy("account_id").agg(F.sum("amount_kobo").alias("kobo"))
    opening = total.agg(F.sort_array(F.collect_list(F.when(F.col("kobo") != 0, F.struct("account_id", "kobo")))).alias("entries"), F.count("*").alias("n"))
    counted = entries.agg(F.count_distinct("transaction_id").alias("transactions"))
    return opening.where("n > 0").crossJoin(counted).select(F.lit("LedgerOpened").alias("type"), F.lit("genesis").alias("subject"), "entries", "transactions")  # one row with one row


def open_inflows(inflows: DataFrame, lines: DataFrame) -> DataFrame:
    """Inflows not confirmed yet, with the keys of the settlement lines of their payout."""
    waiting = inflows.where("confirmed_by is null")
    own = lines.where("payout_reference is not null").groupBy(F.col("payout_reference").alias("inflow_key")).agg(F.sort_array(F.collect_list("idempotency_key")).alias("settlement_keys"))
    return waiting.join(own, "inflow_key", "left").withColumn("settlement_keys", F.coalesce("settlement_keys", F.array().cast("array<string>")))


def discharges(inflow_keys: DataFrame, allocations: DataFrame, shares: DataFrame) -> DataFrame:
    """What each allocation of the given inflows discharges: its amount, its deductions and its net.

    shares: inflow_key, transaction_id, account_id, share_kobo.
    """
    cut = shares.groupBy("inflow_key", "transaction_id").agg(F.sum("share_kobo").alias("cut_kobo"))
    out = allocations.join(inflow_keys.select("inflow_key").distinct(), "inflow_key", "left_semi").join(cut, ["inflow_key", "transaction_id"], "left").fillna(0, ["cut_kobo"])
    return out.select("inflow_key", "transaction_id", "amount_kobo", "cut_kobo", (F.col("amount_kobo") - F.col("cut_kobo")).alias("net_kobo"))


def evidence_state(evidence: DataFrame, blobs: DataFrame) -> DataFrame:
    """Evidence with whether its bytes are held, purged or were never stored (blobs: evidence_id, content, purged)."""
    held = F.when(F.col("purged").isNull(), "absent").when(F.col("purged"), "purged").otherwise("held")
    return evidence.join(blobs.select("evidence_id", "content", "purged"), "evidence_id", "left").withColumn("bytes", held)


def banked_total(entries: DataFrame, transactions: DataFrame, start: Column, end: Column, account: str = "bank_account") -> DataFrame:
    """Transactions and sum of the account's entries recorded in [start, end); one row."""
    recorded = transactions.where((F.col("recorded_at") >= start) & (F.col("recorded_at") < end)).select("transaction_id")
    own = entries.where(F.col("account_id") == account).join(recorded, "transaction_id", "left_semi")
    return own.agg(F.count_distinct("transaction_id").alias("transactions"), F.coalesce(F.sum("amount_kobo"), F.lit(0)).cast("long").alias("credited_kobo"))


def last_attestation(attestations: DataFrame) -> DataFrame:
    """The latest attestation of each bank account, of equal instants the one recorded last."""
    x = attestations.groupBy("bank_account_id").agg(F.max_by(F.struct("as_of", "portal_kobo", "ledger_kobo", "attestation_id"), F.struct("as_of", "attestation_id")).alias("x"))
    return x.select("bank_account_id", "x.*").withColumn("difference_kobo", F.col("portal_kobo") - F.col("ledger_kobo"))


def run_window(loaded: dict[str, DataFrame], limit: int) -> DataFrame:
    """(relation, loaded, truncated) of a run that loads at most ``limit`` rows of each relation."""
    out = None
    for name, df in loaded.items():
        one = df.limit(limit).agg(F.count("*").alias("loaded")).select(F.lit(name).alias("relation"), "loaded", (F.col("loaded") >= limit).alias("truncated"))
        out = one if out is None else out.unionByName(one)
    return out


def percentiles(samples: DataFrame, group: str, value: str) -> DataFrame:
    """Median and p95 of each group by rank: the sample at floor(n * share) in rising order, the last one at most.

    Equal samples are counted before they are sorted; the sort may spill.
    """
    per = samples.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    rising = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    seen = per.withColumn("seen", F.sum("n").over(rising)).withColumn("samples", F.sum("n").over(Window.partitionBy(group)))
    at = lambda share: F.least(F.col("samples") - 1, F.floor(F.col("samples") * share))
    hit = lambda share: F.max(F.when((F.col("seen") - F.col("n") <= at(share)) & (at(share) < F.col("seen")), F.col(value)))
    return seen.groupBy(group).agg(F.max("samples").alias("samples"), hit(0.5).alias("median"), hit(0.95).alias("p95"))


def confirm_inflows(inflows: DataFrame, confirmations: DataFrame) -> DataFrame:
    """``inflows`` after confirmations (inflow_key, credit_key, at): only those still open take one, of several the earliest; ``changed`` tells."""
    first = confirmations.groupBy("inflow_key").agg(F.min(F.struct("at", "credit_key")).alias("c"))
    both = inflows.join(first, "inflow_key", "left").withColumn("changed", F.col("confirmed_by").isNull() & F.col("c").isNotNull())
    return both.withColumn("confirmed_by", F.when(F.col("changed"), F.col("c.credit_key")).otherwise(F.col("confirmed_by"))).drop("c")


def payout_status(payouts: DataFrame, confirmed: DataFrame, returned: DataFrame) -> DataFrame:
    """Payouts after a run: reported ones with a confirmed inflow are confirmed, and confirmed ones that came back are returned."""
    mark = lambda df, c: df.select("payout_reference", F.lit(True).alias(c)).distinct()
    both = payouts.join(mark(confirmed, "_c"), "payout_reference", "left").join(mark(returned, "_r"), "payout_reference", "left")
    once = F.when((F.col("status") == "reported") & F.coalesce("_c", F.lit(False)), "confirmed").otherwise(F.col("status"))
    return both.withColumn("status", once).withColumn("status", F.when((F.col("status") == "confirmed") & F.coalesce("_r", F.lit(False)), "returned").otherwise(F.col("status"))).drop("_c", "_r")


def inconsistent_lines(lines: DataFrame) -> DataFrame:
    """Settlement lines whose gross less fee is not their net."""
    return lines.where("gross_kobo - fee_kobo <> net_kobo")


def summary_sections(matches: DataFrame, exceptions: DataFrame, inflows: DataFrame, start: Column, end: Column) -> DataFrame:
    """(section, name, n, kobo): conclusions by reason and totals by kind in [start, end), the open queue by reason and state, inflows that wait for a credit."""
    own = matches.where((F.col("happened_at") >= start) & (F.col("happened_at") < end))
    per = own.groupBy("reason").agg(F.count("*").alias("n")).withColumn("kobo", F.lit(None).cast("long"))
    kinds = per.groupBy(reason_kind(F.col("reason")).alias("name")).agg(F.sum("n").alias("n"))
    queue = exceptions.where("to_state <> 'resolved'").groupBy(F.concat_ws("/", "reason", "to_state").alias("name")).agg(F.count("*").alias("n"), F.coalesce(F.sum("amount_kobo"), F.lit(0)).cast("long").alias("kobo"))
    waiting = inflows.where("confirmed_by is null").agg(F.count("*").alias("n"), F.coalesce(F.sum("expected_net_kobo"), F.lit(0)).cast("long").alias("kobo"))
    part = lambda df, section, name: df.select(F.lit(section).alias("section"), name.alias("name"), "n", "kobo")
    out = part(per, "conclusion", F.col("reason")).unionByName(part(kinds.withColumn("kobo", F.lit(None).cast("long")), "kind", F.col("name")))
    return out.unionByName(part(queue, "queue", F.col("name"))).unionByName(part(waiting, "awaiting", F.lit("bank_credit")))
