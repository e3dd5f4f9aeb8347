"""The double-entry ledger: balances, invariants, states, postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accounts and their natural signs.
ACCOUNTS = {
    "psp_receivable": 1, "bank_account": 1, "psp_reserve": 1, "taxes_withheld": 1, "penalties": 1, "bank_charges": 1, "fees_expense": 1,
    "merchant_revenue": -1, "reversals": 1, "chargebacks": 1, "suspense": 1,
}
#: Allowed changes of a transaction's state.
ARCS = (("authorized", "settled"), ("authorized", "reversed"), ("authorized", "exception"), ("exception", "settled"), ("exception", "reversed"))


def all_balances(entries: DataFrame) -> DataFrame:
    """Balance of each account, zero where it has no entry."""
    accounts = entries.sparkSession.createDataFrame(list(ACCOUNTS.items()), "account_id string, natural_sign int")
    sums = entries.groupBy("account_id").agg(F.sum("amount_kobo").alias("balance_kobo"))
    return accounts.join(sums, "account_id", "left").select("account_id", F.coalesce("balance_kobo", F.lit(0)).cast("long").alias("balance_kobo"))


def verify_conservation(entries: DataFrame) -> DataFrame:
    """Transactions whose entries do not sum to zero or mix currencies."""
    per = entries.groupBy("transaction_id").agg(F.sum("amount_kobo").alias("sum_kobo"), F.min("currency").alias("lo"), F.max("currency").alias("hi"))
    return per.where((F.col("sum_kobo") != 0) | (F.col("lo") != F.col("hi"))).select("transaction_id", "sum_kobo", (F.col("lo") != F.col("hi")).alias("mixed"))


def verify_balances(cached: DataFrame, entries: DataFrame) -> DataFrame:
    """Accounts whose cached balance differs from the sum of their entries; a missing side counts as zero."""
    now = entries.groupBy("account_id").agg(F.sum("amount_kobo").alias("actual_kobo"))
    both = cached.select("account_id", F.col("balance_kobo").alias("cached_kobo")).join(now, "account_id", "full_outer").fillna(0, ["cached_kobo", "actual_kobo"])
    return both.where("cached_kobo <> actual_kobo")


projection_drift = verify_balances


def latest(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """For each key the named columns of its row with the largest order; partial sums keep one row a key and task."""
    return df.groupBy(key).agg(F.max_by(F.struct(order, *columns), order).alias("x")).select(key, "x.*")


def open_promises(entries: DataFrame, allocations: DataFrame) -> DataFrame:
    """Transactions with something receivable: gross, allocated, outstanding."""
    gross = entries.where("account_id = 'psp_receivable'").groupBy("transaction_id").agg(F.sum("amount_kobo").alias("gross_kobo")).where("gross_kobo > 0")
    used = allocations.groupBy("transaction_id").agg(F.sum("amount_kobo").alias("allocated_kobo"))
    both = gross.join(used, "transaction_id", "left").fillna(0, ["allocated_kobo"])
    return both.withColumn("outstanding_kobo", F.col("gross_kobo") - F.col("allocated_kobo")).where("outstanding_kobo > 0")


def over_allocation(entries: DataFrame, allocations: DataFrame) -> DataFrame:
    """Transactions to which more was allocated than is receivable."""
    gross = entries.where("account_id = 'psp_receivable'").groupBy("transaction_id").agg(F.sum("amount_kobo").alias("receivable_kobo"))
    used = allocations.groupBy("transaction_id").agg(F.sum("amount_kobo").alias("allocated_kobo"))
    return used.join(gross, "transaction_id", "left").fillna(0, ["receivable_kobo"]).where("allocated_kobo > receivable_kobo").select("transaction_id", "receivable_kobo", "allocated_kobo")


def fold_balances(events: DataFrame) -> DataFrame:
    """Balances from an event log whose rows carry arrays of (account_id, kobo)."""
    return events.select(F.explode("entries").alias("e")).groupBy("e.account_id").agg(F.sum("e.kobo").alias("balance_kobo"))


def illegal_transitions(changes: DataFrame, key: str, order: str, state: str, arcs: tuple[tuple[str, str], ...] = ARCS) -> DataFrame:
    """Changes of state that no arc allows; a repeat of the same state is no change."""
    w = Window.partitionBy(key).orderBy(order)
    step = changes.withColumn("from_state", F.lag(state).over(w)).where(F.col("from_state").isNotNull() & (F.col("from_state") != F.col(state)))
    ok = F.lit(False)
    for a, b in arcs:
        ok = ok | ((F.col("from_state") == a) & (F.col(state) == b))
    return step.where(~ok)


#: States that nothing follows.
TERMINAL = ("settled", "reversed")


def apply_transitions(states: DataFrame, requests: DataFrame) -> DataFrame:
    """What each request for a change of state does: transitioned, unchanged, refused, or unknown for want of a transaction.

    states: transaction_id, state; requests: transaction_id, to_state, at,
    caused_by, which take effect in this order of at, caused_by (null first)
    and to_state; equal requests count once.  The rows that transitioned are
    those to append to the changes of state.

    A transaction's state before a request follows from its first terminal
    request and its first escalation, so no task folds a transaction's requests.
    """
    r = requests.select("transaction_id", "to_state", "at", "caused_by").distinct().withColumn("_at", F.struct("at", F.coalesce("caused_by", F.lit("")), "to_state"))
    first = r.groupBy("transaction_id").agg(F.min(F.when(F.col("to_state").isin(*TERMINAL), F.col("_at"))).alias("_ended"), F.min(F.when(F.col("to_state") == "exception", F.col("_at"))).alias("_lifted"))
    both = r.join(first, "transaction_id").join(states.select("transaction_id", "state"), "transaction_id", "left")
    lifted = (F.col("state") == "authorized") & F.coalesce(F.col("_lifted") < F.col("_at"), F.lit(False))
    was = F.when(F.col("state").isNull() | F.col("state").isin(*TERMINAL), F.col("state")).when(F.col("_ended") < F.col("_at"), F.col("_ended.to_state")).when(lifted, "exception").otherwise(F.col("state"))
    legal = F.concat_ws(">", "from_state", "to_state").isin(*[f"{a}>{b}" for a, b in ARCS])
    what = F.when(F.col("from_state").isNull(), "unknown").when(F.col("from_state") == F.col("to_state"), "unchanged").when(legal, "transitioned").otherwise("refused")
    return both.withColumn("from_state", was).select("transaction_id", "from_state", "to_state", "at", "caused_by", what.alias("outcome"))


def discharge_requests(discharged: DataFrame) -> DataFrame:
    """Requests to settle the promises (promise_id) that a confirmation (transaction_id) discharges whole; a part leaves the promise waiting."""
    return discharged.where("kobo = receivable_kobo").select(F.col("promise_id").alias("transaction_id"), F.lit("settled").alias("to_state"), "at", F.col("transaction_id").alias("caused_by"))


def reversal_requests(reversals: DataFrame, suffix: str = "#reversal") -> DataFrame:
    """Requests to reverse the transactions whose whole receivable is given back."""
    return reversals.where("amount_kobo = receivable_kobo and amount_kobo > 0").select("transaction_id", F.lit("reversed").alias("to_state"), "at", F.concat("transaction_id", F.lit(suffix)).alias("caused_by"))


def _legs(df: DataFrame, *legs: tuple[str, Column]) -> DataFrame:
    """Entries of each transaction; legs of zero are left out."""
    made = F.array(*[F.struct(F.lit(a).alias("account_id"), amount.cast("long").alias("amount_kobo")) for a, amount in legs])
    x = df.select("transaction_id", F.posexplode(F.filter(made, lambda e: e["amount_kobo"] != 0)).alias("ordinal", "e"))
    return x.select("transaction_id", F.concat_ws("#", "transaction_id", "ordinal").alias("entry_id"), "ordinal", "e.account_id", "e.amount_kobo", F.lit("NGN").alias("currency"))


def book_authorized(payments: DataFrame) -> DataFrame:
    """Entries of successful payments: receivable against revenue."""
    return _legs(payments.where("status = 'SUCCESSFUL'"), ("psp_receivable", F.col("gross_kobo")), ("merchant_revenue", -F.col("gross_kobo")))


def book_reversal(reversals: DataFrame) -> DataFrame:
    """Entries of reversals (amount_kobo of receivable_kobo); amounts outside (0, receivable] are refused."""
    return _legs(reversals.where("amount_kobo > 0 and amount_kobo <= receivable_kobo"), ("reversals", F.col("amount_kobo")), ("psp_receivable", -F.col("amount_kobo")))


def book_chargeback(chargebacks: DataFrame) -> DataFrame:
    return _legs(chargebacks.where("amount_kobo > 0"), ("chargebacks", F.col("amount_kobo")), ("bank_account", -F.col("amount_kobo")))


def book_bank_confirmed(confirmations: DataFrame, deductions: DataFrame, discharged: DataFrame) -> DataFrame:
    """Entries of confirmations (transaction_id, credited_kobo) with their deductions (transaction_id, account_id, kobo) and discharged promises (transaction_id, promise_id, kobo).

    Refused: nothing discharged, a negative credit, or a remainder that the parts do not explain.
    """
    cut = deductions.groupBy("transaction_id").agg(F.sum("kobo").alias("cut"))
    owed = discharged.groupBy("transaction_id").agg(F.sum("kobo").alias("owed"))
    good = confirmations.join(owed, "transaction_id").join(cut, "transaction_id", "left").fillna(0, ["cut"]).where("credited_kobo >= 0 and credited_kobo + cut = owed")
    legs = good.select("transaction_id", F.lit("bank_account").alias("account_id"), F.col("credited_kobo").alias("amount_kobo"))
    legs = legs.unionByName(deductions.join(good, "transaction_id", "left_semi").groupBy("transaction_id", "account_id").agg(F.sum("kobo").alias("amount_kobo")))
    legs = legs.unionByName(good.select("transaction_id", F.lit("psp_receivable").alias("account_id"), (-F.col("owed")).alias("amount_kobo")))
    return legs.where("amount_kobo <> 0")


def book_reserve_release(releases: DataFrame) -> DataFrame:
    """Entries of reserve releases: bank against reserve; credit and returned amount must agree."""
    return _legs(releases.where("credited_kobo > 0 and credited_kobo + returned_kobo = 0"), ("bank_account", F.col("credited_kobo")), ("psp_reserve", F.col("returned_kobo")))


def negate(entries: DataFrame, suffix: str) -> DataFrame:
    """The exact opposite of whole transactions, as for returned payouts and reversals."""
    return entries.withColumn("transaction_id", F.concat("transaction_id", F.lit(suffix))).withColumn("amount_kobo", -F.col("amount_kobo"))


def book_resolution(resolutions: DataFrame) -> DataFrame:
    """Entries of human decisions; those that touch the bank account or lack an approver other than the resolver are refused."""
    ok = resolutions.where("account_id <> 'bank_account' and approver is not null and approver <> resolver")
    whole = resolutions.groupBy("transaction_id").agg(F.count("*").alias("n")).join(ok.groupBy("transaction_id").agg(F.count("*").alias("n")), ["transaction_id", "n"])
    return ok.join(whole, "transaction_id", "left_semi")


def append_if_absent(new: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """Rows to append: keys not there yet, of repeats the first by ``order``."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    return first.join(existing.select(key), key, "left_anti")


def post_transactions(entries: DataFrame, existing: DataFrame) -> DataFrame:
    """Entries to append: of balanced, single-currency transactions that are not posted yet."""
    bad = verify_conservation(entries).select("transaction_id")
    return entries.join(bad, "transaction_id", "left_anti").join(existing.select("transaction_id").distinct(), "transaction_id", "left_anti")
