"""Queries of the reads, the bookings and the queue's life, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money, protect
from ..operators import calendar, confirmation, fees, ledger, lifecycle, matching, payouts, queue, reads, reserves, resolution, retention, sequential
from ..operators.graph import shared
from ..sources import statements
from .queries import _ASOF, _FEE, _SHARES, _VIEW, AS_OF, MONEY, PAY, _concluded, _shares, query, stamp
from .views import with_staged

_TWO = "cross join (select 0 as p union all select 1) z"
_UNDO = "case when k % 10 = 0 then gross_kobo + 1 when k % 10 = 1 then 0 else gross_kobo // (k % 3 + 1) end"


def _legs_sql(source: str, first: str, second: str, sign: int = 1) -> str:
    return f"select transaction_id, transaction_id || '#' || p as entry_id, p as ordinal, case p when 0 then '{first}' else '{second}' end as account_id, case p when 0 then {sign} else {-sign} end * kobo as amount_kobo, 'NGN' as currency from {source} x {_TWO}"


def _undone(v) -> DataFrame:
    return v["promises"].withColumn("amount_kobo", F.expr(_UNDO.replace("//", "div"))).withColumn("receivable_kobo", F.col("gross_kobo"))


# bookings
@query(_legs_sql(f"(select transaction_id, cast({_UNDO} as bigint) as kobo from promises where {_UNDO} > 0 and {_UNDO} <= gross_kobo)", "reversals", "psp_receivable"), "promises")
def book_reversal(v):
    return ledger.book_reversal(_undone(v))


@query(_legs_sql(f"(select transaction_id, cast({_UNDO} as bigint) as kobo from promises where {_UNDO} > 0)", "chargebacks", "bank_account"), "promises")
def book_chargeback(v):
    return ledger.book_chargeback(_undone(v))


@query(_legs_sql("(select released_by as transaction_id, released_kobo as kobo from reserve_releases where released_kobo % 7 <> 0)", "bank_account", "psp_reserve"), *PAY, "reserve_releases")
def book_reserve_release(v):
    back = F.when(F.col("released_kobo") % 7 == 0, 1 - F.col("released_kobo")).otherwise(-F.col("released_kobo"))
    return ledger.book_reserve_release(v["reserve_releases"].select(F.col("released_by").alias("transaction_id"), F.col("released_kobo").alias("credited_kobo"), back.alias("returned_kobo")))


_KIND = "case kind when 'fee' then 'fees_expense' when 'tax' then 'taxes_withheld' else 'psp_reserve' end"


@query(f"""with d as (select payout_reference as transaction_id, {_KIND} as account_id, cast(sum(kobo) as bigint) as kobo from adjustments group by 1, 2), cut as (select transaction_id, sum(kobo) as cut from d group by 1),
owed as (select inflow_key as transaction_id, sum(amount_kobo) as owed from allocations group by 1),
good as (select transaction_id, cast(case when n % 3 = 0 then expected_net_kobo else owed - cut end as bigint) as credited, cut, cast(owed as bigint) as owed from (select payout_reference as transaction_id, n, expected_net_kobo from payouts) p join owed using (transaction_id) join cut using (transaction_id))
select transaction_id, account_id, amount_kobo from (select transaction_id, 'bank_account' as account_id, credited as amount_kobo, credited, cut, owed from good union all select transaction_id, account_id, kobo, credited, cut, owed from good join d using (transaction_id) union all select transaction_id, 'psp_receivable', -owed, credited, cut, owed from good) x
where credited >= 0 and credited + cut = owed and amount_kobo <> 0""", *PAY, "adjustments", "allocations")
def book_bank_confirmed(v):
    deductions = payouts.adjustment_entries(v["adjustments"]).select(F.col("payout_reference").alias("transaction_id"), "account_id", "kobo")
    discharged = v["allocations"].select(F.col("inflow_key").alias("transaction_id"), F.col("transaction_id").alias("promise_id"), F.col("amount_kobo").alias("kobo"))
    owed, cut = discharged.groupBy("transaction_id").agg(F.sum("kobo").alias("o")), deductions.groupBy("transaction_id").agg(F.sum("kobo").alias("c"))
    own = v["payouts"].withColumnRenamed("payout_reference", "transaction_id").join(owed, "transaction_id").join(cut, "transaction_id")
    confirmations = own.select("transaction_id", F.when(F.col("n") % 3 == 0, F.col("expected_net_kobo")).otherwise(F.col("o") - F.col("c")).alias("credited_kobo"))
    return ledger.book_bank_confirmed(confirmations, deductions, discharged)


@query("select transaction_id || '#returned' as transaction_id, ordinal, account_id, -amount_kobo as amount_kobo from entries where k % 11 = 0", *MONEY)
def book_returned(v):
    return ledger.negate(v["entries"].where("k % 11 = 0"), "#returned").select("transaction_id", "ordinal", "account_id", "amount_kobo")


_DECIDED = "(select transaction_id, ordinal, case when k % 9 = 0 and ordinal = 1 then 'bank_account' else account_id end as account_id, amount_kobo, 'u' || k % 5 as resolver, case when k % 4 <> 0 then 'u' || k % 7 end as approver from entries)"


@query(f"select transaction_id, ordinal, account_id, amount_kobo from {_DECIDED} d where transaction_id not in (select transaction_id from {_DECIDED} e where account_id = 'bank_account' or approver is null or approver = resolver)", *MONEY)
def book_resolution(v):
    own = v["entries"].withColumn("account_id", F.expr("case when k % 9 = 0 and ordinal = 1 then 'bank_account' else account_id end")).withColumn("resolver", F.expr("'u' || k % 5")).withColumn("approver", F.expr("case when k % 4 <> 0 then 'u' || k % 7 end"))
    return ledger.book_resolution(own).select("transaction_id", "ordinal", "account_id", "amount_kobo")


# reads
@query("""select p.transaction_id, s.to_state as state_now, e.legs from promises p
left join (select transaction_id, to_state from (select *, row_number() over (partition by transaction_id order by change_id desc) as rn from state_changes) x where rn = 1) s using (transaction_id)
left join (select transaction_id, string_agg(account_id || ':' || amount_kobo, ',' order by ordinal, account_id, amount_kobo) as legs from entries group by 1) e using (transaction_id)""", *MONEY, "state_changes")
def transactions_read(v):
    found = reads.transactions_read(v["promises"], v["state_changes"], v["entries"])
    return found.select("transaction_id", "state_now", F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["account_id"], e["amount_kobo"])), ",").alias("legs"))


@query("select transaction_id, change_id, to_state from state_changes where change_id > 1000 order by change_id limit 200", "promises", "state_changes")
def event_log_page(v):
    return reads.event_page(v["state_changes"], 1000, 200, "change_id").select("transaction_id", "change_id", "to_state")


@query("select 'genesis' as subject, string_agg(account_id || ':' || kobo, ',' order by account_id) as opening, (select count(distinct transaction_id) from entries) as transactions from (select account_id, cast(sum(amount_kobo) as bigint) as kobo from entries group by 1 having sum(amount_kobo) <> 0) x", *MONEY)
def genesis_snapshot(v):
    return reads.genesis(v["entries"]).select("subject", F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["account_id"], e["kobo"])), ",").alias("opening"), "transactions")


_OWN_LINES = "(select 'settlement:' || k as idempotency_key, 'p-' || source || '-' || cast(cast(occurred_at as date) as varchar(10)) as payout_reference from promises where k % 3 = 0)"


@query(f"select i.inflow_key, coalesce(string_agg(l.idempotency_key, ',' order by l.idempotency_key), '') as settlement_keys from inflows i left join {_OWN_LINES} l on l.payout_reference = i.inflow_key where i.confirmed_by is null group by 1", *PAY, "inflows")
def open_inflows(v):
    lines = v["promises"].where("k % 3 = 0").selectExpr("'settlement:' || k as idempotency_key", "'p-' || source || '-' || cast(cast(occurred_at as date) as string) as payout_reference")
    return reads.open_inflows(v["inflows"], lines).select("inflow_key", F.array_join("settlement_keys", ",").alias("settlement_keys"))


@query("select inflow_key, transaction_id, amount_kobo, cut as cut_kobo, amount_kobo - cut as net_kobo from (select a.*, cast((amount_kobo * 15) // 1000 + amount_kobo % 7 as bigint) as cut from allocations a join inflows i using (inflow_key) where i.n % 2 = 0) x", *PAY, "inflows", "allocations")
def discharges(v):
    shares = v["allocations"].select("inflow_key", "transaction_id", F.explode(F.array(F.struct(F.lit("fees_expense").alias("account_id"), F.expr("(amount_kobo * 15) div 1000").alias("share_kobo")), F.struct(F.lit("penalties").alias("account_id"), (F.col("amount_kobo") % 7).alias("share_kobo")))).alias("s")).select("inflow_key", "transaction_id", "s.*")
    return reads.discharges(v["inflows"].where("n % 2 = 0"), v["allocations"], shares)


@query("select e.evidence_id, e.kind, case when b.evidence_id is null then 'absent' when b.purged then 'purged' else 'held' end as bytes from evidence e left join (select * from evidence where principal <> 'u3') b using (evidence_id)", "evidence")
def evidence_state(v):
    e = v["evidence"]
    return reads.evidence_state(e.select("evidence_id", "kind"), e.where("principal <> 'u3'")).select("evidence_id", "kind", "bytes")


@query("select count(distinct e.transaction_id) as transactions, cast(coalesce(sum(amount_kobo), 0) as bigint) as credited_kobo from entries e join promises p using (transaction_id) where account_id = 'psp_receivable' and occurred_at >= timestamp '1996-01-01' and occurred_at < timestamp '1998-01-01'", *MONEY)
def banked_total(v):
    return reads.banked_total(v["entries"], v["promises"].withColumnRenamed("occurred_at", "recorded_at"), F.to_timestamp(F.lit("1996-01-01")), F.to_timestamp(F.lit("1998-01-01")), "psp_receivable")


@query("select bank_account_id, portal_kobo, ledger_kobo, portal_kobo - ledger_kobo as difference_kobo from (select *, row_number() over (partition by bank_account_id order by as_of desc, event_id desc) as rn from (select 'b' || user_id % 7 as bank_account_id, date_trunc('day', ts) as as_of, cast(round(value * 100) as bigint) as portal_kobo, event_id as ledger_kobo, event_id from events) y) x where rn = 1")
def last_attestation(v):
    own = v["events"].selectExpr("'b' || user_id % 7 as bank_account_id", "date_trunc('day', ts) as as_of", "cast(round(value * 100) as bigint) as portal_kobo", "event_id as ledger_kobo", "event_id as attestation_id")
    return reads.last_attestation(own).select("bank_account_id", "portal_kobo", "ledger_kobo", "difference_kobo")


@query("select 'promises' as relation, least(1000, count(*)) as loaded, count(*) >= 1000 as truncated from promises union all select 'payouts', least(1000, count(*)), count(*) >= 1000 from payouts union all select 'bank_lines', least(1000, count(*)), count(*) >= 1000 from bank_lines", *PAY, "bank_lines")
def run_window(v):
    return reads.run_window({k: v[k] for k in ("promises", "payouts", "bank_lines")}, 1000)


@query("select event_type, n as samples, max(case when i = least(n - 1, cast(floor(n * 0.5) as bigint)) then value end) as median, max(case when i = least(n - 1, cast(floor(n * 0.95) as bigint)) then value end) as p95 from (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null) x group by 1, 2")
def percentiles(v):
    return reads.percentiles(v["events"], "event_type", "value")


@query("select inflow_key, case when confirmed_by is null and value_date is not null then case when n % 5 = 0 then 'y:' || inflow_key else 'x:' || inflow_key end else confirmed_by end as confirmed_by, confirmed_by is null and value_date is not null as changed from inflows", *PAY, "inflows")
def confirm_inflows(v):
    dated = v["inflows"].where("value_date is not null")
    made = dated.select("inflow_key", F.concat(F.lit("x:"), "inflow_key").alias("credit_key"), F.col("value_date").alias("at"))
    early = dated.where("n % 5 = 0").select("inflow_key", F.concat(F.lit("y:"), "inflow_key").alias("credit_key"), (F.col("value_date") - F.make_dt_interval(F.lit(1))).alias("at"))
    return reads.confirm_inflows(v["inflows"], made.unionByName(early)).select("inflow_key", "confirmed_by", "changed")


@query("select payout_reference, case when s = 'reported' and n % 2 = 0 then case when n % 3 = 0 then 'returned' else 'confirmed' end when s = 'confirmed' and n % 3 = 0 then 'returned' else s end as status from (select payout_reference, n, case n % 5 when 0 then 'confirmed' when 1 then 'returned' else 'reported' end as s from payouts) x", *PAY)
def payout_status(v):
    p = v["payouts"].withColumn("status", F.expr("case n % 5 when 0 then 'confirmed' when 1 then 'returned' else 'reported' end"))
    return reads.payout_status(p, p.where("n % 2 = 0"), p.where("n % 3 = 0")).select("payout_reference", "status")


@query("select idempotency_key from settlement_lines where k % 17 = 0", "settlement_lines")
def inconsistent_lines(v):
    return reads.inconsistent_lines(v["settlement_lines"].withColumn("net_kobo", F.col("gross_kobo") - F.col("fee_kobo") + (F.col("k") % 17 == 0).cast("long"))).select("idempotency_key")


_IN = "happened_at >= timestamp '2024-01-01 06:00:00' and happened_at < timestamp '2024-06-01'"
_WHAT = "case when event_id % 3 = 0 then 'EXACT_MATCH' when event_id % 3 = 1 then 'TAX_WITHHELD' else reason end"


@query(f"""with m as (select {_WHAT} as reason, happened_at from exception_events where {_IN})
select 'conclusion' as section, reason as name, count(*) as n, cast(null as bigint) as kobo from m group by 2
union all select 'kind', case reason when 'EXACT_MATCH' then 'match' when 'TAX_WITHHELD' then 'explanation' else 'exception' end, count(*), null from m group by 2
union all select 'queue', reason || '/' || to_state, count(*), cast(sum(amount_kobo) as bigint) from {_VIEW} x where to_state <> 'resolved' group by 2
union all select 'awaiting', 'bank_credit', count(*), cast(coalesce(sum(expected_net_kobo), 0) as bigint) from inflows where confirmed_by is null""", *PAY, "inflows", "exception_events")
def summary_sections(v):
    x = v["exception_events"]
    return reads.summary_sections(x.withColumn("reason", F.expr(_WHAT)), queue.exceptions_view(x), v["inflows"], F.to_timestamp(F.lit("2024-01-01 06:00:00")), F.to_timestamp(F.lit("2024-06-01")))


# the queue's life
_REASONS = ("UNIDENTIFIED_CREDIT", "RETURNED_PAYOUT", "MISSING_SETTLEMENT", "PHANTOM_CREDIT", "EXACT_MATCH", "AMOUNT_MISMATCH", "FEE_VARIANCE", "PAYOUT_UNBALANCED")
_RESULT = f"(select transaction_id, case k % 8 {' '.join(f'when {i} then {r!r}' for i, r in enumerate(_REASONS))} end as reason, case when k % 3 = 0 then 'bank:' || k end as b, case when k % 2 = 0 then 'p' || k end as p, case when k % 5 = 0 then 'settlement:' || k end as s, case when k % 7 <> 0 then transaction_id end as t from promises)"


@query(f"""select transaction_id, reason, subject, case subject when 'bank_credit' then b when 'payout' then p when 'settlement_line' then s else t end as subject_id from (select *, case
 when reason = 'UNIDENTIFIED_CREDIT' then case when b is not null then 'bank_credit' end when reason in ('RETURNED_PAYOUT', 'PAYOUT_UNBALANCED') then case when p is not null then 'payout' end
 when reason = 'MISSING_SETTLEMENT' then case when t is not null then 'transaction' when p is not null then 'payout' end
 when b is not null then 'bank_credit' when p is not null then 'payout' when s is not null then 'settlement_line' when t is not null then 'transaction' end as subject from {_RESULT} r where reason not in ('EXACT_MATCH', 'FEE_VARIANCE')) x where subject is not null""", "promises")
def draft_from(v):
    one = lambda c: F.array_compact(F.array(c))
    reason = F.get(F.array(*[F.lit(r) for r in _REASONS]), (F.col("k") % 8).cast("int"))
    own = v["promises"].select(
        "transaction_id", reason.alias("reason"), one(F.expr("case when k % 3 = 0 then 'bank:' || k end")).alias("bank_credit_keys"), one(F.expr("case when k % 2 = 0 then 'p' || k end")).alias("payout_references"),
        one(F.expr("case when k % 5 = 0 then 'settlement:' || k end")).alias("settlement_keys"), one(F.expr("case when k % 7 <> 0 then transaction_id end")).alias("transaction_ids"),
    )
    return lifecycle.draft_from(own).select("transaction_id", "reason", "subject", "subject_id")


@query("select 'bank_credit' as subject, idempotency_key as subject_id, 'BANK_LINE_COLLISION' as reason, amount_kobo + n % 5 as amount_kobo, 'new' as evidence_id, 'old' as candidate_id, n % 5 as difference_kobo, 'already_claimed' as rejected_because from bank_lines where n % 5 <> 0", *PAY, "bank_lines")
def collision_draft(v):
    return lifecycle.collision_draft(v["bank_lines"].where("n % 5 <> 0").select("idempotency_key", (F.col("amount_kobo") + F.col("n") % 5).alias("arriving_kobo"), F.lit("new").alias("arriving_evidence"), F.col("amount_kobo").alias("stored_kobo"), F.lit("old").alias("stored_evidence")))


_ASKED = "select exception_key, happened_at as asked_at, case event_id % 3 when 0 then 'acknowledged' when 1 then 'resolved' else 'open' end as \"to\", 'u' || event_id % 5 as actor from exception_events where event_id % 7 = 0"


@query(f"""select r.exception_key, v.to_state as from_state, r."to", r.actor from (select *, row_number() over (partition by exception_key order by asked_at, "to", actor) as i from ({_ASKED}) q) r join {_VIEW} v using (exception_key)
where r.i = 1 and v.to_state || '>' || r."to" in ('open>acknowledged', 'open>resolved', 'acknowledged>resolved', 'acknowledged>open', 'resolved>open')""", "exception_events")
def move_exceptions(v):
    asked = v["exception_events"].where("event_id % 7 = 0").select("exception_key", F.col("happened_at").alias("at"), F.expr("case event_id % 3 when 0 then 'acknowledged' when 1 then 'resolved' else 'open' end").alias("to"), F.expr("'u' || event_id % 5").alias("actor"))
    return lifecycle.move(queue.exceptions_view(v["exception_events"]), asked, "exception_key").select("exception_key", "from_state", "to", "actor")


_ANOMALY = "(select anomaly_key, 's' || cast(substr(anomaly_key, 2) as int) % 3 as source, kind, occurrences, rows_in_file, first_seen, case to_state when 'conformed' then 'resolved' when 'raised' then 'open' else to_state end as to_state from (select *, row_number() over (partition by anomaly_key order by event_id desc) as rn, min(happened_at) over (partition by anomaly_key) as first_seen from anomaly_events) z where rn = 1)"


def _anomalies(v) -> DataFrame:
    x = queue.anomaly_history(v["anomaly_events"]).withColumn("to_state", F.expr("case to_state when 'conformed' then 'resolved' when 'raised' then 'open' else to_state end"))
    return x.withColumn("source", F.concat(F.lit("s"), F.substring("anomaly_key", 2, 9).cast("int") % 3))


@query(f"select anomaly_key, source from {_ANOMALY} a where to_state <> 'resolved' and source in ('s0', 's1') and cast(substr(anomaly_key, 2) as int) % 4 <> 0", "anomaly_events")
def clear_conformed(v):
    a = _anomalies(v)
    own = a.where("source <> 's2'")
    seen = own.where(F.substring("anomaly_key", 2, 9).cast("int") % 4 == 0).select("source", "anomaly_key").unionByName(own.select("source", F.lit(None).cast("string").alias("anomaly_key")))
    return queue.clear_conformed(a, seen).select("anomaly_key", "source")


@query(f"select s.anomaly_key, case when a.to_state is null then 'raised' when a.to_state = 'resolved' then 'reopened' else 'recurring' end as effect, case when a.to_state = 'acknowledged' then 'acknowledged' else 'open' end as to_state from (select distinct 'a' || user_id % 450 as anomaly_key from events where event_id % 3 = 0) s left join {_ANOMALY} a using (anomaly_key)", "anomaly_events")
def record_anomalies(v):
    seen = v["events"].where("event_id % 3 = 0").select(F.concat(F.lit("a"), F.col("user_id") % 450).alias("anomaly_key")).distinct()
    return lifecycle.record_anomalies(_anomalies(v), seen).select("anomaly_key", "effect", "to_state")


@query(f"select anomaly_key, cast(least(3, case kind when 'unknown_shape' then 3 when 'unknown_field' then 1 else 2 end + case when occurrences / rows_in_file >= 0.5 then 1 else 0 end) as int) as severity from (select * from {_ANOMALY} a where to_state <> 'resolved' order by first_seen, anomaly_key limit 40) x", "anomaly_events")
def open_anomalies(v):
    return lifecycle.open_anomalies(_anomalies(v), 40).select("anomaly_key", "severity")


@query("select delivery_id, seq from deliveries where seq % 3 <> 0 and received_at < timestamp '2024-03-01' order by received_at, delivery_id limit 100", "deliveries")
def inbox_originals(v):
    own = v["deliveries"].withColumn("content", F.expr("case when seq % 3 <> 0 then 'original' else 'redacted' end"))
    return lifecycle.inbox_originals(own, F.to_timestamp(F.lit("2024-03-01")), 100).select("delivery_id", "seq")


_DECISION = "select event_id, case event_id % 6 when 0 then 'write_off' when 1 then 'reallocate' else 'note' end as action, case when event_id % 13 = 0 then -amount_kobo when event_id % 4 = 0 then amount_kobo * 1000 else amount_kobo end as amount_kobo, event_id % 5 = 0 as books_entries, 'u' || event_id % 4 as resolver, case when event_id % 3 <> 0 then 'u' || event_id % 7 end as approver, case when event_id % 3 <> 0 or event_id % 11 = 0 then happened_at end as approved_at from exception_events"


@query(f"select event_id, case when (approver is null) <> (approved_at is null) then 'half approval' when approver = resolver then 'self approval' when (books_entries or action in ('write_off', 'reallocate') or abs(amount_kobo) >= 5000000) and approver is null then 'approval needed' when amount_kobo < 0 then 'negative amount' end as failure from ({_DECISION}) d", "exception_events")
def approval_failure(v):
    own = v["exception_events"].selectExpr(*[c.strip() for c in _split(_DECISION)])
    return queue.approval_failure(own).select("event_id", "failure")


def _split(sql: str) -> list[str]:
    """The select list of a statement whose items hold no commas."""
    return sql[len("select ") : sql.rindex(" from ")].split(",")


# payouts, reserves, bank
@query("select p.payout_reference as inflow_key, p.source, p.expected_net_kobo, cast(sum(a.amount_kobo) as bigint) as gross_kobo from payouts p join allocations a on a.inflow_key = p.payout_reference group by 1, 2, 3", *PAY, "allocations")
def inflow_from_payouts(v):
    return payouts.inflow_from_payouts(v["allocations"], v["payouts"]).select("inflow_key", "source", "expected_net_kobo", "gross_kobo")


@query("select inflow_key, cast(gross_kobo - coalesce(cut, 0) - expected_net_kobo as bigint) as shortfall_kobo from inflows left join (select payout_reference as inflow_key, sum(kobo) as cut from adjustments where kind <> 'tax' group by 1) a using (inflow_key)", *PAY, "inflows", "adjustments")
def inflow_shortfall(v):
    return payouts.inflow_shortfall(v["inflows"], v["adjustments"].where("kind <> 'tax'").withColumnRenamed("payout_reference", "inflow_key"))


_MOVED = "case n % 3 when 0 then 0 when 1 then n else -n end"


@query(f"select payout_reference as inflow_key, source, n as withheld_kobo, strftime(value_date + to_days(90), '%Y-%m-%d %H:%M:%S') as due_at from payouts where {_MOVED} > 0", *PAY)
def reserve_holds_made(v):
    own = v["payouts"].select(F.col("payout_reference").alias("inflow_key"), "source", F.expr(_MOVED).alias("reserve_kobo"), F.col("value_date").alias("at"))
    return reserves.record_reserve_movement(own, 90)[0].select("inflow_key", "source", "withheld_kobo", stamp("due_at"))


@query(f"select payout_reference as released_by, source, n as amount_kobo from payouts where {_MOVED} < 0", *PAY)
def reserve_releases_made(v):
    own = v["payouts"].select(F.col("payout_reference").alias("inflow_key"), "source", F.expr(_MOVED).alias("reserve_kobo"), F.col("value_date").alias("at"))
    return reserves.record_reserve_movement(own, None)[1].select("released_by", "source", "amount_kobo")


@query("select idempotency_key, expected_kobo from (select *, lag(balance_after_kobo) over (partition by bank_account_id order by value_date, idempotency_key) + case when direction = 'credit' then amount_kobo else -amount_kobo end as expected_kobo from bank_lines) x where balance_after_kobo <> expected_kobo", *PAY, "bank_lines")
def running_balance_breaks(v):
    return reserves.running_balance_breaks(v["bank_lines"]).select("idempotency_key", "expected_kobo")


_CHANNELS = "(select 'a' as contract_id, 'paystack' as source, 'card' as channel, 150 as bp union all select 'b', 'paystack', '*', 100 union all select 'c', 'nomba', 'card', 150)"


@query(f"""select idempotency_key, case when l.status <> 'settled' then null when q.total is null or q.total = l.fee_kobo then 'EXACT_MATCH' else 'FEE_VARIANCE' end as reason from settlement_lines l
join (select source, reference, min(transaction_id) as transaction_id, min(channel) as p_channel, min(gross_kobo) as p_gross, min(state) as state from promises group by 1, 2 having count(*) = 1) p using (source, reference)
left join (select l2.idempotency_key, (p2.gross_kobo * min_by(c.bp, c.channel = '*') + 5000) // 10000 as total from settlement_lines l2 join promises p2 using (source, reference) join {_CHANNELS} c on c.source = l2.source and (c.channel = '*' or c.channel = coalesce(l2.channel, p2.channel, 'unknown')) group by l2.idempotency_key, p2.gross_kobo) q using (idempotency_key)
where l.status = 'settled' and p.state in ('authorized', 'exception') and l.gross_kobo = p.p_gross""", "promises", "settlement_lines")
def line_conclusion_by_channel(v):
    """Rates that differ by channel: the line's own channel decides before the promise's."""
    rates = v["promises"].sparkSession.createDataFrame([("a", "paystack", "card", 150), ("b", "paystack", "*", 100), ("c", "nomba", "card", 150)], "contract_id string, source string, channel string, percent_bp int")
    rates = rates.select("*", F.lit(0).alias("flat_kobo"), F.lit(0).alias("waived_below_kobo"), F.lit(2**53).alias("cap_kobo"), F.lit(0).alias("vat_bp"), F.to_timestamp(F.lit("1990-01-01")).alias("effective_from"), F.lit(None).cast("timestamp").alias("effective_to"))
    return _concluded(v | {"contracts": rates}).where("status = 'settled' and state in ('authorized', 'exception') and gross_kobo = promise_gross").select("idempotency_key", "reason")


# what is left for lines without a payout, and what becomes of the rest
_CLAIMED = """o as (select p.*, cast(p.gross_kobo - coalesce(a.used, 0) as bigint) as owed from promises p left join (select transaction_id, sum(amount_kobo) as used from allocations where inflow_key like '%-199%' group by 1) a using (transaction_id)),
r as (select source, reference, count(*) as n, min(transaction_id) as t from o group by 1, 2),
l as (select s.*, case when r.n = 1 then r.t end as t from (select *, 'settlement:' || k as key from settlement_lines where k % 4 <> 1 union all select *, 'settlement:' || k || '#2' from settlement_lines where k % 6 = 0) s left join r using (source, reference)),
c as (select l.key, l.source, l.gross_kobo, l.settled_at, l.t, o.owed, o.gross_kobo as whole, case when l.status = 'reversed' then case when o.state in ('authorized', 'exception') and l.gross_kobo > 0 and l.gross_kobo <= o.gross_kobo then 'REVERSAL' else 'AMOUNT_MISMATCH' end
 when l.status = 'chargeback' then case when o.state = 'settled' and l.gross_kobo > 0 and l.gross_kobo <= o.gross_kobo then 'CHARGEBACK' else 'AMOUNT_MISMATCH' end when o.state in ('authorized', 'exception') then 'BATCH_MATCH' else 'AMOUNT_MISMATCH' end as kind from l left join o on o.transaction_id = l.t),
w as (select *, owed - coalesce(sum(case kind when 'BATCH_MATCH' then owed when 'AMOUNT_MISMATCH' then 0 else gross_kobo end) over (partition by t order by key rows between unbounded preceding and 1 preceding), 0) as rest from c),
x as (select key as idempotency_key, source, settled_at, case when t is null or rest <= 0 then 'PHANTOM_CREDIT' when kind in ('BATCH_MATCH', 'AMOUNT_MISMATCH') then kind when gross_kobo < whole then 'PARTIAL_' || kind else kind end as reason, t, rest, gross_kobo from w),
claims as (select idempotency_key, reason, case when reason <> 'PHANTOM_CREDIT' then t end as transaction_id, cast(case when reason = 'BATCH_MATCH' then rest when reason not in ('PHANTOM_CREDIT', 'AMOUNT_MISMATCH') then gross_kobo end as bigint) as amount_kobo,
 case when reason = 'BATCH_MATCH' then 'derived:' || source || ':' || coalesce(strftime(settled_at, '%Y-%m-%d'), 'undated') when reason not in ('PHANTOM_CREDIT', 'AMOUNT_MISMATCH') then idempotency_key end as inflow_key from x)"""


def _line_claims(v):
    used = v["allocations"].where("inflow_key like '%-199%'").groupBy("transaction_id").agg(F.sum("amount_kobo").alias("used"))
    promises = v["promises"].join(used, "transaction_id", "left").fillna(0, ["used"]).withColumn("owed_kobo", F.col("gross_kobo") - F.col("used"))
    s = v["settlement_lines"]
    lines = s.where("k % 4 <> 1").unionByName(s.where("k % 6 = 0").withColumn("idempotency_key", F.concat("idempotency_key", F.lit("#2"))))
    return promises, sequential.line_claims(lines, promises)


@query("with " + _CLAIMED + " select idempotency_key, reason, transaction_id, amount_kobo, inflow_key from claims", *PAY, "settlement_lines", "allocations")
def line_claims(v):
    return _line_claims(v)[1].drop("confidence_pct")


@query(f"""with {_CLAIMED} select transaction_id, case when used > 0 then 'PARTIAL_SETTLEMENT' when occurred_at + interval 4 day < timestamp '{AS_OF}' then 'MISSING_SETTLEMENT' else 'PENDING_T_PLUS_N' end as reason, cast(owed - used as bigint) as left_kobo, used > 0 or occurred_at + interval 4 day >= timestamp '{AS_OF}' as deferred
from (select o.*, coalesce(u.used, 0) as used from o left join (select transaction_id, sum(amount_kobo) as used from claims group by 1) u using (transaction_id) where state not in ('settled', 'reversed')) z where owed - used > 0""", *PAY, "settlement_lines", "allocations")
def leftovers(v):
    promises, claims = _line_claims(v)
    promises = promises.withColumn("escalates_at", F.col("occurred_at") + F.make_dt_interval(F.lit(4)))
    return sequential.leftovers(promises, claims.where("amount_kobo is not null").select("transaction_id", "amount_kobo"), F.to_timestamp(F.lit(AS_OF)))


# calendar
_EDITIONS = [("ng", 1, "1994-01-01", "1996-12-31"), ("ng", 2, "1996-01-01", "1997-12-31"), ("ngb", 2, "1997-06-01", "1999-03-31"), ("old", 1, "1990-01-01", "1999-06-30")]
_EDITION_SQL = "(select * from (values " + ", ".join(f"('{i}', {r}, date '{a}', date '{b}')" for i, r, a, b in _EDITIONS) + ") t(calendar_id, revision, covers_from, covers_to))"
_DAYS = "(select distinct cast(occurred_at as date) as day from promises)"


def _editions(v) -> DataFrame:
    e = v["promises"].sparkSession.createDataFrame(_EDITIONS, "calendar_id string, revision int, covers_from string, covers_to string")
    return e.withColumn("covers_from", F.to_date("covers_from")).withColumn("covers_to", F.to_date("covers_to"))


@query(f"select strftime(day, '%Y-%m-%d') as day, calendar_id, revision from (select d.day, e.calendar_id, e.revision, row_number() over (partition by d.day order by e.revision desc, e.calendar_id desc) as rn from {_DAYS} d left join {_EDITION_SQL} e on d.day between e.covers_from and e.covers_to) x where rn = 1", "promises")
def holiday_edition(v):
    days = v["promises"].select(F.to_date("occurred_at").alias("day")).distinct()
    return calendar.edition_days(_editions(v), days).select(F.col("day").cast("string"), "calendar_id", "revision")


@query(f"""with e as (select d.day, x.calendar_id || '@' || x.revision as edition from (select cast(r as date) as day from range(date '1994-01-01', date '2002-01-01', interval 1 day) q(r)) d left join lateral (select calendar_id, revision from {_EDITION_SQL} y where d.day between y.covers_from and y.covers_to order by revision desc, calendar_id desc limit 1) x on true)
select p.transaction_id, string_agg(distinct e.edition, ',' order by e.edition) as editions, count(e.edition) = count(*) as fully_covered from promises p join e on e.day between cast(p.occurred_at as date) and cast(p.occurred_at as date) + cast(p.k % 6 as int) group by 1""", "promises")
def deadline_provenance(v):
    days = v["promises"].sparkSession.sql("select explode(sequence(date '1994-01-01', date '2001-12-31')) as day")
    own = v["promises"].select("transaction_id", F.to_date("occurred_at").alias("local_day"), F.date_add(F.to_date("occurred_at"), (F.col("k") % 6).cast("int")).alias("due_day"))
    found = calendar.deadline_provenance(own, calendar.edition_days(_editions(v), days))
    return found.select("transaction_id", F.when(F.size("editions") > 0, F.array_join("editions", ",")).alias("editions"), "fully_covered")


# text and sources
@query("select event_id, case event_id % 3 when 0 then event_id end as kobo from events")
def whole_kobo(v):
    return v["events"].select("event_id", money.whole_kobo(F.expr("case event_id % 3 when 0 then cast(event_id as double) when 1 then event_id + 0.5D else 1e16D end")).alias("kobo"))


@query("select event_id, case when event_id % 9 = 0 then 'null' when length(x) > 64 then left(x, 64) || '…' else x end as shown from (select event_id, event_type || repeat('x', cast(event_id % 100 as int)) as x from events) y")
def render_value(v):
    text = F.expr("case when event_id % 9 <> 0 then event_type || repeat('x', cast(event_id % 100 as int)) end")
    return v["events"].select("event_id", protect.render(text).alias("shown"))


@query("select transaction_id, format('{:,.2f}', gross_kobo / 100.0) as naira from promises", "promises")
def format_naira(v):
    return v["promises"].select("transaction_id", money.format_naira(F.col("gross_kobo")).alias("naira"))


_PREFIX = protect.ISSUERS[1:-1]


@query(f"""with runs as (select doc_id, unnest(regexp_extract_all(text, '[0-9]+')) as run from documents), d as (select doc_id, run, length(run) as n from runs where length(run) between 13 and 19),
s as (select doc_id, run, n, (select sum(case when i % 2 = 0 then x when 2 * x > 9 then 2 * x - 9 else 2 * x end) from (select i, cast(substr(run, n - i, 1) as int) as x from range(0, n) r(i)) q) as t from d)
select doc_id, left(run, 6) || repeat('*', cast(n - 10 as int)) || right(run, 4) as masked, t % 10 = 0 and regexp_full_match(run, '{_PREFIX}') as card, count(*) as times from s group by 1, 2, 3""")
def masked_cards(v):
    runs = v["documents"].select("doc_id", F.explode(F.filter(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), lambda r: F.length(r).between(13, 19))).alias("run"))
    return runs.groupBy("doc_id", protect.mask(F.col("run")).alias("masked"), protect.looks_like_card(F.col("run")).alias("card")).agg(F.count("*").alias("times"))


def _report(v, row) -> DataFrame:
    """Reports of one user's rows each, as the array of a file."""
    per = v["events"].groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", F.to_json(row).alias("row")))).alias("rows"))
    return per.select(F.col("user_id").cast("string").alias("evidence_id"), F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["row"]), ","), F.lit("]")).alias("body"))


_PLACE = "row_number() over (partition by user_id order by event_id) - 1"
_STATE = "case event_id %% 5 when 0 then 'PENDING' when 1 then 'REVERSED' else '%s' end"
_GROSS = "case when event_id % 11 = 0 then null else event_id * 100 + 700 end"


def _naira(units: str):
    return F.expr(f"cast({units} as decimal(20,2))").cast("string")


def _lines_sql(source: str, done: str) -> str:
    return f"""select cast(user_id as varchar) as evidence_id, '$[' || {_PLACE} || ']' as lineage, 'settlement:{source}' || coalesce(':' || id, '') as idempotency_key, kobo as gross_kobo, fee_kobo, case word when 'REVERSED' then 'reversed' when '{done}' then 'settled' end as status,
case when id is null then 'missing reference' when event_id % 9 = 0 then 'currency' when word = 'PENDING' then 'not a settlement' when kobo is null then 'amount' when fee_kobo < 0 then 'fee' end as reject from (
select user_id, event_id, case when event_id % 50 <> 0 then 'L' || event_id end as id, {_STATE % done} as word, {_GROSS} as kobo, case when {_GROSS} is not null then case when event_id % 17 = 0 then -300 else 150 end end as fee_kobo from events) x"""


@query(_lines_sql("nomba", "SUCCESS"))
def scan_settlement_lines(v):
    net = f"({_GROSS}) - case when event_id % 17 = 0 then -300 else 150 end"
    row = F.struct(
        F.expr("case when event_id % 50 <> 0 then 'L' || event_id end").alias("id"), F.expr(_STATE % "SUCCESS").alias("status"), _naira(f"({_GROSS}) / 100").alias("amountCharged"), _naira(f"({net}) / 100").alias("amount"),
        F.date_format("ts", "yyyy-MM-dd").alias("timeCompleted"), F.expr("case when event_id % 9 = 0 then 'USD' else 'NGN' end").alias("walletCurrency"),
    )
    return statements.scan_settlement_lines(_report(v, row), "nomba").select("evidence_id", "lineage", "idempotency_key", "gross_kobo", "fee_kobo", "status", "reject")


@query(_lines_sql("monnify", "PAID"))
def scan_settlement_envelopes(v):
    net = f"({_GROSS}) - case when event_id % 17 = 0 then -300 else 150 end"
    body = F.struct(
        F.expr("case when event_id % 50 <> 0 then 'L' || event_id end").alias("transactionReference"), F.expr(_STATE % "PAID").alias("paymentStatus"), _naira(f"({_GROSS}) / 100").alias("amountPaid"), _naira(f"({net}) / 100").alias("settlementAmount"),
        F.date_format("ts", "yyyy-MM-dd").alias("paidOn"), F.expr("case when event_id % 9 = 0 then 'USD' else 'NGN' end").alias("currency"),
    )
    return statements.scan_settlement_lines(_report(v, F.struct(body.alias("responseBody"))), "monnify").select("evidence_id", "lineage", "idempotency_key", "gross_kobo", "fee_kobo", "status", "reject")


def _payout_report(v) -> DataFrame:
    fee = lambda kind, amount: F.struct(F.lit(kind).alias("type"), amount.alias("amount"))
    row = F.struct(
        F.expr("case when event_id % 50 <> 0 then 'P' || event_id end").alias("id"), _naira("event_id").alias("gross_amount"), _naira("event_id - 2").alias("net_amount"), F.expr("case when event_id % 9 = 0 then 'USD' else 'NGN' end").alias("currency"),
        F.expr("case when event_id % 5 = 0 then 'PENDING' else 'successful' end").alias("status"), F.date_format("ts", "yyyy-MM-dd").alias("due_datetime"),
        F.array(fee("VAT", F.lit("1.50")), fee("charge_fee", _naira("event_id % 7")), fee("penalty", F.lit("0.25")), fee("odd", F.lit("n/a"))).alias("fees"), _naira("event_id % 3").alias("reserve"), F.when(F.col("event_id") % 4 == 0, F.lit("3")).alias("reserve_release"),
    )
    file = _report(v, row)
    return file.withColumn("body", F.concat(F.lit('{"data":'), "body", F.lit("}")))


_REFUSED = "case when event_id % 50 = 0 then 'missing id' when event_id % 9 = 0 then 'currency' when event_id % 5 = 0 then 'not a settlement' end"


@query(f"select cast(user_id as varchar) as evidence_id, '$.data[' || {_PLACE} || ']' as lineage, case when event_id % 50 <> 0 then 'P' || event_id end as payout_reference, event_id * 100 as gross_kobo, event_id * 100 - 200 as expected_net_kobo, {_REFUSED} as reject from events")
def scan_payouts(v):
    return statements.scan_payouts(_payout_report(v))[0].select("evidence_id", "lineage", "payout_reference", "gross_kobo", "expected_net_kobo", "reject")


@query(f"""with r as (select event_id, 'P' || event_id as payout_reference from events where {_REFUSED} is null)
select payout_reference, 'tax' as kind, 150 as kobo from r union all select payout_reference, 'fee', event_id % 7 * 100 from r where event_id % 7 <> 0 union all select payout_reference, 'penalty', 25 from r
union all select payout_reference, 'reserve', event_id % 3 * 100 from r where event_id % 3 <> 0 union all select payout_reference, 'reserve_release', -300 from r where event_id % 4 = 0""")
def scan_payout_adjustments(v):
    return statements.scan_payouts(_payout_report(v))[1].select("payout_reference", "kind", "kobo")


# payloads
_BODY = """case event_id % 8 when 0 then '{"event_id":' || event_id || ',"data":{"card":{"CVV-2":""}}}' when 1 then '{"event_id":' || event_id || ',"note":"paid with 4111 1111-1111 1111 today"}'
when 2 then '{"rows":[{"id":' || event_id || '},{"ref":"5500--0000 0000-0004"}]}' when 3 then event_id || ',378282246310005,x' when 4 then '{"note":"4111111111111112","id":' || event_id || '}'
when 5 then '{"note":"4111111111111111222222"}' when 6 then '{"cvvs":"1","value":"pin"}' else '{"event_id":' || event_id || '}' end"""


@query("""select event_id, case when event_id % 8 = 0 then 'sad' else 'pan' end as kind, case event_id % 8 when 0 then '$.data.card.CVV-2' when 1 then '$' when 2 then '$.rows[1].ref' else 'body' end as at,
case event_id % 8 when 0 then 'CVV-2' when 1 then '411111******1111' when 2 then '550000******0004' else '378282*****0005' end as detail from events where event_id % 8 < 4""")
def card_findings(v):
    return protect.card_findings(v["events"].withColumn("body", F.expr(_BODY)), "event_id", "body")


_PAYLOAD = """case when event_id % 7 = 3 then 'id=' || event_id when event_id % 11 = 3 then '[1,2]' else '{"event":"charge.success","data":{"id":' || event_id || ',"customer":{"email":"a@b.c","phone":null},"fees":[{"amount":1.50,"note":"n"}],"metadata":null}}' end"""
_MARK = '"redacted":"' + protect.REDACTION + '","dropped":'


@query(f"""select event_id, case when event_id % 7 = 3 then '{{{_MARK}0,"reason":"no JSON: replaced whole"}}' when event_id % 11 = 3 then '{{"_redaction":{{{_MARK}2}},"kept":null}}'
else '{{"event":"charge.success","data":{{"id":' || event_id || ',"fees":[{{"amount":1.5}}]}},"_redaction":{{{_MARK}2}}}}' end as body, cast(case when event_id % 7 = 3 then 0 else 2 end as bigint) as dropped from events""")
def redact_payloads(v):
    return v["events"].select("event_id", protect.redact_payload()(F.expr(_PAYLOAD)).alias("r")).select("event_id", "r.*")


@query("select evidence_id, 'k2' as key_id, case when evidence_id not like '%3' then kind end as plain from evidence", "evidence")
def sealed_evidence(v):
    """Sealed under one root key, its data keys wrapped anew under the next, then read; some under another id than their own."""
    old, new = (protect.KeyRing({"k1": b"1" * 32, "k2": b"2" * 32}, k) for k in ("k1", "k2"))
    aad = protect.context(evidence=F.col("evidence_id"))
    rotated = protect.rotate_rows(protect.seal_rows(v["evidence"], old, F.col("kind"), aad), new, aad)
    read_as = F.when(F.col("evidence_id").like("%3"), F.concat("evidence_id", F.lit("!"))).otherwise(F.col("evidence_id"))
    return protect.unseal_rows(rotated, new, protect.context(evidence=read_as)).select("evidence_id", "key_id", F.col("plain").cast("string").alias("plain"))


@query(f"""select a.inflow_key, a.transaction_id, c.contract_id, c.channel, {{fee}} as expected_fee_kobo, ({{fee}} * vat_bp + 5000) // 10000 as expected_vat_kobo, s.share_kobo as observed_fee_kobo
from (select inflow_key, transaction_id, amount_kobo as gross_kobo from allocations) a left join {_ASOF} c on a.transaction_id = c.key_
left join ({_SHARES}) s on a.inflow_key = s.inflow_key and a.transaction_id = s.transaction_id and s.account_id = 'fees_expense' and s.share_kobo <> 0""".replace("{fee}", f"cast({_FEE} as bigint)"), *PAY, "adjustments", "allocations", "contracts")
def explain_allocations(v):
    """The fee that the contract of each promise's own channel and day asks for, beside its share of what the payout was charged."""
    return fees.explain_allocations(v["allocations"], v["promises"], v["contracts"], _shares(v))


#: Rows of a page of a statement, which one task writes.
PAGE_ROWS = 1_000_000


def _framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows as one JSON array, a row a line."""
    lead = "["
    for batch in batches:
        if batch.num_rows:
            leads = pa.array([lead] + [","] * (batch.num_rows - 1))
            yield pa.RecordBatch.from_arrays([pa.compute.binary_join_element_wise(leads, batch.column(0).cast(pa.string()), "")], names=["line"])
            lead = ","
    if lead == ",":
        yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["line"])


@query("""with r as (select event_id, row_number() over (order by event_id) - 1 as position, case when event_id % 50 <> 0 then 'L' || event_id % 900 end as id, case when event_id % 7 = 0 then 'transfer' when event_id % 2 = 0 then 'credit' else 'debit' end as type, case when event_id % 11 <> 0 then cast(cast(value as decimal(20,2)) * 100 as bigint) end as kobo from events),
s as (select *, row_number() over (partition by id order by position) as rn from r)
select '$[' || position || ']' as lineage, kobo as amount_kobo, case when id is null then 'missing id' when type = 'transfer' then 'type=transfer' when kobo is null then 'amount' when kobo < 0 then 'negative amount' when rn > 1 then 'colliding identity' end as reject from s""")
def scan_statement_splits(v):
    """All events as one bank's one statement, written to the shared folder in pages of a million rows and read back in many tasks."""
    row = F.to_json(F.struct(
        F.when(F.col("event_id") % 50 != 0, F.concat(F.lit("L"), F.col("event_id") % 900)).alias("id"), F.when(F.col("event_id") % 7 == 0, "transfer").when(F.col("event_id") % 2 == 0, "credit").otherwise("debit").alias("type"),
        F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("value").cast("decimal(20,2)").cast("string")).alias("amount"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.concat("event_type", F.lit(' said "},{"')).alias("narration"),
    ))
    lines = v["events"].select("event_id", row.alias("line"))
    spark = lines.sparkSession
    folder = f"{shared(spark)}/statements/{uuid.uuid4().hex}"
    pages = max(1, -(-lines.count() // PAGE_ROWS))
    lines.repartitionByRange(pages, "event_id").sortWithinPartitions("event_id").select("line").mapInArrow(_framed, "line string").write.text(folder)
    return statements.scan_bank_statement(statements.paged_rows(spark, folder), "main").select("lineage", "amount_kobo", "reject")


def _stage_inputs(v):
    """Open inflows with the terms of their sources, all bank lines with some debits among them, and what earlier runs banked."""
    policy = F.when(F.col("source") == "paystack", 60_000).when(F.col("source") == "flutterwave", 10_000).otherwise(0).cast("long")
    # every fifth amount is rounded, so that several share one
    coarse = lambda c: F.when(F.col("n") % 5 == 0, F.expr(f"{c} div 1000000 * 1000000")).otherwise(F.col(c))
    due = F.col("value_date") + F.make_dt_interval(F.lit(3))
    own = v["inflows"].where("confirmed_by is null").select("inflow_key", coarse("expected_net_kobo").alias("expected_net_kobo"), "value_date", due.alias("escalates_at"), policy.alias("allowance_kobo"), (F.col("source") != "monnify").alias("pairs"))
    banked = matching.confirmed_inflows(v["inflows"], v["bank_lines"]).select("inflow_key", "credited_kobo")
    lines = v["bank_lines"].join(v["inflows"].where("confirmed_by is not null").select(F.col("confirmed_by").alias("idempotency_key")), "idempotency_key", "left_anti")
    # what was banked comes back now and then, as the same amount by another line
    back = v["bank_lines"].where("n % 6 = 0 and n % 4 = 0").withColumn("direction", F.lit("debit")).withColumn("idempotency_key", F.concat("idempotency_key", F.lit("!")))
    lines = lines.withColumn("amount_kobo", F.when(F.col("direction") == "credit", coarse("amount_kobo")).otherwise(F.col("amount_kobo"))).unionByName(back)
    return own, lines.select("idempotency_key", "direction", "amount_kobo", "value_date", "narration", "stated_reference"), banked


@query(None)
def bank_stage(v):
    return confirmation.bank_stage(*_stage_inputs(with_staged(v, "payouts")), F.lit(AS_OF).cast("timestamp"))


@query("""with i as (select payout_reference as inflow_key, n // 40 * 100 as amount_kobo, value_date, source <> 'monnify' as pairs from payouts),
c as (select 'bank:' || payout_reference as idempotency_key, n // 40 * 100 as amount_kobo, case when n % 61 = 0 then value_date else timestamp '2001-01-01 00:00:00' end as value_date from payouts where n % 37 <> 0),
g as (select amount_kobo from (select amount_kobo, count(*) as n, min(value_date) as first from c group by 1) a join (select amount_kobo, count(*) as m, max(value_date) as last, bool_and(pairs) as pairs from i group by 1) b using (amount_kobo) where n >= 2 and n = m and pairs and (last is null or first >= last - interval 1440 minute)),
l as (select *, row_number() over (partition by amount_kobo order by value_date, idempotency_key) as rn from c where amount_kobo in (select amount_kobo from g)),
r as (select *, row_number() over (partition by amount_kobo order by coalesce(value_date, timestamp '1970-01-01 00:00:00'), inflow_key) as rn from i where amount_kobo in (select amount_kobo from g))
select l.idempotency_key, r.inflow_key as pair from l join r using (amount_kobo, rn)""", *PAY)
def paired_amounts(v):
    """Groups of several credits and inflows of one amount, from sources that pair them; some lack a credit or are too early."""
    amount = F.expr("n div 40 * 100")
    inflows = v["payouts"].select(F.col("payout_reference").alias("inflow_key"), amount.alias("expected_net_kobo"), "value_date", (F.col("source") != "monnify").alias("pairs"))
    at = F.when(F.col("n") % 61 == 0, F.col("value_date")).otherwise(F.lit("2001-01-01 00:00:00").cast("timestamp"))
    credits = v["payouts"].where("n % 37 <> 0").select(F.concat(F.lit("bank:"), "payout_reference").alias("idempotency_key"), amount.alias("amount_kobo"), at.alias("value_date"))
    return confirmation.paired(credits, inflows)


_GONE = "event_id % 23 = 4"
_DUE = "stored_at + to_days(case when kind = 'webhook' and content = 'original' then 30 else 2192 end) <= timestamp '2024-02-10' and not purged"


def _retention_sql(as_of: str) -> str:
    due = _DUE.replace("2024-02-10", as_of)
    return f"""select evidence_id, case when {due} and kind = 'webhook' and content = 'original' and not ({_GONE}) then 'redacted' else content end as content, purged or ({due} and not (kind = 'webhook' and content = 'original')) as purged,
case when not ({due}) then 'kept' when not (kind = 'webhook' and content = 'original') then 'purged' when {_GONE} then 'failed' else 'redacted' end as result,
case when {due} and kind = 'webhook' and content = 'original' and not ({_GONE}) then 'charge' end as event
from (select e.*, cast(substr(evidence_id, 2) as bigint) as event_id from evidence e) x"""


def _retained(v, as_of: str) -> DataFrame:
    ring = protect.KeyRing({"k1": b"1" * 32}, "k1")
    aad = protect.context(evidence=F.col("evidence_id"))
    own = v["evidence"].select("evidence_id", "kind", "content", "stored_at", "purged")
    body = F.concat(F.lit('{"event":"charge","data":{"email":"'), "evidence_id", F.lit('@x.ng"}}'))
    sealed = protect.seal_rows(own, ring, body, aad).withColumn("sealed", F.when(F.expr("cast(substr(evidence_id, 2) as bigint) % 23 = 4"), F.lit(b"altered")).otherwise(F.col("sealed")))
    done = retention.apply_retention(sealed, ring, F.to_timestamp(F.lit(as_of)), protect.redact_payload())
    read = protect.unseal_rows(done.rows, ring, aad)
    event = F.when(F.col("result") == "redacted", F.get_json_object(F.col("plain").cast("string"), "$.event"))
    return read.select("evidence_id", "content", "purged", "result", event.alias("event"))


@query(_retention_sql("2024-02-10"), "evidence")
def apply_retention(v):
    """Sealed evidence of which some cannot be opened; the rest of what is due is reduced all the same."""
    return _retained(v, "2024-02-10")


@query(_retention_sql("2030-01-20"), "evidence")
def purge_evidence(v):
    """The same six years later, when the first settlement and bank evidence is due as well."""
    return _retained(v, "2030-01-20")


@query("""select seq, case when content = 'original' and received_at < timestamp '2024-03-01' and seq % 17 <> 0 then 'redacted' else content end as content,
case when content <> 'original' or received_at >= timestamp '2024-03-01' then 'kept' when seq % 17 = 0 then 'failed' else 'redacted' end as result,
case when content = 'original' and received_at < timestamp '2024-03-01' and seq % 17 <> 0 then cast(1 as bigint) end as redacted_dropped
from (select *, case when seq % 3 <> 0 then 'original' else 'redacted' end as content from deliveries) d""", "deliveries")
def sweep_originals(v):
    own = v["deliveries"].withColumn("content", F.expr("case when seq % 3 <> 0 then 'original' else 'redacted' end"))
    raw = F.when(F.col("seq") % 17 != 0, F.concat(F.lit('{"event":"charge","data":{"email":"'), "delivery_id", F.lit('@x.ng"}}')))
    done = retention.sweep_originals(own.withColumn("raw", raw), F.to_timestamp(F.lit("2024-03-01")), F.current_timestamp(), protect.redact_payload())
    return done.rows.select("seq", "content", "result", "redacted_dropped")


_KINDS = "case reason when 'PHANTOM_CREDIT' then 'payout' when 'AMOUNT_MISMATCH' then 'bank_credit' when 'MISSING_SETTLEMENT' then 'promise' else 'reserve' end"


@query(f"""select {_KINDS} as subject, exception_key, reason, case when to_state = 'acknowledged' then 'withheld' when reason = 'AMOUNT_MISMATCH' and cast(substr(exception_key, 2) as int) % 5 = 0 then 'withheld' else 'cleared' end as effect
from {_VIEW} x where to_state <> 'resolved' and reason in ('PHANTOM_CREDIT', 'AMOUNT_MISMATCH') and cast(substr(exception_key, 2) as int) % 3 <> 0""", "exception_events")
def clear_vanished(v):
    """A run that judged all payouts and a truncated window of bank credits."""
    view = queue.exceptions_view(v["exception_events"]).withColumn("subject", F.expr(_KINDS)).withColumn("subject_id", F.col("exception_key"))
    k = F.substring("exception_key", 2, 9).cast("int")
    done = queue.clear_vanished(view, view.where(k % 3 == 0), {"payout": False, "bank_credit": True}, view.where(k % 5 != 0).select("subject", "subject_id"))
    return done.select("subject", "exception_key", "reason", "effect")


_EACH = "select * from (select 'b' || user_id % 7 as bank_account_id, date_trunc('day', ts) as as_of, user_id % 7 as k from events) y where k % 3 = 0 and as_of < timestamp '2024-01-20'"


@query(f"""with a as (select bank_account_id, max(as_of) as last from ({_EACH}) z group by 1), b as (select distinct 'b' || user_id % 7 as bank_account_id from events where user_id % 7 <> 6),
x as (select 'reconciliation' as alert, '' as subject, max(happened_at) as last, 60 as most from exception_events union all select 'attestation', bank_account_id, last, 36000 from b left join a using (bank_account_id))
select alert, subject, cast(floor((epoch(timestamp '2024-02-10') - epoch(date_trunc('second', last))) / 60) as bigint) as value from x where last is null or epoch(timestamp '2024-02-10') - epoch(date_trunc('second', last)) > most * 60""", "exception_events")
def stale_alerts(v):
    """Accounts with statements of which some were never compared, and the age of the last conclusion."""
    own = v["events"].selectExpr("concat('b', user_id % 7) as bank_account_id", "date_trunc('day', ts) as as_of", "user_id % 7 as k")
    attested = own.where("k % 3 = 0 and as_of < timestamp '2024-01-20'")
    return queue.stale_alerts(v["exception_events"], own.where("k <> 6"), attested, F.to_timestamp(F.lit("2024-02-10")), 60, 36000)


@query(f"""with d as (select distinct 'x' || user_id % 500 as exception_key from events where event_type = 'click')
select d.exception_key, case when x.to_state is null then 'new' when x.to_state = 'resolved' then 'reopened' else 'unchanged' end as effect from d left join {_VIEW} x using (exception_key)""", "exception_events")
def raise_found(v):
    """Drafts that the events bear out, against the queue as it stands."""
    drafts = v["events"].where("event_type = 'click'").select(F.concat(F.lit("x"), F.col("user_id") % 500).alias("exception_key")).distinct()
    return queue.raise_exceptions(queue.exceptions_view(v["exception_events"]), drafts).select("exception_key", "effect")


_TERMS = "select 'c' || o_orderkey as contract_id, 's' || o_custkey as source, case when o_orderkey % 3 = 0 then 'card' else '*' end as channel, cast(cast(o_orderdate as date) as timestamp) as effective_from, case when o_orderkey % 10 <> 0 then cast(cast(o_orderdate as date) + cast(o_orderkey % 200 + 1 as int) as timestamp) end as effective_to from orders"


@query(f"""with c as ({_TERMS}), w as (select *, max({{'reach': coalesce(effective_to, timestamp '9999-01-01'), 'id': contract_id}}) over (partition by source, channel order by effective_from, contract_id rows between unbounded preceding and 1 preceding) as before from c)
select source, channel, before.id as before_id, contract_id from w where effective_from < before.reach""")
def overlapping_terms(v):
    """A contract for each order, in the scope of its customer."""
    day = "cast(o_orderdate as date)"
    own = v["orders"].selectExpr(
        "concat('c', o_orderkey) as contract_id", "concat('s', o_custkey) as source", "case when o_orderkey % 3 = 0 then 'card' else '*' end as channel", f"cast({day} as timestamp) as effective_from",
        f"case when o_orderkey % 10 <> 0 then cast(date_add({day}, cast(o_orderkey % 200 + 1 as int)) as timestamp) end as effective_to",
    )
    return fees.contract_overlap(own)


_RULED = "select event_id, 'x' || user_id % 500 as exception_key, case event_id % 3 when 0 then 'write_off' else 'note' end as action, cast(100 as bigint) as amount_kobo, 'u' || event_id % 4 as resolver, case when event_id % 5 <> 0 then 'u' || user_id % 7 end as approver, ts as decided from events"
_SIDE = "case when event_id % 7 = 0 then 'bank_account' else 'suspense' end"


@query(f"""with d as (select d.*, x.to_state as was, d.event_id % 2 = 0 as books from ({_RULED}) d left join {_VIEW} x using (exception_key)),
f as (select *, case when was is null then 'no such exception' when was = 'resolved' then 'already resolved' when approver = resolver then 'self approval' when (books or action = 'write_off') and approver is null then 'approval needed' when books and event_id % 7 = 0 then 'touches the bank' when books and event_id % 11 = 0 then 'unbalanced' end as failure from d),
r as (select *, row_number() over (partition by exception_key, failure is null order by decided, event_id) as rn from f)
select event_id, case when failure is null and rn > 1 then 'already resolved' else failure end as failure, cast(case when books and failure is null and rn = 1 then 2 else 0 end as bigint) as n_entries from r""", "exception_events")
def resolve(v):
    """Every event as a decision on an exception; every second one books two entries."""
    own = v["events"].selectExpr(
        "event_id", "event_id as decision_id", "concat('x', user_id % 500) as exception_key", "case event_id % 3 when 0 then 'write_off' else 'note' end as action", "cast(100 as bigint) as amount_kobo",
        "concat('u', event_id % 4) as resolver", "case when event_id % 5 <> 0 then concat('u', user_id % 7) end as approver", "case when event_id % 5 <> 0 then ts end as approved_at", "ts as at",
    )
    legs = own.where("event_id % 2 = 0").select("decision_id", F.explode(F.expr(f"array(struct({_SIDE} as account_id, 100L as amount_kobo), struct('chargebacks' as account_id, if(event_id % 11 = 0, -99L, -100L) as amount_kobo))")).alias("l"))
    done = resolution.resolve(queue.exceptions_view(v["exception_events"]), own.drop("event_id"), legs.select("decision_id", "l.*", F.lit("NGN").alias("currency")))
    both = done.refused.unionByName(done.accepted.select("decision_id", F.lit(None).cast("string").alias("failure")))
    n = done.entries.groupBy("decision_id").agg(F.count("*").alias("n_entries"))
    return both.join(n, "decision_id", "left").select(F.col("decision_id").alias("event_id"), "failure", F.coalesce("n_entries", F.lit(0)).alias("n_entries"))
