"""Queries of drift, near misses, banked money, changes of state and the queue's pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import protect
from ..operators import ledger, matching, queue
from ..sources import drift
from .queries import _CREDIT, _ROWS, _VIEW, ALLOWANCE, ORACLE, PAY, _open, _statement_file, query, stamp
from .reads import _STATE, _naira, _payout_report, _report, book_bank_confirmed

_SEP = "chr(31)"


# drift
def _counted_sql(source: str, seen: str, total: str) -> str:
    """Observations (f, position, kind, detail, sample, lineage) to one row a file, kind and detail."""
    return f"""select f as evidence_id, kind, detail, count(*) as occurrences, arg_min(coalesce(lineage, ''), position) as first_lineage, arg_min(coalesce(sample, ''), position) as sample, coalesce(any_value(n), 0) as rows_in_file, '{source}' || {_SEP} || kind || {_SEP} || detail as anomaly_key
from ({seen}) s left join ({total}) t using (f) group by 1, kind, detail"""


def _shown(df):
    return df.withColumn("first_lineage", F.coalesce("first_lineage", F.lit(""))).withColumn("sample", F.coalesce("sample", F.lit("")))


_ODD = "case when user_id % 10 = 0 then 'object' when user_id % 10 = 1 then 'cut' else 'array' end"


@query("with " + _ROWS.replace("from events", f"from events where {_ODD} = 'array'") + f""", w as (select *, case when id is null then 'missing id' when type = 'transfer' then 'type=transfer' when kobo is null then 'amount' when kobo < 0 then 'negative amount' end as bad from r),
g as (select *, case when bad is null then row_number() over (partition by user_id, id, bad is null order by position) end as rn from w),
o as (select cast(user_id as varchar) as f, position, 'unknown_field' as kind, '$[].branch' as detail, null as sample, '$[' || position || ']' as lineage from g where branch
union all select cast(user_id as varchar), position, 'unknown_value', bad, 'transfer', '$[' || position || ']' from g where bad = 'type=transfer'
union all select cast(user_id as varchar), position, 'malformed_rows', 'bank-statement', bad, '$[' || position || ']' from g where bad <> 'type=transfer'
union all select cast(user_id as varchar), position, 'colliding_identity', 'bank-statement', 'bank:main:' || id, '$[' || position || ']' from g where rn > 1
union all select distinct cast(user_id as varchar), -1, 'unknown_shape', case {_ODD} when 'object' then 'expected a bare array, got object' else 'payload is not JSON' end, null, null from events where {_ODD} <> 'array')
""" + _counted_sql("bank:main", "select * from o", "select cast(user_id as varchar) as f, count(*) as n from r group by 1"))
def statement_drift(v):
    """Statements of which some come in an envelope and some broke off."""
    body = F.expr(f"case {_ODD.replace('user_id', 'cast(evidence_id as bigint)')} when 'object' then concat('{{\"rows\":', body, '}}') when 'cut' then left(body, length(body) - 1) else body end")
    return _shown(drift.statement_drift(_statement_file(v).withColumn("body", body), "main"))


_AT = "row_number() over (partition by user_id order by event_id) - 1"
_EACH = f"(select cast(user_id as varchar) as f, event_id, {_AT} as position from events) e"
_TOTAL = "select cast(user_id as varchar) as f, count(*) as n from events group by 1"
_BAD = "case when event_id % 50 = 0 then 'missing reference' when event_id % 13 = 4 then 'status=HELD' when event_id % 11 = 0 then 'amount' end"


@query(_counted_sql("monnify", f"""select f, position, 'malformed_rows' as kind, 'monnify-rows' as detail, {_BAD} as sample, '$[' || position || ']' as lineage from {_EACH} where {_BAD} is not null
union all select f, position, 'unknown_field', '$[].traceId', null, '$[' || position || ']' from {_EACH} where event_id % 3 = 0
union all select f, position, 'unknown_field', '$[].responseBody.channel', null, '$[' || position || ']' from {_EACH} where event_id % 4 = 1""", _TOTAL))
def line_drift(v):
    body = F.struct(
        F.expr("case when event_id % 50 <> 0 then 'L' || event_id end").alias("transactionReference"), F.expr(f"case when event_id % 13 = 4 then 'held' else {_STATE % 'PAID'} end").alias("paymentStatus"),
        F.when(F.col("event_id") % 11 != 0, _naira("event_id")).alias("amountPaid"), _naira("event_id").alias("settlementAmount"), F.date_format("ts", "yyyy-MM-dd").alias("paidOn"), F.lit("NGN").alias("currency"),
        F.expr("case when event_id % 4 = 1 then 'card' end").alias("channel"),
    )
    return _shown(drift.line_drift(_report(v, F.struct(body.alias("responseBody"), F.expr("case when event_id % 3 = 0 then 'x' end").alias("traceId"))), "monnify"))


@query(_counted_sql("flutterwave", f"""select f, position, 'malformed_rows' as kind, 'flutterwave-payouts' as detail, 'missing id' as sample, '$.data[' || position || ']' as lineage from {_EACH} where event_id % 50 = 0 and f not like '%7'
union all select distinct f, -1, 'unknown_shape', 'no $.data array', 'top-level keys: rows', null from {_EACH} where f like '%7'""", f"select * from ({_TOTAL}) q where f not like '%7'"))
def payout_drift(v):
    """Payout reports, some with their container renamed; the amount of the unknown fee type is no number, so the type is no news."""
    body = F.when(F.col("evidence_id").endswith("7"), F.replace("body", F.lit('{"data":'), F.lit('{"rows":'))).otherwise(F.col("body"))
    return _shown(drift.payout_drift(_payout_report(v).withColumn("body", body)))


# near misses
_MISS = f"""i as (select inflow_key, expected_net_kobo, value_date, confirmed_by is not null as spent, n % 7 = 1 as derived from inflows),
c as (select idempotency_key, amount_kobo, value_date, case when n % 5 = 0 then inflow_key end as two, stated_reference, narration from {_CREDIT} z left join (select n as m, min(inflow_key) as inflow_key from inflows group by 1) q on z.n + 1 = q.m),
named as (select idempotency_key, inflow_key from (select c.idempotency_key, i.inflow_key from (select idempotency_key, unnest(regexp_extract_all(upper(narration || ' ' || coalesce(two, '')), '[A-Z0-9][A-Z0-9_-]{{5,}}')) as word from c) c join i on c.word = upper(i.inflow_key)
 union select c.idempotency_key, i.inflow_key from c join i on c.stated_reference = i.inflow_key) n),
several as (select idempotency_key, inflow_key from named where idempotency_key in (select idempotency_key from named group by 1 having count(*) > 1)),
near as (select * from (select c.idempotency_key, i.inflow_key, i.expected_net_kobo - c.amount_kobo as difference_kobo, i.derived, i.spent, coalesce(c.value_date >= i.value_date - interval 1440 minute, true) as fits,
 cast(row_number() over (partition by c.idempotency_key order by case when abs(i.expected_net_kobo - c.amount_kobo) <= {ALLOWANCE} then 0 else 1 end, abs(i.expected_net_kobo - c.amount_kobo), i.inflow_key) as int) as rank from c cross join i) x where rank <= 4)
select near.idempotency_key, near.inflow_key, case when derived then 'settlement_line' else 'payout' end as kind, difference_kobo,
case when several.inflow_key is not null then 'ambiguous' when spent then 'already_claimed' when not fits then 'outside_window' else 'amount_differs' end as rejected_because, rank
from near left join several on near.idempotency_key = several.idempotency_key and near.inflow_key = several.inflow_key"""


@query("with " + _MISS, *PAY, "inflows", "bank_lines")
def near_misses(v):
    """Credits left over against all inflows, those confirmed before as claimed; every fifth names two."""
    credits, _ = _open(v)
    other = v["inflows"].groupBy((F.col("n") - 1).alias("n")).agg(F.min("inflow_key").alias("two"))
    both = F.concat_ws(" ", "narration", F.when(F.col("n") % 5 == 0, F.col("two")))
    credits = credits.join(other, "n", "left").withColumn("narration", both)
    inflows = v["inflows"].select("inflow_key", "expected_net_kobo", "value_date", F.col("confirmed_by").isNotNull().alias("spent"), (F.col("n") % 7 == 1).alias("derived"))
    return matching.near_misses(credits, inflows, matching.bank_names(credits, inflows), 4, ALLOWANCE)


@query("""with p as (select *, n % 3 <> 0 as searched from payouts), t as (select source, transaction_id, gross_kobo as owed, occurred_at, occurred_at + to_days(cast(k % 4 as int)) as due from promises where gross_kobo > 0),
near as (select p.payout_reference, t.transaction_id, owed - p.gross_kobo as difference_kobo, case when value_date is null or (occurred_at <= value_date and value_date <= due) then 'amount_differs' else 'outside_window' end as rejected_because,
 cast(row_number() over (partition by p.payout_reference order by abs(owed - p.gross_kobo), occurred_at, t.transaction_id) as int) as rank from p join t on p.source = t.source where searched),
large as (select source, transaction_id, owed, cast(row_number() over (partition by source order by owed desc, occurred_at, transaction_id) as int) as rank from t)
select * from near where rank <= 4 union all select p.payout_reference, l.transaction_id, l.owed - p.gross_kobo, 'not_attempted', l.rank from p join large l on p.source = l.source where not searched and l.rank <= 4""", *PAY)
def promise_misses(v):
    promises = v["promises"].withColumnRenamed("gross_kobo", "owed_kobo").withColumn("escalates_at", F.expr("occurred_at + make_dt_interval(cast(k % 4 as int))"))
    return matching.promise_misses(v["payouts"].withColumn("searched", F.expr("n % 3 <> 0")), promises, 4)


# banked money and states
@query(f"""select i.inflow_key, i.source, i.inflow_key as confirmed_by, e.credited_kobo from inflows i join payouts p on p.payout_reference = i.inflow_key
join (select transaction_id, cast(sum(amount_kobo) as bigint) as credited_kobo from ({ORACLE['book_bank_confirmed']}) b where account_id = 'bank_account' group by 1) e on e.transaction_id = i.inflow_key where p.n % 7 <> 2 and i.n % 2 = 0""", *PAY, "inflows")
def banked_inflows(v):
    """Every second inflow confirmed by the transaction of its own key; payouts with a remainder of 2 came back."""
    entries = book_bank_confirmed(v)
    inflows = v["inflows"].withColumn("confirmed_by", F.when(F.col("n") % 2 == 0, F.col("inflow_key")))
    payouts = v["payouts"].withColumn("status", F.when(F.col("n") % 7 == 2, "returned").otherwise("reported"))
    return matching.banked_inflows(inflows, entries, payouts).select("inflow_key", "source", "confirmed_by", "credited_kobo")


_ASKED = """q as (select a.transaction_id, 'settled' as to_state, t.occurred_at as moment, a.inflow_key as caused_by from allocations a join promises t on a.transaction_id = t.transaction_id where a.amount_kobo = t.gross_kobo
union select transaction_id, 'reversed', case when k % 2 = 0 then occurred_at else timestamp '1990-01-01 00:00:00' end, transaction_id || '#reversal' from promises where k % 53 = 0 and gross_kobo > 0
union select transaction_id, 'exception', timestamp '1991-01-01 00:00:00', null from promises where k % 6 = 0
union select transaction_id, 'exception', timestamp '2100-01-01 00:00:00', null from promises where k % 10 = 3
union select 'gone' || k, 'settled', occurred_at, null from promises where k % 90 = 1)"""


@query(f"""with {_ASKED}, f as (select q.*, t.state, first_value(case when to_state in ('settled', 'reversed') then to_state end ignore nulls) over w as ended, max(case when to_state = 'exception' then 1 end) over w as lifted
from q left join promises t on q.transaction_id = t.transaction_id window w as (partition by q.transaction_id order by moment, coalesce(caused_by, ''), to_state rows between unbounded preceding and 1 preceding)),
g as (select *, case when state in ('settled', 'reversed') then state else coalesce(ended, case when lifted = 1 and state is not null then 'exception' end, state) end as from_state from f)
select transaction_id, case when state is not null then from_state end as from_state, to_state, strftime(moment, '%Y-%m-%d %H:%M:%S') as moment, caused_by, case when state is null then 'unknown' when from_state = to_state then 'unchanged'
when from_state || '>' || to_state in ('authorized>settled', 'authorized>reversed', 'authorized>exception', 'exception>settled', 'exception>reversed') then 'transitioned' else 'refused' end as outcome from g""", *PAY, "allocations")
def apply_transitions(v):
    """Promises discharged whole, given back whole, escalated early or too late, and requests for transactions that are not there."""
    p = v["promises"]
    at = lambda text: F.lit(text).cast("timestamp")
    discharged = v["allocations"].select(F.col("inflow_key").alias("transaction_id"), F.col("transaction_id").alias("promise_id"), F.col("amount_kobo").alias("kobo")).join(p.select(F.col("transaction_id").alias("promise_id"), F.col("gross_kobo").alias("receivable_kobo"), F.col("occurred_at").alias("at")), "promise_id")
    back = p.where("k % 53 = 0").select("transaction_id", F.col("gross_kobo").alias("amount_kobo"), F.col("gross_kobo").alias("receivable_kobo"), F.when(F.col("k") % 2 == 0, F.col("occurred_at")).otherwise(at("1990-01-01")).alias("at"))
    asked = ledger.discharge_requests(discharged).unionByName(ledger.reversal_requests(back))
    none = F.lit(None).cast("string").alias("caused_by")
    for rule, when in (("k % 6 = 0", "1991-01-01"), ("k % 10 = 3", "2100-01-01")):
        asked = asked.unionByName(p.where(rule).select("transaction_id", F.lit("exception").alias("to_state"), at(when).alias("at"), none))
    asked = asked.unionByName(p.where("k % 90 = 1").select(F.concat(F.lit("gone"), "k").alias("transaction_id"), F.lit("settled").alias("to_state"), F.col("occurred_at").alias("at"), none))
    return ledger.apply_transitions(p.select("transaction_id", "state"), asked).withColumn("moment", stamp("at")).drop("at")


# the queue
@query("select exception_key, event_id, lag(to_state) over (partition by exception_key order by event_id) as from_state, to_state, strftime(happened_at, '%Y-%m-%d %H:%M:%S') as happened_at from exception_events", "exception_events")
def exception_history(v):
    return queue.exception_history(v["exception_events"]).withColumn("happened_at", stamp("happened_at"))


_KIND = "case cast(substr(exception_key, 2) as int) % 3 when 0 then 'payout' when 1 then 'bank_credit' else 'transaction' end"


@query(f"select exception_key, reason, to_state, case when reason in ('PHANTOM_CREDIT', 'RETURNED_PAYOUT') then 3 when reason = 'MISSING_SETTLEMENT' then 1 else 2 end as severity from (select * from {_VIEW} x where to_state = 'acknowledged' and {_KIND} = 'payout' order by raised_at, exception_key limit 40) y", "exception_events")
def queue_page(v):
    """The 40 oldest acknowledged exceptions of payouts."""
    view = queue.exceptions_view(v["exception_events"]).withColumn("subject", F.expr(_KIND))
    return queue.queue_page(view, ("acknowledged",), "payout", 40).select("exception_key", "reason", "to_state", "severity")


# signatures
@query("select event_id, event_id % 5 <> 0 and event_id % 7 <> 0 as good from events")
def verify_signed_fields(v):
    """Signatures over fields and the instant of sending: every fifth delivery is altered after it was signed, every seventh lacks the header."""
    def body(kind):
        moved = F.struct(F.concat(F.lit("T"), "event_id").alias("transactionId"), F.col("value").alias("transactionAmount"), kind.alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"))
        return F.to_json(F.struct(F.lit("payment_success").alias("event_type"), F.concat(F.lit("r"), "event_id").alias("requestId"), F.struct(F.struct(F.col("user_id").cast("string").alias("userId"), F.lit("w").alias("walletId")).alias("merchant"), moved.alias("transaction")).alias("data")))

    sent = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parts = F.concat(F.lit("payment_success:r"), "event_id", F.lit(":"), F.col("user_id").cast("string"), F.lit(":w:T"), "event_id", F.lit(":"), "event_type", F.lit(":"), sent, F.lit("::"), sent)
    signature = F.base64(F.unhex(protect.keyed_hash(parts.cast("binary"), b"key-1", 256)))
    arrived = body(F.when(F.col("event_id") % 5 == 0, "other").otherwise(F.col("event_type")))
    header = F.when(F.col("event_id") % 7 != 0, sent)
    check = protect.verify_webhook({"nomba": ("key-0", "key-1")}, "sha256", "base64")
    return v["events"].select("event_id", check(F.lit("nomba"), protect.canonical_string(arrived, header), signature).alias("good"))
