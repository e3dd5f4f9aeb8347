"""Queries over the driver's tables and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, protect
from ..operators import calendar, fees, ledger, matching, payouts, queue, reserves, sequential
from ..operators.graph import staged
from ..sources import statements, webhooks
from . import reconcile as runs
from .views import register, with_staged, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "line_conclusion"
ALLOWANCE = 10_000
#: A calendar for the driver's years.
HOLIDAYS = ("1995-01-02", "1996-10-01", "1997-12-25", "1998-01-01", "1998-05-01", "1999-12-27", "2000-06-12")
FIRST_DAY, LAST_DAY = "1994-12-01", "2001-12-31"


def query(sql: str | None, *views: str):
    """Registers a query over the canonical views; ``sql`` is DuckDB text over the views named."""

    def add(f: Callable[[dict[str, DataFrame]], DataFrame]) -> Callable:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(register(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def stamp(name: str, alias: str | None = None) -> F.Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(alias or name)


AS_OF = "1999-06-15 12:00:00"
MONEY = ("promises", "entries")
PAY = ("promises", "payouts")


# ledger
@query("select a.account_id, cast(coalesce(sum(amount_kobo), 0) as bigint) as balance_kobo from (select unnest(['psp_receivable','bank_account','psp_reserve','taxes_withheld','penalties','bank_charges','fees_expense','merchant_revenue','reversals','chargebacks','suspense']) as account_id) a left join entries e on a.account_id = e.account_id group by 1", *MONEY)
def all_balances(v):
    return ledger.all_balances(v["entries"])


@query("select transaction_id, cast(sum(amount_kobo) as bigint) as sum_kobo, count(distinct currency) > 1 as mixed from entries group by 1 having sum(amount_kobo) <> 0 or count(distinct currency) > 1", *MONEY)
def verify_conservation(v):
    return ledger.verify_conservation(v["entries"])


@query("select transaction_id, change_id, to_state from (select *, row_number() over (partition by transaction_id order by change_id desc) as rn from state_changes) x where rn = 1", "promises", "state_changes")
def latest_state(v):
    return ledger.latest(v["state_changes"], "transaction_id", "change_id", "to_state")


@query("""select g.transaction_id, cast(g.gross as bigint) as gross_kobo, cast(coalesce(a.used, 0) as bigint) as allocated_kobo, cast(g.gross - coalesce(a.used, 0) as bigint) as outstanding_kobo
from (select transaction_id, sum(amount_kobo) as gross from entries where account_id = 'psp_receivable' group by 1 having sum(amount_kobo) > 0) g
left join (select transaction_id, sum(amount_kobo) as used from allocations group by 1) a using (transaction_id) where g.gross - coalesce(a.used, 0) > 0""", *MONEY, "payouts", "allocations")
def open_promises(v):
    return ledger.open_promises(v["entries"], v["allocations"])


@query("""select transaction_id, cast(coalesce(r, 0) as bigint) as receivable_kobo, cast(used as bigint) as allocated_kobo from (select transaction_id, sum(amount_kobo) as used from allocations group by 1) a
left join (select transaction_id, sum(amount_kobo) as r from entries where account_id = 'psp_receivable' group by 1) g using (transaction_id) where used > coalesce(r, 0)""", *MONEY, "payouts", "allocations")
def over_allocation(v):
    return ledger.over_allocation(v["entries"], v["allocations"])


@query("select account_id, cast(sum(amount_kobo) as bigint) as balance_kobo from entries group by 1", *MONEY)
def fold_balances(v):
    log = v["entries"].groupBy("transaction_id").agg(F.collect_list(F.struct("account_id", F.col("amount_kobo").alias("kobo"))).alias("entries"))
    return ledger.fold_balances(log)


@query("""select coalesce(c.account_id, n.account_id) as account_id, cast(coalesce(c.b, 0) as bigint) as cached_kobo, cast(coalesce(n.b, 0) as bigint) as actual_kobo
from (select account_id, sum(amount_kobo) as b from entries where k % 53 <> 0 group by 1) c full outer join (select account_id, sum(amount_kobo) as b from entries group by 1) n on c.account_id = n.account_id
where coalesce(c.b, 0) <> coalesce(n.b, 0)""", *MONEY)
def projection_drift(v):
    cached = v["entries"].where("k % 53 <> 0").groupBy("account_id").agg(F.sum("amount_kobo").alias("balance_kobo"))
    return ledger.projection_drift(cached, v["entries"])


@query("select 't' || o_orderkey as transaction_id, 't' || o_orderkey || '#' || p as entry_id, p as ordinal, case p when 0 then 'psp_receivable' else 'merchant_revenue' end as account_id, case p when 0 then 1 else -1 end * cast(round(o_totalprice * 100) as bigint) as amount_kobo, 'NGN' as currency from orders cross join (select 0 as p union all select 1) x where o_orderstatus <> 'P'")
def book_authorized(v):
    paid = v["orders"].select(F.concat(F.lit("t"), "o_orderkey").alias("transaction_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("gross_kobo"), F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise("SUCCESSFUL").alias("status"))
    return ledger.book_authorized(paid)


@query("select e.transaction_id, ordinal, account_id, amount_kobo, currency from entries e where k % 7 <> 0 and transaction_id not in (select transaction_id from entries group by 1 having sum(amount_kobo) <> 0 or count(distinct currency) > 1)", *MONEY)
def post_transactions(v):
    old = v["entries"].where("k % 7 = 0")
    return ledger.post_transactions(v["entries"], old).drop("k")


@query("""with s as (select transaction_id, to_state, lag(to_state) over (partition by transaction_id order by change_id) as from_state from (select transaction_id, change_id, to_state from state_changes union all select transaction_id, 10000000000 + k, 'exception' from promises where k % 6 = 0) x)
select transaction_id, from_state, to_state from s where from_state <> to_state and from_state || '>' || to_state not in ('authorized>settled', 'authorized>reversed', 'authorized>exception', 'exception>settled', 'exception>reversed')""", "promises", "state_changes")
def illegal_transitions(v):
    more = v["promises"].where("k % 6 = 0").select("transaction_id", (F.lit(10000000000) + F.col("k")).alias("change_id"), F.lit("exception").alias("to_state"))
    return ledger.illegal_transitions(v["state_changes"].unionByName(more), "transaction_id", "change_id", "to_state").select("transaction_id", "from_state", "to_state")


# fees
_ASOF = """(select * from (select p.transaction_id as key_, c.*, row_number() over (partition by p.transaction_id order by c.channel = '*', c.contract_id) as rn from promises p join contracts c on p.source = c.source
 and (c.channel = coalesce(p.channel, 'unknown') or c.channel = '*') and c.effective_from <= p.occurred_at and (c.effective_to is null or p.occurred_at < c.effective_to)) z where rn = 1)"""
_FEE = "least((gross_kobo * percent_bp + 5000) // 10000 + case when gross_kobo < waived_below_kobo then 0 else flat_kobo end, cap_kobo)"


@query(f"select p.transaction_id, c.contract_id from promises p left join {_ASOF} c on p.transaction_id = c.key_", "promises", "contracts")
def fee_contract_asof(v):
    return fees.contract_asof(v["promises"], v["contracts"], "transaction_id", "occurred_at").select("transaction_id", "contract.contract_id")


@query(f"select transaction_id, cast({_FEE} as bigint) as fee_kobo, cast(({_FEE} * vat_bp + 5000) // 10000 as bigint) as vat_kobo, cast({_FEE} + ({_FEE} * vat_bp + 5000) // 10000 as bigint) as total_kobo from promises p left join {_ASOF} c on p.transaction_id = c.key_", "promises", "contracts")
def fee_quote(v):
    return fees.fee_quote(fees.contract_asof(v["promises"], v["contracts"], "transaction_id", "occurred_at")).select("transaction_id", "fee_kobo", "vat_kobo", "total_kobo")


@query("select a.source, a.channel, a.contract_id as before_id, b.contract_id from contracts a join contracts b on a.source = b.source and a.channel = b.channel and a.effective_from < b.effective_from and (a.effective_to is null or b.effective_from < a.effective_to)", "contracts")
def contract_overlap(v):
    return fees.contract_overlap(v["contracts"])


# calendar: UTC+1 all year
_DIM = f"""dim as (select day, open, sum(open::int) over (order by day) as ord from (select cast(d as date) as day, not (dayofweek(d) in (0, 6) or strftime(d, '%Y-%m-%d') in ({", ".join(repr(h) for h in HOLIDAYS)})) as open from range(date '{FIRST_DAY}', date '{LAST_DAY}' + 1, interval 1 day) r(d)) z),
local as (select transaction_id, occurred_at, cast(occurred_at + interval 1 hour as date) + case when hour(occurred_at + interval 1 hour) * 60 + minute(occurred_at + interval 1 hour) >= 1020 then 1 else 0 end as start from promises),
dues as (select l.transaction_id, e.day as effective_day, u.day + interval 16 hour as due_at from local l join dim s on s.day = l.start join dim e on e.open and e.ord = s.ord + case when s.open then 0 else 1 end join dim u on u.open and u.ord = e.ord + 2)"""
_DUE = with_views("", "promises").rstrip() + ", " + _DIM
ORACLE["settlement_deadline"] = _DUE + " select transaction_id, strftime(effective_day, '%Y-%m-%d') as effective_day, strftime(due_at, '%Y-%m-%d %H:%M:%S') as due_at from dues"
ORACLE["is_overdue"] = _DUE + f" select transaction_id, timestamp '{AS_OF}' > due_at + interval 1440 minute as overdue from dues"


def _deadlines(v):
    dim = calendar.calendar_dim(v["promises"].sparkSession, FIRST_DAY, LAST_DAY, list(HOLIDAYS))
    return calendar.settlement_deadline(v["promises"], dim, "occurred_at", "Africa/Lagos", 1020, 2, 1440)


@query(None)
def settlement_deadline(v):
    return _deadlines(v).select("transaction_id", F.col("effective_day").cast("string"), stamp("due_at"))


@query(None)
def is_overdue(v):
    return _deadlines(v).select("transaction_id", calendar.is_overdue(F.to_timestamp(F.lit(AS_OF))).alias("overdue"))


# payouts
@query("select payout_reference, cast(gross_kobo - cut as bigint) as derived_net_kobo, cast(expected_net_kobo - (gross_kobo - cut) as bigint) as unexplained_kobo, expected_net_kobo = gross_kobo - cut as consistent from payouts join (select payout_reference, sum(kobo) as cut from adjustments group by 1) a using (payout_reference)", *PAY, "adjustments")
def payout_arithmetic(v):
    return payouts.payout_arithmetic(v["payouts"], v["adjustments"])


@query("select payout_reference, case kind when 'fee' then 'fees_expense' when 'tax' then 'taxes_withheld' else 'psp_reserve' end as account_id, cast(sum(kobo) as bigint) as kobo, min(position) as position from adjustments group by 1, 2 having sum(kobo) <> 0", *PAY, "adjustments")
def adjustment_entries(v):
    return payouts.adjustment_entries(v["adjustments"])


_SHARES = """with t as (select payout_reference as inflow_key, case kind when 'fee' then 'fees_expense' when 'tax' then 'taxes_withheld' else 'psp_reserve' end as account_id, sum(kobo) as total from adjustments group by 1, 2),
w as (select inflow_key, sum(amount_kobo) as w from allocations group by 1),
x as (select t.inflow_key, account_id, transaction_id, total, abs(total)::hugeint as mag, (abs(total)::hugeint * amount_kobo) // w as base, (abs(total)::hugeint * amount_kobo) % w as rest from t join w using (inflow_key) join allocations a using (inflow_key)),
y as (select *, row_number() over (partition by inflow_key, account_id order by rest desc, transaction_id) as rn, mag - sum(base) over (partition by inflow_key, account_id) as spare from x)
select inflow_key, account_id, transaction_id, cast(sign(total) * (base + case when rn <= spare then 1 else 0 end) as bigint) as share_kobo from y"""


@query(_SHARES, *PAY, "adjustments", "allocations")
def apportion(v):
    return _shares(v)


def _shares(v) -> DataFrame:
    zero = v["adjustments"].select(F.col("payout_reference").alias("inflow_key"), "kind", "kobo")
    accounts = F.create_map(*[F.lit(x) for kv in payouts.ADJUSTMENT_ACCOUNTS.items() for x in kv])
    totals = zero.groupBy("inflow_key", accounts[F.col("kind")].alias("account_id")).agg(F.sum("kobo").alias("total_kobo"))
    shares = v["allocations"].select("inflow_key", "transaction_id", F.col("amount_kobo").alias("weight"))
    return payouts.apportion(shares, totals, "inflow_key", "transaction_id")


@query("select 'derived:' || source || ':' || strftime(settled_at, '%Y-%m-%d') as inflow_key, source, cast(sum(gross_kobo) as bigint) as gross_kobo, cast(sum(gross_kobo - fee_kobo) as bigint) as expected_net_kobo, cast(sum(fee_kobo) as bigint) as fee_kobo, count(*) as n_lines from settlement_lines where payout_reference is null group by 1, 2", "settlement_lines")
def inflow_from_lines(v):
    return payouts.inflow_from_lines(v["settlement_lines"])


# matching
_REF = "(select l.*, coalesce(p.n, 0) as n_promises, case when p.n = 1 then p.only_id end as transaction_id from settlement_lines l left join (select source, reference, count(*) as n, min(transaction_id) as only_id from promises group by 1, 2) p using (source, reference))"


@query(f"select idempotency_key, n_promises, transaction_id from {_REF} x", "promises", "settlement_lines")
def reference_match(v):
    return matching.reference_match(v["settlement_lines"], v["promises"])


_CONCLUDE = f"""(select l.idempotency_key, case
 when l.status = 'reversed' then case when p.state not in ('authorized', 'exception') or l.gross_kobo <= 0 or l.gross_kobo > p.gross_kobo then 'AMOUNT_MISMATCH' when l.gross_kobo = p.gross_kobo then 'REVERSAL' else 'PARTIAL_REVERSAL' end
 when l.status = 'chargeback' then case when p.state <> 'settled' or l.gross_kobo <= 0 or l.gross_kobo > p.gross_kobo then 'AMOUNT_MISMATCH' when l.gross_kobo = p.gross_kobo then 'CHARGEBACK' else 'PARTIAL_CHARGEBACK' end
 when p.state not in ('authorized', 'exception') then 'AMOUNT_MISMATCH'
 when l.gross_kobo = p.gross_kobo then case when q.total is null or q.total = l.fee_kobo then 'EXACT_MATCH' else 'FEE_VARIANCE' end
 when q.total is not null and p.gross_kobo - q.total = l.gross_kobo - l.fee_kobo then 'FEE_ADJUSTED_MATCH' else 'AMOUNT_MISMATCH' end as reason
 from {_REF} l join promises p using (transaction_id) left join (select transaction_id, {_FEE} + ({_FEE} * vat_bp + 5000) // 10000 as total from promises p join {_ASOF} c on p.transaction_id = c.key_) q using (transaction_id))"""
_SURE = "case when reason in ('FEE_VARIANCE', 'PARTIAL_REVERSAL', 'PARTIAL_CHARGEBACK') then 90 when reason = 'FEE_ADJUSTED_MATCH' then 99 when reason = 'AMOUNT_MISMATCH' then 0 else 100 end"


def _concluded(v):
    """The fee is predicted for the line's channel, else the promise's, at the instant of the promise."""
    found = matching.reference_match(v["settlement_lines"], v["promises"]).where("transaction_id is not null")
    lines = v["settlement_lines"].select("idempotency_key", "gross_kobo", "fee_kobo", "status", F.col("channel").alias("line_channel"))
    own = v["promises"].select("transaction_id", "source", "channel", "occurred_at", F.col("gross_kobo").alias("promise_gross"), "state")
    both = found.join(lines, "idempotency_key").join(own, "transaction_id").withColumn("channel", F.coalesce("line_channel", "channel"))
    priced = fees.contract_asof(both.withColumnRenamed("fee_kobo", "line_fee"), v["contracts"], "idempotency_key", "occurred_at")
    quoted = fees.fee_quote(priced, "promise_gross").withColumn("fee_kobo", F.col("line_fee")).withColumnRenamed("total_kobo", "predicted")
    return matching.line_conclusion(quoted)


@query(f"select idempotency_key, reason, {_SURE} as confidence_pct from {_CONCLUDE} x", "promises", "settlement_lines", "contracts")
def line_conclusion(v):
    return _concluded(v).select("idempotency_key", "reason", "confidence_pct")


@query(f"select reason, count(*) as n from {_CONCLUDE} x group by 1", "promises", "settlement_lines", "contracts")
def run_tally(v):
    return _concluded(v).groupBy("reason").agg(F.count("*").alias("n"))


@query("select payout_reference from payouts p where not exists (select 1 from inflows i where i.inflow_key = p.payout_reference and i.source = p.source)", *PAY, "inflows")
def unallocated_payouts(v):
    return matching.unallocated_payouts(v["payouts"], v["inflows"]).select("payout_reference")


@query("select idempotency_key from settlement_lines where k % 4 <> 1 and k % 6 <> 2", "settlement_lines")
def unallocated_lines(v):
    s = v["settlement_lines"]
    return matching.unallocated_lines(s, s.where("k % 4 = 1").select("idempotency_key"), s.where("k % 6 = 2").select("idempotency_key")).select("idempotency_key")


@query("select idempotency_key from bank_lines b where direction = 'debit' or not exists (select 1 from inflows i where i.confirmed_by = b.idempotency_key)", *PAY, "inflows", "bank_lines")
def unmatched_bank_lines(v):
    return matching.unmatched_bank_lines(v["bank_lines"], v["inflows"]).select("idempotency_key")


_BANKED = "(select i.inflow_key, i.source, i.expected_net_kobo, i.confirmed_by, b.amount_kobo as credited_kobo from inflows i join bank_lines b on i.confirmed_by = b.idempotency_key where b.direction = 'credit' and b.amount_kobo > 0)"


@query(f"select * from {_BANKED} x", *PAY, "inflows", "bank_lines")
def confirmed_inflows(v):
    return matching.confirmed_inflows(v["inflows"], v["bank_lines"])


_OPEN_I = "(select * from inflows where confirmed_by is null)"
_CREDIT = "(select * from bank_lines b where direction = 'credit' and amount_kobo > 0 and not exists (select 1 from inflows i where i.confirmed_by = b.idempotency_key))"
_NAMED = f"""(select idempotency_key, min(inflow_key) as inflow_key from (
 select c.idempotency_key, i.inflow_key from (select idempotency_key, unnest(regexp_extract_all(upper(narration), '[A-Z0-9][A-Z0-9_-]{{5,}}')) as word from {_CREDIT} z) c join {_OPEN_I} i on c.word = upper(i.inflow_key)
 union select c.idempotency_key, i.inflow_key from {_CREDIT} c join {_OPEN_I} i on c.stated_reference = i.inflow_key) n group by 1 having count(*) = 1)"""


def _open(v):
    lines = matching.unmatched_bank_lines(v["bank_lines"], v["inflows"])
    return lines.where("direction = 'credit' and amount_kobo > 0"), v["inflows"].where("confirmed_by is null")


@query(f"select * from {_NAMED} x", *PAY, "inflows", "bank_lines")
def bank_match_named(v):
    return matching.bank_match_named(*_open(v))


_FIT = f"(select c.idempotency_key, i.inflow_key, i.expected_net_kobo - c.amount_kobo as short_kobo from {_CREDIT} c join {_OPEN_I} i on i.expected_net_kobo - c.amount_kobo between 0 and {ALLOWANCE} and (i.value_date is null or c.value_date >= i.value_date - interval 1440 minute))"


@query(f"select * from {_FIT} x", *PAY, "inflows", "bank_lines")
def bank_match_candidates(v):
    return matching.bank_match_candidates(*_open(v), ALLOWANCE)


# amounts rounded to ten thousand units so that equal groups exist
_ROUND = f"""c as (select idempotency_key, amount_kobo // 1000000 as amount_kobo, value_date from {_CREDIT} z), i as (select inflow_key, expected_net_kobo // 1000000 as amount_kobo, value_date from {_OPEN_I} z),
g as (select amount_kobo from (select amount_kobo, count(*) as n, min(value_date) as cd from c group by 1) a join (select amount_kobo, count(*) as m, max(value_date) as id from i group by 1) b using (amount_kobo) where n >= 2 and n = m and (id is null or cd >= id - interval 1440 minute)),
l as (select idempotency_key, amount_kobo, row_number() over (partition by amount_kobo order by value_date, idempotency_key) as rn from c where amount_kobo in (select amount_kobo from g)),
r as (select inflow_key, amount_kobo, row_number() over (partition by amount_kobo order by coalesce(value_date, timestamp '1970-01-01'), inflow_key) as rn from i where amount_kobo in (select amount_kobo from g))"""
ORACLE["pair_equal_amounts"] = with_views("", *PAY, "inflows", "bank_lines").rstrip() + ", " + _ROUND + " select l.idempotency_key, r.inflow_key, l.amount_kobo from l join r using (amount_kobo, rn)"


@query(None)
def pair_equal_amounts(v):
    c, i = _open(v)
    return matching.pair_equal_amounts(c.withColumn("amount_kobo", F.expr("amount_kobo div 1000000")), i.withColumn("expected_net_kobo", F.expr("expected_net_kobo div 1000000")))


@query(f"select b.idempotency_key, x.inflow_key, b.amount_kobo from {_CREDIT} b join (select credited_kobo, min(inflow_key) as inflow_key from {_BANKED} z group by 1 having count(*) = 1) x on b.amount_kobo = x.credited_kobo", *PAY, "inflows", "bank_lines")
def duplicate_credit(v):
    return matching.duplicate_credit(matching.unmatched_bank_lines(v["bank_lines"], v["inflows"]), matching.confirmed_inflows(v["inflows"], v["bank_lines"]))


@query(f"select min(idempotency_key) as idempotency_key, inflow_key, min(amount_kobo) as amount_kobo from (select case when n % 3 = 0 then idempotency_key || '!' end as idempotency_key, amount_kobo from bank_lines where n % 3 = 0) d join (select credited_kobo, min(inflow_key) as inflow_key from {_BANKED} z group by 1 having count(*) = 1) x on d.amount_kobo = x.credited_kobo group by inflow_key having count(*) = 1", *PAY, "inflows", "bank_lines")
def returned_payout(v):
    debits = v["bank_lines"].where("n % 3 = 0").withColumn("direction", F.lit("debit")).withColumn("idempotency_key", F.concat("idempotency_key", F.lit("!")))
    return matching.returned_payout(debits, matching.confirmed_inflows(v["inflows"], v["bank_lines"])).select("idempotency_key", "inflow_key", "amount_kobo")


@query(f"select idempotency_key, inflow_key, far_kobo, rank from (select c.idempotency_key, i.inflow_key, abs(i.expected_net_kobo - c.amount_kobo) as far_kobo, cast(row_number() over (partition by c.idempotency_key order by abs(i.expected_net_kobo - c.amount_kobo), i.inflow_key) as int) as rank from {_CREDIT} c join {_OPEN_I} i on abs(i.expected_net_kobo - c.amount_kobo) <= 200000) x where rank <= 4", *PAY, "inflows", "bank_lines")
def nearest_candidates(v):
    # the SQL lists only those within 200000; as they lead the whole list, their ranks are the same
    return matching.nearest_candidates(*_open(v), 4, ALLOWANCE).where("far_kobo <= 200000")


@query(f"select idempotency_key, inflow_key, far_kobo, rank from (select c.idempotency_key, i.inflow_key, abs(i.expected_net_kobo - c.amount_kobo) as far_kobo, cast(row_number() over (partition by c.idempotency_key order by case when abs(i.expected_net_kobo - c.amount_kobo) <= {ALLOWANCE} then 0 else 1 end, abs(i.expected_net_kobo - c.amount_kobo), i.inflow_key) as int) as rank from {_CREDIT} c cross join {_OPEN_I} i) x where rank <= 4", *PAY, "inflows", "bank_lines")
def nearest_inflows(v):
    return matching.nearest_candidates(*_open(v), 4, ALLOWANCE)


@query("select payout_reference, transaction_id, far_kobo, rank from (select p.payout_reference, t.transaction_id, abs(t.gross_kobo - p.gross_kobo) as far_kobo, cast(row_number() over (partition by p.payout_reference order by abs(t.gross_kobo - p.gross_kobo), t.occurred_at, t.transaction_id) as int) as rank from payouts p join promises t on p.source = t.source where t.gross_kobo > 0) x where rank <= 4", *PAY)
def nearest_promises(v):
    v = with_staged(v, "payouts")
    return matching.nearest_promises(v["payouts"], v["promises"].withColumnRenamed("gross_kobo", "owed_kobo"), 4)


@query("select payout_reference, transaction_id, owed_kobo, rank from payouts p join (select source, transaction_id, gross_kobo as owed_kobo, cast(row_number() over (partition by source order by gross_kobo desc, occurred_at, transaction_id) as int) as rank from promises where gross_kobo > 0) t on p.source = t.source where rank <= 4", *PAY)
def unattempted_promises(v):
    return matching.unattempted_promises(v["payouts"], v["promises"].withColumnRenamed("gross_kobo", "owed_kobo"), 4)


@query("""select a.l_orderkey, a.l_linenumber, a.l_partkey, concat_ws(',', case when a.l_quantity is distinct from b.l_quantity then 'l_quantity' end, case when a.l_suppkey is distinct from b.l_suppkey then 'l_suppkey' end) as differs,
case when a.l_quantity is not distinct from b.l_quantity and a.l_suppkey is not distinct from b.l_suppkey then 'duplicate' else 'collision' end as kind from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber where a.l_partkey % 2 = 0 and b.l_partkey % 2 = 1""")
def bank_line_collision(v):
    x = v["lineitem"]
    return matching.bank_line_collision(x.where("l_partkey % 2 = 0"), x.where("l_partkey % 2 = 1"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "differs", "kind")


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice, l_shipdate) = 1 and l_orderkey % 10 <> 3 as fresh from lineitem""")
def dedupe(v):
    x = v["lineitem"]
    seen = x.where("l_orderkey % 10 = 3").select("l_orderkey", "l_linenumber")
    return matching.dedupe(x, seen, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "fresh")


# reserves
_POS = "(select h.*, cast(coalesce(r.released, 0) as bigint) as released_kobo, cast(withheld_kobo - coalesce(r.released, 0) as bigint) as outstanding_kobo from reserve_holds h left join (select inflow_key, sum(released_kobo) as released from reserve_releases group by 1) r using (inflow_key))"
_RES = (*PAY, "reserve_holds", "reserve_releases")


@query(f"select inflow_key, withheld_kobo, released_kobo, outstanding_kobo from {_POS} x", *_RES)
def reserve_positions(v):
    return reserves.reserve_positions(v["reserve_holds"], v["reserve_releases"]).select("inflow_key", "withheld_kobo", "released_kobo", "outstanding_kobo")


@query(f"select inflow_key, source, cast(least(outstanding_kobo, greatest(0, 2500000 - coalesce(b, 0))) as bigint) as applied_kobo from (select *, sum(outstanding_kobo) over (partition by source order by withheld_at, inflow_key rows between unbounded preceding and 1 preceding) as b from {_POS} x where outstanding_kobo > 0) y where least(outstanding_kobo, greatest(0, 2500000 - coalesce(b, 0))) > 0", *_RES)
def reserve_fifo_release(v):
    pos = reserves.reserve_positions(v["reserve_holds"], v["reserve_releases"])
    return reserves.reserve_fifo_release(pos, pos.select("source").distinct().withColumn("amount_kobo", F.lit(2500000).cast("long")))


@query(f"select inflow_key, source, outstanding_kobo, 'RESERVE_UNRELEASED' as reason from {_POS} x where due_at < timestamp '{AS_OF}' and outstanding_kobo > 0", *_RES)
def unreleased_reserves(v):
    return reserves.unreleased_reserves(reserves.reserve_positions(v["reserve_holds"], v["reserve_releases"]), F.to_timestamp(F.lit(AS_OF)))


@query("select 'main' as bank_account_id, balance_after_kobo as statement_kobo, cast((select sum(amount_kobo) from entries where account_id = 'psp_receivable') as bigint) as ledger_kobo, cast(balance_after_kobo - (select sum(amount_kobo) from entries where account_id = 'psp_receivable') as bigint) as difference_kobo from bank_lines where balance_after_kobo is not null order by value_date desc, idempotency_key desc limit 1", *PAY, "entries", "bank_lines")
def bank_position(v):
    own = v["entries"].where("account_id = 'psp_receivable'").agg(F.sum("amount_kobo").alias("ledger_kobo")).withColumn("bank_account_id", F.lit("main"))
    return reserves.bank_position(v["bank_lines"], own)


# queue
_VIEW = "(select * from (select *, row_number() over (partition by exception_key order by event_id desc) as rn, min(happened_at) over (partition by exception_key) as raised_at from exception_events) z where rn = 1)"


@query(f"select exception_key, to_state, reason, amount_kobo, event_id, strftime(raised_at, '%Y-%m-%d %H:%M:%S') as raised_at from {_VIEW} x", "exception_events")
def exceptions_view(v):
    return queue.exceptions_view(v["exception_events"]).select("exception_key", "to_state", "reason", "amount_kobo", "event_id", stamp("raised_at"))


_SEV = "case when reason in ('PHANTOM_CREDIT', 'RETURNED_PAYOUT') then 3 when reason = 'MISSING_SETTLEMENT' then 1 else 2 end"


@query(f"select exception_key, reason, {_SEV} as severity from (select * from {_VIEW} x where to_state <> 'resolved' order by raised_at, exception_key limit 50) y", "exception_events")
def open_exceptions(v):
    return queue.open_exceptions(queue.exceptions_view(v["exception_events"]), 50).select("exception_key", "reason", "severity")


@query(f"select exception_key, reason, case when to_state = 'acknowledged' or cast(substr(exception_key, 2) as int) % 5 = 0 then 'withheld' else 'cleared' end as effect from {_VIEW} x where to_state <> 'resolved' and cast(substr(exception_key, 2) as int) % 3 <> 0", "exception_events")
def queue_diff(v):
    keys = v["exception_events"].select("exception_key").distinct().withColumn("k", F.substring("exception_key", 2, 9).cast("int"))
    return queue.queue_diff(queue.exceptions_view(v["exception_events"]), keys.where("k % 3 = 0"), keys.where("k % 5 <> 0"))


@query(f"select d.exception_key, case when x.to_state is null then 'new' when x.to_state = 'resolved' then 'reopened' else 'unchanged' end as effect from (select 'x' || d as exception_key from range(0, 500) r(d)) d left join {_VIEW} x using (exception_key)", "exception_events")
def raise_exceptions(v):
    drafts = v["events"].sparkSession.range(500).select(F.concat(F.lit("x"), "id").alias("exception_key"))
    return queue.raise_exceptions(queue.exceptions_view(v["exception_events"]), drafts).select("exception_key", "effect")


@query("""with l as (select *, row_number() over (partition by anomaly_key order by event_id desc) as rn from anomaly_events), h as (select anomaly_key, min(happened_at) as f, max(happened_at) as t, count(*) filter (where to_state = 'raised') as times_raised, cast(coalesce(sum(occurrences) filter (where to_state = 'raised'), 0) as bigint) as total_occurrences, count(distinct evidence_id) as n_evidence from anomaly_events group by 1)
select anomaly_key, to_state, kind, occurrences, rows_in_file, times_raised, total_occurrences, n_evidence, least(3, case kind when 'unknown_shape' then 3 when 'unknown_field' then 1 else 2 end + case when 2 * occurrences >= rows_in_file then 1 else 0 end) as severity, strftime(f, '%Y-%m-%d %H:%M:%S') as first_seen, strftime(t, '%Y-%m-%d %H:%M:%S') as last_seen from l join h using (anomaly_key) where rn = 1""", "anomaly_events")
def anomaly_history(v):
    return queue.anomaly_history(v["anomaly_events"]).withColumn("first_seen", stamp("first_seen")).withColumn("last_seen", stamp("last_seen"))


@query("select reason, count(*) as n, cast(sum(amount_kobo) as bigint) as amount_kobo from exception_events where happened_at >= timestamp '2024-01-01 06:00:00' and happened_at < timestamp '2024-06-01' group by 1", "exception_events")
def summary(v):
    return queue.summary(v["exception_events"], F.to_timestamp(F.lit("2024-01-01 06:00:00")), F.to_timestamp(F.lit("2024-06-01")))


@query("select principal, action, count(distinct evidence_id) as n_evidence from evidence group by 1, 2", "evidence")
def access_volume(v):
    return queue.access_volume(v["evidence"])


@query("select evidence_id, strftime(stored_at + to_days(case when kind = 'webhook' and content = 'original' then 30 else 2192 end), '%Y-%m-%d %H:%M:%S') as purge_at from evidence", "evidence")
def purge_after(v):
    return v["evidence"].withColumn("purge_at", queue.purge_after(F.col("kind"), F.col("content"), F.col("stored_at"))).select("evidence_id", stamp("purge_at"))


@query("select evidence_id, case when kind = 'webhook' and content = 'original' then 'reduce' else 'purge' end as step from evidence where not purged and stored_at + to_days(case when kind = 'webhook' and content = 'original' then 30 else 2192 end) <= timestamp '2024-02-10'", "evidence")
def retention_due(v):
    return queue.retention_due(v["evidence"], F.to_timestamp(F.lit("2024-02-10"))).select("evidence_id", "step")


@query("select event_id, cast(round(least(1000.0::double * pow(2.0::double, event_id % 8), 300000.0::double) * (0.875::double + ('0x' || right(md5(cast(event_id as varchar)), 2))::int / 255.0::double * 0.25::double)) as bigint) as wait_ms from events")
def retry_after(v):
    return v["events"].select("event_id", queue.retry_after_ms((F.col("event_id") % 8 + 1).cast("int"), F.md5(F.col("event_id").cast("string").cast("binary"))).alias("wait_ms"))


_DEPTH = "(select state, state = 'pending' and coalesce(next_attempt_at > timestamp '2024-06-01', false) as deferred, count(*) as n, min(received_at) as oldest from deliveries group by 1, 2)"


@query(f"select state, deferred, n, strftime(oldest, '%Y-%m-%d %H:%M:%S') as oldest from {_DEPTH} x", "deliveries")
def inbox_depth(v):
    return queue.inbox_depth(v["deliveries"], F.to_timestamp(F.lit("2024-06-01"))).withColumn("oldest", stamp("oldest"))


@query(f"""with d as {_DEPTH}, q as (select count(*) as n from {_VIEW} x where to_state = 'open')
select 'backlog' as alert, cast(sum(n) as bigint) as value from d where state = 'pending' and not deferred having sum(n) > 10
union all select 'failed', cast(sum(n) as bigint) from d where state = 'failed' having sum(n) >= 1
union all select 'oldest_pending', max(date_diff('minute', oldest, timestamp '2030-06-01')) from d where state = 'pending' and not deferred having max(date_diff('minute', oldest, timestamp '2030-06-01')) > 60
union all select 'exceptions', n from q where n > 5""", "deliveries", "exception_events")
def health_alerts(v):
    at = F.to_timestamp(F.lit("2030-06-01"))
    depth = queue.inbox_depth(v["deliveries"].where("true"), F.to_timestamp(F.lit("2024-06-01"))).withColumn("oldest", F.date_trunc("minute", "oldest"))
    return queue.health_alerts(depth, queue.exceptions_view(v["exception_events"]), at, 10, 1, 60, 5)


# text and sources
@query("""select event_id, case when regexp_full_match(x, '-?[0-9]{1,15}(\\.[0-9]{1,2})?') then cast(cast(x as decimal(20,2)) * 100 as bigint) end as kobo from (select event_id, replace(trim(case event_id % 5 when 0 then cast(cast(value as decimal(20,2)) as varchar) when 1 then '1,' || lpad(cast(event_id % 1000 as varchar), 3, '0') || '.5' when 2 then 'abc' when 3 then '-12.345' else ' ' || cast(event_id as varchar) end), ',', '') as x from events) z""")
def naira_to_kobo(v):
    text = F.expr("case event_id % 5 when 0 then cast(cast(value as decimal(20,2)) as string) when 1 then '1,' || lpad(cast(event_id % 1000 as string), 3, '0') || '.5' when 2 then 'abc' when 3 then '-12.345' else ' ' || cast(event_id as string) end")
    return v["events"].select("event_id", money.naira_to_kobo(text).alias("kobo"))


@query("select idempotency_key, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(narration), '[A-Z0-9][A-Z0-9_-]{5,}'))), ' ') as tokens from bank_lines", *PAY, "bank_lines")
def narration_tokens(v):
    return v["bank_lines"].select("idempotency_key", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper("narration"), F.lit(r"[A-Z0-9][A-Z0-9_-]{5,}"), F.lit(0)))), " ").alias("tokens"))


@query("""with runs as (select doc_id, unnest(regexp_extract_all(text, '[0-9]+')) as run from documents), d as (select doc_id, run, length(run) as n from runs where length(run) between 13 and 19),
s as (select doc_id, run, n, (select sum(case when i % 2 = 0 then x when 2 * x > 9 then 2 * x - 9 else 2 * x end) from (select i, cast(substr(run, n - i, 1) as int) as x from range(0, n) r(i)) q) as t from d)
select doc_id, count(*) as n_cards from s where t % 10 = 0 group by 1""")
def scan_card_data(v):
    return protect.card_counts(v["documents"], "doc_id", "text")


@query("select event_id, date_ok, date_shape from (select event_id, case event_id % 3 when 0 then strftime(ts, '%Y-%m-%d') when 1 then null else null end as date_ok, case event_id % 3 when 0 then '9999-99-99' when 1 then '9999-99-99' else '99/99/9999' end as date_shape from events) x")
def iso_date(v):
    text = F.expr("case event_id % 3 when 0 then date_format(ts, 'yyyy-MM-dd') when 1 then '2023-02-30' else date_format(ts, 'dd/MM/yyyy') end")
    return v["events"].select("event_id", F.date_format(statements.iso_date(text), "yyyy-MM-dd").alias("date_ok"), statements.date_shape(text).alias("date_shape"))


def _statement_file(v) -> DataFrame:
    """Files of statement rows, one a user: JSON text as a bank would send."""
    row = F.to_json(F.struct(
        F.when(F.col("event_id") % 50 != 0, F.concat(F.lit("L"), F.col("event_id") % 900)).alias("id"), F.when(F.col("event_id") % 7 == 0, "transfer").when(F.col("event_id") % 2 == 0, "credit").otherwise("debit").alias("type"),
        F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("value").cast("decimal(20,2)").cast("string")).alias("amount"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_type").alias("narration"), F.when(F.col("event_id") % 3 == 0, "x").alias("branch"),
    ))
    per = v["events"].groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", row.alias("row")))).alias("rows"))
    return per.select(F.col("user_id").cast("string").alias("evidence_id"), F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["row"]), ","), F.lit("]")).alias("body"))


_ROWS = "r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as position, case when event_id % 50 <> 0 then 'L' || event_id % 900 end as id, case when event_id % 7 = 0 then 'transfer' when event_id % 2 = 0 then 'credit' else 'debit' end as type, case when event_id % 11 <> 0 then cast(cast(value as decimal(20,2)) * 100 as bigint) end as kobo, event_id % 3 = 0 as branch from events)"


@query(f"""with {_ROWS}, s as (select *, row_number() over (partition by user_id, id order by position) as rn from r)
select cast(user_id as varchar) as evidence_id, '$[' || position || ']' as lineage, kobo as amount_kobo, case when id is null then 'missing id' when type = 'transfer' then 'type=transfer' when kobo is null then 'amount' when kobo < 0 then 'negative amount' when rn > 1 then 'colliding identity' end as reject from s""")
def scan_bank_statement(v):
    return statements.scan_bank_statement(_statement_file(v), "main").select("evidence_id", "lineage", "amount_kobo", "reject")


@query(f"""with {_ROWS} select cast(user_id as varchar) as evidence_id, 'branch' as detail, count(*) filter (where branch) as occurrences, '$[' || min(position) filter (where branch) || ']' as first_lineage, count(*) as rows_in_file, 'unknown_field' as kind from r group by 1 having count(*) filter (where branch) > 0""")
def drift_profile(v):
    return statements.drift_profile(_statement_file(v), ["id", "type", "amount", "date", "narration", "balance", "reference"])


@query("""select event_id, case when event_id % 9 = 0 then 'unverified' when event_id % 10 = 0 then 'rejected' when event_id % 4 <> 0 then 'ignored' else 'payment' end as result, case when event_id % 10 <> 0 then 'payment:paystack:r' || event_id else 'payment:paystack' end as idempotency_key from events""")
def scan_webhooks(v):
    data = F.struct(F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("r"), "event_id")).alias("reference"), F.abs(F.round(F.col("value") * 100)).cast("long").alias("amount"), F.lit("NGN").alias("currency"), F.when(F.col("event_id") % 4 == 0, "success").otherwise("failed").alias("status"))
    body = F.to_json(F.struct(F.lit("charge.success").alias("event"), data.alias("data")))
    sent = v["events"].select("event_id", F.lit("paystack").alias("source"), body.alias("body"), (F.col("event_id") % 9 != 0).alias("verified"))
    return webhooks.scan_webhooks(sent).select("event_id", "result", "idempotency_key")


@query("""with r as (select p.source, p.value_date as moment, x.released_by as name, x.released_kobo as kobo from reserve_releases x join payouts p on x.inflow_key = p.payout_reference),
e as (select source, withheld_at as moment, 0 as turn, inflow_key as name, withheld_kobo as kobo from reserve_holds union all select source, moment, 1, name, kobo from r),
s as (select *, sum(case turn when 0 then kobo else -kobo end) over w as total, sum(case turn when 0 then kobo else 0 end) over w as held, sum(case turn when 1 then kobo else 0 end) over w as freed from e where kobo > 0 window w as (partition by source order by moment, turn, name rows unbounded preceding)),
m as (select *, least(0, min(total) over (partition by source order by moment, turn, name rows unbounded preceding)) as low, least(0, coalesce(min(total) over (partition by source order by moment, turn, name rows between unbounded preceding and 1 preceding), 0)) as low_then from s),
h as (select source, name, held - kobo as a, held as b from m where turn = 0), f as (select source, name, freed - kobo + low_then as a, freed + low as b, low_then - low as over from m where turn = 1)
select f.source, f.name as released_by, h.name as inflow_key, cast(least(h.b, f.b) - greatest(h.a, f.a) as bigint) as applied_kobo, cast(0 as bigint) as unapplied_kobo from f join h on f.source = h.source and h.a < f.b and f.a < h.b
union all select source, name, null, 0, cast(over as bigint) from f where over > 0""", *PAY, "reserve_holds", "reserve_releases")
def reserve_fold(v):
    releases = v["reserve_releases"].join(v["payouts"].select(F.col("payout_reference").alias("inflow_key"), "source", F.col("value_date").alias("at")), "inflow_key").select("source", "at", "released_by", F.col("released_kobo").alias("amount_kobo"))
    return reserves.reserve_fold(v["reserve_holds"], releases)


def _ready(v):
    dim = calendar.calendar_dim(v["promises"].sparkSession, FIRST_DAY, LAST_DAY, list(HOLIDAYS))
    none = v["allocations"].where("false")
    promises = runs.promises_for(v["entries"], v["promises"], none, dim, "Africa/Lagos", 1020, 2, 1440)
    return promises, v["payouts"].withColumn("value_date", F.col("value_date") + F.make_dt_interval(F.lit(1)))


@query(None)
def allocate(v):
    promises, rows = _ready(v)
    terms = fees.contract_asof(v["promises"], v["contracts"], "transaction_id", "occurred_at").select("transaction_id", "contract")
    promises = promises.join(terms, "transaction_id")
    net = payouts.payout_arithmetic(v["payouts"], v["adjustments"]).select("payout_reference", "derived_net_kobo")
    return sequential.allocate(promises, rows.join(net, "payout_reference").select("source", "payout_reference", "gross_kobo", "expected_net_kobo", "derived_net_kobo", "value_date"))


@query(None)
def confirm(v):
    credits, inflows = (staged(x) for x in _open(with_staged(v, "payouts")))
    return sequential.confirm(inflows, credits, matching.bank_names(credits, inflows), matching.bank_match_candidates(credits, inflows, ALLOWANCE), ALLOWANCE)


@query(None)
def reconcile(v):
    promises, rows = _ready(v)
    return runs.reconcile(promises, rows, v["adjustments"], v["bank_lines"], ALLOWANCE).exceptions


def _lanes(v):
    """The open promises of each source dealt into lanes of a few a day, payouts and bank lines made from them, and payouts banked before."""
    dim = calendar.calendar_dim(v["promises"].sparkSession, FIRST_DAY, LAST_DAY, list(HOLIDAYS))
    promises = runs.promises_for(v["entries"], v["promises"], v["allocations"].where("false"), dim, "Africa/Lagos", 1020, 2, 1440, v["contracts"])
    promises = staged(promises)
    lanes = max(1, promises.count() // 8000)  # some 2400 days, four sources, a week in reach
    promises = promises.withColumn("source", F.concat_ws("/", "source", F.pmod(F.xxhash64("transaction_id"), F.lit(lanes)).cast("string")))
    priced = fees.fee_quote(promises, "owed_kobo").withColumn("net", F.col("owed_kobo") - F.coalesce("total_kobo", F.lit(0)))
    per = priced.groupBy("source", F.to_date("occurred_at").alias("day")).agg(F.sum("owed_kobo").alias("gross"), F.sum("net").alias("net"), F.min("owed_kobo").alias("least"))
    kind = F.pmod(F.xxhash64("source", "day"), F.lit(10))
    gross = F.when(kind == 1, F.col("net")).when(kind == 2, F.expr("least div 3")).when(kind == 3, F.col("gross") + 1).otherwise(F.col("gross"))
    rows = per.select("source", F.concat_ws("-", F.lit("p"), "source", "day").alias("payout_reference"), gross.alias("gross_kobo"), (gross - F.when(kind == 4, 1).otherwise(0)).alias("expected_net_kobo"), (F.col("day").cast("timestamp") + F.make_dt_interval(F.lit(1))).alias("value_date"))
    rows = staged(rows)
    side = F.pmod(F.xxhash64("payout_reference"), F.lit(12))
    at = F.col("value_date") + F.make_dt_interval(F.lit(0), F.lit(5))
    line = lambda key, direction, amount, said: (F.concat(F.lit(key), "payout_reference").alias("idempotency_key"), F.lit(direction).alias("direction"), amount.alias("amount_kobo"), at.alias("value_date"), said.alias("narration"), F.when(side % 3 == 0, F.col("payout_reference")).alias("stated_reference"))
    net, said = F.col("expected_net_kobo"), F.when(side % 3 == 1, "TRF").otherwise(F.concat(F.lit("TRF "), "payout_reference"))
    lines = rows.where(side != 5).select(*line("bank:", "credit", net - F.when(side == 6, 5000).when(side == 9, 90_000_000).otherwise(0), said))
    lines = lines.unionByName(rows.where(side == 7).select(*line("bank:twice:", "credit", net, said))).unionByName(rows.where(side == 8).select(*line("bank:back:", "debit", net, said)))
    return promises, rows, lines


@query(None)
def reconcile_run(v):
    """Every conclusion of a whole run: (subject, subject_id, reason), deferred ones and matches among them."""
    promises, rows, lines = _lanes(v)
    none = v["adjustments"].where("false")
    run = runs.reconcile(promises, rows, none, lines, ALLOWANCE, as_of=F.lit("1998-08-04 12:00:00").cast("timestamp"))
    done = run.allocations.where(F.col("reason").isin("PAYOUT_MATCH", "PARTIAL_PAYOUT_MATCH")).select(F.lit("payout").alias("subject"), F.col("payout_reference").alias("subject_id"), "reason").distinct()
    banked = run.confirmations.select(F.lit("bank_credit").alias("subject"), F.col("idempotency_key").alias("subject_id"), F.when(F.col("how") == "bank_charge", "BANK_CHARGE").otherwise("BANK_CONFIRMED").alias("reason"))
    back = run.returned.select(F.lit("debit").alias("subject"), F.col("idempotency_key").alias("subject_id"), F.lit("RETURNED_PAYOUT").alias("reason"))
    out = done
    for part in (banked, back, run.exceptions, run.deferred):
        out = out.unionByName(part)
    return out


@query("select event_id, '{\"event_id\": ' || event_id || ', \"event_type\": \"[redacted]\", \"props\": {\"user\": \"[redacted]\"}}' as body from events")
def redact(v):
    text = F.to_json(F.struct("event_id", "event_type", F.struct(F.col("user_id").alias("user")).alias("props")))
    return v["events"].select("event_id", protect.redact_json(frozenset({"event_id"}))(text).alias("body"))


@query("select event_id, event_id % 5 <> 0 as good from events")
def verify_webhook(v):
    """Signatures of the body's hash with a key known to the sender; every fifth is forged."""
    body = F.col("event_id").cast("string").cast("binary")
    sent = F.when(F.col("event_id") % 5 == 0, _hmac(body, "other")).otherwise(_hmac(body, "key-1"))
    signed = v["events"].select("event_id", body.alias("body"), sent.alias("signature"))
    return signed.select("event_id", protect.verify_webhook({"psp": ("key-0", "key-1")})(F.lit("psp"), "body", "signature").alias("good"))


def _hmac(body, key: str):
    """HMAC-SHA-512 by its definition, for keys shorter than a block; the padded keys are constants of the plan."""
    pad = lambda byte: F.lit(bytes(k ^ byte for k in key.encode().ljust(128, b"\0")))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), body), 512))
    return F.sha2(F.concat(pad(0x5C), inner), 512)


@query("select evidence_id, kind as plain from evidence", "evidence")
def envelope(v):
    """Round trip of AES-GCM with the evidence id as additional data."""
    key = F.lit("0123456789abcdef").cast("binary")
    sealed = v["evidence"].withColumn("sealed", protect.seal(F.col("kind").cast("binary"), key, F.col("evidence_id").cast("binary")))
    return sealed.select("evidence_id", protect.unseal(F.col("sealed"), key, F.col("evidence_id").cast("binary")).cast("string").alias("plain"))
