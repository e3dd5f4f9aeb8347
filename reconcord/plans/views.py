"""Canonical relations over the driver's tables, as SQL text for Spark and for DuckDB.

Keys are hashed with integer arithmetic, so that both engines derive the same
rows.  Money is in minor units, instants are timestamps in UTC.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import staged

TABLES = ("customer", "documents", "events", "lineitem", "orders", "part", "supplier")


@dataclass(frozen=True)
class Dialect:
    """The few spots where the two engines' SQL differs."""

    spark: bool

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})" if self.spark else f"({a} // {b})"

    def later(self, ts: str, minutes: str) -> str:
        return f"({ts} + make_dt_interval(0, 0, cast({minutes} as int)))" if self.spark else f"({ts} + to_minutes(cast({minutes} as bigint)))"


SPARK, DUCK = Dialect(True), Dialect(False)
NO_STAMP = "cast(null as timestamp)"


def texts(d: Dialect) -> dict[str, str]:
    """View name to SQL; a view may use those before it."""
    source = "case o_orderkey % 4 when 0 then 'paystack' when 1 then 'flutterwave' when 2 then 'nomba' else 'monnify' end"
    gross = "cast(round(o_totalprice * 100) as bigint)"
    fee = d.div(f"({gross} * 150 + 5000)", "10000")
    return {
        "promises": f"""
            select 't' || o_orderkey as transaction_id, {source} as source,
              'r' || (o_orderkey - case when o_orderkey % 101 = 0 and o_orderkey > 4 then 4 else 0 end) as reference,
              case when o_orderkey % 7 = 0 then null when o_orderpriority in ('1-URGENT', '2-HIGH') then 'card' when o_orderpriority = '3-MEDIUM' then 'bank_transfer' else 'ussd' end as channel,
              case when o_orderkey % 19 = 0 then 'settled' when o_orderkey % 31 = 0 then 'exception' else 'authorized' end as state,
              {d.later("cast(o_orderdate as timestamp)", "(o_orderkey * 7919) % 1440")} as occurred_at, {gross} as gross_kobo, o_orderkey as k
            from orders""",
        "entries": """
            select transaction_id, 0 as ordinal, 'psp_receivable' as account_id, gross_kobo as amount_kobo, case when k % 997 = 5 then 'USD' else 'NGN' end as currency, k from promises
            union all
            select transaction_id, 1, 'merchant_revenue', case when k % 499 = 7 then 1 - gross_kobo else -gross_kobo end, 'NGN', k from promises
            union all
            select transaction_id || '#reversal', 0, 'reversals', gross_kobo, 'NGN', k from promises where k % 53 = 0
            union all
            select transaction_id || '#reversal', 1, 'psp_receivable', -gross_kobo, 'NGN', k from promises where k % 53 = 0""",
        "state_changes": """
            select transaction_id, 2 * k as change_id, 'authorized' as to_state from promises
            union all
            select transaction_id, 2 * k + 1, state from promises where state <> 'authorized'""",
        "settlement_lines": f"""
            select 'settlement:' || o_orderkey as idempotency_key, {source} as source, 'r' || o_orderkey as reference,
              case when o_orderkey % 3 = 0 then 'p' || o_orderkey % 211 end as payout_reference,
              case when o_orderkey % 2 = 0 then 'card' end as channel,
              case when o_orderkey % 11 = 3 then {gross} - 700 else {gross} end as gross_kobo,
              case when o_orderkey % 13 = 0 then {fee} + 1 else {fee} end as fee_kobo,
              case when o_orderkey % 23 = 0 then 'reversed' when o_orderkey % 29 = 0 then 'chargeback' else 'settled' end as status,
              {d.later("cast(o_orderdate as timestamp)", "1440 + (o_orderkey * 31) % 1440")} as settled_at, o_orderkey as k
            from orders where o_orderkey % 5 <> 4""",
        "payouts": """
            select source, 'p-' || source || '-' || cast(cast(occurred_at as date) as varchar(10)) as payout_reference, sum_gross as gross_kobo,
              sum_gross - fee - tax - reserve + case when n % 17 = 0 then 1 else 0 end as expected_net_kobo, fee, tax, reserve, value_date, n
            from (
              select source, cast(occurred_at as date) as occurred_at, cast(sum(gross_kobo) as bigint) as sum_gross, cast(max(k) as bigint) as n,
                cast(sum(gross_kobo % 1000) as bigint) as fee, cast(count(*) * 75 as bigint) as tax, cast(case when max(k) % 5 = 0 then 40000 else 0 end as bigint) as reserve,
                max(cast(cast(occurred_at as date) as timestamp)) as value_date
              from promises group by source, cast(occurred_at as date)
            ) g""",
        "adjustments": """
            select payout_reference, 1 as position, 'fee' as kind, fee as kobo from payouts
            union all select payout_reference, 2, 'tax', tax from payouts
            union all select payout_reference, 3, 'reserve', reserve from payouts
            union all select payout_reference, 4, 'fee', cast(n % 3 as bigint) from payouts
            union all select payout_reference, 5, 'reserve_release', cast(-(n % 2) as bigint) from payouts""",
        "inflows": f"""
            select payout_reference as inflow_key, source, gross_kobo, expected_net_kobo, case when n % 41 = 0 then {NO_STAMP} else {d.later("value_date", "1440")} end as value_date,
              case when n % 6 = 0 then 'bank:' || payout_reference end as confirmed_by, n
            from payouts where n % 9 <> 4""",
        "allocations": """
            select p.payout_reference as inflow_key, t.transaction_id, t.gross_kobo + case when t.k % 307 = 11 then 1 else 0 end as amount_kobo
            from payouts p join promises t on p.source = t.source and p.payout_reference = 'p-' || t.source || '-' || cast(cast(t.occurred_at as date) as varchar(10))
            where p.n % 9 <> 4 and t.k % 8 <> 3""",
        "bank_lines": f"""
            select 'bank:' || payout_reference || copy as idempotency_key, 'main' as bank_account_id, case when n % 37 = 0 and copy = '' then 'debit' else 'credit' end as direction,
              expected_net_kobo - case when n % 4 = 1 then 5250 when n % 4 = 2 then 60000 else 0 end as amount_kobo,
              case when n % 10 = 0 then null else expected_net_kobo * 2 end as balance_after_kobo, {d.later("value_date", "1440 + n % 2880")} as value_date,
              case when n % 3 = 0 then 'TRF from psp' else 'TRF ' || upper(payout_reference) || ' psp' end as narration,
              case when n % 8 = 0 then payout_reference end as stated_reference, n
            from (select *, '' as copy from payouts union all select *, '#2' from payouts where n % 25 = 0) twice""",
        "named_lines": """
            select idempotency_key, upper(payout_reference) as token from bank_lines b join payouts p on b.n = p.n and b.narration <> 'TRF from psp'""",
        "contracts": """
            select * from (values
              ('c1', 'paystack', 'card', timestamp '1990-01-01 00:00:00', timestamp '1998-01-01 00:00:00', 150, 10000, 250000, 200000, 750),
              ('c2', 'paystack', 'card', timestamp '1998-01-01 00:00:00', cast(null as timestamp), 140, 10000, 250000, 200000, 750),
              ('c3', 'paystack', '*', timestamp '1990-01-01 00:00:00', cast(null as timestamp), 100, 0, 0, 150000, 750),
              ('c4', 'flutterwave', '*', timestamp '1996-06-01 00:00:00', cast(null as timestamp), 140, 0, 0, 200000, 750),
              ('c5', 'monnify', 'bank_transfer', timestamp '1990-01-01 00:00:00', cast(null as timestamp), 0, 1000, 0, 1000, 0),
              ('c6', 'monnify', 'card', timestamp '1990-01-01 00:00:00', timestamp '1999-01-01 00:00:00', 150, 0, 0, 200000, 750),
              ('c7', 'monnify', 'card', timestamp '1998-06-01 00:00:00', cast(null as timestamp), 160, 0, 0, 200000, 750)
            ) as t(contract_id, source, channel, effective_from, effective_to, percent_bp, flat_kobo, waived_below_kobo, cap_kobo, vat_bp)""",
        "exception_events": """
            select 'x' || user_id % 400 as exception_key, event_id, cast(ts as timestamp) as happened_at,
              case event_type when 'purchase' then 'resolved' when 'click' then 'acknowledged' else 'open' end as to_state,
              case user_id % 5 when 0 then 'PHANTOM_CREDIT' when 1 then 'AMOUNT_MISMATCH' when 2 then 'MISSING_SETTLEMENT' when 3 then 'RESERVE_UNRELEASED' else 'RETURNED_PAYOUT' end as reason,
              cast(round(value * 100) as bigint) as amount_kobo
            from events""",
        "anomaly_events": """
            select 'a' || user_id % 300 as anomaly_key, event_id, cast(ts as timestamp) as happened_at,
              case event_type when 'purchase' then 'conformed' when 'click' then 'acknowledged' else 'raised' end as to_state,
              case user_id % 4 when 0 then 'unknown_field' when 1 then 'unknown_value' when 2 then 'malformed_rows' else 'unknown_shape' end as kind,
              event_id % 17 + 1 as occurrences, event_id % 40 + 17 as rows_in_file, 'e' || event_id % 90 as evidence_id
            from events""",
        "deliveries": """
            select 'd' || event_id % 700 as delivery_id, event_id as seq, cast(ts as timestamp) as received_at,
              case event_id % 6 when 0 then 'pending' when 1 then 'failed' when 2 then 'ignored' when 3 then 'pending' else 'processed' end as state, cast(event_id % 8 as int) as attempts,
              case event_id % 12 when 3 then timestamp '2100-01-01 00:00:00' end as next_attempt_at
            from events""",
        "evidence": """
            select 'e' || event_id as evidence_id, case event_id % 3 when 0 then 'webhook' when 1 then 'psp_settlement' else 'bank_statement' end as kind,
              case event_id % 2 when 0 then 'original' else 'redacted' end as content, cast(ts as timestamp) as stored_at, event_id % 50 = 7 as purged, 'u' || user_id % 20 as principal, event_type as action
            from events""",
        "reserve_holds": f"""
            select payout_reference as inflow_key, source, 40000 + n % 1000 as withheld_kobo, value_date as withheld_at, case when n % 15 = 0 then {NO_STAMP} else {d.later("value_date", "129600")} end as due_at
            from payouts where n % 5 = 0""",
        "reserve_releases": """
            select payout_reference as inflow_key, 'b' || n as released_by, 10000 + n % 100 as released_kobo from payouts where n % 10 = 0
            union all select payout_reference, 'c' || n, 20000 from payouts where n % 20 = 0""",
    }


def register(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All views as DataFrames; nothing is computed yet."""
    out: dict[str, DataFrame] = {}
    raw = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    for name, df in raw.items():
        df.createOrReplaceTempView(name)
    for name, text in texts(SPARK).items():
        out[name] = spark.sql(text)
        out[name].createOrReplaceTempView(name)
    return raw | out


def with_staged(v: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """The views with one of them computed once, and those behind it made of what was written."""
    out, own = v | {name: staged(v[name])}, texts(SPARK)
    out[name].createOrReplaceTempView(name)
    for later in list(own)[list(own).index(name) + 1 :]:
        out[later] = out[name].sparkSession.sql(own[later])
        out[later].createOrReplaceTempView(later)
    return out


def with_views(sql: str, *names: str) -> str:
    """DuckDB text with the named views in front."""
    own = texts(DUCK)
    used = [v for v in own if v in names]
    first = "with " + ",\n".join(f"{v} as ({own[v]})" for v in used)
    return f"{first},\n{sql[5:]}" if sql.startswith("with ") else f"{first}\n{sql}"
