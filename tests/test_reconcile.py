"""The whole run: prices, the net retry, and every conclusion that it can come to."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from reconcord.operators import calendar
from reconcord.plans import reconcile as runs

T0 = datetime(2024, 3, 4, 9)
DAY = timedelta(days=1)


def made(spark):
    promises = spark.createDataFrame([("paystack", "t1", "card", "authorized", T0), ("paystack", "t2", None, "authorized", T0), ("other", "t3", "card", "authorized", T0), ("other", "t4", "card", "authorized", T0 - 20 * DAY)], "source string, transaction_id string, channel string, state string, occurred_at timestamp")
    owed = {"t1": 100_000, "t2": 7_000, "t3": 50_000, "t4": 900}
    entries = spark.createDataFrame([(t, i, a, s * k) for t, k in owed.items() for i, (a, s) in enumerate([("psp_receivable", 1), ("merchant_revenue", -1)])], "transaction_id string, ordinal int, account_id string, amount_kobo long")
    contracts = spark.createDataFrame([("c1", "paystack", "card", datetime(2020, 1, 1), None, 150, 10_000, 250_000, 200_000, 750)], "contract_id string, source string, channel string, effective_from timestamp, effective_to timestamp, percent_bp int, flat_kobo int, waived_below_kobo int, cap_kobo int, vat_bp int")
    dim = calendar.calendar_dim(spark, "2024-01-01", "2024-12-31", [])
    none = spark.createDataFrame([], "transaction_id string, amount_kobo long")
    priced = lambda c: runs.promises_for(entries, promises, none, dim, "UTC", 1020, 2, 1440, c)
    return priced, contracts


def test_a_payout_of_the_net_alone_is_found_by_predicted_fees(spark):
    priced, contracts = made(spark)
    # 1.5 % of 100000, the flat part waived, and 7.5 % of the fee
    net = 100_000 - 1500 - 113
    payout = spark.createDataFrame([("paystack", "PAYOUT-1", net, net, T0 + DAY)], "source string, payout_reference string, gross_kobo long, expected_net_kobo long, value_date timestamp")
    adjustments = spark.createDataFrame([], "payout_reference string, position int, kind string, kobo long")
    lines = spark.createDataFrame([("bank:1", "credit", net, T0 + DAY, "TRF payout-1", None), ("bank:2", "credit", net, T0 + DAY, "TRF payout-1", None), ("bank:3", "debit", net, T0 + 2 * DAY, "", None)], "idempotency_key string, direction string, amount_kobo long, value_date timestamp, narration string, stated_reference string")
    run = runs.reconcile(priced(contracts), payout, adjustments, lines, 0, as_of=F.lit(T0 + 10 * DAY))
    assert [(r["reason"], r["transaction_id"], r["amount_kobo"]) for r in run.allocations.collect()] == [("PAYOUT_MATCH", "t1", 100_000)]
    assert [tuple(r) for r in run.confirmations.collect()] == [("bank:1", "PAYOUT-1", "named")]
    assert [tuple(r) for r in run.returned.collect()] == [("bank:3", "PAYOUT-1")]
    assert sorted(tuple(r) for r in run.exceptions.collect()) == [("bank_credit", "bank:2", "DUPLICATE_BANK_CREDIT"), *[("promise", t, "MISSING_SETTLEMENT") for t in ("t2", "t3", "t4")]]
    # without terms the amount fits nothing: only a part of the larger promise is left to claim
    bare = runs.reconcile(priced(None), payout, adjustments, lines, 0)
    assert [(r["reason"], r["transaction_id"], r["amount_kobo"]) for r in bare.allocations.collect()] == [("PARTIAL_PAYOUT_MATCH", "t1", net)]
    assert sorted(r["reason"] for r in bare.deferred.collect() if r["subject"] == "promise") == ["PARTIAL_SETTLEMENT"] + ["PENDING_T_PLUS_N"] * 3
