"""Alerts of what nobody did, and contracts that reach into each other."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from reconcord.operators import fees, queue

NOW = datetime(2024, 5, 1)


def test_stale_alerts(spark):
    at = lambda minutes: NOW - timedelta(minutes=minutes)
    runs = spark.createDataFrame([(at(90),), (at(61),)], "happened_at timestamp")
    statements = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "bank_account_id string")
    checks = spark.createDataFrame([("a", at(10)), ("a", at(500)), ("b", at(101)), ("d", at(900))], "bank_account_id string, as_of timestamp")
    found = lambda *most: sorted(map(tuple, queue.stale_alerts(runs, statements, checks, F.lit(NOW), *most).collect()), key=str)
    # c was never compared; d has no statement; an age equal to the threshold is not stale
    assert found(60, 100) == [("attestation", "b", 101), ("attestation", "c", None), ("reconciliation", "", 61)]
    assert found(61, 101) == [("attestation", "c", None)]
    assert found(0, 0) == []
    assert [tuple(r) for r in queue.stale_alerts(runs.limit(0), statements, checks, F.lit(NOW), 60, 0).collect()] == [("reconciliation", "", None)]


def test_the_contract_that_reaches_furthest_is_named(spark):
    day = lambda n: datetime(2024, 1, n) if n else None
    rows = [("long", "card", 1, 20), ("short", "card", 2, 3), ("inside", "card", 5, 6), ("next", "card", 20, None), ("last", "card", 25, 26), ("other", "*", 2, None)]
    df = spark.createDataFrame([(i, "s", c, day(a), day(b)) for i, c, a, b in rows], "contract_id string, source string, channel string, effective_from timestamp, effective_to timestamp")
    # the neighbour before "inside" ended earlier: it is "long" that reaches into it
    assert sorted((r["before_id"], r["contract_id"]) for r in fees.contract_overlap(df).collect()) == [("long", "inside"), ("long", "short"), ("next", "last")]
