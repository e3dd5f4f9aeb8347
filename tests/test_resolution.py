"""Decisions taken whole or refused."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from reconcord.operators import resolution

T0 = datetime(2024, 1, 1)


def test_a_decision_its_entries_and_the_closing_row_go_together(spark):
    view = spark.createDataFrame([("a", "open"), ("b", "acknowledged"), ("c", "resolved"), ("d", "open"), ("e", "open")], "exception_key string, to_state string")
    rows = [
        ("1", "a", "reclassify", "ann", "ann", 0), ("2", "a", "reclassify", "ann", "bob", 1), ("3", "a", "note", "ann", None, 2), ("4", "b", "note", "ann", None, 0), ("5", "c", "note", "ann", None, 0),
        ("6", "d", "reclassify", "ann", "bob", 0), ("7", "e", "reclassify", "ann", "bob", 0), ("8", "none", "note", "ann", None, 0), ("9", "e", "write_off", "ann", None, 0), ("10", "e", "note", "ann", "bob", 3),
    ]
    decisions = spark.createDataFrame([(i, k, action, 5, who, by, T0 if by else None, T0 + timedelta(hours=h)) for i, k, action, who, by, h in rows], "decision_id string, exception_key string, action string, amount_kobo long, resolver string, approver string, approved_at timestamp, at timestamp")
    legs = {"1": [("suspense", 5), ("chargebacks", -5)], "2": [("suspense", 5), ("chargebacks", -5)], "6": [("bank_account", 5), ("suspense", -5)], "7": [("suspense", 5), ("chargebacks", -4)], "10": [("suspense", 0)]}
    entries = spark.createDataFrame([(i, a, k, "NGN") for i, own in legs.items() for a, k in own], "decision_id string, account_id string, amount_kobo long, currency string")
    done = resolution.resolve(view, decisions, entries)
    assert {r["decision_id"]: r["failure"] for r in done.refused.collect()} == {
        "1": "self approval", "3": "already resolved", "5": "already resolved", "6": "touches the bank", "7": "unbalanced", "8": "no such exception", "9": "approval needed", "10": "void entry",
    }
    assert sorted((r["exception_key"], r["from_state"], r["to_state"], r["decision_id"]) for r in done.closing.collect()) == [("a", "open", "resolved", "2"), ("b", "acknowledged", "resolved", "4")]
    assert sorted(r["decision_id"] for r in done.accepted.collect()) == ["2", "4"]
    assert [tuple(r) for r in done.entries.groupBy("decision_id").agg(F.sum("amount_kobo"), F.count("*")).collect()] == [("2", 0, 2)]
    assert resolution.resolve(view, decisions.limit(0), entries).refused.count() == 0
