"""Retention and the inbox sweep carried out, with rows that cannot be."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from reconcord.functions import protect
from reconcord.operators import retention

NOW = datetime(2024, 6, 1)
BODY = '{"event":"charge","data":{"email":"x@y.ng","id":1}}'
RING = protect.KeyRing({"a": b"a" * 32}, "a")


def aad():
    return protect.context(evidence=F.col("evidence_id"))


def sealed(spark, rows):
    own = spark.createDataFrame([(i, kind, content, NOW - timedelta(days=age), purged, body) for i, kind, content, age, purged, body in rows], "evidence_id string, kind string, content string, stored_at timestamp, purged boolean, body string")
    return protect.seal_rows(own, RING, F.col("body"), aad()).drop("body").withColumn("sealed", F.when(F.col("evidence_id") == "altered", F.lit(b"no")).otherwise(F.col("sealed")))


def test_what_is_due_is_reduced_or_purged_and_failures_stay(spark):
    df = sealed(spark, [
        ("young", "webhook", "original", 29, False, BODY), ("old", "webhook", "original", 30, False, BODY), ("altered", "webhook", "original", 31, False, BODY),
        ("empty", "webhook", "original", 31, False, None), ("export", "psp_settlement", "original", 2192, False, "[]"), ("recent", "bank_statement", "original", 2191, False, "[]"),
        ("gone", "webhook", "original", 99, True, BODY), ("reduced", "webhook", "redacted", 2192, False, BODY),
    ])
    done = retention.apply_retention(df, RING, F.lit(NOW), protect.redact_payload())
    rows = {r["evidence_id"]: r for r in protect.unseal_rows(done.rows, RING, aad()).collect()}
    assert {k: r["result"] for k, r in rows.items()} == {"young": "kept", "old": "redacted", "altered": "failed", "empty": "failed", "export": "purged", "recent": "kept", "gone": "kept", "reduced": "purged"}
    old = rows["old"]
    assert old["content"] == "redacted" and old["stored_at"] == NOW and b"x@y.ng" not in bytes(old["plain"]) and b'"id":1' in bytes(old["plain"])
    assert rows["export"]["purged"] and bytes(rows["export"]["sealed"]) == b"" and bytes(rows["export"]["wrapped_key"]) == b"" and rows["export"]["stored_at"] == NOW - timedelta(days=2192)
    assert bytes(rows["young"]["plain"]).decode() == BODY and bytes(rows["altered"]["sealed"]) == b"no"
    assert sorted(tuple(r) for r in done.failed.collect()) == [("altered", "cannot be opened"), ("empty", "cannot be opened")]
    assert sorted((r["subject"], r["from"], r["to"], r["dropped_fields"]) for r in done.audit.collect()) == [("export", "original", "purged", None), ("old", "original", "redacted", 1), ("reduced", "redacted", "purged", None)]
    # a second pass finds nothing but what failed
    again = retention.apply_retention(done.rows.drop("result"), RING, F.lit(NOW), protect.redact_payload())
    assert again.audit.count() == 0 and again.failed.count() == 2


def test_a_redactor_that_gives_up_fails_its_row_alone(spark):
    df = sealed(spark, [("one", "webhook", "original", 40, False, BODY), ("two", "webhook", "original", 40, False, "other")])
    gives_up = lambda text: F.when(text.startswith("{"), F.struct(F.lit("{}").alias("body"), F.lit(2).cast("long").alias("dropped")))
    done = retention.apply_retention(df, RING, F.lit(NOW), gives_up)
    assert [tuple(r) for r in done.failed.collect()] == [("two", "cannot be reduced")]
    assert [r["subject"] for r in done.audit.collect()] == ["one"]
    none = retention.apply_retention(df.limit(0), RING, F.lit(NOW), gives_up)
    assert none.rows.count() == none.audit.count() == none.failed.count() == 0


def test_sweep_of_the_inbox(spark):
    df = spark.createDataFrame([("a", "original", NOW - timedelta(days=31), BODY), ("b", "original", NOW, BODY), ("c", "redacted", NOW - timedelta(days=31), "{}"), ("d", "original", NOW - timedelta(days=31), None), (None, None, None, None)], "delivery_id string, content string, received_at timestamp, raw string")
    done = retention.sweep_originals(df, F.lit(NOW - timedelta(days=30)), F.lit(NOW), protect.redact_payload())
    got = {r["delivery_id"]: r for r in done.rows.collect()}
    assert {k: (r["result"], r["content"], r["redacted_dropped"]) for k, r in got.items()} == {"a": ("redacted", "redacted", 1), "b": ("kept", "original", None), "c": ("kept", "redacted", None), "d": ("failed", "original", None), None: ("kept", None, None)}
    assert "x@y.ng" not in got["a"]["raw"] and got["a"]["redacted_at"] == NOW and got["b"]["raw"] == BODY
    assert [tuple(r) for r in done.failed.collect()] == [("d", "cannot be reduced")] and [r["subject"] for r in done.audit.collect()] == ["a"]
