"""Drift, changes of state, signed fields and near misses against plain versions."""

import base64
import hashlib
import hmac
import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from reconcord.functions import protect
from reconcord.operators import ledger, matching
from reconcord.sources import drift, statements


def test_json_types(spark):
    texts = {
        "[]": "array", " [1,2] ": "array", "{}": "object", '{"a":[1]}': "object", "null": "object", '"x"': "string", "true": "boolean", "-1.5e3": "number", "0": "number",
        "": None, "x": None, "[1,": None, '{"a":': None, '"x': None, "01": None,
    }
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = dict(df.select("t", drift.json_type(F.col("t"))).collect())
    assert got == texts | {None: None}


def files(spark, bodies):
    return spark.createDataFrame([(f"e{i}", b) for i, b in enumerate(bodies)], "evidence_id string, body string")


def test_drift_of_statements(spark):
    good = {"id": "a", "date": "2024-01-02", "amount": "5", "type": "credit"}
    rows = [good | {"amount": "x"}, good, good, good | {"id": "b", "type": "Credit"}, good | {"id": "c", "type": None, "memo": {"x": 1}}, {k: v for k, v in good.items() if k != "type"} | {"id": "d"}, good | {"id": "e", "date": "2/1/24"}, good | {"id": "f", "date": "3/4/24"}, 7, None]
    bodies = [json.dumps(rows), "[]", None, "{}", "[1", json.dumps([good])]
    got = {(r["evidence_id"], r["kind"], r["detail"]): (r["occurrences"], r["first_lineage"], r["sample"], r["rows_in_file"]) for r in drift.statement_drift(files(spark, bodies), "x").collect()}
    assert got == {
        ("e0", "malformed_rows", "bank-statement"): (3, "$[0]", "amount", 10), ("e0", "colliding_identity", "bank-statement"): (1, "$[2]", "bank:x:a", 10),
        ("e0", "unknown_value", "type=Credit"): (1, "$[3]", "Credit", 10), ("e0", "unknown_value", "type=null"): (1, "$[4]", "null", 10), ("e0", "unknown_value", "type=undefined"): (1, "$[5]", "undefined", 10),
        ("e0", "unknown_value", "date=9/9/99"): (2, "$[6]", "9/9/99", 10), ("e0", "unknown_field", "$[].memo"): (1, "$[4]", None, 10),
        ("e3", "unknown_shape", "expected a bare array, got object"): (1, None, None, 0), ("e4", "unknown_shape", "payload is not JSON"): (1, None, None, 0),
    }
    assert drift.statement_drift(files(spark, []), "x").count() == 0
    # any row claims its id by default, only a good one if asked for
    lines = lambda **how: {r["position"]: r["reject"] for r in statements.scan_bank_statement(files(spark, bodies[:1]), "x", **how).collect()}
    assert lines()[1] == "colliding identity" and lines(good_claims=True)[1] is None


def test_drift_of_payouts_and_lines(spark):
    record = {"id": "p", "gross_amount": "10", "net_amount": 9.5, "currency": "USD", "status": "completed", "fees": [{"type": "Levy", "amount": "0.5"}, {"type": "VAT", "amount": "1"}, {"type": "levy", "amount": "0"}, {"amount": 1}, "x"]}
    bodies = [json.dumps({"data": [record, record | {"status": "HELD"}, record | {"id": None}, record | {"fees": {}, "extra": 1}]}), json.dumps({"items": [], "n": 1}), "3", "nothing"]
    got = {(r["evidence_id"], r["kind"], r["detail"]): (r["occurrences"], r["first_lineage"], r["sample"]) for r in drift.payout_drift(files(spark, bodies)).collect()}
    assert got == {
        ("e0", "malformed_rows", "flutterwave-payouts"): (2, "$.data[1]", "status=HELD"), ("e0", "unknown_field", "$.data[].extra"): (1, "$.data[3]", None),
        ("e0", "unknown_value", "fees[].type=Levy"): (1, None, "Levy"), ("e0", "unknown_value", "fees[].type=unknown"): (1, None, "unknown"),
        ("e1", "unknown_shape", "no $.data array"): (1, None, "top-level keys: items, n"), ("e2", "unknown_shape", "no $.data array"): (1, None, "number"), ("e3", "unknown_shape", "payload is not JSON"): (1, None, None),
    }
    row = {"id": "a", "status": "PAID", "amount": "1", "amountCharged": "2", "walletCurrency": "NGN"}
    lines = drift.line_drift(files(spark, [json.dumps([row, row | {"status": "pending"}, row | {"status": "success", "amount": "3"}])]), "nomba")
    assert [(r["kind"], r["occurrences"], r["sample"]) for r in lines.collect()] == [("malformed_rows", 2, "status=PAID")]  # another source's word is none of its own


def test_transitions_equal_a_fold(spark):
    rnd = random.Random(4)
    arcs = set(ledger.ARCS)
    states = {f"t{i}": rnd.choice(["authorized", "authorized", "exception", "settled", "reversed"]) for i in range(60)}
    day = datetime(2024, 1, 1)
    asked = [(rnd.choice([*states, "gone"]), rnd.choice(["settled", "reversed", "exception", "authorized"]), day + timedelta(days=rnd.randint(0, 3)), rnd.choice([None, "a", "b"])) for _ in range(400)]
    want, now = [], dict(states)
    for t, to, at, by in sorted(set(asked), key=lambda r: (r[0], r[2], r[3] or "", r[1])):
        was = now.get(t)
        what = "unknown" if was is None else "unchanged" if was == to else "transitioned" if (was, to) in arcs else "refused"
        now[t] = to if what == "transitioned" else was
        want.append((t, was, to, at, by, what))
    s = spark.createDataFrame(list(states.items()), "transaction_id string, state string")
    r = spark.createDataFrame(asked + asked[:5], "transaction_id string, to_state string, at timestamp, caused_by string")
    assert sorted(map(str, map(tuple, ledger.apply_transitions(s, r).collect()))) == sorted(map(str, want))


def test_signed_fields(spark):
    body = {"event_type": "paid", "requestId": "r1", "data": {"merchant": {"userId": "u", "walletId": 7}, "transaction": {"transactionId": "T", "type": "x", "time": "t0", "transactionAmount": 5}}}
    text = b"paid:r1:u:7:T:x:t0::t1"
    sign = lambda key, what=text: base64.b64encode(hmac.new(key, what, hashlib.sha256).digest()).decode()
    rows = [
        (json.dumps(body), "t1", sign(b"new")), (json.dumps(body), "t1", sign(b"old")), (json.dumps(body), "t1", sign(b"other")), (json.dumps(body), "t2", sign(b"new")), (json.dumps(body), None, sign(b"new")),
        ("no json", "t1", sign(b"new")), (None, "t1", sign(b"new")), (json.dumps(body), "t1", None), (json.dumps(body | {"note": 1}), "t1", sign(b"new")),
    ]
    df = spark.createDataFrame(rows, "body string, sent string, signature string").coalesce(1)
    check = protect.verify_webhook({"n": ("new", "old")}, "sha256", "base64")
    got = [r[0] for r in df.select(check(F.lit("n"), protect.canonical_string(F.col("body"), F.col("sent")), "signature")).collect()]
    assert got == [True, True, False, False, False, False, False, False, True]


def test_near_misses(spark):
    day = lambda n: datetime(2024, 1, n)
    credits = spark.createDataFrame([("c1", 1000, day(5)), ("c2", 5000, day(5))], "idempotency_key string, amount_kobo long, value_date timestamp")
    inflows = [("a", 1000, day(9), False, False), ("b", 1010, None, True, True), ("c", 1020, day(1), False, False), ("d", 1500, day(1), False, False), ("e", 9000, None, False, False)]
    i = spark.createDataFrame(inflows, "inflow_key string, expected_net_kobo long, value_date timestamp, spent boolean, derived boolean")
    names = spark.createDataFrame([("c1", "c"), ("c1", "e"), ("c2", "d")], "idempotency_key string, inflow_key string")
    got = [tuple(r) for r in matching.near_misses(credits, i, names, 4, 15).orderBy("idempotency_key", "rank").collect()]
    assert got[:4] == [("c1", "a", "payout", 0, "outside_window", 1), ("c1", "b", "settlement_line", 10, "already_claimed", 2), ("c1", "c", "payout", 20, "ambiguous", 3), ("c1", "d", "payout", 500, "amount_differs", 4)]
    assert [(k, d, why) for _, k, _, d, why, _ in got[4:]] == [("d", -3500, "amount_differs"), ("c", -3980, "amount_differs"), ("b", -3990, "already_claimed"), ("a", -4000, "outside_window")]


def test_banked_inflows(spark):
    inflows = spark.createDataFrame([("a", "s", "x", None), ("b", "s", "y", None), ("c", "s", None, None), ("d", "s", "z", None)], "inflow_key string, source string, confirmed_by string, value_date timestamp")
    entries = spark.createDataFrame([("x", "bank_account", 5), ("x", "bank_account", 2), ("x", "psp_receivable", -7), ("y", "bank_account", 9), ("z", "fees_expense", 1)], "transaction_id string, account_id string, amount_kobo long")
    payouts = spark.createDataFrame([("a", "confirmed"), ("b", "returned")], "payout_reference string, status string")
    assert [tuple(r)[:4] for r in matching.banked_inflows(inflows, entries, payouts).collect()] == [("a", "s", "x", 7)]
