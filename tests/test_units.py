"""Stated values for money, calendars, fees, cards and the inbox stream."""

import datetime as dt

from pyspark.sql import functions as F
from reconcord.functions import money, protect
from reconcord.operators import calendar, fees, ledger
from reconcord.streaming import inbox


def test_basis_points_round_half_up(spark):
    df = spark.createDataFrame([(333, 150, 5), (100, 150, 2), (0, 150, 0), (2**50, 150, (2**50 * 150 + 5000) // 10000)], "x long, bp int, want long")
    assert df.where(money.apply_bp(F.col("x"), F.col("bp")) != F.col("want")).count() == 0


def test_fee_quote_golden(spark):
    contract = "struct<contract_id:string,percent_bp:int,flat_kobo:int,waived_below_kobo:int,cap_kobo:int,vat_bp:int>"
    df = spark.createDataFrame([(g, ("c", 150, 10000, 250000, 200000, 750)) for g in (10000, 250000, 1000000, 100000000)], f"gross_kobo long, contract {contract}")
    got = [(r["fee_kobo"], r["vat_kobo"]) for r in fees.fee_quote(df).orderBy("gross_kobo").collect()]
    assert got == [(150, 11), (13750, 1031), (25000, 1875), (200000, 15000)]


def test_deadlines_golden(spark):
    dim = calendar.calendar_dim(spark, "2026-08-01", "2026-12-31", ["2026-10-01"])
    cases = [("2026-09-08 14:00:00", "2026-09-09 16:00:00"), ("2026-09-08 16:01:00", "2026-09-10 16:00:00"), ("2026-09-11 17:00:00", "2026-09-15 16:00:00"), ("2026-09-30 10:00:00", "2026-10-02 16:00:00")]
    df = spark.createDataFrame(cases, "at string, want string").withColumn("at", F.to_timestamp("at"))
    got = calendar.settlement_deadline(df, dim, "at", "Africa/Lagos", 1020, 1, 1440).select(F.date_format("due_at", "yyyy-MM-dd HH:mm:ss").alias("got"), "want")
    assert got.where("got <> want or got is null").count() == 0


def test_naira_text(spark):
    df = spark.createDataFrame([("1,234.5", 123450), ("-3.01", -301), ("7", 700), ("1.234", None), ("x", None), (None, None)], "t string, want long")
    assert df.where(~money.naira_to_kobo(F.col("t")).eqNullSafe(F.col("want"))).count() == 0


def test_cards(spark):
    df = spark.createDataFrame([("a 4111111111111111 b", 1), ("4111111111111112", 0), ("12 34", 0), ("4111111111111111 5500005555555559", 2)], "t string, want int")
    assert df.where(F.size(protect.card_runs(F.col("t"))) != F.col("want")).count() == 0
    assert spark.range(1).select(protect.mask(F.lit("4111111111111111")).alias("m")).first()["m"] == "411111******1111"


def test_bank_confirmation_refuses_a_remainder(spark):
    c = spark.createDataFrame([("x", 90), ("y", 90), ("z", -1)], "transaction_id string, credited_kobo long")
    d = spark.createDataFrame([("x", "fees_expense", 10), ("y", "fees_expense", 9), ("z", "fees_expense", 101)], "transaction_id string, account_id string, kobo long")
    p = spark.createDataFrame([("x", "p", 100), ("y", "p", 100), ("z", "p", 100)], "transaction_id string, promise_id string, kobo long")
    got = sorted(tuple(r) for r in ledger.book_bank_confirmed(c, d, p).collect())
    assert got == [("x", "bank_account", 90), ("x", "fees_expense", 10), ("x", "psp_receivable", -100)]


def test_stream_retries_and_dedupe(spark, tmp_path):
    src = str(tmp_path / "in")
    t0 = dt.datetime(2026, 1, 1)
    rows = [("a", False, t0), ("a", True, t0), ("b", False, t0), ("c", True, t0), ("c", True, t0)] + [("d", False, t0)] * 9
    spark.createDataFrame(rows, "delivery_id string, ok boolean, received_at timestamp").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("delivery_id string, ok boolean, received_at timestamp").parquet(src)
    q = inbox.retry_attempts(stream).writeStream.outputMode("update").format("memory").queryName("attempts").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["delivery_id"]: (r["attempts"], r["state"]) for r in spark.table("attempts").collect()}
    assert got == {"a": (2, "processed"), "b": (1, "pending"), "c": (1, "processed"), "d": (8, "failed")}
    q = inbox.inbox_dedupe(stream).writeStream.foreachBatch(inbox.idempotent_append(str(tmp_path / "out"), "delivery_id")).option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_keyed_hashes_equal_the_standard_library(spark):
    import base64
    import hmac

    for algorithm, encoding in (("sha512", "hex"), ("sha256", "base64")):
        keys = ("short", "k" * 200)
        rows = [(k, b, hmac.new(k.encode(), b, algorithm).digest()) for k in keys for b in (b"", "é".encode(), b"x" * 300)]
        sign = lambda d: d.hex() if encoding == "hex" else base64.b64encode(d).decode()
        made = [("psp", b, sign(d), True) for _, b, d in rows] + [("psp", b"y", sign(rows[0][2]), False), ("other", rows[0][1], sign(rows[0][2]), False), ("psp", None, "x", False), (None, b"", None, False)]
        df = spark.createDataFrame(made, "source string, body binary, signature string, want boolean")
        assert df.where(protect.verify_webhook({"psp": keys}, algorithm, encoding)("source", "body", "signature") != F.col("want")).count() == 0


def test_the_sender_signs_with_constants(spark):
    """A key byte costs nothing per row: no function of arrays is left in the plan."""
    import hashlib
    import hmac

    from reconcord.plans.queries import _hmac

    made = spark.range(3).select("id", _hmac(F.col("id").cast("string").cast("binary"), "key-1").alias("h"))
    assert "lambdafunction" not in made._jdf.queryExecution().toString()
    assert all(r["h"] == hmac.new(b"key-1", str(r["id"]).encode(), hashlib.sha512).hexdigest() for r in made.collect())


def test_editions_by_covered_day(spark):
    """The highest revision that covers a day, of equal ones the highest id."""
    e = spark.createDataFrame([("a", 1, "2026-01-01", "2026-12-31"), ("b", 2, "2026-03-01", "2026-03-31"), ("c", 2, "2026-03-15", "2026-03-20")], "calendar_id string, revision int, covers_from string, covers_to string")
    e = e.withColumn("covers_from", F.to_date("covers_from")).withColumn("covers_to", F.to_date("covers_to"))
    days = spark.createDataFrame([("2026-02-01",), ("2026-03-02",), ("2026-03-16",), ("2025-12-31",)], "d string").select(F.to_date("d").alias("day"))
    got = {str(r["day"]): r["calendar_id"] for r in calendar.edition_days(e, days).collect()}
    assert got == {"2026-02-01": "a", "2026-03-02": "b", "2026-03-16": "c", "2025-12-31": None}


def test_contracts_by_row_and_by_join_agree(spark):
    pay = spark.createDataFrame([(i, s, c, d) for i, (s, c, d) in enumerate([("x", "card", "2026-01-05"), ("x", None, "2026-01-05"), ("x", "card", "2026-02-01"), ("y", "card", "2026-01-05"), (None, "card", "2026-01-05")])], "k int, source string, channel string, d string").withColumn("at", F.to_timestamp("d"))
    made = [("c1", "x", "card", "2026-01-01", "2026-02-01"), ("c2", "x", "*", "2026-01-01", None), ("c0", "x", "card", "2026-01-05", None)]
    terms = [F.lit(1).alias(c) for c in ("percent_bp", "flat_kobo", "waived_below_kobo", "cap_kobo", "vat_bp")]
    con = spark.createDataFrame(made, "contract_id string, source string, channel string, f string, t string").select("contract_id", "source", "channel", F.to_timestamp("f").alias("effective_from"), F.to_timestamp("t").alias("effective_to"), *terms)
    want = {0: "c0", 1: "c2", 2: "c0", 3: None, 4: None}
    for few in (10, 0):
        assert {r["k"]: r["id"] for r in fees.contract_asof(pay, con, "k", "at", few).select("k", F.col("contract.contract_id").alias("id")).collect()} == want


def test_amounts_up_to_what_64_bits_hold(spark):
    texts = ["92233720368547758.07", "92233720368547758.08", "-92233720368547758.08", "1234567890123456.5", "0000000000000000000000012.30", "9" * 60, "1.234", "", None, "1e5"]
    got = [r["k"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(money.naira_to_kobo(F.col("t")).alias("k")).collect()]
    assert got == [2**63 - 1, None, -(2**63), 123456789012345650, 1230, None, None, None, None, None]
