"""Payload scans, redaction, key rings and the stream of deadlines."""

import os
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reconcord.functions import protect
from reconcord.streaming.inbox import promise_states


def test_card_findings(spark):
    bodies = [
        '{"a":{"Card Number":null}}', '{"pin":1}', '{"c\\u0076v":1}', '{"n":4111111111111111}', '{"n":4111111111111111.0}', "4111-1111-1111-1111", "x 4111 1111 1111 1112", '{"spin":1}', None, "",
        '{"batch":"30000000000000004"}', '{"x":"4111111111111111","cvc":0}', '["6500 0000 0000 0002"]', "[" * 100_000 + '"cvv":',
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    got = {r["k"]: (r["kind"], r["at"], r["detail"]) for r in protect.card_findings(df, "k", "body").collect()}
    card = "411111******1111"
    assert got == {
        0: ("sad", "$.a.Card Number", "Card Number"), 1: ("sad", "$.pin", "pin"), 2: ("sad", "$.cvv", "cvv"), 3: ("pan", "$.n", card), 4: ("pan", "$.n", card), 5: ("pan", "body", card),
        11: ("pan", "$.x", card), 12: ("pan", "$[0]", "650000******0002"),
    }


def test_redact_payload(spark):
    df = spark.createDataFrame([('{"data":{"amount":5,"x":[{"y":1},null]}}',), ("3",), ("{}",), (None,), ("{",)], "body string")
    got = [tuple(r[0]) if r[0] else None for r in df.coalesce(1).select(protect.redact_payload()("body")).collect()]
    mark = lambda n: '{"redacted":"keep-list-1","dropped":%d' % n
    assert got[:3] == [('{"data":{"amount":5},"_redaction":' + mark(1) + "}}", 1), ('{"_redaction":' + mark(1) + '},"kept":null}', 1), ('{"_redaction":' + mark(0) + '},"kept":null}', 0)]
    assert not got[3] or got[3] == (None, None)
    assert got[4][0].startswith(mark(0)) and got[4][1] == 0


def test_key_ring(spark):
    ring = protect.KeyRing({"a": b"a" * 32}, "a")
    aad = protect.context(id=F.col("id"), kind=F.lit("x"))
    sealed = protect.seal_rows(spark.range(5), ring, F.col("id").cast("string"), aad)
    rows = spark.createDataFrame(sealed.collect(), sealed.schema)
    assert len({bytes(r["wrapped_key"]) for r in rows.collect()}) == 5
    plain = lambda df, ring, aad=aad: [r["plain"] and bytes(r["plain"]).decode() for r in protect.unseal_rows(df, ring, aad).orderBy("id").collect()]
    assert plain(rows, ring) == list("01234")
    assert plain(rows, protect.KeyRing({"b": b"b" * 32}, "b")) == [None] * 5
    assert plain(rows, protect.KeyRing({"a": b"b" * 32}, "a")) == [None] * 5
    assert plain(rows.withColumn("sealed", F.concat("sealed", F.lit(b"!"))), ring) == [None] * 5
    assert plain(rows, ring, protect.context(id=F.col("id") + 1, kind=F.lit("x"))) == [None] * 5
    both = protect.KeyRing({"a": b"a" * 32, "b": b"b" * 32}, "b")
    turned = spark.createDataFrame(protect.rotate_rows(rows, both, aad).collect(), sealed.schema)
    assert {r["key_id"] for r in turned.collect()} == {"b"}
    assert plain(turned, protect.KeyRing({"b": b"b" * 32}, "b")) == list("01234")
    for keys, active in (({"a": b"a" * 32}, "b"), ({"a": b"a"}, "a")):
        with pytest.raises(ValueError):
            protect.KeyRing(keys, active)


def test_promise_states(spark, tmp_path):
    day = lambda n: datetime(2024, 1, n)
    files = [
        [("a", day(1), day(3), False), ("b", day(1), day(3), False), ("e", day(1), None, True)],
        [("b", day(2), None, True), ("b", day(2), None, True), ("e", day(2), day(3), False)],
        [("c", day(10), day(20), False)],
        [("d", day(11), day(20), False)],
        [("a", day(11), None, True), ("f", day(11), day(6), False)],
    ]
    schema = "transaction_id string, received_at timestamp, escalates_at timestamp, settled boolean"
    source = str(tmp_path / "in")
    os.mkdir(source)
    for i, rows in enumerate(files):
        path = f"{source}/{i}.parquet"
        spark.createDataFrame(rows, schema).toPandas().to_parquet(path, coerce_timestamps="us", index=False)
        os.utime(path, (time.time() - 100 + i,) * 2)
    seen = []
    stream = promise_states(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    run = (
        stream.writeStream.foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect())).outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    assert run.awaitTermination(120)
    of = lambda key: [s for k, s in seen if k == key]
    assert of("a") == ["PENDING", "MISSING_SETTLEMENT", "SETTLED"]
    assert of("b") == ["PENDING", "SETTLED"] and of("e") == ["SETTLED"]
    assert of("c") == of("d") == ["PENDING"] and of("f") == ["MISSING_SETTLEMENT"]
